import random

from pyspark.sql import functions as F

from graphloom.llm import decontaminate as D


def brute(text, items, n=10):
    w = D.normal_words(text)
    hit, met = set(), set()
    for i, t in items:
        if i is None:
            continue
        for p in D.item_windows(t, n):
            p = p.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    met.add(i)
    return len(w), len(hit), sorted(met)


def test_normal_words():
    assert D.normal_words("A-b é C_9\x85d\n\x7f!") == ["a".encode(), b"b", "é c".encode(), "9\x85d".encode()]
    assert D.normal_words(None) == [] and D.normal_words(" .. ") == []


def test_against_brute_force(spark):
    draw = random.Random(11)
    vocab = ["a", "b", "c", "é", "D"]
    items = [(k, " ".join(draw.choices(vocab, k=draw.choice([0, 1, 2, 9, 10, 11, 14])))) for k in range(40)] + [(99, None), (None, "a b"), (7, "b b b b b b b b b b b")]
    texts = [draw.choice([" ", ", ", "--"]).join(draw.choices(vocab, k=draw.randint(0, 60))) for _ in range(150)] + [None, "", "?!", " ".join(["a"] * 5000), "zz " * 300_000 + "a b c D"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_hit string").withColumns({c: F.lit("own") for c in ("items", "runs", "spans", "window", "__text")})
    before = None
    for block in (D.BLOCK_CHARS, 3000):  # one automaton, and several passes
        got = {r["doc_id"]: r for r in D.scan_texts(docs, bench, window_words=4, block_chars=block).collect()}
        for k, t in enumerate(texts):
            assert (got[k]["n_words"], got[k]["n_hit"], list(got[k]["items"])) == brute(t, items, 4), (block, t)
        spans = [[(s["start"], s["end"]) for s in got[k]["spans"]] for k in range(len(texts))]
        before = before or spans
        assert spans == before and any(spans)


def test_offsets_and_edges(spark):
    q = "What is the Tall, tall tree of the old north marsh called today?"
    text = "Intro é. what IS the tall tall tree -- of the old north marsh called TODAY! tail"
    docs = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, q)], "item_id long, text string")
    rows = D.scan_texts(docs, bench).collect()
    spans = [[text[s["start"] : s["end"]] for s in r["spans"]] for r in rows if r["doc_id"] == 1]
    assert spans == [["what IS the tall tall tree -- of the old north marsh called TODAY"]] * 2
    assert D.scan_texts(docs.limit(0), bench).count() == 0
    assert all(r["n_hit"] == 0 for r in D.scan_texts(docs, bench.limit(0)).collect())
