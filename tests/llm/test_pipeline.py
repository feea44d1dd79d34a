"""Each stage against a plain version of itself, and the pipeline as a whole."""

import random

import corpus_pipeline as P
from graphloom.llm import decontaminate, quality
from test_line_dedup import brute as line_brute


def write(spark, path, rows, labels, bench, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def corpus(prose):
    rows, labels = [], []
    for k in range(60):
        t = prose(k, 70 + k)
        rows.append((k, t, "en", f"s{k % 3}", len(t)))
        labels.append((k, 1, 0))
    for k in range(100, 120):
        t = " ".join(x + "$$$" for x in prose(k, 80).split())
        rows.append((k, t, "en", "s0", len(t)))
        labels.append((k, 0, 1))
    near = rows[5][1] + " tail"
    rows.append((200, near, "en", "s1", len(near)))
    leak = rows[7][1].replace("\n", " \n ")
    bench = [(1, prose(900, 14)), (2, None)]
    t = prose(901, 60, line=100) + " " + bench[0][1] + " " + prose(902, 20, line=100)
    rows.append((201, t, "en", "s2", len(t)))
    passage = prose(903, 48)
    for k in (202, 203):
        t = prose(k, 60) + "\n" + passage + "\n" + prose(k + 50, 60)
        rows.append((k, t, "en", "s2", len(t)))
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), (5, rows[5][1], "en", "s2", rows[5][4])]
    assert leak
    return rows, labels, bench


def near_brute(rows, words=5):
    """Ids that stay: the least of each group of texts whose sets of five-word shingles are similar."""
    sets = {}
    for i, text, *_ in rows:
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return {i for i, g in group.items() if i == g}


def test_near_dedup_finds_what_brute_force_finds(spark, docs_schema):
    """Copies with one to six words changed, so that similarities lie on both sides of the threshold."""
    draw = random.Random(77)
    rows = []
    for g in range(60):
        w = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(40, 160))]
        for k in range(4):
            v = list(w)
            for _ in range(draw.randint(0, 6) * (k > 0)):
                v[draw.randrange(len(v))] = f"x{draw.randint(0, 10_000)}"
            rows.append((g * 10 + k, " ".join(v), "en", "s", 1))
    docs = spark.createDataFrame(rows, docs_schema)
    got = {r["doc_id"] for r in dict(P.STAGES)["near_dedup"](spark, docs, "").collect()}
    want = near_brute(rows)
    assert want <= got and len(got - want) <= 0.01 * (len(rows) - len(want))  # recall of removals 0.99 or more


def test_stages_on_their_own_input(spark, prose, docs_schema, tmp_path):
    rows, labels, bench = corpus(prose)
    sf = write(spark, str(tmp_path), rows, labels, bench, docs_schema)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        got = [tuple(r) for r in out.collect()]
        before = [tuple(r) for r in docs.collect()]
        ids = sorted(r[0] for r in got)
        if name == "quality_rules":
            model = quality.train_field([(r[1], q) for r in sorted({r[0]: r for r in rows}.values()) for i, q, _ in labels if i == r[0]])
            want = [r for r in before if (c := quality.base_counts(r[1]))[0] >= 50 and 2 * c[4] <= c[0] and quality.content_share(r[1], model) >= 0.5]
            assert sorted(got) == sorted(want) and not set(range(100, 120)) & set(ids)
        elif name == "line_dedup":
            assert sum(prose(903, 48) in r[1] for r in got) == 1
            once = {r[0]: r for r in before}  # rows that repeat count as one document
            cut = {i: (t, n) for i, t, _, n in line_brute([(i, r[1]) for i, r in once.items()])}
            want = [(r[0], cut[r[0]][0]) for r in before if not cut[r[0]][1] or cut[r[0]][0].strip()]
            assert sorted((r[0], r[1]) for r in got) == sorted(want)
            # the repeated row 5 counts as one document; the near copy 200 loses what it shares
            assert all(r[4] == len(r[1]) for r in got)
        elif name == "near_dedup":
            assert ids.count(5) == len([r for r in before if r[0] == 5])
            assert sorted(got) == sorted(r for r in before if r[0] in near_brute(before))
            assert len(set(ids)) == len({r[1] for r in got})
        elif name == "decontamination":
            items = [w for i, t in bench for w in decontaminate.item_windows(t)]
            clean = lambda t: all(w not in b" ".join(decontaminate.normal_words(t)) for w in items)  # noqa: B023, E731
            assert sorted(got) == sorted(r for r in before if clean(r[1])) and 201 not in ids
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
            path = str(tmp_path / f"stage{k}")
            spark.createDataFrame(got, docs.schema).write.parquet(path)
            docs = spark.read.parquet(path)
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}


def test_edges_of_every_stage(spark, prose, docs_schema, tmp_path):
    """Null and blank texts, null ids and sources, repeated rows, a long text, and columns with results' names."""
    a, b = prose(1, 120), prose(2, 30_000)
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n", "en", None, 2), (None, a, "en", "s", 1), (4, a, "en", "s", 1), (4, a, "en", "s", 1), (5, b, "en", "s", 1)]
    schema = docs_schema + ", kept string, n_hit string, N_Lines string, gone string, spans int"
    sf = write(spark, str(tmp_path), [], [], [], docs_schema)
    docs = spark.createDataFrame([(*r, "k", "h", "l", "g", 7) for r in odd], schema)
    want = {"quality_rules": [None, 4, 4, 5], "near_dedup": [None, 1, 2, 3, 4, 4, 5], "decontamination": [None, 1, 2, 3, 4, 4, 5]}
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(tuple(r)[5:] == ("k", "h", "l", "g", 7) for r in rows), name
        ids = sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x))
        if name == "line_dedup":  # the null id comes first, so the rows of 4 lose their text
            assert ids == [None, 1, 2, 3, 5] and {r["doc_id"]: r["text"] for r in rows}[None] == a
        else:
            assert ids == want[name], name
        assert stage(spark, docs.limit(0), sf).count() == 0
    drawn = P.STAGES[4][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in drawn if r["n_tokens"]} <= {None, 4, 5}


def test_run_and_empty(spark, prose, docs_schema, tmp_path):
    rows, labels, bench = corpus(prose)
    sf = write(spark, str(tmp_path / "full"), rows, labels, bench, docs_schema)
    out = P.run(spark, sf).collect()
    assert out and {r["source"] for r in out} == {"s0", "s1", "s2"}
    none = write(spark, str(tmp_path / "none"), [], [], [], docs_schema)
    assert P.run(spark, none).count() == 0


def test_query_names():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
    assert random.Random(1)
