import random

import numpy as np

from graphloom.llm import quality as Q


def brute_counts(text):
    text = text or ""
    blank = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in blank:
            words += [word] if word else []
            word = ""
        else:
            word += c
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    dup, seen = 0, []
    for line in text.split("\n"):
        if any(c not in blank for c in line):
            dup += line in seen
            seen.append(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts_against_brute_force():
    draw = random.Random(1)
    for _ in range(200):
        text = "".join(draw.choice(["a", "b", " ", " ", "\n", "é", "#", "|", "\t", "\xa0", " ", "𝒳"]) for _ in range(draw.randint(0, 120)))
        assert Q.base_counts(text) == brute_counts(text), text
    assert Q.base_counts(None) == (0, 0, 0, 0, 0)


def test_viterbi_is_the_best_sequence():
    draw = np.random.default_rng(2)
    for n in (1, 2, 5, 9):
        e, t = draw.normal(size=(n, 2)), draw.normal(size=(2, 2))
        score = lambda y: e[range(n), y].sum() + t[y[:-1], y[1:]].sum()  # noqa: B023, E731
        best = max(score(np.array([(k >> j) & 1 for j in range(n)])) for k in range(2**n))
        assert np.isclose(score(Q.viterbi(e, t)), best)


def test_gradient_matches_differences():
    draw = np.random.default_rng(3)
    x, y = draw.normal(size=(3, 6, len(Q.FEATURES))), draw.integers(0, 2, (3, 6))
    w, t = draw.normal(size=(2, len(Q.FEATURES))), draw.normal(size=(2, 2))
    _, gw, gt = Q.chain_gradient(x, y, w, t)
    for v, g in ((w, gw), (t, gt)):
        k = (1, 1)
        v[k] += 1e-5
        up = Q.chain_gradient(x, y, w, t)[0]
        v[k] -= 2e-5
        down = Q.chain_gradient(x, y, w, t)[0]
        v[k] += 1e-5
        assert np.isclose((up - down) / 2e-5, g[k], atol=1e-4)


def junk(text, kind):
    w = text.split()
    if kind == 0:
        return " ".join(x + "###" for x in w)
    return " | ".join(w) if kind == 1 else " ".join(x.upper() + "!!" for x in w)


def corpus(prose):
    good = [prose(k, 80 + k % 60) for k in range(120)]
    bad = [junk(prose(k + 500, 90), k % 3) for k in range(60)]
    return good, bad


def test_held_out_accuracy_and_edges(spark, prose, docs_schema):
    good, bad = corpus(prose)
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(k, int(k < 120), 0) for k in range(180) if k % 2], "doc_id long, quality int, toxic int")
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "x " * 60, "en", "s", 1), (903, prose(77, 20_000), "en", "s", 1), (904, prose(78, 300_000), "en", "s", 1)]
    got = {r["doc_id"]: r for r in Q.judge_quality(spark.createDataFrame(rows, docs_schema), labels).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["kept"] for k in range(0, 120, 2)) and not any(got[k]["kept"] for k in range(120, 180, 2))
    assert [got[k]["kept"] for k in (900, 901, 902, 903, 904)] == [False, False, False, True, True]
    assert got[902]["base_failed"] and got[902]["n_repeat_words"] == 60


def test_lines_of_spliced_documents_held_out(spark, prose):
    """Line labels of documents that hold both kinds; none of their lines was in training."""
    good, bad = corpus(prose)
    model = Q.train_field([(t, 1) for t in good[:60]] + [(t, 0) for t in bad[:30]])
    draw, said, true = np.random.default_rng(5), [], []
    for g, b in zip(good[60:90], bad[30:], strict=True):
        lines, junk_lines = g.split("\n"), [x for x in (b[k : k + 90] for k in range(0, len(b), 90)) if x.strip()][:4]
        at = int(draw.integers(0, len(lines) + 1))
        text = "\n".join(lines[:at] + junk_lines + lines[at:])
        x, _ = Q.line_features(text)
        said += Q.viterbi(x @ model[0].T, model[1]).tolist()
        true += [1] * at + [0] * len(junk_lines) + [1] * (len(lines) - at)
    said, true = np.array(said) == Q.BOILERPLATE, np.array(true) == Q.BOILERPLATE
    precision, recall = (said & true).sum() / said.sum(), (said & true).sum() / true.sum()
    assert precision >= 0.9 and recall >= 0.9, (precision, recall)


def test_splices_hold_both_labels():
    lines = [(["a", "b"], [1, 1]), (["x"], [0]), (["c", "d"], [1, 1]), (["y"], [0]), (["e"], [1])]
    assert Q.spliced(lines)[0] == (["a", "b", "x"], [1, 1, 0])
    assert [sorted(set(y)) for _, y in Q.spliced(lines)] == [[0, 1]] * 2 and sorted(x for xs, _ in Q.spliced(lines) for x in xs) == ["a", "b", "c", "d", "x", "y"]


def test_without_labels_and_empty(spark, prose, docs_schema):
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, prose(1, 80), "en", "s", 1), (1, prose(1, 80), "en", "s", 1), (2, "short", None, None, None)], docs_schema)
    assert sorted((r["doc_id"], r["kept"]) for r in Q.judge_quality(docs.withColumn("kept", docs.doc_id), none).collect()) == [(1, True), (1, True), (2, False)]
    assert Q.judge_quality(docs.limit(0), none).count() == 0
