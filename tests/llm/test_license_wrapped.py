"""Notices wrapped over lines, against a plain version by runs of words."""

import math
import random
import textwrap

from graphloom.llm import license_scan as L


def words_of(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def plain(text):
    w, found, best = words_of(text), set(), 0.0
    for label, t in L.TEMPLATES:
        s, n = set(t.split()), math.ceil(round(len(t.split()) / L.THRESHOLD, 9))
        most = max((len(set(w[k : k + n]) & s) for k in range(len(w))), default=0)
        if most * 10 >= 8 * len(s):
            found.add(label)
            best = max(best, most / len(s))
    return found, best


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in L.scan_licenses(df).collect()}


def test_published_notices(spark):
    texts = [("x\n\n" + "\n".join(f"{lead}{line}" for line in textwrap.wrap(t, 60)) + "\n\ny") for _, t in L.TEMPLATES for lead in (" * ", "# ")]
    labels = [label for label, _ in L.TEMPLATES for _ in range(2)]
    got = scan(spark, texts)
    for k, label in enumerate(labels):
        assert label in got[k]["labels"].split(",") and got[k]["score"] == 1.0


def test_runs_against_plain_version(spark):
    draw = random.Random(12)
    vocab = sorted({w for _, t in L.TEMPLATES for w in t.split()}) + ["amber", "basin", "cedar"]
    texts = [""]
    for _ in range(120):
        w = draw.choices(vocab, k=draw.randint(0, 30))
        for _ in range(draw.randint(1, 3)):
            w += [x for x in draw.choice(L.TEMPLATES)[1].split() if draw.random() > draw.choice([0, 0.1, 0.2])] + draw.choices(vocab, k=draw.randint(0, 9))
        texts.append("\n".join(textwrap.wrap(" ".join(w), draw.choice([20, 45, 70]))))
    got = scan(spark, texts)
    for k, t in enumerate(texts):
        found, best = plain(t)
        base = set(filter(None, got[k]["base_labels"].split(",")))
        assert set(filter(None, got[k]["labels"].split(","))) == found | base
        assert abs(got[k]["score"] - max(best, 1.0 if base else 0.0)) < 1e-9
