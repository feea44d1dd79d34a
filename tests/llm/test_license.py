import random

from pyspark.sql import functions as F

from graphloom.llm import license_scan as L


def words_of(text):
    out, w = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            out += [w] if w else []
            w = ""
        else:
            w += c
    return out


def brute(i, text):
    w = words_of(text)
    hits, labels = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        for k in range(len(w)):
            if w[k : k + len(p)] == p:
                hits.append(k)
                labels.add(label)
    found, best = set(), 0.0
    for label, t in L.TEMPLATES:
        s, n = set(t.split()), -(-len(t.split()) * 10 // 8)
        most = max((len(set(w[k : k + n]) & s) for k in range(len(w))), default=0)
        if most * 10 >= 8 * len(s):
            found.add(label)
            best = max(best, most / len(s))
    return (i, len(w), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found)), round(max(best, 1.0 if hits else 0.0), 9))


def test_against_brute_force(spark):
    draw = random.Random(9)
    texts = [None, "", "MIT license", "mİT license", "gnu  General-Public\nLicense mit license mit license", "x" * 50_000 + " cc by", "K license apache licenſe"]
    vocab = sorted({w for _, t in L.TEMPLATES for w in t.split()}) + ["é", "worK", "und"]
    for _ in range(120):
        lines = [" ".join(draw.choices(vocab, k=draw.choice([0, 5, 700])))]
        for _ in range(draw.randint(1, 6)):
            t = draw.choice(L.TEMPLATES)[1].split()
            t = [x for x in t if draw.random() > draw.choice([0, 0.1, 0.2, 0.3])] + draw.choices(vocab, k=draw.randint(0, 4))
            draw.shuffle(t)
            lines.append(draw.choice([" ", "-", ", "]).join(x.title() if draw.random() < 0.2 else x for x in t))
        texts.append("\n".join(lines))
    texts += [texts[-1] + " " + "filler words " * 40_000 + texts[-2]]  # a very long one
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(0, None, "x")], "doc_id long, text string, labels string")
    df = df.withColumns({c: F.lit("own") for c in ("hits", "tiles", "block", "word", "template", "n_words", "base", "found")})  # clashing names
    got = sorted([(*r[:7], round(r["score"], 9)) for r in L.scan_licenses(df).collect()], key=str)
    assert got == sorted([brute(k, t) for k, t in enumerate(texts)] + [brute(0, None)], key=str)


def test_empty_and_no_templates(spark):
    df = spark.createDataFrame([(1, "mit license"), (2, None)], "doc_id long, text string")
    assert L.scan_licenses(df.limit(0)).count() == 0
    assert sorted((r["doc_id"], r["labels"]) for r in L.scan_licenses(df, templates=[]).collect()) == [(1, "mit"), (2, "")]
