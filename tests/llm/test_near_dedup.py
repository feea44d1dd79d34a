import random

import numpy as np

from graphloom.llm import near_dedup as N
from graphloom.llm.components import components


def brute(docs, size=2):
    ids = [d[0] for d in docs]
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    parent = {i: i for i in ids if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            if None in (ids[a], ids[b]):
                continue
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return sorted([(i, len(s), None if i is None else find(i)) for (i, _), s in zip(docs, sets, strict=True)], key=str)


def run(spark, docs, size=2):
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_shingles int").repartition(3)
    rows = N.link_documents(df, words=size).collect()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in rows)
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows], key=str)


def edited(text, draw, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        k = draw.randrange(len(w))
        w[k] = f"edit{draw.randint(0, 10**6)}"
    return " ".join(w)


def test_groups_chains_and_copies(spark, prose):
    draw = random.Random(3)
    docs, k = [], 0
    for g in range(12):
        base = prose(g, draw.randint(8, 150))
        for _ in range(draw.randint(1, 14)):
            docs.append((k, edited(base, draw, draw.choice([0, 0, 0.01, 0.04, 0.08, 0.12]))))
            k += 1
    chain = prose(99, 120)  # every link near, ends far
    for _ in range(10):
        docs.append((k, chain))
        chain = edited(chain, draw, 0.05)
        k += 1
    draw.shuffle(docs)
    for size in (N.QUERY_WORDS, N.SHINGLE_WORDS):
        assert run(spark, docs, size) == brute(docs, size)


def test_large_group_of_near_copies_keeps_every_link(spark, prose):
    draw = random.Random(8)
    base = prose(1, 100)
    docs = [(k, edited(base, draw, draw.choice([0.01, 0.03, 0.06, 0.1, 0.14]))) for k in range(250)]
    assert run(spark, docs) == brute(docs)


def test_edges(spark, prose):
    long = " ".join(prose(5, 3000).split() * 10)
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "Two\x0bwords"), (8, "É a"), (9, "é a"), (None, "two words"), (10, long), (11, long + " end")]
    assert run(spark, docs) == brute(docs)
    assert run(spark, docs, 5) == brute(docs, 5)
    assert run(spark, []) == []
    twice = run(spark, [(1, "a b c"), (1, "a b c"), (0, "a b c")])
    assert twice == [(0, 2, 0), (1, 2, 0), (1, 2, 0)]


def test_index_guarantee():
    """Signatures that differ in at most 2 * CHUNKS - 1 positions share a key."""
    draw = np.random.default_rng(1)
    for _ in range(200):
        a = draw.integers(0, 1 << 16, N.POSITIONS).astype(np.uint16)
        b = a.copy()
        for k in draw.choice(N.POSITIONS, 2 * N.CHUNKS - 1, replace=False):
            b[k] ^= draw.integers(1, 1 << 16)
        x, y = N.bucket_keys(np.stack([a, b]))
        assert set(x) & set(y)


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randint(0, 120), draw.randint(0, 120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(None, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        if a is not None and a != b:
            ca, cb = want.setdefault(a, {a}), want.setdefault(b, {b})
            if ca is not cb:
                ca |= cb
                for n in cb:
                    want[n] = ca
    assert got == {n: min(c) for n, c in want.items()}
