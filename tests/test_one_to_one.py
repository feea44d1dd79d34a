"""The greedy choice loses nothing in long tied groups and chains."""

import random

import pytest

from graphloom.operators import matching as M

SCHEMA = "source string, target string, confidence double"


def plain(pairs):
    used, taken, out = set(), set(), []
    for s, t, c in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if s not in used and t not in taken:
            used.add(s)
            taken.add(t)
            out.append((s, t, c))
    return sorted(out)


def test_chain_longer_than_a_thousand(spark):
    pairs = [(f"s{k:05}", f"t{k + d:05}", 1 - (2 * k + d) / 10_000) for k in range(1100) for d in (0, 1)]
    pairs = [(t, s, c) for s, t, c in pairs]
    assert sorted(map(tuple, M.one_to_one(spark.createDataFrame(pairs, SCHEMA)).collect())) == plain(pairs)


@pytest.mark.parametrize("sources, targets", [(12, 12), (9, 14)])
def test_a_tied_block_takes_one_round(spark, sources, targets):
    pairs = [(f"s{a:02}", f"t{b:02}", 0.9) for a in range(sources) for b in range(targets)]
    assert M._best_pairs(spark.createDataFrame(pairs, SCHEMA)).count() == min(sources, targets)


def test_rounds_on_the_executors(spark):
    draw = random.Random(8)
    for _ in range(3):
        pairs = list({(s, t): (s, t, draw.choice([0.8, 0.8, 0.9])) for s, t in ((f"s{draw.randint(0, 5)}", f"t{draw.randint(0, 5)}") for _ in range(30))}.values())
        assert sorted(map(tuple, M.one_to_one(spark.createDataFrame(pairs, SCHEMA), driver_candidates=0).collect())) == plain(pairs)
