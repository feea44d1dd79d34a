"""The lists of all parts hold each part once."""

import os

import pytest

from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_lists_hold_all_parts(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet")
    found = [r["p"] for r in catalog.QUERIES["sparql_list_members_all"](spark, SF).collect()]
    assert len(set(found)) == len(found) == parts.count()
    assert parts.groupBy("p_brand").count().where("count > 6").count() > 0


def test_closure_on_the_executors(spark):
    import random

    from graphloom.plans.closure import close_pairs, closure

    draw = random.Random(3)
    for edges in ([(str(k), str(k + 1)) for k in range(37)], [(str(draw.randint(0, 25)), str(draw.randint(0, 25))) for _ in range(30)], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]):
        found = closure(spark.createDataFrame(edges, "s string, o string"), driver_edges=0)
        assert sorted(map(tuple, found.collect())) == sorted(close_pairs(edges, 10_000))
