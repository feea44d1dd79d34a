"""Shuffles of terms have more parts the more is read, so that the memory of one task does not grow with the input."""

import os
import re

import pytest

from graphloom import session
from graphloom.plans import catalog, sparql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def parts(df):
    return {int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}


def plain(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ["reason_subproperty", "reason_domain_range"])
def test_reasoning(spark, monkeypatch, name):
    small = catalog.QUERIES[name](spark, SF)
    assert max(parts(small)) <= 4
    monkeypatch.setattr(session, "PART_BYTES", 1_000)
    large = catalog.QUERIES[name](spark, SF)
    read = os.path.getsize(f"{SF}/orders.parquet")
    assert max(parts(large)) >= read // 1_000 and plain(large) == plain(small)


def test_each_table_counts_once(spark):
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    once = session.read_bytes(nation)
    assert once == os.path.getsize(f"{SF}/nation.parquet") == session.read_bytes(nation.union(nation), nation)
    assert session.read_bytes(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int")) == 0


@pytest.mark.parametrize("name", ["sparql_exists_correlated", "sparql_optional", "sparql_minus", "sparql_subselect"])
def test_joins(spark, monkeypatch, name):
    """Customers, broadcast as one whole to each task, grew with the input."""
    small = catalog.QUERIES[name](spark, SF)
    monkeypatch.setattr(session, "PART_BYTES", 1_000)
    monkeypatch.setattr(sparql, "PART_BYTES", 1_000)
    large = catalog.QUERIES[name](spark, SF)
    text = large._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text and max(parts(large)) > 20 and plain(large) == plain(small)
