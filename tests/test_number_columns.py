"""The steps of a number are computed once for each row, by as many tasks as the bytes read ask for."""

import os

import pytest

from graphloom import session
from graphloom.plans import catalog
from graphloom.plans.views import PREFIXES, graph_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_names_the_literal_a_few_times(spark):
    """The whole plan was 93,828 characters long, as each use of ?s read the literal again."""
    assert len(text(catalog.QUERIES["sparql_number_functions"](spark, SF))) < 30_000
    q = "SELECT ?p (ABS(?s - 25) + ROUND(?s / 4.0) * 2 AS ?a) WHERE { ?p ex:size ?s BIND(?s * 2 AS ?d) FILTER(?d > 10) }"
    got = {r["p"]: r["a"] for r in graph_of(spark, SF, "part").query(q, PREFIXES).collect()}
    for r in spark.read.parquet(f"{SF}/part.parquet").where("p_size > 5").collect():
        assert float(got.pop(f"<http://example.org/part/{r['p_partkey']}>").split('"')[1]) == abs(r["p_size"] - 25) + int(r["p_size"] / 4 + 0.5) * 2
    assert not got


def test_one_file_is_many_tasks(spark, monkeypatch):
    small = sorted(map(tuple, catalog.QUERIES["sparql_number_functions"](spark, SF).collect()))
    monkeypatch.setattr(session, "PART_BYTES", 2_000)
    large = catalog.QUERIES["sparql_number_functions"](spark, SF)
    assert "REPARTITION_BY_NUM" in text(large) and sorted(map(tuple, large.collect())) == small
