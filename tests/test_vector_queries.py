"""The registered searches over every hundredth row ask as many queries as the table has such rows."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("mode", ["cosine", "poincare", "product"])
def test_queries_grow_with_the_table(spark, mode):
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").count()
    found = catalog.QUERIES[f"vec_{mode}_topk_hundredth"](spark, SF).groupBy("query").agg(F.count("*").alias("n")).collect()
    assert asked > 3 and len(found) == asked and {r["n"] for r in found} == {10}
