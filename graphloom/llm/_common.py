"""Helpers the corpus operators share: tables, shared-folder intermediates and text expressions."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import discard, materialize, shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["append_arrow", "discard", "lower_ascii", "materialize", "new_path", "parallelism", "sampled_texts", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/graphloom-{tag}-{uuid.uuid4().hex}"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def append_arrow(docs: DataFrame, run, fields: str) -> DataFrame:
    """docs plus the columns of fields, which run(batch) returns as Arrow arrays; like-named input columns give way."""
    import pyarrow as pa
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(fields)
    taken = {f.name.lower() for f in added}
    kept = [f for f in docs.schema if f.name.lower() not in taken]
    names = [f.name for f in kept]
    new = [f.name for f in added]

    def each(batches):
        for batch in batches:
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, *run(batch)], names=[*names, *new])

    return docs.mapInArrow(each, StructType([*kept, *added]))


def sampled_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> list:
    """Rows (id, ..., text) of a bounded table ids (id, ...), by id; of an id's several texts the smallest, so the bound holds."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    rows = texts.groupBy(*ids.columns).agg(F.min("text").alias("text")).collect()
    return sorted(rows, key=lambda r: tuple(r[c] for c in ids.columns))
