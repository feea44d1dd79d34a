"""Graph views of the relational tables that the contract queries run on, as narrow native mappings."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.session import local_frame

EX = "http://example.org/"
PREFIXES = {"ex": EX}


def ex(name: str) -> str:
    return f"<{EX}{name}>"


def node(kind: str, key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"<{EX}{kind}/"), key.cast("string"), F.lit(">"))


def money(c: str) -> Column:
    return T.number_literal(F.col(c).cast("decimal(18,2)"), T.DECIMAL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emit(df: DataFrame, subject: Column, pairs: list[tuple[str, Column]]) -> DataFrame:
    """Triples of every row: (predicate, object column) pairs; null objects give none.

    One narrow branch for each predicate: a pattern with a constant predicate prunes the other branches at planning, and
    its scan reads the columns of that predicate alone.
    """
    parts = [df.select(subject.alias("s"), F.lit(p).alias("p"), o.alias("o")) for p, o in pairs]
    return functools.reduce(DataFrame.unionByName, parts).where(F.col("o").isNotNull())


def _customer(df):
    return emit(df, node("customer", "c_custkey"), [(T.TYPE, F.lit(ex("Customer"))), (ex("nation"), node("nation", "c_nationkey")), (ex("segment"), T.plain_literal(F.col("c_mktsegment"))), (ex("name"), T.plain_literal(F.col("c_name"))), (ex("acctbal"), money("c_acctbal"))])


def _supplier(df):
    return emit(df, node("supplier", "s_suppkey"), [(T.TYPE, F.lit(ex("Supplier"))), (ex("nation"), node("nation", "s_nationkey")), (ex("name"), T.plain_literal(F.col("s_name"))), (ex("acctbal"), money("s_acctbal"))])


def _nation(df):
    return emit(df, node("nation", "n_nationkey"), [(T.TYPE, F.lit(ex("Nation"))), (ex("region"), node("region", "n_regionkey")), (T.LABEL, T.plain_literal(F.col("n_name")))])


def _region(df):
    return emit(df, node("region", "r_regionkey"), [(T.TYPE, F.lit(ex("Region"))), (T.LABEL, T.plain_literal(F.col("r_name")))])


def _orders(df):
    day = T.number_literal(F.date_format("o_orderdate", "yyyy-MM-dd"), T.DATE)
    return emit(df, node("order", "o_orderkey"), [(T.TYPE, F.lit(ex("Order"))), (ex("placedBy"), node("customer", "o_custkey")), (ex("total"), money("o_totalprice")), (ex("date"), day), (ex("status"), T.plain_literal(F.col("o_orderstatus"))), (ex("priority"), T.plain_literal(F.col("o_orderpriority")))])


def _part(df):
    return emit(df, node("part", "p_partkey"), [(T.TYPE, F.lit(ex("Part"))), (T.LABEL, T.plain_literal(F.col("p_name"))), (ex("brand"), T.plain_literal(F.col("p_brand"))), (ex("size"), T.number_literal(F.col("p_size"), T.INTEGER)), (ex("price"), money("p_retailprice"))])


def _events(df):
    return emit(df, node("event", "event_id"), [(T.TYPE, F.lit(ex("Event"))), (ex("kind"), T.plain_literal(F.col("event_type"))), (ex("user"), node("user", "user_id")), (ex("value"), T.number_literal(F.col("value").cast("decimal(18,2)"), T.DECIMAL))])


def _conversations(df):
    turn = F.concat(F.lit(f"<{EX}turn/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(">"))
    nxt = F.concat(F.lit(f"<{EX}turn/"), F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") + 1).cast("string"), F.lit(">"))
    last = df.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return emit(df.select("conv_id", "turn").join(last, "conv_id"), turn, [(ex("next"), F.when(F.col("turn") < F.col("last"), nxt))])


_VIEWS = {"customer": _customer, "supplier": _supplier, "nation": _nation, "region": _region, "orders": _orders, "part": _part, "events": _events, "conversations": _conversations}


def graph_of(spark: SparkSession, sf_dir: str, *names: str) -> Graph:
    """The graph of the named tables. Their keys make the triples distinct already."""
    parts = [_VIEWS[n](table(spark, sf_dir, n)) for n in names]
    return Graph(functools.reduce(DataFrame.unionByName, parts).withColumn("g", F.lit(None).cast("string")))


def part_classes(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts typed by type/brand classes, which are under their type, which is under Part; labels on all classes but brands'."""
    df = table(spark, sf_dir, "part")
    kind = F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))
    brand = F.replace(F.col("p_brand"), F.lit(" "), F.lit("_"))
    leaf, up = node("class", F.concat(kind, F.lit("/"), brand)), node("class", kind)
    pairs = df.select("p_type", "p_brand").distinct()
    leaves = emit(pairs, leaf, [(T.TYPE, F.lit(T.CLASS)), (T.SUBCLASS, up)])
    ups = emit(df.select("p_type").distinct(), up, [(T.TYPE, F.lit(T.CLASS)), (T.SUBCLASS, F.lit(ex("Part"))), (T.LABEL, T.plain_literal(F.col("p_type")))])
    own = emit(df, node("part", "p_partkey"), [(T.TYPE, leaf)])
    return Graph.of(leaves.unionByName(ups).unionByName(own))


def literal_rows(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return local_frame(spark, rows, ["s", "p", "o"])


def values(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns of terms as native values: kinds maps a column to a type, cast from the literal's text."""
    return df.select(*[T.lex(F.col(c)).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])
