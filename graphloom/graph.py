"""The graph: a set of quads (s, p, o, g) held in a DataFrame. Values are immutable; operations return new graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans import sparql
from graphloom.session import local_frame, materialize

QUADS = "s string, p string, o string, g string"


@dataclass
class UpdateResult:
    graph: Graph
    added: int
    removed: int

    @property
    def affected(self) -> int:
        """The growth in triples, never below zero: deletions alone report 0."""
        return max(0, self.added - self.removed)


class Graph:
    def __init__(self, quads: DataFrame):
        self.quads = quads
        self.spark: SparkSession = quads.sparkSession

    @classmethod
    def of(cls, triples: DataFrame) -> Graph:
        """From (s, p, o) or (s, p, o, g) rows; duplicates collapse."""
        if "g" not in triples.columns:
            triples = triples.withColumn("g", F.lit(None).cast("string"))
        return cls(triples.select("s", "p", "o", "g").distinct())

    @classmethod
    def rows(cls, spark: SparkSession, rows: list[tuple]) -> Graph:
        return cls.of(local_frame(spark, [(*r, None) if len(r) == 3 else tuple(r) for r in rows], ["s", "p", "o", "g"]))

    @classmethod
    def table(cls, spark: SparkSession, name: str) -> Graph:
        """A graph saved by save_table."""
        return cls(spark.table(name).select("s", "p", "o", "g"))

    def save_table(self, name: str, buckets: int = 64) -> Graph:
        """Save as a table partitioned by predicate and bucketed by subject, and read it from there.

        A pattern with a constant predicate then reads one partition, and patterns that share their subject join without
        a shuffle. Choose buckets so that the largest predicate has about 128 MB a bucket.
        """
        self.quads.write.mode("overwrite").partitionBy("p").bucketBy(buckets, "s").sortBy("s").saveAsTable(name)
        return Graph.table(self.spark, name)

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], QUADS))

    @property
    def triples(self) -> DataFrame:
        """The default graph."""
        return self.quads.where(F.col("g").isNull()).select("s", "p", "o")

    @property
    def all_triples(self) -> DataFrame:
        """The triples of every graph, as stored."""
        return self.quads.select("s", "p", "o")

    def with_predicate(self, *predicates: str) -> DataFrame:
        return self.triples.where(F.col("p").isin(*predicates))

    def query(self, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
        return sparql.run_query(self.quads, text, prefixes)

    def ask(self, text: str, prefixes: dict[str, str] | None = None) -> bool:
        return bool(self.query(text, prefixes).first()["result"])

    def update(self, text: str, prefixes: dict[str, str] | None = None) -> Graph:
        return Graph(sparql.run_update(self.quads, text, prefixes)[0])

    def update_counted(self, text: str, prefixes: dict[str, str] | None = None) -> UpdateResult:
        after = Graph(materialize(sparql.run_update(self.quads, text, prefixes)[0], "graph"))
        key = ["s", "p", "o", "g"]
        cond = lambda a, b: (a["s"] == b["s"]) & (a["p"] == b["p"]) & (a["o"] == b["o"]) & a["g"].eqNullSafe(b["g"])
        a, b = after.quads.select(*key), self.quads.select(*key)
        return UpdateResult(after, a.join(b, cond(a, b), "left_anti").count(), b.join(a, cond(b, a), "left_anti").count())

    def add(self, triples: DataFrame) -> Graph:
        """The union as a set. Only the new triples are made distinct, against those of them that are there: a small addition is
        broadcast, and the graph itself is never shuffled for it."""
        new = Graph.of(triples).quads.alias("n")
        same = lambda a, b: (F.col(f"{a}.s") == F.col(f"{b}.s")) & (F.col(f"{a}.p") == F.col(f"{b}.p")) & (F.col(f"{a}.o") == F.col(f"{b}.o")) & F.col(f"{a}.g").eqNullSafe(F.col(f"{b}.g"))
        there = self.quads.alias("q").join(new, same("q", "n"), "left_semi").select("q.s", "q.p", "q.o", "q.g")
        fresh = new.join(there.alias("t"), same("n", "t"), "left_anti").select("n.s", "n.p", "n.o", "n.g")
        return Graph(self.quads.unionByName(fresh))

    def add_disjoint(self, triples: DataFrame) -> Graph:
        """The union with distinct default-graph triples that are known not to be there."""
        return Graph(self.quads.unionByName(triples.select("s", "p", "o", F.lit(None).cast("string").alias("g"))))

    def remove(self, triples: DataFrame) -> Graph:
        gone = Graph.of(triples).quads.select("s", "p", "o").distinct()
        return Graph(self.quads.join(gone, ["s", "p", "o"], "left_anti").select("s", "p", "o", "g"))

    def count(self) -> int:
        return self.quads.count()

    def cached(self) -> Graph:
        return Graph(self.quads.persist())
