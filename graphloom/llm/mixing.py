"""Mixing sources to target weights by temperature.

A source's share of tokens is raised to an exponent and normalised; the exponent is bisected to the largest value in
[0, 1] whose weights reach a target entropy, and raised again as far as a limit on repetition asks. Weights times the token
budget are the sources' quotas.

A quota is realised as epochs: each is a permutation of the whole source, the last one is cut where its tokens would
exceed the quota. A source is dealt into blocks by a hash; an epoch permutes its blocks, and the documents of each
block. A document's offset in its source's sequence, scaled by the quota, names the mix block it belongs to, so
every mix block holds the sources in their weights.

Scale: one narrow pass for tokens; shares are pre-aggregated. Running totals are taken within blocks of about
``BLOCK_DOCS`` documents and over the totals of blocks, so a source with a third of all rows is many tasks. The
bisection runs on the driver over at most ``SOURCES_KEPT`` source totals, above that as aggregates on the executors.

Edge cases: a null text has no tokens; a null source is a source; sources without tokens have no weight and yield no rows; a null
id is an id; rows that repeat are drawn each. An empty table gives an empty result. A target entropy beyond reach is met as
nearly as exponents in [0, 1] can.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm._common import materialize, table

BLOCK_DOCS = 5_000
SOURCES_KEPT = 10_000
STEPS = 50
#: Production parameters of the query: share of the greatest entropy, times a document may appear, number of mix blocks.
TARGET_ENTROPY_SHARE = 0.95
MAX_REPEATS = 4.0
MIX_BLOCKS = 64
SEED = 17

_WORD = r"[^ \t\n\x0B\f\r]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


class _Shares:
    """Aggregates over source totals for a given exponent."""

    def __init__(self, totals: DataFrame):
        row = totals.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
        self.n, self.total, self.frame, self.tokens = row["n"], row["t"] or 0, totals, None
        if self.n <= SOURCES_KEPT:
            self.tokens = sorted(r["tokens"] for r in totals.select("tokens").collect())  # at most SOURCES_KEPT numbers

    def norm(self, a: float) -> float:
        """The sum of shares to the power a."""
        if self.tokens is not None:
            return math.fsum((t / self.total) ** a for t in self.tokens)
        return self.frame.agg(F.sum(F.pow(F.col("tokens") / self.total, F.lit(a)))).first()[0]

    def entropy(self, a: float) -> float:
        z = self.norm(a)
        if self.tokens is not None:
            return -math.fsum(w * math.log(w) for w in ((t / self.total) ** a / z for t in self.tokens))
        w = F.pow(F.col("tokens") / self.total, F.lit(a)) / z
        return -self.frame.agg(F.sum(w * F.log(w))).first()[0]

    def repeats(self, a: float, budget: float) -> float:
        """How often the smallest source, which repeats most, appears."""
        least = self.tokens[0] if self.tokens is not None else self.frame.agg(F.min("tokens")).first()[0]
        return budget * (least / self.total) ** a / self.norm(a) / least


def bisect_exponent(fits) -> float:
    """The largest a in [0, 1] with fits(a), for fits that holds below some a; 0 if none does."""
    if fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def exponent(shares: _Shares, budget: float, target_entropy: float | None, max_repeats: float | None) -> float:
    a = 1.0 if target_entropy is None else bisect_exponent(lambda x: shares.entropy(x) >= target_entropy)
    if max_repeats is not None and shares.repeats(a, budget) > max_repeats:
        a = 1 - bisect_exponent(lambda x: shares.repeats(1 - x, budget) <= max_repeats)
    return a


def mix_sources(docs: DataFrame, budget: int | None = None, entropy_share: float | None = TARGET_ENTROPY_SHARE, max_repeats: float | None = MAX_REPEATS, mix_blocks: int = MIX_BLOCKS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, source, epoch, n_tokens, offset, mix_block, weight): the drawn documents, one row for each time."""
    narrow = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("n_tokens"), F.xxhash64(id_col, text_col).alias("h")), "tokens")
    totals = narrow.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")).where("tokens > 0")
    totals = materialize(totals, "sources")
    shares = _Shares(totals)
    budget = shares.total if budget is None else budget
    if shares.n == 0:
        a, z = 1.0, 1.0
    else:
        target = None if entropy_share is None else entropy_share * math.log(shares.n)
        a = exponent(shares, budget, target, max_repeats)
        z = shares.norm(a)
    weighed = totals.withColumn("weight", F.pow(F.col("tokens") / F.lit(float(max(shares.total, 1))), F.lit(a)) / F.lit(z)).withColumn("quota", F.floor(F.col("weight") * budget)).withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK_DOCS))
    weighed = weighed.withColumnRenamed("source", "of")

    drawn = (
        narrow.join(weighed, narrow["source"].eqNullSafe(weighed["of"]))
        .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "h"), "n_blocks"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("quota") / F.col("tokens")))))
        .select("id", "source", "n_tokens", "h", "weight", "quota", "tokens", "block", "epoch")
    )
    within = Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64(F.lit(seed), "epoch", "h"), "h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    sizes = drawn.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("size"))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("b"), F.coalesce(F.sum("size").over(order), F.lit(0)).alias("start"))
    met = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b")))
    offset = F.col("epoch") * F.col("tokens") + F.col("start") + F.col("inside")
    return (
        met.withColumn("offset", offset)
        .where(F.col("offset") + F.col("n_tokens") <= F.col("quota"))
        .select(F.col("id").alias(id_col), "source", "epoch", "n_tokens", "offset", F.least(F.floor(F.col("offset") * F.lit(float(mix_blocks)) / F.col("quota")), F.lit(mix_blocks - 1)).alias("mix_block"), F.round("weight", 9).alias("weight"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
