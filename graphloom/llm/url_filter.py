"""URL filters as a sort-merge range join over reversed-host canonical keys.

A rule (host, path, verdict) fits its host and every subdomain when the url's path starts with the rule's
path. Written as ``reversed host labels + "/" + path``, a rule is a prefix, so in byte order it covers one
interval of keys, and such intervals nest. Each url yields one key per trailing part of its host (no deeper
than the deepest rule). Rules open at their key and close at ``key || 0xFF``; one pass over the sorted events
keeps the stack: the running sum of opens and closes is its height, and its top is the last rule opened at
that height. Everything is DataFrame expressions.

Scale: urls are dealt evenly over ``salts`` groups by a hash of the row, so no host makes a hot task; every
group sweeps the rules of its shard. Rule lists over ``RULES_PER_SHARD`` are split into shards by a hash of
their exact host, which each url key meets in exactly one shard.

Edge cases: null url or no "://": host and path are empty, and the default verdict holds. Rules with a null
host, path or verdict are ignored. The longest rule (host plus path, in characters) wins; among equally long
ones that with more host labels, then block, then the greater string. Repeated rows are each judged. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm._common import lower_ascii, parallelism, table

RULES_PER_SHARD = 100_000
SALTS_PER_PARTITION = 6

ALLOW, BLOCK = "allow", "block"

#: Production rules of the query: (host, path, verdict).
RULES = [
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
]


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty for null or without "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, "\\."))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """Judge every row of pages.

    Returns id_col, host, path, rule, verdict: one row per input row; join on the id to filter wide pages.
    """
    spark = pages.sparkSession
    labels = reversed_labels(F.col("host"))
    known = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # of a rule given twice, block holds
        .select("verdict", F.concat("host", "path").alias("rule"), F.size(labels).alias("n_labels"), F.concat(F.array_join(labels, "."), F.lit("/")).alias("host_key"), "path")
    )
    totals = known.agg(F.count("*").alias("n"), F.max("n_labels").alias("deepest")).first()
    deepest = totals["deepest"] or 1
    shards = max(1, -(-totals["n"] // RULES_PER_SHARD))
    salts = max(1, -(-parallelism(spark) * SALTS_PER_PARTITION // shards))

    host, path = url_host_path(F.col("__url"))
    urls = (
        pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"))
        .select("__id", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("__id", "__url"), F.lit(salts)).alias("salt"))
        .withColumn("uid", F.monotonically_increasing_id())
        .withColumn("labels", reversed_labels(F.col("host")))
        .withColumn("depth_", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest)))))
        .withColumn("host_key", F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("depth_")), "."), F.lit("/")))
        .drop("labels", "depth_")
    )

    def sharded(df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("host_key"), F.lit(shards)))

    key = F.concat("host_key", "path").cast("binary")
    found = F.struct(F.length("rule").alias("len"), "n_labels", F.col("verdict"), F.col("rule"))
    copies = sharded(known).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    opens = copies.select("shard", "salt", key.alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"), found.alias("found"))
    closes = copies.select("shard", "salt", F.concat(key, F.lit(bytearray(b"\xff"))).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"))
    asked = sharded(urls).select("shard", "salt", key.alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"), "uid", "__id", "host", "path")
    events = asked.unionByName(opens, allowMissingColumns=True).unionByName(closes, allowMissingColumns=True)

    swept = Window.partitionBy("shard", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("shard", "salt", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        events.withColumn("height", F.sum("step").over(swept))
        .withColumn("top", F.when(F.col("height") > 0, F.last("found", ignorenulls=True).over(level)))
        .where(F.col("kind") == 1)
        .groupBy("salt", "uid", "__id", "host", "path")
        .agg(F.max("top").alias("top"))
        .select(F.col("__id").alias(id_col), "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


ORACLE = """
WITH rules(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (
  SELECT page_id, row_number() OVER () AS uid,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, uid, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT p.uid, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.uid ORDER BY length(r.host || r.path) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.uid = p.uid AND f.k = 1
"""
