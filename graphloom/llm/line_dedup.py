"""Line dedup by overlapping three-line windows.

Every three consecutive lines (split at "\\n") of a text with a non-blank line among them form a window, known by
two independent 64-bit hashes. A text of one or two lines is one window, and so is a line of ``LONG_WORDS`` words or more, which says as much as three
lines and which no three-line window finds between differing neighbours. A window found more than once in the whole corpus keeps its first
occurrence, in the order of (doc_id, text hash, line); every later occurrence is removed: the positions its windows cover are merged,
and the lines outside them are joined again. A removed line always
has an equal line earlier in that order, so at least one copy of every line stays.

Scale: windows are pre-aggregated (count and first place) before the shuffle; the repeated ones alone are joined
back to the windows, where a frequent window is a skewed join that the runtime may split; positions are gathered
per document only. No Python anywhere.

Edge cases: a null text stays null with zero lines; a window of blank lines is none; rows
that repeat (same id, same text) count as one document and get the same result; a null doc_id is an id of its
own, before all others; a document whose lines are all removed gets an empty text; a very long text is one row; an empty table gives an empty
result. Other columns pass through; columns with a result's name give way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import table

WINDOW_LINES = 3
#: Words of a line that is a window of its own.
LONG_WORDS = 50
_SEED = 7919
_WORD = r"[^ \t\n\x0B\f\r]+"


def _windows(docs: DataFrame, id_col: str, text_col: str, long_words: int | None) -> DataFrame:
    """(__id, __hash, __at, __n, __h1, __h2): place, number of lines and hashes of every window."""
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.col("__text").isNotNull())
    lines = texts.select("__id", F.xxhash64("__text").alias("__hash"), F.split(F.col("__text"), "\n").alias("__lines"))
    size = F.size("__lines")
    of = lambda at, n: F.struct(at.alias("at"), n.alias("n"))
    places = F.transform(F.sequence(F.lit(0), F.greatest(size - WINDOW_LINES, F.lit(0))), lambda k: of(k, F.least(size, F.lit(WINDOW_LINES))))
    if long_words is not None:
        line = lambda k: F.get(F.col("__lines"), k)
        is_long = lambda k: (F.length(line(k)) >= 2 * long_words - 1) & (F.regexp_count(line(k), F.lit(_WORD)) >= long_words)
        alone = F.transform(F.filter(F.sequence(F.lit(0), size - 1), is_long), lambda k: of(k, F.lit(1)))
        places = F.concat(places, F.when(size > 1, alone).otherwise(F.array().cast("array<struct<at: int, n: int>>")))
    window = F.slice(F.col("__lines"), F.col("__w.at") + 1, F.col("__w.n"))
    return (
        lines.select("__id", "__hash", "__lines", F.explode(places).alias("__w"))
        .where(F.array_join(window, "").rlike(r"[^ \t\n\x0B\f\r]"))
        .select("__id", "__hash", F.col("__w.at").alias("__at"), F.col("__w.n").alias("__n"), F.xxhash64(window).alias("__h1"), F.xxhash64(F.lit(_SEED), window).alias("__h2"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = LONG_WORDS) -> DataFrame:
    """docs with later copies of windows cut from text_col, plus n_lines and n_removed (of them). long_words: None for no windows of one long line."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    windows = _windows(docs, id_col, text_col, long_words)
    place = F.struct("__id", "__hash", "__at")
    repeated = windows.groupBy("__h1", "__h2").agg(F.min(place).alias("__first"), F.max(place).alias("__last")).where(~F.col("__first").eqNullSafe(F.col("__last")))
    later = windows.join(repeated.drop("__last"), ["__h1", "__h2"]).where(~place.eqNullSafe(F.col("__first")))
    cuts = later.groupBy("__id", "__hash").agg(F.collect_set(F.struct("__at", "__n")).alias("__cuts"))

    keyed = docs.withColumn("__key", F.xxhash64(text_col))
    joined = keyed.join(cuts, keyed[id_col].eqNullSafe(cuts["__id"]) & (keyed["__key"] == cuts["__hash"]), "left")
    size = F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0))
    covered = F.array_distinct(F.flatten(F.transform("__cuts", lambda w: F.sequence(w["__at"], w["__at"] + w["__n"] - 1))))
    cut = F.col("__cuts").isNotNull()
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__covered"), lambda k: F.get(F.col("__lines"), k))
    return (
        joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(size).cast("long"))
        .withColumns({"__lines": F.when(cut, F.split(F.col(text_col), "\n")), "__covered": F.when(cut, covered)})
        .withColumn("n_removed", F.when(cut, F.size("__covered")).otherwise(0).cast("long"))
        .withColumn(text_col, F.when(cut, F.array_join(kept, "\n")).otherwise(F.col(text_col)))
        .select(*docs.columns, "n_lines", "n_removed")
    )


def query(spark: SparkSession, sf_dir: str, long_words: int | None = LONG_WORDS) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, long_words=long_words).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def query_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three lines and of whole short texts alone."""
    return query(spark, sf_dir, long_words=None)


def _oracle(long_words: int | None) -> str:
    alone = "" if long_words is None else f"""
  UNION ALL SELECT l.doc_id, l.pos, 1, [line] FROM lines l JOIN docs d USING (doc_id)
  WHERE len(d.lines) > 1 AND len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) >= {long_words}"""
    return f"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
wins AS (
  SELECT doc_id, pos, 3 AS n, [line, lead(line) OVER w, lead(line, 2) OVER w] AS text
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
  QUALIFY lead(line, 2) OVER w IS NOT NULL
  UNION ALL SELECT doc_id, 0, len(lines), lines FROM docs WHERE len(lines) < 3{alone}),
ranked AS (
  SELECT doc_id, pos, n, row_number() OVER (PARTITION BY text ORDER BY doc_id, pos) AS k
  FROM wins WHERE regexp_matches(array_to_string(text, ''), '[^ \\t\\n\\x0B\\f\\r]')),
cuts AS (SELECT DISTINCT doc_id, pos + d AS pos FROM (SELECT doc_id, pos, unnest(range(n)) AS d FROM ranked WHERE k > 1)),
kept AS (
  SELECT l.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY l.pos) AS text
  FROM lines l ANTI JOIN cuts c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines, (coalesce(len(d.lines), 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(k.text, '')) END::BIGINT AS kept_chars, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""


ORACLE, ORACLE_SHORT = _oracle(LONG_WORDS), _oracle(None)
