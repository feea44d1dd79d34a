"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and mixing over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder and
rereads it as the next stage's docs. All stages but the last return the columns of documents; the last returns the
drawn mixture: doc_id, source, epoch, n_tokens, offset, mix_block, weight.

A stage's result is read from its predecessor's table and, for near-dedup, a small one of the ids that go; other intermediates are deleted
before the stage returns.

Edge cases: a null or blank text fails the quality rules. In the later stages, given such rows as their input, it is kept: it has no
lines to cut, no near-duplicates, no benchmark words; mixing draws it, with no tokens, if its source has any. Rows that repeat an id
stand and fall together where they say the same: line dedup treats equal rows as one document, near-dedup keeps or drops all rows of an id,
mixing draws each. A null id is never a near-duplicate; a null source is a source of its own. Empty tables give empty results, and
further columns of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from graphloom.llm._common import discard, materialize, new_path, table


def _aside(docs: DataFrame, *results: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns that have a result's name set aside, and the names to give back."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in results}
    return docs.withColumnsRenamed(own), {v: k for k, v in own.items()}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject."""
    free, back = _aside(docs, *quality.RESULTS)
    return quality.judge_quality(free, table(spark, sf_dir, "labels")).where("kept").select(*free.columns).withColumnsRenamed(back).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated three-line windows, repeated long lines and repeated texts of fewer lines; documents of which no word is left go."""
    free, back = _aside(docs, "n_lines", "n_removed")
    cut = line_dedup.dedup_lines(free)
    cut = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).select(*free.columns).withColumnsRenamed(back).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) keep one document, that of the smallest id."""
    read: list[DataFrame] = []
    gone = materialize(near_dedup.link_documents(docs, read=read).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    for done in read:
        discard(done)
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti").select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    free, back = _aside(docs, *decontaminate.RESULTS)
    return decontaminate.scan_texts(free, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*free.columns).withColumnsRenamed(back).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the mixture."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", remove_benchmark),
    ("mixing", mix),
]

#: Line labels and minhash buckets have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    raise ValueError("no stages")


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
