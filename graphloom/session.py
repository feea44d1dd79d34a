"""Session helpers: where intermediates are written, and how lineage is cut."""

from __future__ import annotations

import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where the session names no shared folder (tests, one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/graphloom"


#: Settings for clusters: runtime re-planning, skewed joins split, and partitions of a size that fits executors.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine a local one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: a durable cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._graphloom_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads again."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of read files for which a shuffle gets a part of its own: rows of terms are some twenty times as large in memory.
PART_BYTES, MOST_PARTS = 2_000_000, 20_000


def read_bytes(*frames: DataFrame) -> int:
    """Bytes of the tables that the frames read, each counted once, as the optimizer knows them; those it knows nothing of count as none."""
    sizes = {}
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for leaf in map(leaves.apply, range(leaves.size())):
            sizes[leaf.semanticHash()] = int(str(leaf.stats().sizeInBytes()))
    return sum(n for n in sizes.values() if n < 1 << 60)


def parts_of(*frames: DataFrame) -> int | None:
    """The number of parts for a shuffle of the frames together, so that the memory of a task does not grow with the input; None
    where the session's own number is enough."""
    wanted = min(-(-read_bytes(*frames) // PART_BYTES), MOST_PARTS)
    return wanted if wanted > int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame) -> DataFrame:
    """df dealt over more tasks, where it comes straight from files of few splits: one file of narrow rows is one task, however many rows it has."""
    size = read_bytes(df)
    if size <= PART_BYTES // 4:
        return df
    run = df._jdf.queryExecution()
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size // (PART_BYTES // 4)), MOST_PARTS))
    narrow = "Exchange" not in run.executedPlan().toString()
    return df.repartition(wanted, *[F.col(f"`{c}`") for c in df.columns]) if narrow and run.toRdd().getNumPartitions() < wanted else df


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of df if there are at most limit of them; None otherwise."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def local_frame(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """String rows as a relation whose size the optimizer knows, so that small ones are broadcast."""
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.string()) for n, c in zip(names, columns, strict=True)}))
