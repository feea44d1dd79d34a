"""State that outlives a session: append-only Parquet tables under one folder, read back as DataFrames.

Every append adds files and never rewrites any, so concurrent writers and retried tasks are safe; tables with a key keep their
history, and current() gives the latest row of each key.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import shared_dir

#: Tables, their columns, and the key of those whose latest row counts.
TABLES: dict[str, tuple[str, list[str]]] = {
    "ontology_versions": ("id long, label string, triple_count long, path string, format string, created_at double", []),
    "monitor_watchers": ("id string, check_type string, threshold double, severity string, action string, query string, message string, webhook_url string, webhook_headers string, enabled boolean, at double", ["id"]),
    "monitor_state": ("key string, value string, at double", ["key"]),
    "drift_feedback": ("id string, from_iri string, to_iri string, predicted string, confidence double, actual string, signal_domain_range double, signal_label_sim double, signal_hierarchy double, signal_individuals double, at double", ["id"]),
    "iri_locks": ("iri string, reason string, at double", ["iri"]),
    "lineage_events": ("session_id string, seq long, timestamp long, event_type string, operation string, details string", []),
    "enforce_rules": ("id string, rule_pack string, query string, severity string, message string, enabled boolean, at double", ["id"]),
    "align_feedback": ("source_iri string, target_iri string, predicted_relation string, accepted boolean, signals_json string, at double", []),
    "tool_feedback": ("tool string, rule_id string, entity string, accepted boolean, at double", []),
    "embeddings": ("iri string, text_vec array<double>, struct_vec array<double>, at double", ["iri"]),
    "ontology_cache": ("name string, source_path string, source_mtime double, source_size long, source_sha string, cache_path string, triple_count long, at double", ["name"]),
}


class State:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_dir(spark)}/graphloom-state"

    def append(self, table: str, rows: list[dict] | DataFrame) -> None:
        """Add rows; a missing time is now."""
        schema, _ = TABLES[table]
        if not isinstance(rows, DataFrame):
            columns = [c.split(" ") for c in schema.split(", ")]
            now = {"at": time.time(), "created_at": time.time()}
            value = lambda v, kind: float(v) if kind == "double" and v is not None else v
            rows = self.spark.createDataFrame([tuple(value(r.get(n, now.get(n)), kind) for n, kind in columns) for r in rows], schema)
        rows.write.mode("append").parquet(f"{self.folder}/{table}")

    def table(self, table: str) -> DataFrame:
        """All rows ever added."""
        schema, _ = TABLES[table]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")

    def current(self, table: str) -> DataFrame:
        """The latest row of each key."""
        _, key = TABLES[table]
        rows = self.table(table)
        if not key:
            return rows
        return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("at").desc()))).where("__n = 1").drop("__n")

    def record_drift(self, from_iri: str, to_iri: str, predicted: str, confidence: float, actual: str, **signals: float) -> None:
        """Drift feedback, one current row for each pair of terms."""
        self.append("drift_feedback", [{"id": f"{from_iri}_{to_iri}", "from_iri": from_iri, "to_iri": to_iri, "predicted": predicted, "confidence": confidence, "actual": actual, **{f"signal_{k}": float(v) for k, v in signals.items()}}])
