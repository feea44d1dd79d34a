"""Tabular sources as string columns: CSV, JSON, NDJSON, XML, Parquet, YAML and XLSX, SQL, and remote fetches."""

from __future__ import annotations

import io
import itertools
import os
import re
import sys
import urllib.parse
import urllib.request
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.operators.mapping import stringified
from graphloom.session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: File formats by ending (fixed values); others mean CSV.
EXTENSIONS = {"csv": "csv", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "yaml": "yaml", "yml": "yaml", "xml": "xml", "xlsx": "xlsx", "xls": "xlsx", "parquet": "parquet"}
#: Rows of a DuckDB result that the driver holds at once.
BATCH_ROWS = 100_000


def detect_format(path: str) -> str:
    return EXTENSIONS.get(os.path.splitext(path.rstrip("/"))[1][1:].lower(), "csv")


def headers(df: DataFrame) -> list[str]:
    return sorted(df.columns)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a row of another length is an error."""
    return stringified(spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects or one object; scalars as text, nested values as JSON."""
    return stringified(spark.read.option("multiLine", True).option("primitivesAsString", True).json(path))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return stringified(spark.read.option("primitivesAsString", True).json(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return stringified(spark.read.parquet(path))


def _flat(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dict, list)):
        import json

        return json.dumps(value, ensure_ascii=False)
    return str(value)


def yaml_rows(data: bytes) -> Iterator[dict[str, str]]:
    """A sequence of maps, or one map; other entries are skipped."""
    import yaml

    found = yaml.safe_load(data)
    for row in found if isinstance(found, list) else [found]:
        if isinstance(row, dict):
            yield {str(k): _flat(v) for k, v in row.items()}


def xml_rows(data: bytes) -> Iterator[dict[str, str]]:
    """Children of the root are records, their children fields; attributes and deeper elements are ignored."""
    for record in ET.fromstring(data):
        row = {f.tag.rpartition("}")[2]: (f.text or "").strip() for f in record}
        if row:
            yield row


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_rows(data: bytes) -> Iterator[dict[str, str]]:
    """The first sheet of a workbook; its first row is the header."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        head: dict[int, str] = {}
        for row in ET.fromstring(z.read(sheets[0])).iter(f"{_NS}row"):
            cells = {}
            for k, c in enumerate(row.iter(f"{_NS}c")):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else k
                v = c.find(f"{_NS}v")
                text = v.text or "" if v is not None else ""
                kind = c.get("t")
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif kind == "b":
                    text = "true" if text == "1" else "false"
                cells[at] = text
            if not head:
                head = {k: v for k, v in cells.items() if v}
            elif any(cells.values()):
                yield {name: cells.get(k, "") for k, name in head.items()}


_PARSERS = {"yaml": yaml_rows, "xml": xml_rows, "xlsx": xlsx_rows}


def read_parsed(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Files that are parsed whole, one a row on the executors; the columns are the keys of all files, gathered first."""
    parse = _PARSERS[fmt]
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                found = [list(r.items()) for r in parse(content.as_py())]
                for k in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 10_000], pa.map_(pa.string(), pa.string()))], names=["row"])

    mapped = files.mapInArrow(rows, "row map<string, string>")
    names = sorted(r["k"] for r in mapped.select(F.explode(F.map_keys("row")).alias("k")).distinct().collect())  # column names
    return mapped.select(*[F.coalesce(F.col("row")[n], F.lit("")).alias(n) for n in names])


def read_file(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or detect_format(path)
    readers = {"csv": read_csv, "json": read_json, "ndjson": read_ndjson, "parquet": read_parquet}
    return readers[fmt](spark, path) if fmt in readers else read_parsed(spark, path, fmt)


# SQL ---------------------------------------------------------------------------------------------


def sql_driver(connection: str) -> str:
    """postgres, duckdb or spark by the form of a connection string."""
    c = connection.lower()
    if c.startswith(("postgres://", "postgresql://")) or "host=" in c:
        return "postgres"
    if c.startswith("duckdb:") or c.endswith((".duckdb", ".ddb")) or c == ":memory:":
        return "duckdb"
    if c in ("", "spark"):
        return "spark"
    raise ValueError(f"unknown connection {connection!r}")


def duckdb_target(connection: str) -> str:
    target = re.sub(r"^duckdb:(//)?", "", connection)
    return target or ":memory:"


def sql_rows(spark: SparkSession, sql: str, connection: str = "spark") -> DataFrame:
    """A query's rows as text: over the session's views, a PostgreSQL server by JDBC, or a DuckDB file on the driver."""
    driver = sql_driver(connection)
    if driver == "spark":
        return stringified(spark.sql(sql))
    if driver == "postgres":
        u = urllib.parse.urlparse(connection)
        reader = spark.read.format("jdbc").option("url", f"jdbc:postgresql://{u.hostname}:{u.port or 5432}{u.path}").option("query", sql)
        return stringified(reader.option("user", u.username or "").option("password", u.password or "").load())
    return _duckdb_rows(spark, sql, duckdb_target(connection))


def _duckdb_rows(spark: SparkSession, sql: str, target: str) -> DataFrame:
    """A DuckDB query's rows, read as a stream: a result beyond one batch goes batch by batch to a table in the shared folder."""
    import duckdb
    import pyarrow as pa

    def frame(batch: pa.RecordBatch) -> DataFrame:
        columns = [c.cast(pa.string()) if pa.types.is_time(c.type) or pa.types.is_dictionary(c.type) else c for c in batch.columns]
        return stringified(spark.createDataFrame(pa.Table.from_arrays(columns, names=batch.schema.names)))

    with duckdb.connect(target, read_only=target != ":memory:") as c:
        found = c.sql(sql).to_arrow_reader(BATCH_ROWS)
        first, second = next(found, None), next(found, None)
        if first is None:
            return spark.createDataFrame([], StructType([StructField(n, StringType()) for n in found.schema.names]))
        if second is None:
            return frame(first)
        path = f"{shared_dir(spark)}/graphloom-sql-{uuid.uuid4().hex}"
        for batch in itertools.chain((first, second), found):
            frame(batch).write.mode("append").parquet(path)
    return spark.read.schema(frame(first).schema).parquet(path)


def fetch(url: str, timeout: float = 30.0) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read().decode("utf-8")


def fetch_sparql(endpoint: str, query: str, timeout: float = 30.0) -> str:
    """The answer of a remote CONSTRUCT or DESCRIBE as N-Triples text."""
    request = urllib.request.Request(endpoint, urllib.parse.urlencode({"query": query}).encode(), {"Accept": "application/n-triples"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.read().decode("utf-8")


def push_sparql(endpoint: str, triples: DataFrame, batch: int = 5_000) -> None:
    """INSERT DATA batches to an endpoint from the executors."""

    def send(rows):
        block = []

        def flush():
            if block:
                body = "INSERT DATA {\n" + "\n".join(block) + "\n}"
                urllib.request.urlopen(urllib.request.Request(endpoint, body.encode(), {"Content-Type": "application/sparql-update"}), timeout=60).close()
                block.clear()

        for r in rows:
            block.append(f"{r['s']} {r['p']} {r['o']} .")
            if len(block) >= batch:
                flush()
        flush()

    triples.select("s", "p", "o").foreachPartition(send)
