"""Contract queries of sources, sinks, description logic, versions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.operators import lifecycle, mapping
from graphloom.plans import dl
from graphloom.plans.views import EX, emit, ex, graph_of, literal_rows, node, part_classes, table
from graphloom.session import shared_dir
from graphloom.sources import rdf, tabular
from graphloom.streaming.monitoring import windowed_counts

QUERIES: dict = {}
ORACLES: dict = {}


def contract(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _path(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/graphloom-{tag}-{uuid.uuid4().hex}"


def _iri(kind: str, key: str) -> str:
    return f"'<{EX}{kind}/' || {key} || '>'"


_TEXT = "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size FROM part"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@contract("source_csv", _TEXT)
def source_csv(spark, sf_dir):
    path = _path(spark, "csv")
    _parts(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return tabular.read_csv(spark, path)


@contract("source_ndjson", _TEXT)
def source_ndjson(spark, sf_dir):
    path = _path(spark, "json")
    _parts(spark, sf_dir).write.json(path)
    return tabular.read_ndjson(spark, path)


@contract("source_parquet", _TEXT)
def source_parquet(spark, sf_dir):
    path = _path(spark, "parquet")
    _parts(spark, sf_dir).write.parquet(path)
    return tabular.read_parquet(spark, path)


@contract("source_xml", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def source_xml(spark, sf_dir):
    """The nations as one XML text, parsed whole on the executors."""
    path = _path(spark, "xml")
    row = F.concat(F.lit("<n><n_nationkey>"), F.col("n_nationkey").cast("string"), F.lit("</n_nationkey><n_name>"), "n_name", F.lit("</n_name></n>"))
    body = table(spark, sf_dir, "nation").agg(F.concat(F.lit("<r>"), F.array_join(F.collect_list(row), ""), F.lit("</r>")).alias("value"))
    body.coalesce(1).write.text(path)
    return tabular.read_parsed(spark, path, "xml")


@contract("source_sql", "SELECT n_regionkey::VARCHAR AS r, count(*)::VARCHAR AS n, (max(n_nationkey) - min(n_nationkey))::VARCHAR AS span FROM nation GROUP BY 1")
def source_sql(spark, sf_dir):
    view = f"v_{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").createOrReplaceTempView(view)
    return tabular.sql_rows(spark, f"SELECT n_regionkey AS r, count(*) AS n, max(n_nationkey) - min(n_nationkey) AS span FROM {view} GROUP BY 1")


_NATIONS = f"""
SELECT {_iri('nation', 'n_nationkey')} AS s, '{T.TYPE}' AS p, '<http://example.org/Nation>' AS o FROM nation
UNION ALL SELECT {_iri('nation', 'n_nationkey')}, '<http://example.org/region>', {_iri('region', 'n_regionkey')} FROM nation
UNION ALL SELECT {_iri('nation', 'n_nationkey')}, '{T.LABEL}', '"' || n_name || '"' FROM nation"""


def _round_trip(fmt):
    def run(spark, sf_dir):
        return rdf.load_text(spark, rdf.serialize(graph_of(spark, sf_dir, "nation"), fmt), fmt).triples

    return run


for _fmt in ("turtle", "rdfxml"):
    contract(f"{_fmt}_round_trip", _NATIONS)(_round_trip(_fmt))


@contract("nquads_round_trip", f"SELECT s, p, o, '<http://example.org/g>' AS g FROM ({_NATIONS})")
def nquads(spark, sf_dir):
    path = _path(spark, "nq")
    rdf.write_nquads(Graph(graph_of(spark, sf_dir, "nation").triples.withColumn("g", F.lit(ex("g")))), path)
    return rdf.read_ntriples(spark, path)


@contract("ingest_pipeline", f"""
SELECT '<http://example.org/data/' || s_suppkey || '>' AS s, '{T.TYPE}' AS p, '<http://example.org/data/' || k || '>' AS o FROM supplier, (VALUES ('Supplier'), ('Agent')) t(k)""")
def ingest_pipeline(spark, sf_dir):
    from graphloom.plans.reason import reason

    m = mapping.Mapping(mapping.DEFAULT_BASE, "s_suppkey", f"{mapping.DEFAULT_BASE}Supplier", [])
    g = Graph.of(mapping.rows_to_triples(table(spark, sf_dir, "supplier"), m)).add(literal_rows(spark, [(f"<{mapping.DEFAULT_BASE}Supplier>", T.SUBCLASS, f"<{mapping.DEFAULT_BASE}Agent>")]))
    return reason(g, "rdfs").graph.with_predicate(T.TYPE)


_UP = "'<http://example.org/class/' || replace(p_type, ' ', '_') || '>'"


@contract("dl_classify", f"""
SELECT DISTINCT {_UP} AS sub, '<http://example.org/Part>' AS sup FROM part
UNION ALL SELECT DISTINCT '<http://example.org/Big>', {_UP} FROM part WHERE p_type = (SELECT min(p_type) FROM part) UNION ALL SELECT '<http://example.org/Big>', '<http://example.org/Part>'""")
def dl_classify(spark, sf_dir):
    """Types of parts under Part, and a class defined as the part of the first type with two sizes."""
    g = part_classes(spark, sf_dir)
    kinds = g.triples.where((F.col("p") == T.SUBCLASS) & (F.col("o") == ex("Part")))
    first = kinds.agg(F.min("s")).first()[0]
    owl = lambda n: f"<{T.OWL}{n}>"
    defined = [(ex("Big"), T.EQUIVALENT_CLASS, "_:d"), ("_:d", owl("intersectionOf"), "_:l1"), ("_:l1", T.FIRST, first), ("_:l1", T.REST, "_:l2"), ("_:l2", T.FIRST, "_:m"), ("_:l2", T.REST, T.NIL), ("_:m", T.ON_PROPERTY, ex("size")), ("_:m", owl("minCardinality"), T.literal("2", f"{T.XSD}nonNegativeInteger"))]
    return dl.classify(Graph.of(kinds.unionByName(literal_rows(spark, defined)))).select("sub", "sup")


@contract("dl_unsatisfiable", "SELECT '<http://example.org/Both>' AS class, false AS satisfiable UNION ALL SELECT '<http://example.org/region/' || r_regionkey || '>', true FROM region")
def dl_unsatisfiable(spark, sf_dir):
    """Regions are disjoint, so a class under two of them is empty."""
    r = table(spark, sf_dir, "region")
    pairs = r.select(node("region", "r_regionkey").alias("s")).join(r.select(node("region", "r_regionkey").alias("o")), F.col("s") < F.col("o"))  # five regions
    g = Graph.of(pairs.select("s", F.lit(T.DISJOINT).alias("p"), "o").unionByName(literal_rows(spark, [(ex("Both"), T.SUBCLASS, f"<{EX}region/0>"), (ex("Both"), T.SUBCLASS, f"<{EX}region/1>")])))
    return dl.class_status(g)


@contract("version_rollback", f"SELECT * FROM ({_NATIONS}) WHERE p = '{T.LABEL}'")
def version_rollback(spark, sf_dir):
    v = lifecycle.Versions(spark)
    g = graph_of(spark, sf_dir, "nation")
    v.save(Graph(g.quads.where(F.col("p") == T.LABEL)), "labels")
    v.save(g, "all")
    return v.rollback("labels").triples


@contract("plan_migrate", f"""
SELECT {_iri('nation', 'n_nationkey')} AS s, '<{T.OWL}deprecated>' AS p, '"true"^^<{T.BOOLEAN}>' AS o FROM nation WHERE n_regionkey = 2""")
def plan_migrate(spark, sf_dir):
    cls = lambda d: Graph.of(emit(d, node("nation", "n_nationkey"), [(T.TYPE, F.lit(T.CLASS))]))
    df = table(spark, sf_dir, "nation")
    return lifecycle.migration_triples(cls(df), cls(df.where("n_regionkey <> 2"))).where(F.col("p") == f"<{T.OWL}deprecated>")


@contract("stream_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """The events as a stream, run to its end, into a table of daily counts."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    path = _path(spark, "windows")
    q = windowed_counts(stream, window="1 day").writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", _path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
