"""Contract queries of file formats, rule packs, alignment signals, individuals, plans, expressions and record fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.operators import checks, lifecycle, mapping, matching, records
from graphloom.plans import dl
from graphloom.plans.catalog_sources import _iri, _path
from graphloom.plans.views import EX, PREFIXES, emit, ex, graph_of, literal_rows, node, table, values
from graphloom.sources import rdf, tabular

QUERIES: dict = {}
ORACLES: dict = {}


def contract(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


# formats -----------------------------------------------------------------------------------------

_NATION = "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation"


def _one_text(df, row, head="", between="", tail=""):
    """The rows of a small table as one text."""
    return df.agg(F.concat(F.lit(head), F.array_join(F.collect_list(row), between), F.lit(tail)).alias("value")).coalesce(1)


@contract("source_json", _NATION)
def source_json(spark, sf_dir):
    path = _path(spark, "json")
    _one_text(table(spark, sf_dir, "nation"), F.to_json(F.struct("n_nationkey", "n_name")), "[", ",\n", "]").write.text(path)
    return tabular.read_json(spark, path).select("n_nationkey", "n_name")


@contract("source_yaml", _NATION)
def source_yaml(spark, sf_dir):
    path = _path(spark, "yaml")
    row = F.concat(F.lit("- n_nationkey: "), F.col("n_nationkey").cast("string"), F.lit('\n  n_name: "'), "n_name", F.lit('"\n'))
    _one_text(table(spark, sf_dir, "nation"), row).write.text(path)
    return tabular.read_parsed(spark, path, "yaml").select("n_nationkey", "n_name")


@contract("rdf_files", f"""
SELECT {_iri('nation', 'n_nationkey')} AS s, '<http://example.org/region>' AS p, {_iri('region', 'n_regionkey')} AS o FROM nation""")
def rdf_files(spark, sf_dir):
    """A Turtle file for each region, parsed on the executors."""
    path = _path(spark, "ttl")
    row = F.concat(F.lit("<nation/"), F.col("n_nationkey").cast("string"), F.lit("> ex:region <region/"), F.col("n_regionkey").cast("string"), F.lit("> ."))
    text = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(row), "\n").alias("body"))
    text.select(F.concat(F.lit(f"@prefix ex: <{EX}> . @base <{EX}> .\n"), "body").alias("value")).repartition(5).write.option("maxRecordsPerFile", 1).text(path)
    return rdf.load_files(spark, path, "turtle").triples


@contract("convert_formats", f"SELECT {_iri('region', 'r_regionkey')} AS s, '{T.LABEL}' AS p, '\"' || r_name || '\"' AS o FROM region")
def convert_formats(spark, sf_dir):
    """Turtle to RDF/XML to N-Triples and back to triples."""
    text = rdf.serialize(graph_of(spark, sf_dir, "region"), "turtle")
    text = rdf.convert(rdf.convert(text, "rdfxml", "turtle"), "ntriples", "rdfxml")
    return rdf.load_text(spark, text, "ntriples").with_predicate(T.LABEL)


# mapping -----------------------------------------------------------------------------------------


@contract("map_generated_ids", "SELECT count(*)::BIGINT AS subjects, (2 * count(*))::BIGINT AS triples FROM (SELECT DISTINCT event_type, user_id FROM events)")
def map_generated_ids(spark, sf_dir):
    """Rows without an id get one from their values; equal rows share it."""
    df = table(spark, sf_dir, "events").select("event_type", "user_id")
    made = mapping.rows_to_triples(df, mapping.Mapping(f"{EX}e/", None, f"{EX}Event", [mapping.Field("event_type", f"{EX}kind")])).distinct()
    return made.agg(F.count_distinct("s").alias("subjects"), F.count("*").alias("triples"))


# checks ------------------------------------------------------------------------------------------


@contract("enforce_boro", f"SELECT 'missing_state' AS rule, {_iri('nation', 'n_nationkey')} AS entity FROM nation WHERE n_regionkey >= 3")
def enforce_boro(spark, sf_dir):
    """Nations as entities, of which those of the first regions have a state."""
    n = table(spark, sf_dir, "nation")
    state = node("state", "n_nationkey")
    kinds = emit(n, node("nation", "n_nationkey"), [(T.SUBCLASS, F.lit(ex("Entity")))])
    states = emit(n.where("n_regionkey < 3"), state, [(T.SUBCLASS, node("nation", "n_nationkey"))]).unionByName(emit(n.where("n_regionkey < 4"), state, [(T.SUBCLASS, F.lit(ex("State")))]))
    return checks.missing_state(Graph.of(kinds.unionByName(states))).select("rule", "entity")


@contract("enforce_custom", "SELECT r AS rule, 'warning' AS severity, '(graph)' AS entity FROM (SELECT 'has_asia' AS r, EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA') AS hit UNION ALL SELECT 'has_moon', EXISTS (SELECT 1 FROM region WHERE r_name = 'MOON')) WHERE hit")
def enforce_custom(spark, sf_dir):
    ask = lambda name: f'PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> ASK {{ ?r rdfs:label "{name}" }}'
    rules = [checks.CustomRule("has_asia", "own", ask("ASIA")), checks.CustomRule("has_moon", "own", ask("MOON")), checks.CustomRule("other", "else", ask("ASIA"))]
    return checks.enforce(graph_of(spark, sf_dir, "region"), "own", rules).select("rule", "severity", "entity")


@contract("enforce_compliance", "SELECT 2::BIGINT AS total, (2 - count(DISTINCT r_name))::BIGINT AS passed FROM region WHERE r_name IN ('ASIA', 'MOON')")
def enforce_compliance(spark, sf_dir):
    ask = lambda name: f'PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> ASK {{ ?r rdfs:label "{name}" }}'
    out = checks.compliance(graph_of(spark, sf_dir, "region"), "own", [checks.CustomRule(n, "own", ask(n)) for n in ("ASIA", "MOON")])
    return spark.createDataFrame([(out["total"], out["passed"])], "total long, passed long")


# alignment ---------------------------------------------------------------------------------------


@contract("label_similarity", """
WITH l AS (SELECT DISTINCT p_name || ' ' || p_size % 7 AS a, string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] || ' ' || p_size % 7 AS b FROM part),
p AS (SELECT x.a, y.b, len(list_intersect(string_split(x.a, ' '), string_split(y.b, ' '))) AS n, len(list_distinct(string_split(x.a, ' ') || string_split(y.b, ' '))) AS m FROM (SELECT DISTINCT a FROM l) x, (SELECT DISTINCT b FROM l) y)
SELECT 'a ' || a AS a, 'b ' || b AS b, round(greatest(jaro_winkler_similarity(a, b), n / m), 4) AS label FROM p WHERE greatest(jaro_winkler_similarity(a, b), n / m) >= 0.88""")
def label_similarity(spark, sf_dir):
    """Labels of parts against the same with their words turned round, which only the overlap of words can find."""
    p = table(spark, sf_dir, "part")
    words, k = F.split("p_name", " "), (F.col("p_size") % 7).cast("string")
    side = lambda x, label: p.select(label.alias("label")).distinct().select(F.concat(F.lit(f"{x} "), "label").alias("iri"), "label")
    found = matching.similar_labels(side("a", F.concat_ws(" ", "p_name", k)), side("b", F.concat_ws(" ", words[1], words[0], k)), 0.88)
    return found.select("a", "b", F.round("label", 4).alias("label"))


@contract("align_structure", f"""
WITH b AS (SELECT DISTINCT p_type AS t FROM part)
SELECT {_iri('src', 't')} AS source, {_iri('tgt', 't')} AS target, 1.0::DOUBLE AS label, 0.25::DOUBLE AS property, 1.0::DOUBLE AS parent, 0.5::DOUBLE AS instance, 0.0::DOUBLE AS restriction, 0.5::DOUBLE AS neighborhood,
  round(0.25 + 0.20 / 4 + 0.15 + 0.075 + 0.05, 3)::DOUBLE AS confidence, '{T.EXACT_MATCH}' AS relation FROM b""")
def align_structure(spark, sf_dir):
    """Types of parts in two ontologies that share a parent, half of the instances and some properties."""
    kinds = table(spark, sf_dir, "part").select("p_type").distinct()

    def side(space, prop, one):
        cls = node(space, "p_type")
        has = lambda n: F.concat(F.lit(f"<{EX}{space}p/{n}_"), "p_type", F.lit(">"))
        own = emit(kinds, cls, [(T.TYPE, F.lit(T.CLASS)), (T.LABEL, T.plain_literal(F.col("p_type"))), (T.SUBCLASS, F.lit(f"<{EX}{space}p/Part>"))])
        props = emit(kinds, has("shared"), [(T.DOMAIN, cls), (T.RANGE, F.lit(f"<{EX}{space}r/{prop}>"))])
        more = emit(kinds, has("also"), [(T.DOMAIN, cls)]) if one else emit(kinds, has("shared"), [(T.DOMAIN, cls)])
        things = [emit(kinds, F.concat(F.lit(f"<{EX}{space}i/{i}_"), "p_type", F.lit(">")), [(T.TYPE, cls)]) for i in (("x", "y") if one else ("x",))]
        out = own.unionByName(props).unionByName(more)
        for t in things:
            out = out.unionByName(t)
        return Graph.of(out)

    found = matching.align_candidates(side("src", "R1", True), side("tgt", "R2", False), threshold=0.5)
    same = F.replace("source", F.lit("/src/"), F.lit("/tgt/")) == F.col("target")
    return found.where(same).select("source", "target", *[F.round(c, 4).alias(c) for c in matching.SIGNALS], "confidence", "relation")


@contract("crosswalk_labels", "SELECT DISTINCT p_name AS label, p_name AS best, 1.0::DOUBLE AS score FROM part")
def crosswalk_labels(spark, sf_dir):
    """Labels held against a crosswalk that knows them."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    cross = names.select(F.lit("c").alias("source_code"), F.lit("S").alias("source_system"), F.lit("t").alias("target_code"), F.lit("T").alias("target_system"), F.lit("exact").alias("relation"), F.col("p_name").alias("source_label"), F.lit(None).cast("string").alias("target_label"))
    path = _path(spark, "crosswalk")
    cross.write.parquet(path)
    labels = names.select(node("part", "p_name").alias("iri"), F.col("p_name").alias("label"))
    return matching.validate_labels(labels, matching.load_crosswalk(spark, path)).select("label", "best", "score")


# description logic -------------------------------------------------------------------------------


@contract("dl_individuals", f"""
SELECT {_iri('nation', 'n_nationkey')} AS individual, {_iri('region', 'n_regionkey')} AS class FROM nation UNION ALL SELECT {_iri('nation', 'n_nationkey')}, '<http://example.org/Area>' FROM nation""")
def dl_individuals(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    regions = emit(table(spark, sf_dir, "region"), node("region", "r_regionkey"), [(T.SUBCLASS, F.lit(ex("Area")))])
    return dl.individual_types(Graph.of(emit(n, node("nation", "n_nationkey"), [(T.TYPE, node("region", "n_regionkey"))]).unionByName(regions)))


@contract("dl_explain", "SELECT '<http://example.org/Both>' AS class, false AS satisfiable, 2::BIGINT AS clash")
def dl_explain(spark, sf_dir):
    g = Graph.of(literal_rows(spark, [(ex("A"), T.DISJOINT, ex("B")), (ex("Both"), T.SUBCLASS, ex("A")), (ex("Both"), T.SUBCLASS, ex("B")), (ex("Both"), T.SUBCLASS, ex("C"))]))
    out = dl.explain(dl.ontology_of(g), ex("Both"))
    return spark.createDataFrame([(out["class"], out["satisfiable"], len(out["clash"]))], "class string, satisfiable boolean, clash long")


# change ------------------------------------------------------------------------------------------


@contract("update_affected", "SELECT count(*)::BIGINT AS added, count(*)::BIGINT AS removed FROM nation")
def update_affected(spark, sf_dir):
    done = graph_of(spark, sf_dir, "nation").update_counted("DELETE { ?n ex:region ?r } INSERT { ?n ex:area ?r } WHERE { ?n ex:region ?r }", PREFIXES)
    return spark.createDataFrame([(done.added, done.removed)], "added long, removed long")


@contract("plan_apply", f"SELECT {_iri('nation', 'n_nationkey')} AS s FROM nation WHERE n_regionkey <> 2")
def plan_apply(spark, sf_dir):
    """A plan that a lock refuses, and that is applied by force."""
    n = table(spark, sf_dir, "nation")
    cls = lambda d: Graph.of(emit(d, node("nation", "n_nationkey"), [(T.TYPE, F.lit(T.CLASS))]))
    planner = lifecycle.Planner(cls(n))
    planner.lock(f"<{EX}nation/{n.where('n_regionkey = 2').agg(F.min('n_nationkey')).first()[0]}>")
    if not planner.plan(cls(n.where("n_regionkey <> 2")))["locked"]:
        raise AssertionError("the lock was not seen")
    try:
        planner.apply()
    except lifecycle.LockedError:
        return planner.apply("force").triples.select("s")
    raise AssertionError("a locked term was removed")


@contract("monitor_sweep", "SELECT 'blocked' AS status, 2::BIGINT AS checked, 1::BIGINT AS alerts")
def monitor_sweep(spark, sf_dir):
    q = "PREFIX ex: <http://example.org/> SELECT (COUNT(?n) AS ?count) WHERE { ?n a ex:Nation }"
    out, _ = lifecycle.Monitor([lifecycle.Watcher("many", q, 10, action="block"), lifecycle.Watcher("most", q, 1_000)]).run(graph_of(spark, sf_dir, "nation"))
    return spark.createDataFrame([(out["status"], out["checked"], len(out["alerts"]))], "status string, checked long, alerts long")


# expressions -------------------------------------------------------------------------------------


@contract("sparql_number_functions", f"""
SELECT {_iri('part', 'p_partkey')} AS p, abs(p_size - 25)::BIGINT AS a, ceil(p_size / 4.0)::BIGINT AS c, floor(p_size / 4.0)::BIGINT AS f, round(p_size / 4.0)::BIGINT AS r FROM part WHERE p_size % 4 <> 2""")
def number_functions(spark, sf_dir):
    q = "SELECT ?p (ABS(?s - 25) AS ?a) (CEIL(?s / 4.0) AS ?c) (FLOOR(?s / 4.0) AS ?f) (ROUND(?s / 4.0) AS ?r) WHERE { ?p ex:size ?s FILTER(?s - 4 * FLOOR(?s / 4) != 2) }"
    return values(graph_of(spark, sf_dir, "part").query(q, PREFIXES), a="double", c="double", f="double", r="double").select("p", *[F.col(c).cast("long").alias(c) for c in "acfr"])


@contract("sparql_date_functions", f"""
SELECT {_iri('order', 'o_orderkey')} AS o, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS d FROM orders""")
def date_functions(spark, sf_dir):
    q = "SELECT ?o (YEAR(?t) AS ?y) (MONTH(?t) AS ?m) (DAY(?t) AS ?d) WHERE { ?o ex:date ?t }"
    return values(graph_of(spark, sf_dir, "orders").query(q, PREFIXES), y="long", m="long", d="long")


@contract("sparql_hash_cast", f"""
SELECT {_iri('customer', 'c_custkey')} AS c, md5(c_name) AS m, sha256(c_name) AS h, c_custkey::BIGINT AS k FROM customer""")
def hash_cast(spark, sf_dir):
    q = 'SELECT ?c (MD5(?n) AS ?m) (SHA256(?n) AS ?h) (xsd:integer(REPLACE(STR(?c), "^.*/", "")) AS ?k) WHERE { ?c ex:name ?n }'
    return values(graph_of(spark, sf_dir, "customer").query(q, PREFIXES), m="string", h="string", k="long")


# records -----------------------------------------------------------------------------------------


@contract("record_fields", """
SELECT s_suppkey, round(s_suppkey * 0.3048, 1)::DOUBLE AS metres, (s_suppkey % 120) <= 90 AS valid, trim(regexp_replace(s_name, '[^a-zA-Z0-9]+', '-', 'g'), '-') AS slug,
  CASE WHEN s_suppkey % 3 > 0 THEN round(0.009 * (s_suppkey * 10) / (s_suppkey % 3), 6) END::DOUBLE AS sample FROM supplier""")
def record_fields(spark, sf_dir):
    k = F.col("s_suppkey")
    sample = records.ground_sample((k * 10).cast("double"), (k % 3).cast("double"), F.lit(0.009))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", records.feet_to_metres(k.cast("string")).alias("metres"), records.valid_coordinates((k % 120).cast("double"), F.lit(10.0)).alias("valid"), records.slug(F.col("s_name")).alias("slug"), F.round(sample, 6).alias("sample"),
    )


@contract("record_manifests", """
SELECT r_regionkey AS id, '{"type":"Manifest","id":"http://example.org/m/' || r_regionkey || '","label":"' || r_name || '","metadata":[{"label":"r_name","value":"' || r_name || '"}]}' AS manifest FROM region""")
def record_manifests(spark, sf_dir):
    return records.manifests(table(spark, sf_dir, "region"), "r_regionkey", "r_name", f"{EX}m/", ["r_name"])
