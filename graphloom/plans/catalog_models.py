"""Contract queries of drift, alignment, vectors, plans, watchers, grounding and record operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.functions import vectors as V
from graphloom.graph import Graph
from graphloom.operators import lifecycle as L
from graphloom.operators import matching as M
from graphloom.operators import records as R
from graphloom.plans.views import EX, PREFIXES, emit, ex, graph_of, literal_rows, node, table
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


def _iri(kind: str, key: str) -> str:
    return f"'<{EX}{kind}/' || {key} || '>'"


def _lit(c: str) -> str:
    return f"'\"' || {c} || '\"'"


# drift and alignment -----------------------------------------------------------------------------


def _part_terms(spark, sf_dir, keep, name, space):
    """Brands and types of parts as classes, and a property for each brand."""
    df = table(spark, sf_dir, "part")
    brands = df.select("p_brand").distinct().where(keep)
    cls = F.concat(F.lit(f"<{EX}{space}/"), F.replace(F.col("p_brand"), F.lit(" "), F.lit("_")), F.lit(">"))
    prop = F.concat(F.lit(f"<{EX}{space}/has_"), F.replace(F.col("p_brand"), F.lit(" "), F.lit("_")), F.lit(">"))
    out = emit(brands, cls, [(T.TYPE, F.lit(T.CLASS)), (T.LABEL, T.plain_literal(name(F.col("p_brand"))))])
    return Graph.of(out.unionByName(emit(brands, prop, [(T.TYPE, F.lit(T.OBJECT_PROPERTY)), (T.DOMAIN, cls)])))


_SPLIT = "('<http://example.org/v/' || x || replace(p_brand, ' ', '_') || '>')"
_NUM = "regexp_extract(p_brand, '[0-9]+')::INT"


@contract("drift_terms", f"""
WITH b AS (SELECT DISTINCT p_brand FROM part), t(x, kind) AS (VALUES ('', 'class'), ('has_', 'property'))
SELECT 'removed' AS change, {_SPLIT} AS iri, kind FROM b, t WHERE {_NUM} % 5 = 0
UNION ALL SELECT 'added', {_SPLIT}, kind FROM b, t WHERE {_NUM} % 7 = 0 AND {_NUM} % 5 <> 0""")
def drift_terms(spark, sf_dir):
    n = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    same = lambda c: c
    return M.drift_terms(_part_terms(spark, sf_dir, (n % 7 != 0) | (n % 5 == 0), same, "v"), _part_terms(spark, sf_dir, n % 5 != 0, same, "v"))


@contract("drift_renames")
def drift_renames(spark, sf_dir):
    n = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    old = _part_terms(spark, sf_dir, n > 0, lambda c: c, "v")
    new = _part_terms(spark, sf_dir, n > 0, lambda c: F.concat(c, F.lit("s")), "w")
    return M.rename_candidates(old, new).select("from_iri", "to_iri", F.round("confidence", 4).alias("confidence"))


def _align_pair(spark, sf_dir):
    yes = F.lit(True)
    source = _part_terms(spark, sf_dir, yes, lambda c: c, "src")
    target = _part_terms(spark, sf_dir, yes, lambda c: F.upper(c), "tgt")
    bare = lambda g: Graph(g.quads.where(F.col("p") != T.DOMAIN))
    return bare(source), bare(target)


@contract("align_candidates")
def align_candidates(spark, sf_dir):
    return M.align_candidates(*_align_pair(spark, sf_dir), threshold=0.6)


@contract("align_one_to_one", f"""
SELECT '<http://example.org/src/' || replace(p_brand, ' ', '_') || '>' AS source, '<http://example.org/tgt/' || replace(p_brand, ' ', '_') || '>' AS target FROM (SELECT DISTINCT p_brand FROM part)""")
def align_one(spark, sf_dir):
    return M.align(*_align_pair(spark, sf_dir), threshold=0.6).select("source", "target")


def _crosswalk(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("source_code"), F.lit("PART").alias("source_system"), F.concat(F.lit("T"), "p_partkey").alias("target_code"), F.lit("TGT").alias("target_system"), F.lit("exact").alias("relation"), F.col("p_name").alias("source_label"), F.col("p_type").alias("target_label"))


@contract("clinical_lookup", "SELECT p_partkey::VARCHAR AS source_code, 'T' || p_partkey AS target_code, p_name AS source_label FROM part WHERE p_partkey = 42")
def crosswalk_lookup(spark, sf_dir):
    return M.crosswalk_lookup(_crosswalk(spark, sf_dir), "42", "PART").select("source_code", "target_code", "source_label")


@contract("fuzzy_label_topk")
def fuzzy_topk(spark, sf_dir):
    return M.fuzzy_labels(_crosswalk(spark, sf_dir), "part steel").select("source_code", F.round("score", 6).alias("score"))


@contract("clinical_enrich", f"""
VALUES ('<http://example.org/Widget>', '{T.EXACT_MATCH}', '<http://example.org/tgt/T42>'), ('<http://example.org/Widget>', '{T.LABEL}', '"' || (SELECT p_type FROM part WHERE p_partkey = 42) || '"')""".replace("VALUES", "SELECT * FROM (VALUES", 1) + ") t(s, p, o)")
def enrich(spark, sf_dir):
    return M.enrich(graph_of(spark, sf_dir, "region"), ex("Widget"), _crosswalk(spark, sf_dir), "42", "PART")


@contract("prf_score", """
SELECT count_if(quality = 1 AND n_chars >= 800)::BIGINT AS tp, count_if(quality <> 1 AND n_chars >= 800)::BIGINT AS fp, count_if(quality = 1 AND n_chars < 800)::BIGINT AS fn,
  round(count_if(quality = 1 AND n_chars >= 800) / count_if(n_chars >= 800), 9) AS precision, round(count_if(quality = 1 AND n_chars >= 800) / count_if(quality = 1), 9) AS recall,
  round(2 * count_if(quality = 1 AND n_chars >= 800) / (count_if(n_chars >= 800) + count_if(quality = 1)), 9) AS f1
FROM documents JOIN labels USING (doc_id)""")
def prf(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    said = table(spark, sf_dir, "documents").where("n_chars >= 800").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id")
    out = M.scores(said, labels.where("quality = 1").select("doc_id"), ["doc_id"])
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


# vectors -----------------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("iri"), F.col("embedding").cast("array<double>").alias("text_vec")).withColumn("struct_vec", V.into_ball(F.col("text_vec")))
    q = v.where("iri % 100 = 0").select(F.col("iri").alias("query"), F.col("text_vec").alias("q_text"), F.col("struct_vec").alias("q_struct"))
    return v, q


def _top(mode):
    """The nearest of all rows to every hundredth row."""

    def run(spark, sf_dir):
        v, q = _vectors(spark, sf_dir)
        return V.top_k(v, q, 10, mode).select("query", "iri", F.round("score", 4).alias("score"), "rank")

    return run


_VEC = """
WITH v AS (SELECT vec_id AS iri, embedding::DOUBLE[] AS t, sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])) AS n FROM embeddings),
b AS (SELECT *, [x * 0.9::DOUBLE / (1 + n) FOR x IN t] AS s FROM v),
p AS (SELECT q.iri AS query, b.iri, list_dot_product(q.t, b.t) / (q.n * b.n) AS cos,
  acosh(greatest(1 + 2 * pow(list_distance(q.s, b.s), 2) / (greatest(1 - list_dot_product(q.s, q.s), 1e-5) * greatest(1 - list_dot_product(b.s, b.s), 1e-5)), 1)) AS d
  FROM b AS q JOIN b ON q.iri % 100 = 0),
r AS (SELECT query, iri, {score} AS score, row_number() OVER (PARTITION BY query ORDER BY {score} {way}, iri) AS rank FROM p)
SELECT query, iri, round(score, 4) AS score, rank FROM r WHERE rank <= 10"""

for _name, _mode, _score, _way in (("vec_cosine_topk", "cosine", "cos", "DESC"), ("vec_poincare_topk", "poincare", "d", ""), ("vec_product_topk", "product", "0.5::DOUBLE * cos + 0.5::DOUBLE / (1 + d)", "DESC")):
    for _alias in (_name, f"{_name}_hundredth"):  # two names of one search
        contract(_alias, _VEC.format(score=_score, way=_way))(_top(_mode))


# plans, watchers, lineage, grounding -------------------------------------------------------------


def _planned(spark, sf_dir):
    """Nations as classes under their region; the next version lacks those of region 2."""
    df = table(spark, sf_dir, "nation")
    cls = lambda d: emit(d, node("nation", "n_nationkey"), [(T.TYPE, F.lit(T.CLASS)), (T.SUBCLASS, node("region", "n_regionkey"))])
    used = emit(table(spark, sf_dir, "customer"), node("customer", "c_custkey"), [(ex("nation"), node("nation", "c_nationkey"))])
    return Graph.of(cls(df).unionByName(used)), Graph.of(cls(df.where("n_regionkey <> 2")).unionByName(used))


_RADIUS = f"""
SELECT {_iri('nation', 'n_nationkey')} AS iri, (2 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey))::BIGINT AS refs FROM nation WHERE n_regionkey = 2"""


@contract("plan_blast_radius", _RADIUS)
def blast_radius(spark, sf_dir):
    old, new = _planned(spark, sf_dir)
    return L.blast_radius(old, L.plan_changes(old, new).where("change = 'removed'")).withColumnRenamed("references", "refs")


@contract("plan_risk", f"SELECT 'high' AS risk, 0::BIGINT AS added, count(*)::BIGINT AS removed, sum(refs)::BIGINT AS refs FROM ({_RADIUS})")
def plan_risk(spark, sf_dir):
    old, new = _planned(spark, sf_dir)
    changes = L.plan_changes(old, new)
    return L.plan_risk(changes, L.blast_radius(old, changes.where("change = 'removed'"))).withColumnRenamed("references", "refs")


@contract("monitor_watchers", """
WITH k AS (SELECT count_if(event_type = 'click') AS clicks, count(*) AS n FROM events)
SELECT 'clicks' AS id, clicks::DOUBLE AS value, clicks > 100 AS alert FROM k UNION ALL SELECT 'all', n::DOUBLE, n > 1000000 FROM k UNION ALL SELECT 'other', 0::DOUBLE, false""")
def watchers(spark, sf_dir):
    q = "PREFIX ex: <http://example.org/> SELECT (COUNT(?e) AS ?count) WHERE { ?e ex:kind "
    ws = [L.Watcher("clicks", q + '"click" }', 100), L.Watcher("all", q + "?k }", 1_000_000, action="block"), L.Watcher("other", check_type="disk", threshold=5), L.Watcher("off", q + "?k }", enabled=False)]
    return L.watch_values(graph_of(spark, sf_dir, "events"), ws).select("id", "value", "alert")


@contract("ground_triples", """
WITH c AS (SELECT n_nationkey, n_regionkey, n_nationkey % 3 AS k FROM nation)
SELECT 'nation/' || n_nationkey AS s, CASE WHEN k = 0 THEN 'region/' || n_regionkey WHEN k = 1 THEN 'region/77' ELSE 'x' END AS o,
  CASE k WHEN 0 THEN 'grounded' WHEN 1 THEN 'contradicted' ELSE 'unknown' END AS status, CASE WHEN k = 0 THEN 65 ELSE 0 END::BIGINT AS confidence, CASE WHEN k = 0 THEN 1 ELSE 0 END::BIGINT AS evidence_count FROM c""")
def ground(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    claims = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("s"), F.when(k == 2, "colour").otherwise("region").alias("p"), F.when(k == 0, F.concat(F.lit("region/"), F.col("n_regionkey").cast("string"))).when(k == 1, "region/77").otherwise("x").alias("o"))
    return L.ground(graph_of(spark, sf_dir, "nation"), claims).select("s", "o", "status", "confidence", "evidence_count")


@contract("grounding_degree", "SELECT 25::BIGINT AS claims, (SELECT count(*) FROM nation WHERE n_regionkey < 3)::BIGINT AS grounded")
def grounding_degree(spark, sf_dir):
    claims = emit(table(spark, sf_dir, "nation"), node("nation", "n_nationkey"), [(ex("region"), node("region", F.when(F.col("n_regionkey") < 3, F.col("n_regionkey")).otherwise(99)))])
    return R.grounding_degree(claims, graph_of(spark, sf_dir, "nation")).select("claims", "grounded")


@contract("lineage_seq", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS seq FROM events")
def lineage(spark, sf_dir):
    return L.with_sequence(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", F.col("seq").cast("long").alias("seq"))


@contract("consistency_check", "SELECT 1::BIGINT AS same_different, count(*)::BIGINT AS disjoint_types FROM customer WHERE c_mktsegment = 'BUILDING'")
def consistency(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    g = Graph.of(emit(c, node("customer", "c_custkey"), [(T.TYPE, F.lit(ex("Person"))), (T.TYPE, F.when(F.col("c_mktsegment") == "BUILDING", F.lit(ex("Firm"))))]))
    claims = literal_rows(spark, [(ex("Person"), T.DISJOINT, ex("Firm")), (ex("a"), T.SAME_AS, ex("b")), (ex("b"), f"<{T.OWL}differentFrom>", ex("a"))])
    out = L.consistency(g, claims)
    return spark.createDataFrame([(out["same_different"], out["disjoint_types"])], "same_different long, disjoint_types long")


# records -----------------------------------------------------------------------------------------


@contract("stereo_overlap_join", """
WITH b AS (SELECT event_id, user_id, ((event_id * 3) % 10)::DOUBLE AS x, ((event_id * 7) % 11)::DOUBLE AS y FROM events),
p AS (SELECT a.event_id AS a, c.event_id AS b, greatest(least(a.x, c.x) + 4 - greatest(a.x, c.x), 0) * greatest(least(a.y, c.y) + 4 - greatest(a.y, c.y), 0) / 16 AS o
  FROM b AS a JOIN b AS c ON a.user_id = c.user_id AND a.event_id < c.event_id)
SELECT a, b, round(o, 6) AS o FROM p WHERE o BETWEEN 0.3 AND 0.95""")
def stereo(spark, sf_dir):
    x, y = ((F.col("event_id") * 3) % 10).cast("double"), ((F.col("event_id") * 7) % 11).cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 4).alias("x1"), (y + 4).alias("y1"))
    frames = table(spark, sf_dir, "events").select("event_id", "user_id", box.alias("box"))
    return R.stereo_pairs(frames, "user_id", "event_id", "event_id", cell=4.0).select("a", "b", F.round("overlap", 6).alias("o"))


@contract("date_normalise", """
SELECT o_orderkey, CASE WHEN k = 4 THEN NULL WHEN k = 3 THEN strftime(o_orderdate, '%Y') WHEN k = 2 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value,
  CASE k WHEN 4 THEN NULL WHEN 3 THEN 'gYear' WHEN 2 THEN 'gYearMonth' ELSE 'date' END AS kind, CASE WHEN k < 4 THEN k = 3 END AS approximate
FROM (SELECT *, o_orderkey % 5 AS k FROM orders)""")
def dates(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "d MMMM yyyy")).when(k == 2, F.date_format(d, "MMMM yyyy")).when(k == 3, F.concat(F.lit("circa "), F.date_format(d, "yyyy"))).otherwise("undated")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.partial_date(text).alias("d")).select("o_orderkey", "d.value", "d.kind", "d.approximate")


@contract("record_distribution", "SELECT lang AS value, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 1) AS percent FROM documents GROUP BY lang")
def distribution(spark, sf_dir):
    return R.distribution(table(spark, sf_dir, "documents"), F.col("lang"))


@contract("rule_cascade", """
SELECT p_type IS NULL AS actual, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'A' WHEN p_size IN (1, 2, 3) THEN 'B' ELSE 'C' END AS predicted, count(*)::BIGINT AS n FROM part GROUP BY ALL""")
def cascade(spark, sf_dir):
    rules = [R.Rule("A", "brand", {"p_brand": ["Brand#11", "Brand#12"]}), R.Rule("B", "size", {"p_size": [1, 2, 3]})]
    return R.confusion(R.cascade(table(spark, sf_dir, "part").withColumn("actual", F.col("p_type").isNull()), rules, "C"), "actual")


@contract("verify_references", f"""
SELECT c_custkey AS id, CASE WHEN n_nationkey IS NULL OR n_nationkey > 20 THEN 'missing' WHEN n_regionkey = 1 THEN 'ok' ELSE 'wrong_type' END AS status FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def verify(spark, sf_dir):
    refs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("ref"))
    known = table(spark, sf_dir, "nation").where("n_nationkey <= 20").select(F.col("n_nationkey").alias("ref"), F.array(F.col("n_regionkey").cast("string")).alias("types"))
    return R.verify_references(refs, known, ["1"]).select("id", "status")


@contract("column_coverage", "SELECT k AS \"column\", bool_or(contains(lower(n_name), k)) AS covered FROM nation, (VALUES ('an'), ('zz'), ('ia')) t(k) GROUP BY k")
def coverage(spark, sf_dir):
    cols = spark.createDataFrame([("an", "an"), ("zz", "zz"), ("ia", "IA")], "column string, keyword string")
    return R.column_coverage(cols, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


@contract("all_parts_under", f"""
SELECT {_iri('order', 'o_custkey')} AS whole FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey HAVING bool_and(o_orderstatus = 'F')""")
def all_parts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kinds = emit(orders, node("o", "o_orderkey"), [(T.TYPE, F.concat(F.lit(f"<{EX}status/"), F.col("o_orderstatus"), F.lit(">")))])
    g = Graph.of(kinds.unionByName(literal_rows(spark, [(f"<{EX}status/F>", T.SUBCLASS, ex("Filled")), (ex("Filled"), T.SUBCLASS, ex("Done"))])))
    parts = orders.select(node("order", "o_custkey").alias("whole"), node("o", "o_orderkey").alias("part"))
    return R.all_parts_under(parts, g, ex("Done"))


@contract("axiom_extraction", """
WITH b AS (SELECT DISTINCT lower(replace(p_type, '_', ' ')) AS t FROM part)
SELECT 'subclassof' AS kind, t AS a, 'part' AS b FROM b UNION ALL SELECT 'domain', 'has size', 'part' UNION ALL SELECT 'disjoint', least(x.t, y.t), greatest(x.t, y.t) FROM b x JOIN b y ON x.t < y.t""")
def axiom_extraction(spark, sf_dir):
    kinds = table(spark, sf_dir, "part").select("p_type").distinct()
    iri = node("class", F.replace(F.col("p_type"), F.lit(" "), F.lit("_")))
    named = emit(kinds, iri, [(T.TYPE, F.lit(T.CLASS)), (T.SUBCLASS, F.lit(ex("Part"))), (T.LABEL, T.plain_literal(F.col("p_type")))])
    ranked = kinds.withColumn("k", F.dense_rank().over(Window.orderBy("p_type")))
    cell = lambda k: F.concat(F.lit("_:c"), k.cast("string"))
    last = ranked.agg(F.max("k")).first()[0]
    cells = emit(ranked, cell(F.col("k")), [(T.FIRST, iri), (T.REST, F.when(F.col("k") == last, F.lit(T.NIL)).otherwise(cell(F.col("k") + 1)))])
    rest = literal_rows(spark, [("_:all", T.TYPE, f"<{T.OWL}AllDisjointClasses>"), ("_:all", f"<{T.OWL}members>", "_:c1"), (ex("hasSize"), T.TYPE, T.DATATYPE_PROPERTY), (ex("hasSize"), T.DOMAIN, ex("Part"))])
    return R.axioms(Graph.of(named.unionByName(cells).unionByName(rest)))


@contract("windowed_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed(spark, sf_dir):
    out = windowed_counts(table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@contract("footprints", """
SELECT s_suppkey, round(h * 230 * 9000 / 152.4 / 2 / 111111.0, 6)::DOUBLE AS half FROM supplier, (VALUES (1.0)) t(h)""")
def footprints(spark, sf_dir):
    lat, lon = (F.col("s_suppkey") % 60).cast("double"), (F.col("s_suppkey") % 170).cast("double")
    box = R.bounds(R.footprint(lat, lon, F.lit(9000.0), F.lit(152.4)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(box["y1"] - lat, 6).alias("half"))


@contract("sparql_count_by_suffix", f"SELECT {_iri('region', 'n_regionkey')} AS r, count(*)::BIGINT AS n FROM nation WHERE ends_with(n_name, '1') GROUP BY 1")
def count_by_suffix(spark, sf_dir):
    out = graph_of(spark, sf_dir, "nation").query('SELECT ?r (COUNT(?n) AS ?k) WHERE { ?n ex:region ?r ; rdfs:label ?l FILTER(STRENDS(?l, "1")) } GROUP BY ?r', PREFIXES)
    return out.select("r", T.lex(F.col("k")).cast("long").alias("n"))
