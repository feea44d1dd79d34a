"""Contract queries of mapping, reasoning, statistics and checks over the graph views."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.operators import checks, mapping
from graphloom.plans.reason import reason
from graphloom.plans.views import EX, emit, ex, graph_of, literal_rows, node, part_classes, table, values

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


def _dec(c: str) -> str:
    return f"'\"' || {c}::DECIMAL(18,2) || '\"^^<{T.DECIMAL}>'"


# mapping -----------------------------------------------------------------------------------------


@contract("map_customer_triples", f"""
SELECT {_iri('customer', 'c_custkey')} AS s, '{T.TYPE}' AS p, '<http://example.org/Customer>' AS o FROM customer
UNION ALL SELECT {_iri('customer', 'c_custkey')}, '<http://example.org/name>', {_lit('c_name')} FROM customer WHERE c_name <> ''
UNION ALL SELECT {_iri('customer', 'c_custkey')}, '<http://example.org/nation>', '<http://example.org/customer/' || c_nationkey || '>' FROM customer
UNION ALL SELECT {_iri('customer', 'c_custkey')}, '<http://example.org/key>', '"' || c_custkey || '"^^<{T.INTEGER}>' FROM customer""")
def map_customer(spark, sf_dir):
    fields = [mapping.Field("c_name", f"{EX}name", T.STRING), mapping.Field("c_nationkey", f"{EX}nation", lookup=True), mapping.Field("c_custkey", f"{EX}key", T.INTEGER)]
    return mapping.rows_to_triples(table(spark, sf_dir, "customer"), mapping.Mapping(f"{EX}customer/", "c_custkey", f"{EX}Customer", fields))


@contract("map_auto_headers", f"""
WITH n AS (SELECT *, '<http://example.org/data/' || n_nationkey || '>' AS s FROM (SELECT * EXCLUDE n_name, n_name FROM nation)),
r AS (SELECT '<http://example.org/data/' || replace(n_name, ' ', '_') || '>' AS s, * FROM nation)
SELECT s, '{T.TYPE}' AS p, '<http://example.org/data/Thing>' AS o FROM r
UNION ALL SELECT s, '<http://example.org/data/ont#n_name>', {_lit('n_name')} FROM r
UNION ALL SELECT s, '<http://example.org/data/ont#n_nationkey>', {_lit('n_nationkey')} FROM r
UNION ALL SELECT s, '<http://example.org/data/ont#n_regionkey>', {_lit('n_regionkey')} FROM r""")
def map_auto(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return mapping.rows_to_triples(df, mapping.Mapping.from_headers(df.columns))


@contract("map_lookup_links", f"""
SELECT '<http://example.org/orders/' || o_orderkey || '>' AS s, '{T.TYPE}' AS p, '<http://example.org/Order>' AS o FROM orders
UNION ALL SELECT '<http://example.org/orders/' || o_orderkey || '>', '<http://example.org/priority>', '<http://example.org/orders/' || replace(o_orderpriority, ' ', '_') || '>' FROM orders""")
def map_lookup(spark, sf_dir):
    return mapping.rows_to_triples(table(spark, sf_dir, "orders"), mapping.Mapping(f"{EX}orders/", "o_orderkey", f"{EX}Order", [mapping.Field("o_orderpriority", f"{EX}priority", lookup=True)]))


@contract("map_escaping", f"""
SELECT '<http://example.org/d/' || doc_id || '>' AS s, '<http://example.org/text>' AS p,
  '"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"' AS o FROM documents WHERE text <> ''
UNION ALL SELECT '<http://example.org/d/' || doc_id || '>', '{T.TYPE}', '<http://example.org/Doc>' FROM documents""")
def map_escaping(spark, sf_dir):
    return mapping.rows_to_triples(table(spark, sf_dir, "documents"), mapping.Mapping(f"{EX}d/", "doc_id", f"{EX}Doc", [mapping.Field("text", f"{EX}text")]))


@contract("schema_to_owl", f"""
WITH cols(t, c, x, pk, fk, nn) AS (VALUES
  ('region', 'r_regionkey', 'integer', true, NULL, true), ('region', 'r_name', 'string', false, NULL, true),
  ('nation', 'n_nationkey', 'integer', true, NULL, true), ('nation', 'n_name', 'string', false, NULL, false), ('nation', 'n_regionkey', 'integer', false, 'Region', false)),
named AS (SELECT *, '<http://example.org/db/' || upper(t[1]) || t[2:] || '>' AS k, '<http://example.org/db/' || t || '_' || c || '>' AS q, '_:r_' || t || '_' || c AS b FROM cols)
SELECT DISTINCT k AS s, '{T.TYPE}' AS p, '{T.CLASS}' AS o FROM named
UNION ALL SELECT DISTINCT k, '{T.LABEL}', {_lit('t')} FROM named
UNION ALL SELECT q, '{T.TYPE}', CASE WHEN fk IS NULL THEN '{T.DATATYPE_PROPERTY}' ELSE '{T.OBJECT_PROPERTY}' END FROM named
UNION ALL SELECT q, '{T.LABEL}', {_lit('c')} FROM named
UNION ALL SELECT q, '{T.DOMAIN}', k FROM named
UNION ALL SELECT q, '{T.RANGE}', CASE WHEN fk IS NULL THEN '<{T.XSD}' || x || '>' ELSE '<http://example.org/db/' || fk || '>' END FROM named
UNION ALL SELECT q, '{T.TYPE}', '<{T.OWL}FunctionalProperty>' FROM named WHERE pk
UNION ALL SELECT k, '{T.SUBCLASS}', b FROM named WHERE nn
UNION ALL SELECT b, '{T.TYPE}', '{T.RESTRICTION}' FROM named WHERE nn
UNION ALL SELECT b, '{T.ON_PROPERTY}', q FROM named WHERE nn
UNION ALL SELECT b, '<{T.OWL}minCardinality>', '"1"^^<{T.XSD}nonNegativeInteger>' FROM named WHERE nn""")
def schema_to_owl(spark, sf_dir):
    tables = [mapping.introspect("region", table(spark, sf_dir, "region"), "r_regionkey", not_null=["r_name"]), mapping.introspect("nation", table(spark, sf_dir, "nation"), "n_nationkey", {"n_regionkey": "region"})]
    return literal_rows(spark, mapping.schema_triples(tables))


# reasoning ---------------------------------------------------------------------------------------

_LEAF = "'<http://example.org/class/' || replace(p_type, ' ', '_') || '/' || replace(p_brand, ' ', '_') || '>'"
_UP = "'<http://example.org/class/' || replace(p_type, ' ', '_') || '>'"
_PART = "'<http://example.org/Part>'"


@contract("reason_subclass_closure", f"""
WITH RECURSIVE e(s, o) AS (SELECT DISTINCT {_LEAF}, {_UP} FROM part UNION SELECT DISTINCT {_UP}, {_PART} FROM part),
c(s, o) AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s)
SELECT s, '{T.SUBCLASS}' AS p, o FROM c EXCEPT SELECT s, '{T.SUBCLASS}', o FROM e""")
def subclass_closure(spark, sf_dir):
    return reason(part_classes(spark, sf_dir), "rdfs").inferred.where(F.col("p") == T.SUBCLASS)


@contract("reason_type_inherit", f"""
SELECT {_iri('part', 'p_partkey')} AS s, '{T.TYPE}' AS p, {_UP} AS o FROM part
UNION SELECT {_iri('part', 'p_partkey')}, '{T.TYPE}', {_PART} FROM part""")
def type_inherit(spark, sf_dir):
    return reason(part_classes(spark, sf_dir), "rdfs").inferred.where(F.col("p") == T.TYPE)


def _placed(spark, sf_dir, *axioms):
    """Orders with their buyers and totals, and axioms; the keys of the orders make the triples distinct already."""
    own = emit(table(spark, sf_dir, "orders"), node("order", "o_orderkey"), [(ex("placedBy"), node("customer", "o_custkey")), (ex("total"), T.typed_literal(F.col("o_totalprice").cast("decimal(18,2)"), T.DECIMAL))])
    return Graph(own.unionByName(literal_rows(spark, list(axioms))).withColumn("g", F.lit(None).cast("string")))


@contract("reason_domain_range", f"""
SELECT {_iri('order', 'o_orderkey')} AS s, '{T.TYPE}' AS p, '<http://example.org/Order>' AS o FROM orders
UNION SELECT {_iri('customer', 'o_custkey')}, '{T.TYPE}', '<http://example.org/Buyer>' FROM orders""")
def domain_range(spark, sf_dir):
    g = _placed(spark, sf_dir, (ex("placedBy"), T.DOMAIN, ex("Order")), (ex("placedBy"), T.RANGE, ex("Buyer")), (ex("total"), T.RANGE, ex("Money")))
    return reason(g, "rdfs").inferred


@contract("reason_subproperty", f"""
SELECT {_iri('order', 'o_orderkey')} AS s, '<http://example.org/' || p || '>' AS p, {_iri('customer', 'o_custkey')} AS o FROM orders, (VALUES ('involves'), ('relatesTo')) t(p)
UNION ALL SELECT '<http://example.org/placedBy>', '{T.SUBPROPERTY}', '<http://example.org/relatesTo>'""")
def subproperty(spark, sf_dir):
    g = _placed(spark, sf_dir, (ex("placedBy"), T.SUBPROPERTY, ex("involves")), (ex("involves"), T.SUBPROPERTY, ex("relatesTo")))
    return reason(g, "rdfs").inferred


_T = "'<http://example.org/turn/' || conv_id || '/' || {} || '>'"


@contract("reason_transitive", f"""
SELECT '<http://example.org/turn/' || a.conv_id || '/' || a.turn || '>' AS s, '<http://example.org/next>' AS p, '<http://example.org/turn/' || b.conv_id || '/' || b.turn || '>' AS o
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 < b.turn""")
def transitive(spark, sf_dir):
    g = graph_of(spark, sf_dir, "conversations").add(literal_rows(spark, [(ex("next"), T.TYPE, f"<{T.OWL}TransitiveProperty>")]))
    return reason(g, "owl-rl").inferred


@contract("reason_symmetric", f"""
WITH e AS (SELECT {_iri('nation', 'n_nationkey')} AS s, {_iri('nation', '((n_nationkey + 1) % 25)')} AS o FROM nation)
SELECT o AS s, '<http://example.org/borders>' AS p, s AS o FROM e EXCEPT SELECT s, '<http://example.org/borders>', o FROM e""")
def symmetric(spark, sf_dir):
    df = emit(table(spark, sf_dir, "nation"), node("nation", "n_nationkey"), [(ex("borders"), node("nation", (F.col("n_nationkey") + 1) % 25))])
    return reason(Graph.of(df.unionByName(literal_rows(spark, [(ex("borders"), T.TYPE, f"<{T.OWL}SymmetricProperty>")]))), "owl-rl").inferred


@contract("reason_inverse", f"SELECT {_iri('region', 'n_regionkey')} AS s, '<http://example.org/hasNation>' AS p, {_iri('nation', 'n_nationkey')} AS o FROM nation")
def inverse(spark, sf_dir):
    g = graph_of(spark, sf_dir, "nation").add(literal_rows(spark, [(ex("region"), T.INVERSE_OF, ex("hasNation"))]))
    return reason(g, "owl-rl").inferred


@contract("reason_equivalent", f"""
SELECT {_iri('part', 'p_partkey')} AS s, '{T.TYPE}' AS p, '<http://example.org/Item>' AS o FROM part
UNION ALL SELECT {_iri('part', 'p_partkey')}, '<http://example.org/cost>', {_dec('p_retailprice')} FROM part
UNION ALL VALUES ('<http://example.org/Part>', '{T.SUBCLASS}', '<http://example.org/Item>'), ('<http://example.org/Item>', '{T.SUBCLASS}', '<http://example.org/Part>'),
  ('<http://example.org/price>', '{T.SUBPROPERTY}', '<http://example.org/cost>'), ('<http://example.org/cost>', '{T.SUBPROPERTY}', '<http://example.org/price>')""")
def equivalent(spark, sf_dir):
    axioms = [(ex("Part"), T.EQUIVALENT_CLASS, ex("Item")), (ex("price"), T.EQUIVALENT_PROPERTY, ex("cost"))]
    return reason(graph_of(spark, sf_dir, "part").add(literal_rows(spark, axioms)), "owl-rl").inferred


@contract("reason_sameas", f"SELECT {_iri('sku', 'p_partkey')} AS s, '{T.SAME_AS}' AS p, {_iri('part', 'p_partkey')} AS o FROM part")
def same_as(spark, sf_dir):
    return reason(Graph.of(emit(table(spark, sf_dir, "part"), node("part", "p_partkey"), [(T.SAME_AS, node("sku", "p_partkey"))])), "owl-rl").inferred


def _typed_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    own = emit(c, node("customer", "c_custkey"), [(T.TYPE, F.concat(F.lit(f"<{EX}segment/"), F.col("c_mktsegment"), F.lit(">"))), (T.TYPE, F.when(F.col("c_acctbal") > 5000, F.lit(ex("Rich")))), (ex("nation"), node("nation", "c_nationkey"))])
    orders = emit(table(spark, sf_dir, "orders"), node("customer", "o_custkey"), [(ex("placed"), node("order", "o_orderkey"))])
    kinds = emit(table(spark, sf_dir, "orders"), node("order", "o_orderkey"), [(T.TYPE, F.when(F.col("o_orderstatus") == "F", F.lit(ex("Filled"))))])
    return own.unionByName(orders).unionByName(kinds)


_B = "_:b"
_OWL = lambda n: f"<{T.OWL}{n}>"


@contract("reason_some_values", f"""
SELECT DISTINCT {_iri('customer', 'o_custkey')} AS s, '{T.TYPE}' AS p, '_:some' AS o FROM orders WHERE o_orderstatus = 'F'""")
def some_values(spark, sf_dir):
    axioms = [("_:some", T.TYPE, T.RESTRICTION), ("_:some", T.ON_PROPERTY, ex("placed")), ("_:some", _OWL("someValuesFrom"), ex("Filled"))]
    return reason(Graph.of(_typed_customers(spark, sf_dir).unionByName(literal_rows(spark, axioms))), "owl-rl-ext").inferred


@contract("reason_has_value", f"""
SELECT {_iri('customer', 'c_custkey')} AS s, '{T.TYPE}' AS p, '_:in3' AS o FROM customer WHERE c_nationkey = 3 OR c_acctbal > 5000
UNION ALL SELECT {_iri('customer', 'c_custkey')}, '<http://example.org/nation>', {_iri('nation', '3')} FROM customer WHERE c_acctbal > 5000 AND c_nationkey <> 3""")
def has_value(spark, sf_dir):
    axioms = [("_:in3", T.ON_PROPERTY, ex("nation")), ("_:in3", _OWL("hasValue"), f"<{EX}nation/3>"), (ex("Rich"), T.SUBCLASS, "_:in3")]
    return reason(Graph.of(_typed_customers(spark, sf_dir).unionByName(literal_rows(spark, axioms))), "owl-rl-ext").inferred


@contract("reason_intersection", f"SELECT {_iri('customer', 'c_custkey')} AS s, '{T.TYPE}' AS p, '<http://example.org/RichBuilder>' AS o FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def intersection(spark, sf_dir):
    axioms = [(ex("RichBuilder"), _OWL("intersectionOf"), "_:l1"), ("_:l1", T.FIRST, ex("Rich")), ("_:l1", T.REST, "_:l2"), ("_:l2", T.FIRST, f"<{EX}segment/BUILDING>"), ("_:l2", T.REST, T.NIL)]
    return reason(Graph.of(_typed_customers(spark, sf_dir).unionByName(literal_rows(spark, axioms))), "owl-rl-ext").inferred


@contract("reason_union", f"SELECT {_iri('customer', 'c_custkey')} AS s, '{T.TYPE}' AS p, '<http://example.org/RichOrBuilder>' AS o FROM customer WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING'")
def union_of(spark, sf_dir):
    axioms = [(ex("RichOrBuilder"), _OWL("unionOf"), "_:l1"), ("_:l1", T.FIRST, ex("Rich")), ("_:l1", T.REST, "_:l2"), ("_:l2", T.FIRST, f"<{EX}segment/BUILDING>"), ("_:l2", T.REST, T.NIL)]
    return reason(Graph.of(_typed_customers(spark, sf_dir).unionByName(literal_rows(spark, axioms))), "owl-rl-ext").inferred


# statistics and checks ---------------------------------------------------------------------------


@contract("stats_graph", """
SELECT (SELECT count(*) FROM nation)::BIGINT * 3 + (SELECT count(*) FROM region) * 2 + 2 AS triples, 2::BIGINT AS classes, 1::BIGINT AS properties,
       ((SELECT count(*) FROM nation) + (SELECT count(*) FROM region))::BIGINT AS individuals, 1::BIGINT AS object_properties, 0::BIGINT AS data_properties""")
def stats_graph(spark, sf_dir):
    schema = literal_rows(spark, [(ex("region"), T.DOMAIN, ex("Nation")), (ex("region"), T.RANGE, ex("Region"))])
    return checks.stats(graph_of(spark, sf_dir, "nation", "region").add(schema))


@contract("diff_triples", f"""
WITH a AS (SELECT {_iri('supplier', 's_suppkey')} AS s, '<http://example.org/acctbal>' AS p, {_dec('s_acctbal')} AS o FROM supplier),
b AS (SELECT {_iri('supplier', 's_suppkey')} AS s, '<http://example.org/acctbal>' AS p, {_dec('CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END')} AS o FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT 'added' AS change, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def diff_triples(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    value = lambda c: [(ex("acctbal"), T.typed_literal(c.cast("decimal(18,2)"), T.DECIMAL))]
    old = Graph.of(emit(s, node("supplier", "s_suppkey"), value(F.col("s_acctbal"))))
    new = Graph.of(emit(s.where("s_suppkey % 7 <> 0"), node("supplier", "s_suppkey"), value(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))))
    return checks.diff(old, new)


def _linted(spark, sf_dir):
    extra = [(ex("p1"), T.TYPE, T.OBJECT_PROPERTY), (ex("p2"), T.TYPE, T.DATATYPE_PROPERTY), (ex("p2"), T.DOMAIN, ex("Part"))]
    return part_classes(spark, sf_dir).add(literal_rows(spark, extra))


_LINT = f"""
SELECT 'missing_label' AS rule, 'warning' AS severity, {_LEAF} AS entity FROM (SELECT DISTINCT p_type, p_brand FROM part)
UNION ALL SELECT 'missing_comment', 'warning', {_LEAF} FROM (SELECT DISTINCT p_type, p_brand FROM part)
UNION ALL SELECT 'missing_comment', 'warning', {_UP} FROM (SELECT DISTINCT p_type FROM part)
UNION ALL SELECT 'missing_domain', 'info', '<http://example.org/p1>'"""


@contract("lint_issues", _LINT)
def lint_issues(spark, sf_dir):
    return checks.lint(_linted(spark, sf_dir))


@contract("lint_feedback", f"""
WITH i AS ({_LINT}), v AS (SELECT *, length(entity) % 4 AS no FROM i)
SELECT rule, CASE WHEN no >= 2 THEN 'info' ELSE severity END AS severity, entity FROM v WHERE no < 3""")
def lint_feedback(spark, sf_dir):
    issues = checks.lint(_linted(spark, sf_dir))
    votes = issues.select(F.lit("lint").alias("tool"), F.col("rule").alias("rule_id"), "entity", F.lit(False).alias("accepted"), F.explode(F.when(F.length("entity") % 4 > 0, F.sequence(F.lit(1), F.length("entity") % 4))).alias("k"))
    return checks.apply_feedback(issues, votes, "lint")


@contract("enforce_generic", f"""
SELECT 'missing_label' AS rule, {_LEAF} AS entity FROM (SELECT DISTINCT p_type, p_brand FROM part)
UNION ALL VALUES ('missing_domain', '<http://example.org/p1>'), ('missing_range', '<http://example.org/p1>'), ('missing_range', '<http://example.org/p2>')""")
def enforce_generic(spark, sf_dir):
    return checks.enforce(_linted(spark, sf_dir), "generic").select("rule", "entity")


@contract("enforce_partition", f"""
WITH k AS (SELECT DISTINCT {_UP} AS k FROM part)
SELECT 'not_disjoint' AS rule, {_PART} AS entity, 'not disjoint: ' || a.k || ' ' || b.k AS message FROM k a JOIN k b ON a.k < b.k""")
def enforce_partition(spark, sf_dir):
    return checks.enforce(part_classes(spark, sf_dir), "value_partition").select("rule", "entity", "message")


@contract("enforce_hierarchy", f"""
WITH kids AS (SELECT DISTINCT {_UP} AS e, {_LEAF} AS k FROM part UNION SELECT DISTINCT {_PART}, {_UP} FROM part)
SELECT 'flat_hierarchy' AS rule, e AS entity FROM kids GROUP BY e HAVING count(*) > 5
UNION ALL SELECT 'shallow_hierarchy', '(hierarchy)'
UNION ALL SELECT 'low_avg_depth', '(hierarchy)' FROM (SELECT avg(d) AS d FROM (SELECT 2 AS d FROM (SELECT DISTINCT p_type, p_brand FROM part) UNION ALL SELECT 1 FROM (SELECT DISTINCT p_type FROM part))) WHERE d < 2
UNION ALL SELECT 'low_hierarchy_density', '(hierarchy)' FROM (SELECT 1.0 * (l + u) / (2 * l + 3 * u + n) AS x FROM (SELECT count(DISTINCT p_type || p_brand) AS l, count(DISTINCT p_type) AS u, count(*) AS n FROM part)) WHERE x < 0.05""")
def enforce_hierarchy(spark, sf_dir):
    return checks.enforce(part_classes(spark, sf_dir), "hierarchy").select("rule", "entity")


_SHAPE = lambda kind, path, value, target="Customer": checks.Constraint(ex(target), ex(path), kind, value, message="m")


def _ordered(spark, sf_dir):
    link = emit(table(spark, sf_dir, "orders"), node("customer", "o_custkey"), [(ex("placed"), node("order", "o_orderkey"))])
    return graph_of(spark, sf_dir, "customer").add(link)


@contract("shacl_mincount", f"""
SELECT {_iri('customer', 'c_custkey')} AS focus_node, count(o_orderkey)::VARCHAR AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 8""")
def shacl_min(spark, sf_dir):
    return checks.validate_shapes(_ordered(spark, sf_dir), [_SHAPE("min_count", "placed", "8")]).select("focus_node", "value")


@contract("shacl_maxcount", f"""
SELECT {_iri('customer', 'c_custkey')} AS focus_node, count(*)::VARCHAR AS value FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) > 12""")
def shacl_max(spark, sf_dir):
    return checks.validate_shapes(_ordered(spark, sf_dir), [_SHAPE("max_count", "placed", "12")]).select("focus_node", "value")


@contract("shacl_datatype", f"""
SELECT {_iri('customer', 'c_custkey')} AS focus_node, '<http://example.org/' || p || '>' AS path, v AS value FROM customer, LATERAL (VALUES ('acctbal', {_dec('c_acctbal')}), ('segment', {_lit('c_mktsegment')})) t(p, v)
WHERE p = 'acctbal'""")
def shacl_datatype(spark, sf_dir):
    shapes = [_SHAPE("datatype", "acctbal", f"<{T.INTEGER}>"), _SHAPE("datatype", "segment", f"<{T.STRING}>"), _SHAPE("datatype", "nation", f"<{T.STRING}>")]
    return checks.validate_shapes(graph_of(spark, sf_dir, "customer"), shapes).select("focus_node", "path", "value")


@contract("shacl_from_turtle", f"""
SELECT {_iri('customer', 'c_custkey')} AS focus_node, 'min_count' AS kind FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 5
UNION ALL SELECT {_iri('customer', 'c_custkey')}, 'datatype' FROM customer""")
def shacl_from_turtle(spark, sf_dir):
    from graphloom.sources.rdf import parse_turtle

    shapes = parse_turtle("""@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <http://example.org/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
      ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:property [ sh:path ex:placed ; sh:minCount 5 ], [ sh:path ex:name ; sh:datatype xsd:integer ; sh:minCount 1 ] .""")
    found = checks.validate_shapes(_ordered(spark, sf_dir), checks.shapes_from_triples([t[:3] for t in shapes]))
    return found.select("focus_node", "kind")


@contract("partitioned_shacl", """
SELECT source AS partition, count_if(n_chars < 100) = 0 AS conforms, count_if(n_chars < 100)::BIGINT AS violations FROM documents GROUP BY source""")
def partitioned_shacl(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    g = Graph.of(emit(docs, node("document", "doc_id"), [(T.TYPE, F.lit(ex("Document"))), (ex("chars"), T.typed_literal(F.col("n_chars"), T.INTEGER))]))
    parts = docs.select(node("document", "doc_id").alias("focus_node"), F.col("source").alias("partition"))
    return checks.validate_partitioned(g, [_SHAPE("min_inclusive", "chars", "100", "Document")], parts)


@contract("ntriples_round_trip", f"""
SELECT {_iri('customer', 'c_custkey')} AS s, '<http://example.org/name>' AS p, {_lit('c_name')} AS o FROM customer
UNION ALL SELECT {_iri('customer', 'c_custkey')}, '<http://example.org/acctbal>', {_dec('c_acctbal')} FROM customer""")
def ntriples_round_trip(spark, sf_dir):
    from graphloom.session import shared_dir
    from graphloom.sources.rdf import read_ntriples, write_ntriples

    import uuid

    path = f"{shared_dir(spark)}/graphloom-nt-{uuid.uuid4().hex}"
    write_ntriples(graph_of(spark, sf_dir, "customer"), path)
    back = Graph.of(read_ntriples(spark, path))
    return back.with_predicate(ex("name"), ex("acctbal"))


@contract("values_native", "SELECT r_name AS name FROM region")
def values_native(spark, sf_dir):
    return values(graph_of(spark, sf_dir, "region").query("SELECT ?name WHERE { ?r rdfs:label ?name }"), name="string")
