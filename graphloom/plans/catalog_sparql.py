"""Contract queries of the SPARQL algebra over the graph views, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.plans.reason import reason
from graphloom.plans.views import EX, PREFIXES, emit, ex, graph_of, literal_rows, node, table, values

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


def _run(g: Graph, text: str):
    return g.query(text, PREFIXES)


@contract("sparql_flagship", f"""
SELECT {_iri('region', 'n_regionkey')} AS region, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey""")
def flagship(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    kinds = F.concat(F.lit(f"<{EX}segment/"), F.col("c_mktsegment"), F.lit(">"))
    typed = emit(customers, node("customer", "c_custkey"), [(T.TYPE, kinds), (ex("nation"), node("nation", "c_nationkey"))])
    schema = customers.select(kinds.alias("s")).distinct().select("s", F.lit(T.SUBCLASS).alias("p"), F.lit(ex("Customer")).alias("o"))
    top = literal_rows(spark, [(ex("Customer"), T.SUBCLASS, ex("Party"))])
    nations = graph_of(spark, sf_dir, "nation").triples
    g = Graph.of(typed.unionByName(schema).unionByName(top).unionByName(nations))
    closed = reason(g, "rdfs").graph
    return values(_run(closed, "SELECT ?region (COUNT(?c) AS ?n) WHERE { ?c a ex:Party ; ex:nation ?k . ?k ex:region ?region } GROUP BY ?region"), n="long")


@contract("sparql_bgp_join", f"""
SELECT {_iri('customer', 'c_custkey')} AS c, {_lit('n_name')} AS nation, {_lit('r_name')} AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def bgp_join(spark, sf_dir):
    g = graph_of(spark, sf_dir, "customer", "nation", "region")
    return _run(g, "SELECT ?c ?nation ?region WHERE { ?c a ex:Customer ; ex:nation ?n . ?n rdfs:label ?nation ; ex:region ?r . ?r rdfs:label ?region }")


@contract("sparql_repeated_variable", f"SELECT {_iri('nation', 'n_nationkey')} AS n FROM nation WHERE n_nationkey = n_regionkey")
def repeated_variable(spark, sf_dir):
    loops = emit(table(spark, sf_dir, "nation"), node("nation", "n_nationkey"), [(ex("like"), node("nation", "n_regionkey"))])
    return _run(Graph.of(loops), "SELECT ?n WHERE { ?n ex:like ?n }")


@contract("sparql_optional", f"""
SELECT {_iri('customer', 'c_custkey')} AS c, {_iri('order', 'o_orderkey')} AS o
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice::DECIMAL(18,2) > 200000""")
def optional(spark, sf_dir):
    g = graph_of(spark, sf_dir, "customer", "orders")
    return _run(g, "SELECT ?c ?o WHERE { ?c a ex:Customer OPTIONAL { ?o ex:placedBy ?c ; ex:total ?t FILTER(?t > 200000) } }")


@contract("sparql_optional_compat", f"""
WITH a AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name END AS l FROM part),
b AS (SELECT p_partkey, p_brand AS l FROM part)
SELECT {_iri('part', 'a.p_partkey')} AS p, {_lit('coalesce(a.l, b.l)')} AS l
FROM a LEFT JOIN b ON a.p_partkey = b.p_partkey AND (a.l IS NULL OR a.l = b.l)""")
def optional_compat(spark, sf_dir):
    g = graph_of(spark, sf_dir, "part")
    return _run(g, "SELECT ?p ?l WHERE { ?p a ex:Part OPTIONAL { ?p rdfs:label ?l ; ex:size ?s FILTER(?s > 25) } OPTIONAL { ?p ex:brand ?l } }")


@contract("sparql_union", f"""
SELECT {_iri('customer', 'c_custkey')} AS x, {_lit('c_name')} AS name FROM customer
UNION ALL SELECT {_iri('supplier', 's_suppkey')}, {_lit('s_name')} FROM supplier""")
def union(spark, sf_dir):
    g = graph_of(spark, sf_dir, "customer", "supplier")
    return _run(g, "SELECT ?x ?name WHERE { { ?x a ex:Customer ; ex:name ?name } UNION { ?x a ex:Supplier ; ex:name ?name } }")


@contract("sparql_distinct", f"SELECT DISTINCT {_iri('nation', 'k')} AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def distinct(spark, sf_dir):
    return _run(graph_of(spark, sf_dir, "customer", "supplier"), "SELECT DISTINCT ?n WHERE { ?x ex:nation ?n }")


@contract("sparql_not_exists", f"SELECT {_iri('customer', 'c_custkey')} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists(spark, sf_dir):
    return _run(graph_of(spark, sf_dir, "customer", "orders"), "SELECT ?c WHERE { ?c a ex:Customer FILTER NOT EXISTS { ?o ex:placedBy ?c } }")


@contract("sparql_exists", f"SELECT {_iri('customer', 'c_custkey')} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice::DECIMAL(18,2) > 300000)")
def exists(spark, sf_dir):
    return _run(graph_of(spark, sf_dir, "customer", "orders"), "SELECT ?c WHERE { ?c a ex:Customer FILTER EXISTS { ?o ex:placedBy ?c ; ex:total ?t FILTER(?t > 300000) } }")


@contract("sparql_exists_correlated", f"""
SELECT {_iri('customer', 'c_custkey')} AS c FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice::DECIMAL(18,2) < c_acctbal::DECIMAL(18,2) * 2) OR c_mktsegment = 'BUILDING'""")
def exists_correlated(spark, sf_dir):
    return _run(graph_of(spark, sf_dir, "customer", "orders"), 'SELECT ?c WHERE { ?c a ex:Customer ; ex:acctbal ?b ; ex:segment ?s FILTER (EXISTS { ?o ex:placedBy ?c ; ex:total ?t FILTER(?t < ?b * 2) } || ?s = "BUILDING") }')


@contract("sparql_minus", f"SELECT {_iri('customer', 'c_custkey')} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def minus(spark, sf_dir):
    return _run(graph_of(spark, sf_dir, "customer", "orders"), 'SELECT ?c WHERE { ?c a ex:Customer MINUS { ?o ex:placedBy ?c ; ex:status "F" } }')


@contract("sparql_filter_functions", f"""
SELECT {_iri('part', 'p_partkey')} AS p, {_lit('upper(p_name)')} AS u, length(p_name)::BIGINT AS n, {_lit("substr(p_name, 2, 4)")} AS m,
       {_lit("CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE '' END")} AS b,
       {_lit("replace(p_name, 'a', 'o')")} AS r, {_lit("md5(p_name)")} AS h
FROM part WHERE contains(lower(p_name), 'a') AND p_size BETWEEN 5 AND 40 AND regexp_matches(p_name, '(?i)[aeiou]')""")
def filter_functions(spark, sf_dir):
    g = graph_of(spark, sf_dir, "part")
    q = """SELECT ?p (UCASE(?l) AS ?u) (STRLEN(?l) AS ?n) (SUBSTR(?l, 2, 4) AS ?m) (STRBEFORE(?l, " ") AS ?b) (REPLACE(?l, "a", "o") AS ?r) (MD5(?l) AS ?h)
    WHERE { ?p rdfs:label ?l ; ex:size ?s FILTER(CONTAINS(LCASE(?l), "a") && ?s >= 5 && ?s <= 40 && REGEX(STR(?l), "[aeiou]", "i")) }"""
    return values(_run(g, q), n="long")


@contract("sparql_bind_if_coalesce", f"""
SELECT {_iri('event', 'event_id')} AS e, {_lit("CASE WHEN value::DECIMAL(18,2) > 50 THEN 'high' ELSE 'low' END")} AS band,
       round(value::DECIMAL(18,2) * 2 + 1, 2)::DECIMAL(18,2) AS twice FROM events""")
def bind_if(spark, sf_dir):
    q = 'SELECT ?e ?band ?twice WHERE { ?e ex:value ?v BIND(IF(?v > 50, "high", "low") AS ?band) BIND(COALESCE(?missing, ?v * 2 + 1) AS ?twice) }'
    return values(_run(graph_of(spark, sf_dir, "events"), q), twice="decimal(18,2)")


@contract("sparql_values", f"SELECT {_iri('nation', 'n_nationkey')} AS n, {_lit('n_name')} AS l, v AS k FROM nation JOIN (VALUES (0, 1), (3, 2), (7, 3)) t(r, v) ON r = n_nationkey")
def values_block(spark, sf_dir):
    q = "SELECT ?n ?l ?k WHERE { VALUES (?n ?k) { (<http://example.org/nation/0> 1) (<http://example.org/nation/3> 2) (<http://example.org/nation/7> 3) } ?n rdfs:label ?l }"
    return values(_run(graph_of(spark, sf_dir, "nation"), q), k="int")


@contract("sparql_group_having", f"""
SELECT {_lit('event_type')} AS f, count(*)::BIGINT AS n, sum(value::DECIMAL(18,2))::DECIMAL(18,2) AS q FROM events GROUP BY event_type HAVING count(*) > 100""")
def group_having(spark, sf_dir):
    q = "SELECT ?f (COUNT(*) AS ?n) (SUM(?x) AS ?q) WHERE { ?e ex:kind ?f ; ex:value ?x } GROUP BY ?f HAVING (COUNT(*) > 100)"
    return values(_run(graph_of(spark, sf_dir, "events"), q), n="long", q="decimal(18,2)")


@contract("sparql_agg_all", f"""
SELECT {_lit('o_orderstatus')} AS s, count(DISTINCT o_custkey)::BIGINT AS c, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(18,2) AS total,
       min(o_totalprice::DECIMAL(18,2)) AS low, max(o_totalprice::DECIMAL(18,2)) AS high, round(avg(o_totalprice::DECIMAL(18,2)::DOUBLE), 4) AS mean,
       {_lit('min(o_orderpriority)')} AS first FROM orders GROUP BY o_orderstatus""")
def agg_all(spark, sf_dir):
    q = "SELECT ?s (COUNT(DISTINCT ?k) AS ?c) (SUM(?t) AS ?total) (MIN(?t) AS ?low) (MAX(?t) AS ?high) (AVG(?t) AS ?mean) (SAMPLE(?p) AS ?first) WHERE { ?o ex:status ?s ; ex:placedBy ?k ; ex:total ?t ; ex:priority ?p } GROUP BY ?s"
    d18 = "decimal(18,2)"
    return values(_run(graph_of(spark, sf_dir, "orders"), q), c="long", total=d18, low=d18, high=d18, mean="double").withColumn("mean", F.round("mean", 4))


@contract("sparql_avg_empty", "SELECT 0::BIGINT AS n, 0::DOUBLE AS a, 0::DOUBLE AS s, NULL::VARCHAR AS m")
def avg_empty(spark, sf_dir):
    q = 'SELECT (COUNT(?t) AS ?n) (AVG(?t) AS ?a) (SUM(?t) AS ?s) (MAX(?t) AS ?m) WHERE { ?o ex:status "none such" ; ex:total ?t }'
    return values(_run(graph_of(spark, sf_dir, "orders"), q), n="long", a="double", s="double")


@contract("sparql_filter_scope", f"""
SELECT {_iri('customer', 'c_custkey')} AS c, {_lit("'no gold'")} AS issue FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'GOLD')
UNION ALL SELECT {_iri('customer', 'c_custkey')}, {_lit("'no building'")} FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING')""")
def filter_scope(spark, sf_dir):
    q = """SELECT ?c ?issue WHERE { ?c ex:segment "BUILDING" {
      { BIND("no gold" AS ?issue) FILTER NOT EXISTS { ?c ex:segment "GOLD" } } UNION { BIND("no building" AS ?issue) FILTER NOT EXISTS { ?c ex:segment "BUILDING" } } } }"""
    return _run(graph_of(spark, sf_dir, "customer"), q)


@contract("sparql_group_computed_key", f"SELECT {_lit('strftime(o_orderdate, ' + chr(39) + '%Y' + chr(39) + ')')} AS y, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def group_computed_key(spark, sf_dir):
    return values(_run(graph_of(spark, sf_dir, "orders"), "SELECT ?y (COUNT(?o) AS ?n) WHERE { ?o ex:date ?d } GROUP BY (SUBSTR(STR(?d), 1, 4) AS ?y)"), n="long")


@contract("sparql_date_range", """
SELECT count(*)::BIGINT AS n, min(strftime(o_orderdate, '%Y-%m-%d')) AS first, max(strftime(o_orderdate, '%Y-%m-%d')) AS last FROM orders
WHERE o_orderdate::DATE >= DATE '1995-01-01' AND o_orderdate::DATE < DATE '1997-01-01'""")
def date_range(spark, sf_dir):
    q = 'SELECT (COUNT(?o) AS ?n) (MIN(?d) AS ?first) (MAX(?d) AS ?last) WHERE { ?o ex:date ?d FILTER(?d >= "1995-01-01"^^xsd:date && ?d < "1997-01-01"^^xsd:date) }'
    return values(_run(graph_of(spark, sf_dir, "orders"), q), n="long", first="string", last="string")


@contract("sparql_group_concat", f"SELECT {_iri('region', 'n_regionkey')} AS r, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def group_concat(spark, sf_dir):
    return values(_run(graph_of(spark, sf_dir, "nation"), 'SELECT ?r (GROUP_CONCAT(?l; SEPARATOR="; ") AS ?names) WHERE { ?n ex:region ?r ; rdfs:label ?l } GROUP BY ?r'), names="string")


@contract("sparql_subselect", f"""
WITH k AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT {_iri('customer', 'c_custkey')} AS c, {_lit('c_name')} AS name, n::BIGINT AS n FROM k JOIN customer ON c_custkey = o_custkey WHERE n >= (SELECT max(n) FROM k) - 2""")
def subselect(spark, sf_dir):
    q = """SELECT ?c ?name ?n WHERE { { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o ex:placedBy ?c } GROUP BY ?c }
      { SELECT (MAX(?k) AS ?top) WHERE { { SELECT ?d (COUNT(?o) AS ?k) WHERE { ?o ex:placedBy ?d } GROUP BY ?d } } } ?c ex:name ?name FILTER(?n >= ?top - 2) }"""
    return values(_run(graph_of(spark, sf_dir, "customer", "orders"), q), n="long")


@contract("sparql_order_limit", f"SELECT {_iri('part', 'p_partkey')} AS p, {_lit('p_name')} AS l FROM part ORDER BY p_size DESC, p_name, p LIMIT 25 OFFSET 5")
def order_limit(spark, sf_dir):
    return _run(graph_of(spark, sf_dir, "part"), "SELECT ?p ?l WHERE { ?p ex:size ?s ; rdfs:label ?l } ORDER BY DESC(?s) ?l ?p LIMIT 25 OFFSET 5")


_TURN = "'<http://example.org/turn/' || conv_id || '/' || {} || '>'"


@contract("sparql_path_plus", f"SELECT {_TURN.format('a.turn').replace('conv_id', 'a.conv_id')} AS x, {_TURN.format('b.turn').replace('conv_id', 'b.conv_id')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def path_plus(spark, sf_dir):
    return _run(graph_of(spark, sf_dir, "conversations"), "SELECT ?x ?y WHERE { ?x ex:next+ ?y }")


@contract("sparql_path_star", f"SELECT {_TURN.format('turn')} AS y FROM conversations WHERE conv_id = 0")
def path_star(spark, sf_dir):
    return _run(graph_of(spark, sf_dir, "conversations"), "SELECT ?y WHERE { <http://example.org/turn/0/0> ex:next* ?y }")


@contract("sparql_path_mixed", f"""
SELECT {_iri('order', 'o_orderkey')} AS o, {_iri('region', 'n_regionkey')} AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT {_iri('customer', 'c_custkey')}, {_iri('region', 'n_regionkey')} FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def path_mixed(spark, sf_dir):
    return _run(graph_of(spark, sf_dir, "orders", "customer", "nation"), "SELECT ?o ?r WHERE { ?o ((ex:placedBy/ex:nation)|ex:nation)/ex:region ?r }")


@contract("sparql_path_inverse_negated", f"""
SELECT {_iri('nation', 'n_nationkey')} AS n, {_iri('customer', 'c_custkey')} AS x FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def path_inverse(spark, sf_dir):
    return _run(graph_of(spark, sf_dir, "customer", "nation"), "SELECT ?n ?x WHERE { ?n ex:region <http://example.org/region/1> . ?n ^!(ex:segment|ex:region|rdf:type) ?x }")


_MEMBERS = f"""
SELECT '<http://example.org/brand/' || replace(p_brand, ' ', '_') || '>' AS b, {_iri('part', 'p_partkey')} AS p
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)"""


@contract("sparql_list_members_all", _MEMBERS)
@contract("sparql_list_members", _MEMBERS)
def list_members(spark, sf_dir):
    """The members of the lists of each brand's parts, which hold all of them; two names of one query."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    df = table(spark, sf_dir, "part").withColumn("k", F.row_number().over(w)).withColumn("last", F.max("k").over(Window.partitionBy("p_brand")))
    brand = F.replace(F.col("p_brand"), F.lit(" "), F.lit("_"))
    cell = lambda k: F.concat(F.lit("_:l"), brand, F.lit("_"), k.cast("string"))
    cells = emit(df, cell(F.col("k")), [(T.FIRST, node("part", "p_partkey")), (T.REST, F.when(F.col("k") == F.col("last"), F.lit(T.NIL)).otherwise(cell(F.col("k") + 1)))])
    heads = emit(df.where("k = 1"), node("brand", brand), [(ex("parts"), cell(F.col("k")))])
    return _run(Graph.of(cells.unionByName(heads)), "SELECT ?b ?p WHERE { ?b ex:parts/rdf:rest*/rdf:first ?p }")


@contract("sparql_ask", "SELECT EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA') AS result")
def ask(spark, sf_dir):
    return _run(graph_of(spark, sf_dir, "region"), 'ASK { ?r rdfs:label "ASIA" }')


@contract("sparql_construct", f"SELECT {_iri('region', 'n_regionkey')} AS s, '<http://example.org/has>' AS p, {_iri('nation', 'n_nationkey')} AS o FROM nation")
def construct(spark, sf_dir):
    return _run(graph_of(spark, sf_dir, "nation"), "CONSTRUCT { ?r ex:has ?n } WHERE { ?n ex:region ?r }")


@contract("sparql_describe", f"""
SELECT {_iri('nation', 'n_nationkey')} AS s, p, o FROM nation, LATERAL (VALUES ('{T.TYPE}', '<http://example.org/Nation>'),
  ('<http://example.org/region>', {_iri('region', 'n_regionkey')}), ('{T.LABEL}', {_lit('n_name')})) t(p, o) WHERE n_regionkey = 2""")
def describe(spark, sf_dir):
    return _run(graph_of(spark, sf_dir, "nation"), "DESCRIBE ?n WHERE { ?n ex:region <http://example.org/region/2> }")


@contract("sparql_named_graphs", f"""
SELECT '<http://example.org/g/' || n_regionkey || '>' AS g, count(*)::BIGINT AS n FROM nation GROUP BY n_regionkey""")
def named_graphs(spark, sf_dir):
    df = emit(table(spark, sf_dir, "nation"), node("nation", "n_nationkey"), [(ex("region"), node("region", "n_regionkey"))])
    g = Graph(df.withColumn("g", F.replace(F.col("o"), F.lit("region/"), F.lit("g/"))))
    return values(_run(g, "SELECT ?g (COUNT(?n) AS ?n2) WHERE { GRAPH ?g { ?n ex:region ?r } } GROUP BY ?g").withColumnRenamed("n2", "n"), n="long")


@contract("sparql_term_functions", f"""
SELECT {_iri('nation', 'n_nationkey')} AS n, 'true' AS a, 'false' AS b, 'http://www.w3.org/2001/XMLSchema#string' AS d, '' AS g, url_encode(n_name) AS e, (n_nationkey % 2 = 0)::VARCHAR AS even FROM nation""")
def term_functions(spark, sf_dir):
    q = """SELECT ?n (isIRI(?n) AS ?a) (isLiteral(?n) AS ?b) (DATATYPE(?l) AS ?d) (LANG(?l) AS ?g) (ENCODE_FOR_URI(?l) AS ?e) (STRDT(STR(FLOOR(?k / 2) * 2 = ?k), xsd:string) AS ?even)
      WHERE { ?n rdfs:label ?l BIND(xsd:integer(REPLACE(STR(?n), "^.*/", "")) AS ?k) }"""
    return values(_run(graph_of(spark, sf_dir, "nation"), q), a="string", b="string", d="string", g="string", e="string", even="string")


@contract("update_insert_delete", f"""
SELECT {_iri('nation', 'n_nationkey')} AS s, '<http://example.org/area>' AS p, {_iri('region', 'n_regionkey')} AS o FROM nation WHERE n_regionkey <> 3
UNION ALL SELECT {_iri('nation', 'n_nationkey')}, '{T.LABEL}', {_lit('n_name')} FROM nation
UNION ALL SELECT '<http://example.org/nation/99>', '{T.LABEL}', '"NOWHERE"'""")
def update(spark, sf_dir):
    g = graph_of(spark, sf_dir, "nation")
    g = g.update("""DELETE WHERE { ?n a ex:Nation } ; DELETE { ?n ex:region ?r } INSERT { ?n ex:area ?r } WHERE { ?n ex:region ?r } ;
      DELETE { ?n ex:area ?r } WHERE { ?n ex:area ?r FILTER(?r = <http://example.org/region/3>) } ;
      INSERT DATA { <http://example.org/nation/99> rdfs:label "NOWHERE" } ; DELETE DATA { <http://example.org/nation/98> rdfs:label "X" }""", PREFIXES)
    return g.triples
