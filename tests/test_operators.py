"""Mapping, checks, matching, lifecycle, records and vectors on small cases."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.functions import text as X
from graphloom.functions import vectors as V
from graphloom.graph import Graph
from graphloom.operators import checks, lifecycle, mapping, matching, records
from graphloom.sources.rdf import load_text, parse_turtle

HEAD = "@prefix : <http://x/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
x = lambda n: f"<http://x/{n}>"


def turtle(spark, text):
    return load_text(spark, HEAD + text, "turtle")


# mapping -----------------------------------------------------------------------------------------


def test_rows_to_triples(spark):
    df = spark.createDataFrame([("a b<c>?", 'q"\\\n', None, 1.5), ("", "same", "t", None), ("", "same", "t", None)], "id string, name string, kind string, n double")
    m = mapping.Mapping.from_json(json.dumps({"base_iri": "http://x/", "id_field": "id", "class": "http://x/C", "mappings": [{"field": "name", "predicate": "http://x/p"}, {"field": "kind", "predicate": "http://x/k", "lookup": True}, {"field": "n", "predicate": "http://x/n", "datatype": T.DECIMAL}, {"field": "gone", "predicate": "http://x/g"}]}))
    rows = set(map(tuple, mapping.rows_to_triples(df, m).collect()))
    s = x("a_b_c__")
    assert {(s, T.TYPE, x("C")), (s, x("p"), '"q\\"\\\\\\n"'), (s, x("n"), T.literal("1.5", T.DECIMAL))} <= rows
    auto = {r[0] for r in rows} - {s}
    assert len(auto) == 1 and next(iter(auto)).startswith("<http://x/_auto_") and (next(iter(auto)), x("k"), x("t")) in rows
    again = mapping.Mapping.from_json(m.to_json())
    assert again == m and mapping.Mapping.from_headers(["z", "b"]).id_field == "b"


def test_schema_and_types():
    assert [mapping.sql_to_xsd(t).rpartition("#")[2] for t in ("DECIMAL(10,2)", "double", "BIGINT", "timestamp_ntz", "bytea", "uuid", "time")] == ["decimal", "decimal", "integer", "dateTime", "hexBinary", "string", "time"]
    assert mapping.pascal_case("order_line_items") == "OrderLineItems" and mapping.pascal_case("aBC") == "ABC"


# checks ------------------------------------------------------------------------------------------


def test_shapes(spark):
    g = turtle(spark, ':b1 a :B ; rdfs:label "one" , "two" ; :h 5 ; :o :z . :b2 a :B ; :h "x" , :iri . :z a :Z .')
    shapes = parse_turtle(HEAD + """:S a sh:NodeShape ; sh:targetClass :B ; sh:property [ sh:path rdfs:label ; sh:minCount 1 ; sh:maxCount 1 ; sh:message "one label" ] ,
      [ sh:path :h ; sh:datatype xsd:integer ] , [ sh:path :q ; sh:minCount 0 ] , [ sh:path ( :a :b ) ; sh:minCount 1 ] , [ sh:path :o ; sh:class :Z ; sh:pattern "zz" ] .""")
    found = checks.validate_shapes(g, checks.shapes_from_triples([t[:3] for t in shapes]))
    assert sorted((T.local_name(r["focus_node"]), r["kind"], r["value"]) for r in found.collect()) == [("b1", "max_count", "2"), ("b2", "datatype", '"x"'), ("b2", "min_count", "0")]
    told = json.loads(checks.report(found))
    assert (told["conforms"], told["violation_count"]) == (False, 3) and told["violations"][0]["message"] == "one label"
    wide = checks.validate_shapes(g, checks.shapes_from_triples([t[:3] for t in shapes], extended=True))
    assert ("b1", "pattern") in {(T.local_name(r["focus_node"]), r["kind"]) for r in wide.collect()}
    parts = spark.createDataFrame([(x("b1"), "p"), (x("none"), "q")], "focus_node string, partition string")
    assert {r["partition"]: (r["conforms"], r["violations"]) for r in checks.validate_partitioned(g, checks.shapes_from_triples([t[:3] for t in shapes]), parts).collect()} == {"p": (False, 1), "q": (True, 0), "(none)": (False, 2)}


def test_enforce_packs(spark):
    g = turtle(spark, ":Entity a owl:Class . :E1 a owl:Class ; rdfs:subClassOf :Entity . :State a owl:Class . :Lone a owl:Class ; rdfs:label \"l\" . :A rdfs:subClassOf :V . :B rdfs:subClassOf :V ; owl:disjointWith :A . :C rdfs:subClassOf :V .")
    assert {r["entity"] for r in checks.orphan_class(g).collect()} == {x("State"), x("Lone")}
    assert [r["entity"] for r in checks.enforce(g, "boro").collect()] == [x("E1")]
    assert sorted(r["message"] for r in checks.enforce(g, "value_partition").collect()) == [f"not disjoint: {x('A')} {x('C')}", f"not disjoint: {x('B')} {x('C')}"]
    ok = turtle(spark, ":Entity a owl:Class . :E1 rdfs:subClassOf :Entity . :S1 rdfs:subClassOf :State , :E1 .")
    assert checks.enforce(ok, "boro").count() == 0
    custom = [checks.CustomRule("no-lone", "house", "ASK { ?c rdfs:label \"l\" }", "error", "m"), checks.CustomRule("sel", "house", "SELECT ?c WHERE { ?c rdfs:label ?l }")]
    assert [(r["rule"], r["message"]) for r in checks.enforce(g, "house", custom).collect()] == [("no-lone", "m")]
    assert checks.compliance(g, "house", custom)["compliance"] == 0.5 and checks.compliance(g, "nothing")["compliance"] == 1.0
    assert {r["rule"] for r in checks.enforce(Graph.empty(spark), "hierarchy").collect()} == {"low_avg_depth", "low_hierarchy_density"}


def test_feedback(spark):
    issues = spark.createDataFrame([(r, "error", "e") for r in ("keep", "drop", "lower", "none")], "rule string, severity string, entity string")
    votes = [("t", "keep", "e", False)] * 5 + [("t", "keep", "e", True)] + [("t", "drop", "e", False)] * 3 + [("t", "lower", "e", False)] * 2 + [("other", "none", "e", False)] * 9
    got = {r["rule"]: r["severity"] for r in checks.apply_feedback(issues, spark.createDataFrame(votes, "tool string, rule_id string, entity string, accepted boolean"), "t").collect()}
    assert got == {"keep": "error", "lower": "warning", "none": "error"}


def test_lint_diff_stats(spark):
    g = turtle(spark, ":o a owl:Ontology . :A a owl:Class ; rdfs:label \"a\" ; rdfs:comment \"c\" . :p a owl:ObjectProperty ; rdfs:domain :A ; rdfs:range :A . :i a :A .")
    assert checks.lint(g).count() == 0
    assert checks.stats(g).first().asDict() == {"triples": 8, "classes": 1, "properties": 1, "individuals": 1, "object_properties": 1, "data_properties": 0}
    assert checks.diff(g, g).count() == 0 and checks.diff(g, Graph.empty(spark)).count() == 8


# matching ----------------------------------------------------------------------------------------


def test_jaro_winkler_properties():
    assert X.jaro_winkler("abcd", "abxy") == pytest.approx(0.7333333)
    assert X.jaro("DWAYNE", "DUANE") == pytest.approx(0.8222222) and X.jaro_winkler("", "a") == 0 and X.jaro_winkler("", "") == 1
    draw = random.Random(1)
    for _ in range(300):
        a, b = ("".join(draw.choices("abcé", k=draw.randint(0, 8))) for _ in "ab")
        assert 0 <= X.jaro_winkler(a, b) <= 1 and X.jaro_winkler(a, a) == 1


def test_labels(spark):
    rows = [("DomesticCat",), ("Über_Grosse-Katze",), ("ABC",), ("a  b",)]
    got = [r["n"] for r in spark.createDataFrame(rows, "l string").select(X.normal_label(F.col("l")).alias("n")).collect()]
    assert got == ["domestic cat", "über grosse katze", "abc", "a b"]


def test_align_and_greedy(spark):
    a = turtle(spark, ':Dog a owl:Class ; rdfs:label "Dog" . :Cat a owl:Class ; rdfs:label "House_Cat" . :Q a owl:Class .')
    b = load_text(spark, HEAD.replace("http://x/", "http://y/") + ':Hound a owl:Class ; rdfs:label "dog" . :k a owl:Class ; rdfs:label "house cat" .', "turtle")
    got = {(T.local_name(r["source"]), T.local_name(r["target"]), r["confidence"], T.local_name(r["relation"])) for r in matching.align(a, b, 0.8).collect()}
    assert got == {("Dog", "Hound", 0.85, "exactMatch"), ("Cat", "k", 0.85, "exactMatch")}
    draw = random.Random(4)
    for _ in range(3):
        pairs = [(f"s{draw.randint(0, 9)}", f"t{draw.randint(0, 9)}", draw.choice([0.8, 0.9, 0.95])) for _ in range(40)]
        pairs = sorted({(s, t): (s, t, c) for s, t, c in pairs}.values(), key=lambda p: (-p[2], p[0], p[1]))
        used, want = set(), []
        for s, t, c in pairs:
            if s not in used and t not in used:
                used |= {s, t}
                want.append((s, t, c))
        found = matching.one_to_one(spark.createDataFrame(pairs, "source string, target string, confidence double"))
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_similar_labels_lose_nothing(spark):
    draw = random.Random(7)
    words = ["heart", "heart valve", "valve of heart", "lung", "left lung", "lungs", "brain stem", "stem", "hart"]
    mk = lambda p: [(f"{p}{k}", draw.choice(words) + draw.choice(["", "s", " a"])) for k in range(25)]
    a, b = mk("a"), mk("b")
    frame = lambda r: spark.createDataFrame(r, "iri string, label string")
    got = {(r["a"], r["b"]): r["label"] for r in matching.similar_labels(frame(a), frame(b), block=10).collect()}
    want = {}
    for i, s in a:
        for j, t in b:
            u, v = set(s.split()), set(t.split())
            sim = max(X.jaro_winkler(s, t), len(u & v) / len(u | v))
            if sim >= 0.75:
                want[i, j] = sim
    assert got == pytest.approx(want)


def test_weights(spark):
    empty = spark.createDataFrame([], "accepted boolean, signals_json string")
    assert matching.learn_align_weights(empty) == matching.ALIGN_WEIGHTS
    votes = [(k % 2 == 0, json.dumps({"label": 0.9 if k % 2 == 0 else 0.1, "property": 0.5})) for k in range(12)]
    w = matching.learn_align_weights(spark.createDataFrame(votes, empty.schema))
    assert sum(w) == pytest.approx(1) and w[0] > matching.ALIGN_WEIGHTS[0]
    rows = [(1.0, 0.5, 0.0, 0.0, "rename", "rename" if k < 8 else "no") for k in range(12)]
    assert matching.learn_drift_weights(spark.createDataFrame(rows, "signal_domain_range double, signal_label_sim double, signal_hierarchy double, signal_individuals double, predicted string, actual string")) == pytest.approx([2 / 3, 1 / 3, 0, 0])


def test_drift_and_renames(spark):
    a = turtle(spark, ":p a owl:ObjectProperty ; rdfs:label \"has part\" ; rdfs:domain :A ; rdfs:range :B . :A a owl:Class .")
    b = turtle(spark, ":q a owl:ObjectProperty ; rdfs:label \"has parts\" ; rdfs:domain :A ; rdfs:range :B . :A a owl:Class .")
    row = matching.rename_candidates(a, b).first()
    assert (row["from_iri"], row["to_iri"]) == (x("p"), x("q")) and row["confidence"] > 0.5
    assert matching.drift_velocity(a, b) == 0.5 and matching.drift_velocity(a, a) == 0


def test_crosswalks(spark):
    c = spark.createDataFrame([("1", "A", "9", "B C", "exact", "Heart attack", "Myocardial infarction"), ("2", "A", None, None, None, "Stroke", None)], matching.CROSSWALK)
    assert matching.fuzzy_labels(c, "heart atack").first()["source_code"] == "1"
    labels = spark.createDataFrame([("i", "STROKE"), ("j", "zzz")], "iri string, label string")
    got = {r["iri"]: (r["best"], r["matches"]) for r in matching.validate_labels(labels, c).collect()}
    assert got == {"i": ("Stroke", 1), "j": (None, 0)}
    assert matching.enrich(Graph.empty(spark), x("C"), c, "1", "A").count() == 2 and matching.enrich(Graph.empty(spark), x("C"), c, "7", "A").count() == 0


# lifecycle ---------------------------------------------------------------------------------------


def test_plan_lock_apply(spark):
    old = turtle(spark, ":A a owl:Class . :B a owl:Class . :i a :B .")
    new = turtle(spark, ":A a owl:Class . :B2 a owl:Class .")
    p = lifecycle.Planner(old)
    with pytest.raises(RuntimeError):
        p.apply()
    p.lock(x("B"), "kept")
    out = p.plan(new)
    assert (out["risk"], out["added"], out["removed"], out["references"], out["locked"]) == ("high", 1, 1, 2, [x("B")])
    with pytest.raises(lifecycle.LockedError):
        p.apply("safe")
    p.blocked = True
    with pytest.raises(lifecycle.BlockedError):
        p.apply("safe")
    p.locks = {}
    g = p.apply("migrate")
    assert g.ask(f"ASK {{ {x('B')} <{T.OWL}equivalentClass> {x('B2')} ; <{T.OWL}deprecated> true }}")
    assert lifecycle.Planner(old).plan(old)["risk"] == "low"


def test_versions_and_monitor(spark):
    v = lifecycle.Versions(spark)
    good = turtle(spark, ":A a owl:Class .")
    v.save(good, "one")
    v.save(turtle(spark, ":A a owl:Class . :B a owl:Class ."), "one")
    v.save(good, "two")
    assert [e["id"] for e in v.history()] == [3, 2, 1] and v.rollback("one").count() == 2
    sent = []
    q = "SELECT (COUNT(?c) AS ?count) WHERE { ?c a owl:Class }"
    m = lifecycle.Monitor([lifecycle.Watcher("w", q, 1, webhook_url="u", message="many")], v, send=lambda u, p: sent.append(p))
    bad = turtle(spark, ":A a owl:Class . :B a owl:Class . :C a owl:Class .")
    assert m.run(good)[0]["status"] == "ok" and m.run(bad)[0]["status"] == "alert" and sent[0]["message"] == "many"
    m.watchers[0].action = "block"
    assert m.run(bad)[0]["status"] == "blocked" and m.run(good)[0]["status"] == "blocked"
    m.clear()
    m.watchers[0].action = "auto_rollback"
    out, after = m.run(bad)
    assert out["status"] == "auto_rolled_back" and after.count() == 1


def test_grounding(spark):
    g = load_text(spark, '@prefix e: <http://example.org/> . @prefix s: <http://schema.org/> . e:Who s:year "1963" , e:X ; e:by e:BBC .', "turtle")
    claims = spark.createDataFrame([("Who", "year", "1963"), ("Who", "by", "BBC"), ("http://example.org/Who", "by", "ITV"), ("No", "by", "BBC"), ("Who", "by", "BBC")], "s string, p string, o string")
    got = [(r["s"][-3:], r["o"], r["status"], r["confidence"], r["evidence_count"]) for r in lifecycle.ground(g, claims).collect()]
    assert sorted(got) == sorted([("Who", "1963", "grounded", 40, 1), ("Who", "BBC", "grounded", 65, 1), ("Who", "BBC", "grounded", 65, 1), ("Who", "ITV", "contradicted", 0, 0), ("No", "BBC", "unknown", 0, 0)])


# records and vectors -----------------------------------------------------------------------------


def test_record_columns(spark):
    row = spark.createDataFrame([("RAF/106G/1", "F.52 20-inch", "  a  b! ", "1000", "Crown Copyright", "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))")], "ref string, cam string, t string, ft string, r string, w string")
    out = row.select(records.collection(F.col("ref")).alias("c"), records.focal_length(F.col("cam")).alias("f"), records.slug(F.col("t")).alias("s"), records.feet_to_metres(F.col("ft")).alias("m"), records.rights_iri(F.col("r")).alias("r"), records.bounds(records.parse_polygon(F.col("w"))).alias("b")).first()
    assert tuple(out["c"]) == ("RAF", "106G/1") and out["f"] == 508.0 and out["s"] == "a-b" and out["m"] == 304.8 and "crown-copyright" in out["r"] and tuple(out["b"]) == (0, 0, 2, 2)
    deg = spark.range(1).select(records.footprint(F.lit(0.0), F.lit(10.0), F.lit(1000.0), F.lit(100.0), heading=F.lit(90.0)).alias("p"), records.polygon(records.buffered(F.lit(1.0), F.lit(2.0), 0.5)).alias("w"), records.ground_sample(F.lit(1000.0), F.lit(100.0), F.lit(0.02)).alias("g")).first()
    half = 230 * 1000 / 100 / 2 / 111_111
    assert len(deg["p"]) == 5 and max(abs(q["lat"]) for q in deg["p"]) == pytest.approx(half) and deg["g"] == pytest.approx(0.2)
    assert deg["w"] == "POLYGON((1.5 0.5, 2.5 0.5, 2.5 1.5, 1.5 1.5, 1.5 0.5))"


def test_stereo_grid_equals_plain(spark):
    draw = random.Random(2)
    rows = []
    for k in range(120):
        a, b = draw.uniform(0, 8), draw.uniform(0, 8)
        rows.append((k % 3, k, f"f{k}", (a, b, a + draw.uniform(0.5, 3), b + draw.uniform(0.5, 3))))
    df = spark.createDataFrame(rows, "g int, f int, iri string, box struct<x0: double, y0: double, x1: double, y1: double>")
    plain = sorted(map(tuple, records.stereo_pairs(df, "g", "f", "iri").collect()))
    assert plain and sorted(map(tuple, records.stereo_pairs(df, "g", "f", "iri", cell=1.0).collect())) == plain


def test_manifest_and_records(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, None, "y")], "id int, title string, m string")
    body = json.loads(records.manifests(df, "id", "title", "http://m/", ["m"]).where("id = 1").first()["manifest"])
    assert body["id"] == "http://m/1" and body["metadata"] == [{"label": "m", "value": "x"}]
    triples, errors = records.records_to_graph(df, F.concat(F.lit("<http://x/"), F.col("id").cast("string"), F.lit(">")), [("<http://x/t>", T.plain_literal(F.col("title")))], ["title"])
    assert triples.count() == 1 and errors.first()["missing"] == "title"


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0], [0.5, 0.0])], "a array<float>, b array<float>, o array<float>, p array<float>")
    out = row.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.cosine(F.col("a"), F.col("o")).alias("z"), V.poincare(F.col("o"), F.col("p")).alias("d"), V.poincare(F.col("p"), F.col("p")).alias("s"), V.l2_normalized(F.col("a")).alias("n")).first()
    assert out["c"] == pytest.approx(0.96) and out["z"] == 0 and out["d"] == pytest.approx(2 * math.atanh(0.5)) and out["s"] == 0 and out["n"] == pytest.approx([0.6, 0.8])
    p, q = np.array([[0.1, 0.2]]), np.array([[0.3, -0.1]])
    assert np.allclose(V.mobius_add(-p, V.mobius_add(p, q)), q) and np.allclose(V.exp_map(p, np.zeros((1, 2))), p)
    assert np.linalg.norm(V.project(np.array([[3.0, 4.0]]))) < 1


def test_top_k_in_blocks(spark, monkeypatch):
    draw = np.random.default_rng(1)
    v = spark.createDataFrame([(k, draw.normal(size=3).tolist(), draw.uniform(-0.4, 0.4, 3).tolist()) for k in range(40)], "iri int, text_vec array<double>, struct_vec array<double>")
    q = v.where("iri < 9").selectExpr("iri AS query", "text_vec AS q_text", "struct_vec AS q_struct")
    for mode in ("cosine", "poincare", "product"):
        whole = sorted(map(tuple, V.top_k(v, q, 3, mode).collect()))
        assert len(whole) == 27 and all(r[0] == r[1] for r in whole if r[3] == 1 and mode != "product")
        with monkeypatch.context() as m:
            m.setattr(V, "QUERY_BLOCK", 4)
            assert sorted(map(tuple, V.top_k(v, q, 3, mode).collect())) == whole


def test_hierarchy_training():
    edges = [("r", "a"), ("r", "b"), ("a", "a1"), ("a", "a2"), ("b", "b1"), ("b", "b2")]
    out = {k: np.array(v) for k, v in V.train_hierarchy(edges, [], dim=8, epochs=300, rate=0.05).items()}
    again = V.train_hierarchy(edges[::-1], [], dim=8, epochs=300, rate=0.05)
    assert all(np.allclose(out[k], again[k]) for k in out) and all(np.linalg.norm(v) < 1 for v in out.values())
    assert np.linalg.norm(out["r"]) < min(np.linalg.norm(out[k]) for k in ("a1", "a2", "b1", "b2"))
    d = lambda a, b: V.ball_distance(out[a], out[b])
    assert d("a1", "a") < d("a1", "b") and d("b2", "b") < d("b2", "a")
