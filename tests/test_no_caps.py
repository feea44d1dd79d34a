"""What used to stop at a limit goes on to the end, or raises."""

import pytest

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.operators import lifecycle, matching
from graphloom.plans import reason as R
from graphloom.session import shared_dir


def labels(spark, rows):
    return spark.createDataFrame(rows, "iri string, label string")


def test_labels_that_share_words_alone(spark):
    a = labels(spark, [("a1", "green river stone"), ("a2", "x")])
    b = labels(spark, [("b1", "stone river green mountainside"), ("b2", "y"), ("b3", "zebra qualm stone river green")])
    got = {(r["a"], r["b"]): r["label"] for r in matching.similar_labels(a, b, 0.75, block=1).collect()}
    assert got[("a1", "b1")] >= 0.75 and ("a2", "b2") not in got
    assert matching.similar_labels(a, b, 0.6).where("a = 'a1' AND b = 'b3'").first()["label"] >= 0.6


def test_long_and_cyclic_lists(spark):
    cells = [t for k in range(1500) for t in ((f"_:{k}", T.FIRST, f"<m{k}>"), (f"_:{k}", T.REST, f"_:{k + 1}" if k < 1499 else T.NIL))]
    t = spark.createDataFrame(cells, "s string, p string, o string")
    heads = spark.createDataFrame([("_:0",), ("_:1490",), (T.NIL,)], "head string")
    got = sorted((r["head"], r["position"], r["member"]) for r in R.list_members(t, heads).collect())
    assert got == sorted([("_:0", k, f"<m{k}>") for k in range(1500)] + [("_:1490", k, f"<m{1490 + k}>") for k in range(10)])
    ring = spark.createDataFrame([("_:a", T.FIRST, "<x>"), ("_:a", T.REST, "_:a")], "s string, p string, o string")
    with pytest.raises(ValueError, match="cyclic"):
        R.list_members(ring, spark.createDataFrame([("_:a",)], "head string"))


def test_rules_that_do_not_settle_raise(spark):
    rows = [(f"<n{k}>", "<next>", f"<n{k + 1}>") for k in range(20)] + [("<next>", T.TYPE, f"<{T.OWL}TransitiveProperty>")]
    g = Graph.of(spark.createDataFrame(rows, "s string, p string, o string"))
    assert R.reason(g, "owl-rl").inferred.count() == 190
    with pytest.raises(RuntimeError, match="did not settle"):
        R.reason(g, "owl-rl", max_rounds=2)


def test_hierarchies_too_large_for_the_driver_raise(spark, monkeypatch):
    from graphloom.engine import Engine
    from graphloom.plans import dl

    e = Engine(spark)
    e.load(turtle="@prefix : <http://x/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . :A a owl:Class . :B a owl:Class . :C a owl:Class .")
    monkeypatch.setattr(dl, "MAX_AXIOMS", 2)
    assert "driver memory" in e.call("embed", struct_dim=2, struct_epochs=1)["error"]


def test_webhooks_get_their_headers(spark):
    sent = []
    g = Graph.of(spark.createDataFrame([("<a>", "<p>", "<b>")], "s string, p string, o string"))
    q = "SELECT (COUNT(?s) AS ?count) WHERE { ?s ?p ?o }"
    w = lifecycle.Watcher("w", q, 0, webhook_url="u", webhook_headers={"X-Key": "1"})
    lifecycle.Monitor([w], send=lambda *a: sent.append(a)).run(g)
    assert sent[0][0] == "u" and sent[0][2] == {"X-Key": "1"}


def test_clusters_need_a_shared_folder():
    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Fake)


def test_renames_pair_terms_that_can_reach_the_threshold(spark):
    old = [("<a/Size>", T.TYPE, T.CLASS), ("<a/len>", T.TYPE, T.OBJECT_PROPERTY), ("<a/len>", T.DOMAIN, "<D>"), ("<a/len>", T.RANGE, "<E>")]
    new = [(s.replace("<a/", "<b/"), p, o) for s, p, o in old]
    of = lambda rows: Graph.of(spark.createDataFrame(rows, "s string, p string, o string"))
    pairs = lambda w: {(r["from_iri"], r["to_iri"]) for r in matching.rename_candidates(of(old), of(new), w).collect()}
    assert pairs(None) == {("<a/Size>", "<b/Size>"), ("<a/len>", "<b/len>")}
    assert pairs([0.1, 0.7, 0.1, 0.1]) >= pairs(None)
