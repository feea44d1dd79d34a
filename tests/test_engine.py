import json

import pytest

from graphloom.engine import Engine, parse_batch, run_batch
from graphloom.streaming.monitoring import watch_stream, windowed_counts

TTL = '@prefix : <http://x/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :Animal a owl:Class ; rdfs:label "Animal" . :Dog a owl:Class ; rdfs:label "Dog" ; rdfs:subClassOf :Animal . :rex a :Dog .'


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    assert e.call("load", turtle=TTL)["triple_count"] == 6
    return e


def test_surface_is_complete(spark):
    tools = Engine.tools()
    assert len(tools) >= 51 and all(callable(getattr(Engine, t)) for t in tools)


def test_query_reason_version_plan(engine):
    assert engine.call("query", query="ASK { ?x a <http://x/Dog> }") == {"result": True}
    got = engine.call("query", query="SELECT ?c ?l WHERE { ?c a owl:Class OPTIONAL { ?c rdfs:label ?l } } ORDER BY ?c")
    assert got["variables"] == ["c", "l"] and got["results"][0] == {"c": "<http://x/Animal>", "l": '"Animal"'}
    assert engine.call("version", label="v1")["triple_count"] == 6
    assert engine.call("reason", profile="rdfs")["inferred_count"] == 1
    assert engine.call("version", label="v2")["triple_count"] == 7
    plan = engine.call("plan", new_turtle=TTL.replace(":Dog", ":Hound"))
    assert plan["risk"] == "high" and engine.call("lock", iris=["http://x/Dog"])["locked"] == ["<http://x/Dog>"]
    assert "LockedError" in engine.call("apply")["error"] and engine.call("apply", mode="force")["ok"]
    assert engine.call("rollback", label="v1")["triple_count"] == 6 and len(engine.call("history")["versions"]) == 2
    assert "error" in engine.call("apply") and "error" in engine.call("nope")
    assert any(":P:" in e for e in engine.call("lineage")["events"])


def test_files(engine, tmp_path):
    out = str(tmp_path / "o.nt")
    assert engine.call("save", path=out, format="ntriples")["ok"] and engine.call("validate", input=out)["triple_count"] == 6
    assert "rdf:Description" in engine.call("convert", path=out, to="rdfxml")["content"]
    assert engine.call("diff", old_path=out, new_path=out)["added_count"] == 0
    data = tmp_path / "d.csv"
    data.write_text("id,name\n1,Rex\n2,\n")
    shapes = "@prefix sh: <http://www.w3.org/ns/shacl#> . [] a sh:NodeShape ; sh:targetClass <http://example.org/data/Thing> ; sh:property [ sh:path <http://example.org/data/ont#name> ; sh:minCount 1 ] ."
    done = engine.call("extend", data_path=str(data), shapes=shapes, inline_shapes=True, reason_profile="rdfs")
    assert done["stopped"] and done["shacl"]["violation_count"] == 1 and "reason" not in done
    assert engine.call("map", data_path=str(data))["mapping"]["id_field"] == "id"


def test_align_feedback_search_monitor(engine, tmp_path):
    other = tmp_path / "b.ttl"
    other.write_text(TTL.replace("http://x/", "http://y/"))
    got = engine.call("align", source=str(other), min_confidence=0.5)
    assert got["count"] == 2 and engine.call("align_feedback", source_iri="a", target_iri="b", accepted=True)["ok"]
    assert engine.call("embed", struct_dim=4, struct_epochs=5)["embedded"] == 2
    assert engine.call("search", query="dog", mode="text")["results"][0]["iri"] == "<http://x/Dog>"
    assert len(engine.call("search", query="dog", mode="structure")["results"]) == len(engine.call("search", query="dog")["results"]) == 2
    assert engine.call("similarity", iri_a="<http://x/Dog>", iri_b="<http://x/Dog>")["cosine"] == 1
    w = json.dumps([{"id": "w", "query": "SELECT (COUNT(?c) AS ?count) WHERE { ?c a owl:Class }", "threshold": 1, "action": "block"}])
    assert engine.call("monitor", watchers=w)["status"] == "blocked" and engine.call("monitor_clear")["ok"]
    engine.call("lint_feedback", rule_id="missing_comment", entity="<http://x/Dog>", accepted=False)
    assert engine.call("enforce", rule_pack="generic")["total"] == 4
    assert engine.call("dl_check", sub_class="http://x/Dog", super_class="http://x/Animal")["subsumed"]
    assert engine.call("ground", triples=[{"s": "http://x/rex", "p": "type", "o": "http://x/Dog"}])["results"][0]["status"] == "grounded"


def test_batch_and_filter(spark):
    e = Engine(spark, deny=["push", "@remote"])
    assert "not allowed" in e.call("pull", url="http://x")["error"] and not e.allowed("marketplace") and e.allowed("load")
    assert Engine(spark, allow=["@core"]).allowed("query") and not Engine(spark, allow=["@core"]).allowed("reason")
    out: list[str] = []
    text = '# c\nclear\n{"command": "load", "args": {"turtle": "<http://a> <http://b> <http://c> ."}}\nquery "ASK { ?s ?p ?o }"\nnope\nstats\n'
    assert run_batch(e, text, emit=out.append) == 1 and json.loads(out[2])["result"] == {"result": True} and len(out) == 5
    out.clear()
    assert run_batch(e, text, bail=True, emit=out.append) == 1 and len(out) == 4
    assert parse_batch('[{"command": "stats"}]') == [("stats", {})]


def test_stream(spark, tmp_path):
    from graphloom.graph import Graph
    from graphloom.operators.lifecycle import Monitor, Watcher

    src = str(tmp_path / "in")
    spark.createDataFrame([("<a>", "<b>", "<c>")], "s string, p string, o string").write.parquet(src)
    stream = spark.readStream.schema("s string, p string, o string").parquet(src)
    seen: list[dict] = []
    m = Monitor([Watcher("w", "SELECT (COUNT(?s) AS ?count) WHERE { ?s <b> ?o }", 0)])
    q = watch_stream(stream, lambda: Graph.empty(spark), m, seen.append, str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert [s["status"] for s in seen] == ["alert"]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double")
    assert sorted((r["n"], r["total"]) for r in windowed_counts(events).collect()) == [(1, 4.0), (2, 3.0)]
