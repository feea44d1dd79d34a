import json
import threading
import urllib.request

import pytest

from graphloom.engine import Engine
from graphloom.operators import checks, mapping
from graphloom.operators.matching import CROSSWALK, load_crosswalk
from graphloom.serve import server
from graphloom.state import TABLES, State


def test_tables(spark, tmp_path):
    s = State(spark, str(tmp_path))
    assert len(TABLES) == 11 and all(s.table(t).count() == 0 for t in TABLES)
    s.append("iri_locks", [{"iri": "<a>", "reason": "1", "at": 1.0}, {"iri": "<a>", "reason": "2", "at": 2.0}])
    assert s.table("iri_locks").count() == 2 and s.current("iri_locks").first()["reason"] == "2"
    s.record_drift("<a>", "<b>", "rename", 0.5, "rename", label_sim=0.9)
    s.record_drift("<a>", "<b>", "rename", 0.6, "no", label_sim=0.9)
    row = s.current("drift_feedback").first()
    assert (row["confidence"], row["actual"], row["signal_label_sim"], row["signal_hierarchy"]) == (0.6, "no", 0.9, None)


def test_engine_takes_up_state(spark, tmp_path):
    a = Engine(spark, state=State(spark, str(tmp_path)))
    a.lock(["http://x/A"], "why")
    a.lint_feedback("r", "e", False)
    a.align_feedback("s", "t", True, {"label": 1.0})
    a.add_rule(checks.CustomRule("q", "house", "ASK { ?a ?b ?c }"))
    a.monitor(json.dumps([{"id": "w", "query": "SELECT (COUNT(?s) AS ?count) WHERE { ?s ?p ?o }", "threshold": -1, "action": "block"}]))
    b = Engine(spark, state=State(spark, str(tmp_path)))
    b.restore()
    assert b.locks == {"<http://x/A>": "why"} and b.feedback == [("lint", "r", "e", False)] and len(b.align_votes) == 1
    assert b.custom_rules[0].id == "q" and b.watchers[0].action == "block" and b.monitor_.blocked
    assert b.state.table("lineage_events").count() == 3


def test_http(spark):
    e = Engine(spark)
    s = server(e)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_port}"

    def post(path, body):
        with urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode())) as r:
            return json.load(r)

    assert post("/api/load-turtle", {"turtle": "<http://a> <http://b> <http://c> ."})["triple_count"] == 1
    assert post("/api/query", {"query": "ASK { ?s ?p ?o }"}) == {"result": True}
    with urllib.request.urlopen(f"{base}/api/stats") as r:
        assert json.load(r)["triples"] == 1
    for path, body in (("/api/nope", {}), ("/api/query", {"query": "nonsense"})):
        with pytest.raises(urllib.error.HTTPError):
            post(path, body)
    s.shutdown()


def test_database_schemas(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "d.duckdb")
    with duckdb.connect(path) as c:
        c.execute("CREATE TABLE customer (id INTEGER PRIMARY KEY, name VARCHAR NOT NULL, email VARCHAR)")
        c.execute("CREATE TABLE orders (id INTEGER PRIMARY KEY, customer_id INTEGER NOT NULL REFERENCES customer(id), total DECIMAL(10,2) NOT NULL)")
        tables = {t.name: t for t in mapping.introspect_duckdb(c)}
    assert tables["orders"].foreign_keys == {"customer_id": "customer"} and [x.primary_key for x in tables["customer"].columns] == [True, False, False]
    assert [x.nullable for x in tables["customer"].columns] == [False, False, True]
    assert Engine(spark).call("import_schema", connection=path)["tables"] == 2
    rows = {mapping.POSTGRES_KEYS: [{"constraint_type": "PRIMARY KEY", "table_name": "t", "column_name": "id", "parent": "t"}, {"constraint_type": "FOREIGN KEY", "table_name": "t", "column_name": "u_id", "parent": "u"}], mapping.POSTGRES_COLUMNS: [{"table_name": "t", "column_name": "id", "data_type": "integer", "is_nullable": "NO"}, {"table_name": "t", "column_name": "u_id", "data_type": "integer", "is_nullable": "YES"}]}
    t = mapping.introspect_postgres(rows.__getitem__)[0]
    assert t.foreign_keys == {"u_id": "u"} and t.columns[0].primary_key and t.columns[1].nullable


def test_crosswalk_file(spark, tmp_path):
    spark.createDataFrame([(1, "A", "9", "B", "exact", "x", "y", 0)], "source_code int, source_system string, target_code string, target_system string, relation string, source_label string, target_label string, extra int").write.parquet(str(tmp_path / "c"))
    df = load_crosswalk(spark, str(tmp_path / "c"))
    assert df.first()["source_code"] == "1" and len(df.columns) == len(CROSSWALK.split(", "))
