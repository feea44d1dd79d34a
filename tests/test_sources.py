import pytest
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.sources import rdf, store, tabular

TTL = """@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @base <http://base/> .
# comment
:a a :C ; :p "line\\n\\"q\\"" , 'x'@EN-gb , 1 , -2.5 , 1e3 , true ; :q <rel> , [ :r ( :b "two" ) ] .
_:n :p \"\"\"long "text" end\"\"\" ; :d "2020-01-01"^^xsd:date , "s"^^xsd:string .
"""


def test_turtle():
    rows = {t[:3] for t in rdf.parse_turtle(TTL)}
    objects = {o for s, p, o in rows if s == "<http://x/a>" and p == "<http://x/p>"}
    assert objects == {'"line\\n\\"q\\""', '"x"@en-gb', T.literal("1", T.INTEGER), T.literal("-2.5", T.DECIMAL), T.literal("1e3", T.DOUBLE), T.TRUE}
    assert ("<http://x/a>", "<http://x/q>", "<http://base/rel>") in rows and any(o == '"s"' for _, _, o in rows)
    assert sum(p == T.FIRST for _, p, _ in rows) == 2 and len(rows) == 17
    for bad in ("<a> <b>", "@prefix x: <y> . q:a q:b q:c .", '<a> <b> "x .', "<a> <b> <c> ; ."):
        if bad.endswith("; ."):
            assert rdf.validate(bad)["valid"]
        else:
            assert not rdf.validate(bad)["valid"], bad


def test_trig_and_formats():
    rows = rdf.parse_text("@prefix : <http://x/> . :g { :a :b :c . } GRAPH :h { :a :b :d } :a :b :e .", "trig")
    assert sorted((o, g) for _, _, o, g in rows) == [("<http://x/c>", "<http://x/g>"), ("<http://x/d>", "<http://x/h>"), ("<http://x/e>", None)]
    assert rdf.detect_format("a/b.NQ") == "nquads" and rdf.detect_format("x") == "turtle" and rdf.sniff(" <?xml ?>") == "rdfxml"
    with pytest.raises(rdf.RdfError):
        rdf.format_by_name("nope")


XML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://x/" xml:base="http://x/b" xml:lang="fr">
<e:C rdf:about="#i" e:att="v"><e:p rdf:resource="http://x/o"/><e:q rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</e:q>
<e:r><e:D rdf:nodeID="n"/></e:r><e:l rdf:parseType="Collection"><rdf:Description rdf:about="http://x/m"/></e:l><e:s rdf:parseType="Resource"><e:t>w</e:t></e:s></e:C></rdf:RDF>"""


def test_rdfxml():
    rows = {t[:3] for t in rdf.parse_text(XML)}
    s = "<http://x/b#i>"
    assert {(s, T.TYPE, "<http://x/C>"), (s, "<http://x/att>", '"v"@fr'), (s, "<http://x/p>", "<http://x/o>"), (s, "<http://x/q>", T.literal("5", T.INTEGER))} <= rows
    assert any(p == T.FIRST and o == "<http://x/m>" for _, p, o in rows) and any(p == "<http://x/t>" for _, p, _ in rows)


@pytest.mark.parametrize("fmt", ["turtle", "ntriples", "rdfxml"])
def test_round_trips(spark, fmt):
    rows = [t for t in rdf.parse_turtle(TTL)]
    g = Graph.rows(spark, [t[:3] for t in rows])
    back = {t[:3] for t in rdf.parse_text(rdf.serialize(g, fmt), fmt)}
    ground = lambda ts: {t for t in ts if not any(x.startswith("_:") for x in t)}
    assert ground(back) == ground({t[:3] for t in rows}) and len(back) == len({t[:3] for t in rows})


def test_files_and_lines(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    assert rdf.load_files(spark, str(tmp_path / "a.ttl")).count() == 17
    (tmp_path / "b.nt").write_text('<a> <b> "x"^^<http://www.w3.org/2001/XMLSchema#string> .\n# c\n\n_:x <p> "y"@EN .\n<a> <b> <c> <g> .\n')
    rows = sorted(map(tuple, rdf.read_ntriples(spark, str(tmp_path / "b.nt")).collect()), key=str)
    assert ("<a>", "<b>", '"x"', None) in rows and ("_:x", "<p>", '"y"@en', None) in rows and ("<a>", "<b>", "<c>", "<g>") in rows
    (tmp_path / "c.nt").write_text("nonsense\n")
    with pytest.raises(Exception, match="not an N-Triples line"):
        rdf.read_ntriples(spark, str(tmp_path / "c.nt")).collect()
    assert rdf.read_ntriples(spark, str(tmp_path / "c.nt"), strict=False).count() == 0


def xlsx(path, rows):
    import zipfile

    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + c)}{r + 1}" t="{"inlineStr" if isinstance(v, str) else "n"}">' + (f"<is><t>{v}</t></is>" if isinstance(v, str) else f"<v>{v}</v>") + "</c>" for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')


def test_tabular(spark, tmp_path):
    want = [{"a": "1", "b": "x"}, {"a": "2", "b": ""}]
    (tmp_path / "t.csv").write_text("b,a\nx,1\n,2\n")
    (tmp_path / "t.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    (tmp_path / "t.ndjson").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    (tmp_path / "t.yaml").write_text("- a: 1\n  b: x\n- a: 2\n")
    (tmp_path / "t.xml").write_text("<r><i k='z'><a>1</a><b>x</b></i><j><a>2</a></j></r>")
    xlsx(tmp_path / "t.xlsx", [["a", "b"], [1, "x"], [2]])
    spark.createDataFrame([(1, "x"), (2, None)], "a int, b string").write.parquet(str(tmp_path / "t.parquet"))
    for end in ("csv", "json", "ndjson", "yaml", "xml", "xlsx", "parquet"):
        df = tabular.read_file(spark, str(tmp_path / f"t.{end}"))
        assert tabular.headers(df) == ["a", "b"]
        assert sorted((r.asDict() for r in df.collect()), key=lambda r: r["a"]) == want, end
    (tmp_path / "bad.csv").write_text("a,b\n1\n2,3,4\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        tabular.read_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_sql(spark):
    assert [tabular.sql_driver(c) for c in ("postgres://h/d", "duckdb:x.db", "a.duckdb", "spark")] == ["postgres", "duckdb", "duckdb", "spark"]
    assert tabular.sql_rows(spark, "SELECT 1 AS a, CAST(NULL AS STRING) AS b").collect()[0].asDict() == {"a": "1", "b": ""}
    assert tabular.sql_rows(spark, "SELECT 7 AS a, 'x' AS b", "duckdb::memory:").collect()[0].asDict() == {"a": "7", "b": "x"}
    assert tabular.sql_rows(spark, "SELECT 7 AS a WHERE false", "duckdb::memory:").columns == ["a"]
    odd = tabular.sql_rows(spark, "SELECT NULL::INT AS a, TIME '10:11:12' AS t, 'u'::ENUM('u', 'v') AS e UNION ALL SELECT 3, NULL, NULL", "duckdb::memory:")
    assert sorted((r["a"] or "", r["t"] or "", r["e"] or "") for r in odd.collect()) == [("", "10:11:12.000000", "u"), ("3", "", "")]
    with pytest.raises(ValueError):
        tabular.sql_driver("mysql://x")


def test_large_duckdb_results_are_streamed(spark, monkeypatch):
    monkeypatch.setattr(tabular, "BATCH_ROWS", 4_096)
    found = tabular.sql_rows(spark, "SELECT range AS a, 'x' || range AS b FROM range(20000)", "duckdb::memory:")
    assert found.select(F.count("*"), F.sum("a").cast("long"), F.countDistinct("b")).first()[:] == (20000, 199990000, 20000)


def test_repository_cache_and_slots(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.ttl").write_text("<http://a> <http://b> <http://c> .")
    (tmp_path / "sub" / "B.NT").write_text("<http://a> <http://b> <http://c> .\n<http://a> <http://b> <http://d> .\n")
    (tmp_path / "x.txt").write_text("no")
    names = lambda **k: [r["name"] for r in store.list_files(spark, str(tmp_path), **k).collect()]
    assert names() == ["a.ttl"] and names(recursive=True) == ["a.ttl", "B.NT"] and names(recursive=True, glob="b.*") == ["B.NT"] and names(recursive=True, limit=1, offset=1) == ["B.NT"]
    assert store.resolve_target("B", [str(tmp_path)]).endswith("B.NT")
    for bad in ("../etc", "zzz"):
        with pytest.raises(store.RepositoryError):
            store.resolve_target(bad, [str(tmp_path)])
    reg = store.Registry(spark, str(tmp_path / "cache"), idle_seconds=0.001)
    path = str(tmp_path / "a.ttl")
    assert reg.load(path, auto_refresh=True)["cached"] is False and reg.load(path, auto_refresh=True)["cached"] is True
    import os
    import time

    time.sleep(0.01)
    assert reg.evict_idle() == ["a"] and not reg.status()["loaded"] and reg.graph().count() == 1
    (tmp_path / "a.ttl").write_text("<http://a> <http://b> <http://c> , <http://e> .")
    os.utime(path, (1, 1))
    assert reg.graph().count() == 2 and reg.recompile()["triple_count"] == 2
    assert reg.unload(delete_cache=True) and reg.listed() == [] and reg.graph().count() == 0


def test_imports_and_catalogue(spark):
    texts = {"http://b": "<http://b> <http://www.w3.org/2002/07/owl#imports> <http://c> , <http://a> .", "http://a": "<http://a> <http://p> <http://x> ."}

    def fetch(iri):
        if iri not in texts:
            raise OSError("gone")
        return texts[iri]

    g = Graph.rows(spark, [("<http://a>", f"<{T.OWL}imports>", "<http://b>")])
    done, log = store.import_closure(g, fetch)
    assert {x["iri"]: x["status"] for x in log} == {"<http://b>": "loaded", "<http://a>": "loaded", "<http://c>": "failed"} and done.count() == 4
    assert store.catalogue(spark).count() == 32 and store.catalogue(spark, "iot").count() == 2 and store.catalogue_entry("foaf")["format"] == "rdfxml"
