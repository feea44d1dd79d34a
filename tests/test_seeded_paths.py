"""Paths between two variables start from the values that one of them has already."""

import random

import pytest

from graphloom.graph import Graph
from graphloom.plans import closure as C
from graphloom.plans import sparql


@pytest.mark.parametrize("limit", [0, 20_000])
def test_pairs_from_seeds(spark, limit):
    draw = random.Random(5)
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")]
    for edges in ([(str(k), str(k + 1)) for k in range(37)], ring, [("y", "a"), ("a", "b"), ("b", "a")], [(str(draw.randint(0, 25)), str(draw.randint(0, 25))) for _ in range(30)]):
        seeds = sorted({edges[0][0], edges[3][0] if len(edges) > 3 else "a", "none"})
        got = sorted(map(tuple, C.reach_pairs(spark.createDataFrame(edges, "s string, o string"), spark.createDataFrame([(x,) for x in seeds], "n string"), limit).collect()))
        assert got == sorted({(a, b) for a, b in C.close_pairs(edges, 10_000) if a in seeds} | {(x, x) for x in seeds})


def test_lists_do_not_close_the_whole_path(spark, monkeypatch):
    """All pairs of the cells of a list grow with the square of its length."""

    def never(*_):
        raise AssertionError("the path was closed from every node")

    rows = [t for k in range(300) for t in ((f"_:{k}", "<first>", f"<m{k}>"), (f"_:{k}", "<rest>", f"_:{k + 1}"))] + [("<b>", "<parts>", "_:0"), ("<c>", "<parts>", "_:290")]
    g = Graph.of(spark.createDataFrame(rows, "s string, p string, o string"))
    monkeypatch.setattr(sparql, "closure", never)
    got = sorted(map(tuple, g.query("SELECT ?b ?m WHERE { ?b <parts>/<rest>*/<first> ?m }").collect()))
    assert got == sorted([("<b>", f"<m{k}>") for k in range(300)] + [("<c>", f"<m{k}>") for k in range(290, 300)])
    one = g.query("SELECT ?b ?m WHERE { ?b <parts> ?x . ?x <rest>+ ?y . ?y <first> ?m }").where("b = '<c>'").collect()
    assert sorted(r["m"] for r in one) == [f"<m{k}>" for k in range(291, 300)]


def test_both_ends_and_backwards(spark):
    rows = [("<a>", "<n>", "<b>"), ("<b>", "<n>", "<c>"), ("<c>", "<n>", "<a>"), ("<k>", "<to>", "<c>"), ("<a>", "<like>", "<a>"), ("<k>", "<p>", "<n>")]
    g = Graph.of(spark.createDataFrame(rows, "s string, p string, o string"))
    assert sorted(r["x"] for r in g.query("SELECT ?x WHERE { ?k <to> ?c . ?x <n>+ ?c }").collect()) == ["<a>", "<b>", "<c>"]
    assert [tuple(r) for r in g.query("SELECT ?a ?b WHERE { ?a <like> ?b . ?a <n>+ ?b }").collect()] == [("<a>", "<a>")]
    assert {r["y"] for r in g.query("SELECT ?y WHERE { <k> <to> ?c . ?c ^<n>* ?y }").collect()} == {"<a>", "<b>", "<c>"}
    assert g.query("SELECT ?y WHERE { <b> ?q <c> . ?q <m>* ?y }").collect() == g.query("SELECT ?y WHERE { VALUES ?y { <n> } }").collect()
