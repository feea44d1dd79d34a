import pytest

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.plans import dl
from graphloom.sources.rdf import parse_turtle

HEAD = """@prefix : <http://x/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
"""


def onto(text):
    return dl.read_ontology([t[:3] for t in parse_turtle(HEAD + text)])


def sat(o, c):
    return o.satisfiable(dl.named(f"http://x/{c}"))


def sub(o, a, b):
    return o.subsumed(dl.named(f"http://x/{a}"), dl.named(f"http://x/{b}"))


UNSATISFIABLE = {
    "complement": ":A a owl:Class ; rdfs:subClassOf :B , [ owl:complementOf :B ] .",
    "disjoint": ":A rdfs:subClassOf :B , :C . :B owl:disjointWith :C .",
    "some and all": ":A rdfs:subClassOf [ owl:onProperty :r ; owl:someValuesFrom :B ] , [ owl:onProperty :r ; owl:allValuesFrom :C ] . :B owl:disjointWith :C .",
    "min over max": ':A rdfs:subClassOf [ owl:onProperty :r ; owl:minCardinality 3 ] , [ owl:onProperty :r ; owl:maxCardinality 2 ] .',
    "functional with disjoint fillers": ":r a owl:FunctionalProperty . :B owl:disjointWith :C . :A rdfs:subClassOf [ owl:onProperty :r ; owl:someValuesFrom :B ] , [ owl:onProperty :r ; owl:someValuesFrom :C ] .",
    "functional through a super role": ":s a owl:FunctionalProperty . :r rdfs:subPropertyOf :s . :q rdfs:subPropertyOf :s . :B owl:disjointWith :C . :A rdfs:subClassOf [ owl:onProperty :r ; owl:someValuesFrom :B ] , [ owl:onProperty :q ; owl:someValuesFrom :C ] .",
    "inverse": ":r owl:inverseOf :s . :A rdfs:subClassOf [ owl:onProperty :r ; owl:someValuesFrom [ owl:onProperty :s ; owl:allValuesFrom [ owl:complementOf :A ] ] ] .",
    "symmetric": ":r a owl:SymmetricProperty . :A rdfs:subClassOf [ owl:onProperty :r ; owl:someValuesFrom [ owl:onProperty :r ; owl:allValuesFrom [ owl:complementOf :A ] ] ] .",
    "transitive": ":r a owl:TransitiveProperty . :A rdfs:subClassOf [ owl:onProperty :r ; owl:someValuesFrom [ owl:onProperty :r ; owl:someValuesFrom :B ] ] , [ owl:onProperty :r ; owl:allValuesFrom [ owl:complementOf :B ] ] .",
    "union of the impossible": ":A rdfs:subClassOf [ owl:unionOf ( :B :C ) ] , [ owl:complementOf :B ] , [ owl:complementOf :C ] .",
    "all disjoint": "[] a owl:AllDisjointClasses ; owl:members ( :B :C :D ) . :A rdfs:subClassOf :B , :D .",
    "domain": ":r rdfs:domain :B . :B owl:disjointWith :A . :A rdfs:subClassOf [ owl:onProperty :r ; owl:someValuesFrom owl:Thing ] .",
    "range": ":r rdfs:range :B . :B owl:disjointWith :C . :A rdfs:subClassOf [ owl:onProperty :r ; owl:someValuesFrom :C ] .",
    "qualified": ":A rdfs:subClassOf [ owl:onProperty :r ; owl:minQualifiedCardinality 2 ; owl:onClass :B ] , [ owl:onProperty :r ; owl:maxQualifiedCardinality 1 ; owl:onClass :B ] .",
    "exact": ":A rdfs:subClassOf [ owl:onProperty :r ; owl:cardinality 1 ] , [ owl:onProperty :r ; owl:minCardinality 2 ] .",
    "nothing": ":A rdfs:subClassOf owl:Nothing .",
    "inherited": ":A rdfs:subClassOf :B . :B rdfs:subClassOf :C , :D . :C owl:disjointWith :D .",
    "all under an empty class": ":A rdfs:subClassOf [ owl:onProperty :r ; owl:someValuesFrom :B ] . :B owl:equivalentClass owl:Nothing .",
}

SATISFIABLE = {
    "all without some": ":A rdfs:subClassOf [ owl:onProperty :r ; owl:allValuesFrom :B ] , [ owl:onProperty :r ; owl:allValuesFrom [ owl:complementOf :B ] ] .",
    "endless chain": ":A rdfs:subClassOf [ owl:onProperty :r ; owl:someValuesFrom :A ] .",
    "endless functional inverse": ":r a owl:FunctionalProperty . :s owl:inverseOf :r . :A rdfs:subClassOf [ owl:onProperty :s ; owl:someValuesFrom :A ] .",
    "two by two": ":A rdfs:subClassOf [ owl:onProperty :r ; owl:minCardinality 2 ] , [ owl:onProperty :r ; owl:maxCardinality 2 ] .",
    "merge": ":A rdfs:subClassOf [ owl:onProperty :r ; owl:someValuesFrom :B ] , [ owl:onProperty :r ; owl:someValuesFrom :C ] , [ owl:onProperty :r ; owl:maxCardinality 1 ] .",
    "union": ":A rdfs:subClassOf [ owl:unionOf ( :B :C ) ] , [ owl:complementOf :B ] .",
    "not transitive": ":A rdfs:subClassOf [ owl:onProperty :r ; owl:someValuesFrom [ owl:onProperty :r ; owl:someValuesFrom :B ] ] , [ owl:onProperty :r ; owl:allValuesFrom [ owl:complementOf :B ] ] .",
    "qualified apart": ":B owl:disjointWith :C . :A rdfs:subClassOf [ owl:onProperty :r ; owl:minQualifiedCardinality 2 ; owl:onClass :B ] , [ owl:onProperty :r ; owl:maxQualifiedCardinality 1 ; owl:onClass :C ] .",
}


@pytest.mark.parametrize("name", UNSATISFIABLE)
def test_unsatisfiable(name):
    assert sat(onto(UNSATISFIABLE[name]), "A") is False


@pytest.mark.parametrize("name", SATISFIABLE)
def test_satisfiable(name):
    assert sat(onto(SATISFIABLE[name]), "A") is True


def test_subsumptions():
    o = onto(""":Parent owl:equivalentClass [ owl:intersectionOf ( :Person [ owl:onProperty :child ; owl:someValuesFrom :Person ] ) ] .
      :Mother owl:equivalentClass [ owl:intersectionOf ( :Parent :Woman ) ] . :Woman rdfs:subClassOf :Person .
      :Grand owl:equivalentClass [ owl:intersectionOf ( :Person [ owl:onProperty :child ; owl:someValuesFrom :Parent ] ) ] .""")
    assert sub(o, "Mother", "Parent") and sub(o, "Grand", "Parent") and sub(o, "Mother", "Person")
    assert not sub(o, "Parent", "Grand") and not sub(o, "Parent", "Mother") and not sub(o, "Person", "Woman")
    assert dl.check_subsumption(o, "<http://x/Grand>", "http://x/Parent")["subsumed"]


def test_individuals():
    o = onto(":r a owl:ObjectProperty ; rdfs:range :B . :x a :A ; :r :y . :A rdfs:subClassOf [ owl:onProperty :r ; owl:allValuesFrom :C ] .")
    assert o.consistent() and o.instance_of("<http://x/y>", dl.named("http://x/C")) and o.instance_of("<http://x/y>", dl.named("http://x/B"))
    assert not o.instance_of("<http://x/x>", dl.named("http://x/C"))
    assert onto(":x a :A , :B . :A owl:disjointWith :B .").consistent() is False
    assert onto(":x owl:sameAs :y ; owl:differentFrom :y .").consistent() is False
    assert onto(":r a owl:ObjectProperty , owl:FunctionalProperty . :x :r :y , :z . :y owl:differentFrom :z .").consistent() is False


def test_limits_mean_unknown(monkeypatch):
    monkeypatch.setattr(dl, "MAX_NODES", 3)
    assert sat(onto(":A rdfs:subClassOf [ owl:onProperty :r ; owl:minCardinality 8 ] ."), "A") is None


def test_distributed_classification(spark):
    rows = parse_turtle(HEAD + """:A a owl:Class ; rdfs:subClassOf :B . :B rdfs:subClassOf :C . :D owl:equivalentClass [ owl:intersectionOf ( :A :B ) ] .
      :E rdfs:subClassOf :A , [ owl:complementOf :C ] . :i a :A .""")
    g = Graph.rows(spark, [t[:3] for t in rows])
    status = {T.local_name(r["class"]): r["satisfiable"] for r in dl.class_status(g).collect()}
    assert status == {"A": True, "B": True, "C": True, "D": True, "E": False}
    pairs = {(T.local_name(r["sub"]), T.local_name(r["sup"])) for r in dl.classify(g).collect()}
    assert pairs == {("A", "B"), ("A", "C"), ("B", "C"), ("D", "A"), ("A", "D"), ("D", "B"), ("D", "C")}
    assert {T.local_name(r["class"]) for r in dl.individual_types(g).collect()} == {"A", "B", "C", "D"}
    assert '"unsatisfiable_classes": ["<http://x/E>"]' in dl.classification_report(g)
    assert dl.explain(dl.ontology_of(g), "http://x/E")["clash"]
