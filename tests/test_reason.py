"""The semi-naive reasoner against a naive fixpoint over sets."""

import random

import pytest

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.plans.reason import list_members, reason

O = lambda n: f"<{T.OWL}{n}>"  # noqa: E731, E741
i = lambda x: f"<http://e/{x}>"


def naive(base, profile):
    every = set(base)
    of = lambda p: {(s, o) for s, q, o in base if q == p}
    domains, ranges = of(T.DOMAIN), of(T.RANGE)
    typed = lambda c: {s for s, q, o in base if q == T.TYPE and o == c}
    trans, symm, inv = typed(O("TransitiveProperty")), typed(O("SymmetricProperty")), of(T.INVERSE_OF)
    eqc, eqp = of(T.EQUIVALENT_CLASS), of(T.EQUIVALENT_PROPERTY)
    lit = lambda t: t.startswith('"')
    while True:
        new = set()
        for kind in (T.SUBCLASS, T.SUBPROPERTY):
            pairs = {(s, o) for s, p, o in every if p == kind}
            new |= {(a, kind, d) for a, b in pairs for c, d in pairs if b == c and len({a, b, d}) == 3}
        sub, props = ({(s, o) for s, p, o in every if p == k} for k in (T.SUBCLASS, T.SUBPROPERTY))
        new |= {(x, T.TYPE, b) for x, p, a in every if p == T.TYPE for c, b in sub if a == c and a != b}
        new |= {(s, T.TYPE, c) for s, p, o in every for q, c in domains if p == q}
        new |= {(o, T.TYPE, c) for s, p, o in every for q, c in ranges if p == q and o.startswith("<")}
        new |= {(s, b, o) for s, p, o in every for a, b in props if p == a and a != b}
        if profile != "rdfs":
            new |= {(a, p, d) for a, p, b in every if p in trans for c, q, d in every if q == p and b == c and a != d}
            new |= {(o, p, s) for s, p, o in every if p in symm and not lit(o)}
            new |= {(o, b, s) for s, p, o in every for a, b in inv | {(y, x) for x, y in inv} if p == a and not lit(o)}
            new |= {(o, p, s) for s, p, o in every if p == T.SAME_AS and not lit(o)}
            new |= {(a, T.SUBCLASS, b) for x, y in eqc for a, b in ((x, y), (y, x)) if a != b}
            new |= {(a, T.SUBPROPERTY, b) for x, y in eqp for a, b in ((x, y), (y, x)) if a != b}
        if new <= every:
            return every - set(base)
        every |= new


@pytest.mark.parametrize("profile", ["rdfs", "owl-rl"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_naive(spark, profile, seed):
    draw = random.Random(seed)
    cs, ps, xs = "ABCDE", "pqrs", "uvwx"
    rows = set()
    for _ in range(26):
        k = draw.randrange(9)
        c, p, x = (lambda: i(draw.choice(cs))), (lambda: i(draw.choice(ps))), (lambda: i(draw.choice(xs)))
        rows.add([
            lambda: (c(), T.SUBCLASS, c()), lambda: (p(), T.SUBPROPERTY, p()), lambda: (x(), T.TYPE, c()), lambda: (x(), p(), x()), lambda: (x(), p(), x()),
            lambda: (p(), draw.choice([T.DOMAIN, T.RANGE]), c()), lambda: (p(), T.TYPE, draw.choice([O("TransitiveProperty"), O("SymmetricProperty")])),
            lambda: draw.choice([(p(), T.INVERSE_OF, p()), (c(), T.EQUIVALENT_CLASS, c()), (p(), T.EQUIVALENT_PROPERTY, p())]), lambda: draw.choice([(x(), p(), '"lit"'), (x(), T.SAME_AS, x())]),
        ][k]())
    got = {tuple(r) for r in reason(Graph.rows(spark, sorted(rows)), profile).inferred.collect()}
    assert got == naive(rows, profile)


def test_restrictions_and_options(spark):
    rows = [("_:r", T.ON_PROPERTY, i("p")), ("_:r", O("someValuesFrom"), i("F")), (i("Under"), T.SUBCLASS, "_:r"), (i("x"), i("p"), i("y")), (i("y"), T.TYPE, i("F")), ("_:a", T.ON_PROPERTY, i("q")), ("_:a", O("allValuesFrom"), i("G")), (i("H"), T.SUBCLASS, "_:a"), (i("h"), T.TYPE, i("H")), (i("h"), i("q"), i("z"))]
    g = Graph.rows(spark, rows)
    plain = {tuple(r) for r in reason(g, "owl-rl-ext").inferred.collect()}
    assert (i("x"), T.TYPE, "_:r") in plain and (i("x"), T.TYPE, i("Under")) not in plain and (i("z"), T.TYPE, i("G")) not in plain
    more = {tuple(r) for r in reason(g, "owl-rl-ext", lenient=True, all_values=True).inferred.collect()}
    assert (i("x"), T.TYPE, i("Under")) in more and (i("z"), T.TYPE, i("G")) in more


def test_empty_unknown_profile_and_report(spark):
    done = reason(Graph.empty(spark), "no such")
    assert done.profile == "rdfs" and done.inferred.count() == 0
    assert '"dry_run": true' in done.report(materialized=False)


def test_list_members(spark):
    cells = [("_:1", T.FIRST, i("a")), ("_:1", T.REST, "_:2"), ("_:2", T.FIRST, i("b")), ("_:2", T.REST, T.NIL)]
    g = Graph.rows(spark, cells)
    heads = spark.createDataFrame([("_:1",), (T.NIL,)], "head string")
    assert sorted((r["member"], r["position"]) for r in list_members(g.triples, heads).collect()) == [(i("a"), 0), (i("b"), 1)]
