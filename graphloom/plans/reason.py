"""Rule reasoning as a semi-naive fixpoint: profiles rdfs, owl-rl and owl-rl-ext.

Schema slices (subclass, subproperty, domain, range and the role axioms) are closed first; then instance rules run over what was
new in the round before, until nothing is new. RDFS alone needs one pass where no axiom is about the axioms' own predicates. Domains, ranges, role characteristics, inverses and restrictions are read
from the input once. What was found is written to the shared folder every round. Unknown profiles mean rdfs.

Deliberate rules of this engine: rdfs11 gives no reflexive facts; ranges type IRIs only; symmetric and inverse rules make no
literal subjects; the second conclusion of the someValuesFrom rule (x is also typed by every class under the
restriction) is unsound in OWL and off unless ``lenient`` is set; sameAs is symmetric, and transitive with ``closed_same_as``;
allValuesFrom is on request (``all_values``).
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.plans.closure import closure
from graphloom.session import discard, materialize, parts_of

MAX_ROUNDS = 64
_O = lambda name: f"<{T.OWL}{name}>"


@dataclass
class Inference:
    """The facts that are new, and the graph with them."""

    profile: str
    inferred: DataFrame
    graph: Graph
    rounds: int

    def report(self, materialized: bool = True) -> str:
        inferred, before = self.inferred.count(), self.graph.count()
        sample = [f"{r['s']} a {r['o']}" for r in self.inferred.where(F.col("p") == T.TYPE).orderBy("s", "o").limit(10).collect()]
        return json.dumps({"profile_used": self.profile, "inferred_count": inferred, "iterations": self.rounds, "initial_triples": before - inferred if materialized else before, "final_triples": before, "sample_inferences": sample, **({} if materialized else {"dry_run": True})})


def list_members(t: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, member, position) of RDF lists; t: triples, heads: (head).

    Round k joins what was found with the jumps of 2^k cells, so the number of rounds is logarithmic in the longest list. A cyclic list raises.
    """
    first = t.where(F.col("p") == T.FIRST).select(F.col("s").alias("cell"), F.col("o").alias("member"))
    jump = materialize(t.where((F.col("p") == T.REST) & (F.col("o") != T.NIL)).select(F.col("s").alias("cell"), F.col("o").alias("next")), "list")
    found = materialize(heads.select("head", F.col("head").alias("cell"), F.lit(0).cast("long").alias("position")).where(F.col("cell") != T.NIL), "list")
    cells, length = jump.count(), 1
    while True:
        further = materialize(found.join(jump, "cell").select("head", F.col("next").alias("cell"), (F.col("position") + length).alias("position")), "list")
        if further.isEmpty():
            return found.join(first, "cell").select("head", "member", "position")
        if length > cells:
            raise ValueError("a list is cyclic")
        found = materialize(found.unionByName(further), "list")
        jump = materialize(jump.join(jump.select(F.col("cell").alias("next"), F.col("next").alias("after")), "next").select("cell", F.col("after").alias("next")), "list")
        length *= 2


class _Rules:
    def __init__(self, base: DataFrame, profile: str, lenient: bool, closed_same_as: bool, all_values: bool):
        self.profile, self.lenient, self.closed_same_as, self.all_values = profile, lenient, closed_same_as, all_values
        pairs = lambda p: base.where(F.col("p") == p).select("s", "o")
        self.domains = pairs(T.DOMAIN).select(F.col("s").alias("p"), F.col("o").alias("c"))
        self.ranges = pairs(T.RANGE).select(F.col("s").alias("p"), F.col("o").alias("c"))
        self.rl = profile in ("owl-rl", "owl-rl-ext")
        self.ext = profile == "owl-rl-ext"
        if self.rl:
            typed = lambda c: base.where((F.col("p") == T.TYPE) & (F.col("o") == c)).select(F.col("s").alias("p")).distinct()
            self.transitive, self.symmetric = typed(_O("TransitiveProperty")), typed(_O("SymmetricProperty"))
            inv = pairs(T.INVERSE_OF)
            self.inverse = inv.select(F.col("s").alias("p"), F.col("o").alias("q")).union(inv.select(F.col("o").alias("p"), F.col("s").alias("q"))).distinct()
            self.equal_classes, self.equal_properties = pairs(T.EQUIVALENT_CLASS), pairs(T.EQUIVALENT_PROPERTY)
            self.has_transitive, self.has_symmetric, self.has_inverse = (not x.isEmpty() for x in (self.transitive, self.symmetric, self.inverse))
        if self.ext:
            on = pairs(T.ON_PROPERTY).select(F.col("s").alias("r"), F.col("o").alias("p"))
            of = lambda name: pairs(_O(name)).select(F.col("s").alias("r"), F.col("o").alias("f")).join(on, "r")
            self.some, self.value, self.every = of("someValuesFrom"), of("hasValue"), of("allValuesFrom")
            lists = lambda name: pairs(_O(name)).select(F.col("s").alias("c"), F.col("o").alias("head"))
            both, either = lists("intersectionOf"), lists("unionOf")
            self.both = both.join(list_members(base, both.select("head").distinct()), "head").select("c", "member").distinct()
            self.either = either.join(list_members(base, either.select("head").distinct()), "head").select("c", "member").distinct()
            self.both_sizes = self.both.groupBy("c").agg(F.count("*").alias("size"))

    def schema(self, every: DataFrame) -> DataFrame:
        """Closed subclass and subproperty triples that are new or not."""
        out = []
        for p, equal in ((T.SUBCLASS, "equal_classes"), (T.SUBPROPERTY, "equal_properties")):
            edges = every.where(F.col("p") == p).select("s", "o")
            if self.rl:
                e = getattr(self, equal)
                edges = edges.union(e).union(e.select(F.col("o").alias("s"), F.col("s").alias("o")))
            edges = edges.where(F.col("s") != F.col("o"))
            out.append(closure(edges).where(F.col("s") != F.col("o")).select("s", F.lit(p).alias("p"), "o"))
        return functools.reduce(DataFrame.unionByName, out)

    def instances(self, every: DataFrame, fresh: DataFrame, sub: DataFrame, props: DataFrame) -> list[DataFrame]:
        typed = lambda df: df.select("s", F.lit(T.TYPE).alias("p"), "o")
        out = [
            fresh.where(F.col("p") == T.TYPE).select("s", F.col("o").alias("k")).join(sub.select(F.col("s").alias("k"), "o"), "k").transform(typed),
            fresh.join(self.domains, "p").select("s", F.col("c").alias("o")).transform(typed),
            fresh.where(T.is_iri(F.col("o"))).join(self.ranges, "p").select(F.col("o").alias("s"), F.col("c").alias("o")).transform(typed),
            fresh.join(props.select(F.col("s").alias("p"), F.col("o").alias("q")), "p").select("s", F.col("q").alias("p"), "o"),
        ]
        if self.rl:
            subject = ~T.is_literal(F.col("o"))
            if self.has_transitive:
                moved = fresh.join(self.transitive, "p", "left_semi")
                alls = every.join(self.transitive, "p", "left_semi")
                for a, b in ((moved, alls), (alls, moved)):
                    step = a.select("p", "s", F.col("o").alias("m")).join(b.select("p", F.col("s").alias("m"), "o"), ["p", "m"])
                    out.append(step.where(F.col("s") != F.col("o")).select("s", "p", "o"))
            if self.has_symmetric:
                out.append(fresh.join(self.symmetric, "p", "left_semi").where(subject).select(F.col("o").alias("s"), "p", F.col("s").alias("o")))
            if self.has_inverse:
                out.append(fresh.join(self.inverse, "p").where(subject).select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o")))
            same = fresh.where((F.col("p") == T.SAME_AS) & subject)
            out.append(same.select(F.col("o").alias("s"), "p", F.col("s").alias("o")))
            if self.closed_same_as:
                alls = every.where(F.col("p") == T.SAME_AS)
                out.append(same.select("s", F.col("o").alias("m")).join(alls.select(F.col("s").alias("m"), "o"), "m").where(F.col("s") != F.col("o")).select("s", F.lit(T.SAME_AS).alias("p"), "o"))
        if self.ext:
            types = every.where(F.col("p") == T.TYPE).select(F.col("s").alias("x"), F.col("o").alias("c"))
            uses = every.select(F.col("s").alias("x"), "p", F.col("o").alias("y"))
            some = uses.join(self.some, "p")
            met = some.join(types.select(F.col("x").alias("y"), F.col("c").alias("f")), ["y", "f"], "left_semi").union(some.where(F.col("y") == F.col("f")))
            met = met.select(F.col("x").alias("s"), "r")
            out.append(met.select("s", F.col("r").alias("o")).transform(typed))
            if self.lenient:
                out.append(met.join(sub.select(F.col("o").alias("r"), F.col("s").alias("under")), "r").select("s", F.col("under").alias("o")).transform(typed))
            under = types.join(sub.select(F.col("s").alias("c"), F.col("o").alias("r")), "c").select("x", "r").union(types.select("x", F.col("c").alias("r")))
            out.append(under.join(self.value, "r").select(F.col("x").alias("s"), "p", F.col("f").alias("o")))
            out.append(uses.join(self.value.select("r", "p", F.col("f").alias("y")), ["p", "y"]).select(F.col("x").alias("s"), F.col("r").alias("o")).transform(typed))
            if self.all_values:
                made = under.join(self.every, "r").join(uses, ["x", "p"]).where(~T.is_literal(F.col("y")))
                out.append(made.select(F.col("y").alias("s"), F.col("f").alias("o")).transform(typed))
            each = types.select("x", F.col("c").alias("member")).distinct()
            counted = each.join(self.both, "member").groupBy("x", "c").agg(F.count("*").alias("n")).join(self.both_sizes, "c").where(F.col("n") == F.col("size"))
            out.append(counted.select(F.col("x").alias("s"), F.col("c").alias("o")).transform(typed))
            out.append(each.join(self.either, "member").select(F.col("x").alias("s"), F.col("c").alias("o")).transform(typed))
        return out


def _single_pass(base: DataFrame) -> DataFrame | None:
    """RDFS facts in one plan: properties first, then domains and ranges, then classes, each over closed hierarchies.

    None if a rule could feed an earlier one: where a hierarchy's own predicates, or rdf:type, have axioms themselves.
    """
    pairs = lambda p: base.where(F.col("p") == p).select("s", "o")
    hierarchy = lambda p: closure(pairs(p).where(F.col("s") != F.col("o"))).where(F.col("s") != F.col("o"))
    sub, props = hierarchy(T.SUBCLASS), hierarchy(T.SUBPROPERTY)
    own = [T.TYPE, T.SUBCLASS, T.SUBPROPERTY]
    axioms = base.where(F.col("p").isin(T.DOMAIN, T.RANGE, T.SUBPROPERTY) & F.col("s").isin(*own)).select("s").union(props.where(F.col("o").isin(T.SUBCLASS, T.SUBPROPERTY)).select("s"))
    if not axioms.isEmpty():
        return None
    raised = base.join(props.select(F.col("s").alias("p"), F.col("o").alias("q")), "p").select("s", F.col("q").alias("p"), "o")
    uses = base.unionByName(raised)
    typed = lambda df: df.select("s", F.lit(T.TYPE).alias("p"), "o")
    of = lambda p: pairs(p).select(F.col("s").alias("p"), F.col("o").alias("c"))
    domains = uses.join(of(T.DOMAIN), "p").select("s", F.col("c").alias("o"))
    ranges = uses.where(T.is_iri(F.col("o"))).join(of(T.RANGE), "p").select(F.col("o").alias("s"), F.col("c").alias("o"))
    given = typed(domains.unionByName(ranges).distinct())
    kinds = uses.where(F.col("p") == T.TYPE).unionByName(given)
    under = typed(kinds.select("s", F.col("o").alias("k")).join(sub.select(F.col("s").alias("k"), "o"), "k"))
    schema = sub.select("s", F.lit(T.SUBCLASS).alias("p"), "o").unionByName(props.select("s", F.lit(T.SUBPROPERTY).alias("p"), "o"))
    made = functools.reduce(DataFrame.unionByName, [raised, given, under, schema])
    return _new(made, base)


def _new(made: DataFrame, base: DataFrame) -> DataFrame:
    """The distinct triples of made that are not in base; a table of any size is dealt into parts of a like size."""
    key = ["s", "p", "o"]
    made, base = made.select(*key), base.select(*key)
    parts = parts_of(made, base)
    if parts:
        made, base = made.repartition(parts, *key), base.repartition(parts, *key)
    return made.distinct().join(base, key, "left_anti")


def reason(g: Graph, profile: str = "rdfs", lenient: bool = False, closed_same_as: bool = False, all_values: bool = False, max_rounds: int = MAX_ROUNDS) -> Inference:
    """All facts of a profile over the default graph."""
    profile = profile if profile in ("rdfs", "owl-rl", "owl-rl-ext") else "rdfs"
    if profile == "rdfs":
        inferred = _single_pass(g.triples)
        if inferred is not None:
            return Inference(profile, inferred, g.add_disjoint(inferred), 1)
    base = materialize(g.triples.distinct(), "base")
    rules = _Rules(base, profile, lenient, closed_same_as, all_values)
    key = ["s", "p", "o"]
    every, fresh, schema, found, rounds = base, base, None, [], 0  # each round's facts are a table of their own, in no earlier one
    while rounds < max_rounds:
        rounds += 1
        moved = schema is None or not fresh.where(F.col("p").isin(T.SUBCLASS, T.SUBPROPERTY)).isEmpty()
        if moved:
            before, schema = schema, materialize(rules.schema(every), "schema")
            if before is not None:
                discard(before)
        sub = schema.where(F.col("p") == T.SUBCLASS).select("s", "o")
        props = schema.where(F.col("p") == T.SUBPROPERTY).select("s", "o")
        made = rules.instances(every, every if moved else fresh, sub, props)
        if moved:
            made.append(schema)
        fresh = materialize(_new(functools.reduce(DataFrame.unionByName, [m.select(*key) for m in made]), every), "fresh")
        if fresh.isEmpty():
            break
        found.append(fresh)
        every = every.unionByName(fresh)
    else:
        raise RuntimeError(f"the facts did not settle in {max_rounds} rounds")
    discard(fresh)
    discard(schema)
    inferred = functools.reduce(DataFrame.unionByName, found, base.select(*key).limit(0))
    return Inference(profile, inferred, g.add_disjoint(inferred), rounds)
