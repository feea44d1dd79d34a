"""SPARQL 1.1 algebra compiled to DataFrame plans.

A solution set is a DataFrame with one nullable term column per variable. The compiler tracks which variables are certainly
bound: those join by plain equality; the others need the compatible-mapping condition (equal, or unbound on a side).
Triple patterns are ordered most selective first and never by a cross product while a shared variable is left;
Catalyst picks the physical joins.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.plans.closure import closure, reach, reach_pairs
from graphloom.plans.sparql_expr import Expressions, Num, Val, integer, order_keys
from graphloom.session import PART_BYTES, local_frame, parts_of, read_bytes, spread
from graphloom.plans.sparql_parser import Expr, Group, Path, Query, Select, SparqlError, Triple, Update, Var, parse_query, parse_update


#: Expressions that read numbers: operators, and calls of functions on numbers among them.
_NUMERIC = ("+", "-", "*", "/", "neg", "call")


def column_name(var: str) -> str:
    """A column name for a variable; Spark ignores case, SPARQL does not."""
    return "v_" + "".join(f"{c.lower()}~" if c.isupper() else c for c in var)


@dataclass
class Solution:
    df: DataFrame
    vars: list[str]
    certain: set[str]
    dealt: tuple[list[str], int] | None = None  # the variables and the number of parts by which the rows are dealt already

    def column(self, var: str) -> Column | None:
        return self.df[column_name(var)] if var in self.vars else None

    def select(self, names: list[str]) -> Solution:
        cols = [(F.col(f"`{column_name(v)}`") if v in self.vars else F.lit(None).cast("string").alias(column_name(v))) for v in names]
        return Solution(self.df.select(*cols) if cols else self.df.select(F.lit(1).alias("one")), list(names), self.certain & set(names))


def _c(var: str) -> Column:
    return F.col(f"`{column_name(var)}`")


def _named(var: str) -> str:
    return column_name(var)


def walk(e: Expr):
    yield e
    for a in e.args:
        if isinstance(a, Expr):
            yield from walk(a)


def expr_vars(e: Expr) -> set[str]:
    return {x.args[0] for x in walk(e) if x.op == "var"}


def conjuncts(e: Expr) -> list[Expr]:
    return [y for x in e.args for y in conjuncts(x)] if e.op == "and" else [e]


class Compiler:
    """Compiles patterns over quads (s, p, o, g); the default graph is where g is null."""

    def __init__(self, quads: DataFrame, froms: list | None = None):
        self.spark: SparkSession = quads.sparkSession
        self.quads = quads
        plain = [i for named, i in froms or [] if not named]
        self.active = quads.where(F.col("g").isin(*plain)) if plain else quads.where(F.col("g").isNull())
        self.graph_var: str | None = None

    # basic patterns
    def unit(self) -> Solution:
        return Solution(self.spark.range(1).select(F.lit(1).alias("one")), [], set())

    def nothing(self, names: list[str]) -> Solution:
        return Solution(self.spark.createDataFrame([], ", ".join(f"`{_named(v)}` string" for v in names) or "one int"), names, set(names))

    def triples(self) -> DataFrame:
        return self.active

    def pattern(self, t: Triple) -> Solution:
        if isinstance(t.p, Path):
            return self.path_pattern(t)
        df = self.triples()
        wanted: list[tuple[str, str]] = []
        for place, x in (("s", t.s), ("p", t.p), ("o", t.o)):
            if isinstance(x, Var):
                wanted.append((x.name, place))
            else:
                df = df.where(F.col(place) == x)
        if self.graph_var:
            wanted.append((self.graph_var, "g"))
        first: dict[str, str] = {}
        for name, place in wanted:
            if name in first:
                df = df.where(F.col(first[name]) == F.col(place))
            else:
                first[name] = place
        cols = [F.col(place).alias(_named(name)) for name, place in first.items()]
        return Solution(df.select(*cols) if cols else df.select(F.lit(1).alias("one")), list(first), set(first))

    def nodes(self) -> DataFrame:
        return self.active.select(F.col("s").alias("n")).union(self.active.select(F.col("o").alias("n"))).distinct()

    def path_edges(self, p: object) -> DataFrame:
        """(s, o) rows of a path, with the multiplicities that SPARQL gives it; star and opt without their zero-length part."""
        if isinstance(p, str):
            return self.active.where(F.col("p") == p).select("s", "o")
        if isinstance(p, Var):
            raise SparqlError("a variable inside a property path")
        if p.op == "iri":
            return self.path_edges(p.args[0])
        if p.op == "inv":
            return self.path_edges_full(p.args[0]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if p.op == "seq":
            out = self.path_edges_full(p.args[0])
            for q in p.args[1:]:
                out = out.select("s", F.col("o").alias("m")).join(self.path_edges_full(q).select(F.col("s").alias("m"), "o"), "m").select("s", "o")
            return out
        if p.op == "alt":
            return functools.reduce(DataFrame.union, [self.path_edges_full(q) for q in p.args])
        if p.op == "neg":
            forward, inverse = p.args
            out = self.active.where(~F.col("p").isin(*forward)).select("s", "o") if forward or not inverse else None
            if inverse:
                back = self.active.where(~F.col("p").isin(*inverse)).select(F.col("o").alias("s"), F.col("s").alias("o"))
                out = back if out is None else out.union(back)
            return out
        if p.op in ("plus", "star"):
            return closure(self.path_edges_full(p.args[0]))
        if p.op == "opt":
            return self.path_edges_full(p.args[0]).distinct()
        raise SparqlError(f"unknown path {p.op}")

    def path_edges_full(self, p: object) -> DataFrame:
        out = self.path_edges(p)
        if isinstance(p, Path) and p.op in ("star", "opt"):
            out = out.union(self.nodes().select(F.col("n").alias("s"), F.col("n").alias("o"))).distinct()
        return out

    def path_pattern(self, t: Triple) -> Solution:
        p = t.p
        if p.op == "seq":
            # split into patterns, so that constants and other patterns restrict each step
            mids = [Var(f"_p{id(t)}_{k}") for k in range(len(p.args) - 1)]
            ends = [t.s, *mids, t.o]
            parts = [Triple(a, q.args[0] if isinstance(q, Path) and q.op == "iri" else q, b) for a, q, b in zip(ends, p.args, ends[1:], strict=False)]
            out = self.bgp(parts)
            return out.select([v for v in out.vars if not v.startswith("_p")])
        if p.op == "inv":
            q = p.args[0]
            return self.pattern(Triple(t.o, q.args[0] if isinstance(q, Path) and q.op == "iri" else q, t.s))
        reflexive = p.op in ("star", "opt")
        constant_s, constant_o = not isinstance(t.s, Var), not isinstance(t.o, Var)
        if p.op in ("plus", "star") and (constant_s or constant_o):
            edges = self.path_edges_full(p.args[0])
            start, other = (t.s, t.o) if constant_s else (t.o, t.s)
            if not constant_s:
                edges = edges.select(F.col("o").alias("s"), F.col("s").alias("o"))
            seed = local_frame(self.spark, [(start,)], ["n"])
            found = reach(edges, seed)
            if reflexive:
                found = found.union(seed).distinct()
            if isinstance(other, Var):
                return Solution(found.select(F.col("n").alias(_named(other.name))), [other.name], {other.name})
            return Solution(found.where(F.col("n") == other).select(F.lit(1).alias("one")), [], set())
        edges = self.path_edges(p)
        if reflexive:
            nodes = self.nodes()
            for x in (t.s, t.o):
                if not isinstance(x, Var):
                    nodes = nodes.union(local_frame(self.spark, [(x,)], ["n"]))
            edges = edges.union(nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))).distinct()
        cols, names = [], []
        for place, x in (("s", t.s), ("o", t.o)):
            if not isinstance(x, Var):
                edges = edges.where(F.col(place) == x)
            elif x.name in names:
                edges = edges.where(F.col("s") == F.col("o"))
            else:
                cols.append(F.col(place).alias(_named(x.name)))
                names.append(x.name)
        return Solution(edges.select(*cols) if cols else edges.select(F.lit(1).alias("one")), names, set(names))

    @staticmethod
    def _names(t: Triple) -> set[str]:
        return {x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)}

    @staticmethod
    def _cost(t: Triple) -> tuple:
        """Lower is more selective: constants in s, then o, then p; type patterns and paths later."""
        known = lambda x: not isinstance(x, Var)
        return (-(4 * known(t.s) + 3 * (known(t.o) and t.p != T.TYPE) + known(t.p)), isinstance(t.p, Path), t.p == T.TYPE)

    def bgp(self, triples: list[Triple]) -> Solution:
        todo = sorted(triples, key=self._cost)
        out, bound, nodes = None, set(), set()
        while todo:
            tied = [t for t in todo if self._names(t) & bound] or todo
            t = min(tied, key=self._cost)
            todo.remove(t)
            found = self._from_bound(t, out, nodes) or self.pattern(t)
            out = found if out is None else self.join(out, found)
            bound |= self._names(t)
            if not isinstance(t.p, Path):
                nodes |= {x.name for x in (t.s, t.o) if isinstance(x, Var)}
        return out or self.unit()

    def _from_bound(self, t: Triple, out: Solution | None, nodes: set[str]) -> Solution | None:
        """A star or plus path between two variables from the values that one of them has already; None where that does not apply.

        nodes: the variables that stand for subjects or objects of the graph; others may hold terms that have no path of zero length.
        """
        p = t.p
        if not (out is not None and self.graph_var is None and isinstance(p, Path) and p.op in ("star", "plus") and isinstance(t.s, Var) and isinstance(t.o, Var) and t.s.name != t.o.name):
            return None
        start = next((x.name for x in (t.s, t.o) if x.name in nodes), None)
        if start is None:
            return None
        edges = self.path_edges_full(p.args[0])
        if start == t.o.name:
            edges = edges.select(F.col("o").alias("s"), F.col("s").alias("o"))
        seeds = out.df.select(_c(start).alias("n"))
        pairs = reach_pairs(edges, seeds)
        if p.op == "plus":
            pairs = pairs.withColumnRenamed("o", "m").join(edges.select(F.col("s").alias("m"), "o"), "m").select("s", "o").distinct()
        other = t.o.name if start == t.s.name else t.s.name
        return Solution(pairs.select(F.col("s").alias(_named(start)), F.col("o").alias(_named(other))), [start, other], {start, other})

    # joins
    def _sides(self, left: Solution, right: Solution) -> tuple[DataFrame, list[str], Column | None]:
        """The right side with shared columns renamed, the shared variables, and the join condition."""
        shared = [v for v in right.vars if v in left.vars]
        r = right.df.select(*[_c(v).alias(f"r_{_named(v)}") if v in shared else _c(v) for v in right.vars]) if right.vars else right.df.select(F.lit(1).alias("r_one"))
        cond = None
        for v in shared:
            a, b = left.df[f"`{_named(v)}`"], r[f"`r_{_named(v)}`"]
            c = a == b
            if v not in left.certain:
                c = c | a.isNull()
            if v not in right.certain:
                c = c | b.isNull()
            cond = c if cond is None else cond & c
        return r, shared, cond

    @staticmethod
    def _dealt(left: Solution, right: Solution, r: DataFrame, shared: list[str]) -> tuple[DataFrame, DataFrame, tuple[list[str], int] | None]:
        """Both sides of a join, and how they are dealt. Where both read more than a part, neither is broadcast, as a task would hold all of
        it, and there are as many parts as the tables ask for. (The optimizer takes a table for as large as its compressed files.)"""
        keys = [v for v in shared if v in left.certain and v in right.certain]
        if not keys or min(read_bytes(left.df), read_bytes(r)) <= PART_BYTES:
            return left.df, r, None
        again = left.dealt is not None and left.dealt[0] == keys
        parts = left.dealt[1] if again else parts_of(left.df, r)
        if not parts:
            return left.df, r.hint("merge"), None
        a = left.df if again else left.df.repartition(parts, *[_c(v) for v in keys])
        return a, r.repartition(parts, *[F.col(f"`r_{_named(v)}`") for v in keys]).hint("merge"), (keys, parts)

    def _merge(self, joined: DataFrame, left: Solution, right: Solution, shared: list[str], outer: bool, dealt: tuple[list[str], int] | None = None) -> Solution:
        names = left.vars + [v for v in right.vars if v not in left.vars]
        cols = [F.coalesce(_c(v), F.col(f"`r_{_named(v)}`")).alias(_named(v)) if v in shared and v not in left.certain else _c(v) for v in names]
        certain = set(left.certain) if outer else left.certain | right.certain
        return Solution(joined.select(*cols) if cols else joined.select(F.lit(1).alias("one")), names, certain, dealt)

    def join(self, left: Solution, right: Solution) -> Solution:
        r, shared, cond = self._sides(left, right)
        if cond is None:
            return self._merge(left.df.crossJoin(r), left, right, shared, False)
        if self._keyless(left, right, shared):
            return self._merge(self._inner(self._parts(left, right, r, shared)), left, right, shared, False)
        a, b, dealt = self._dealt(left, right, r, shared)
        return self._merge(a.join(b, cond, "inner"), left, right, shared, False, dealt)

    # Joins on variables none of which is bound for certain on both sides have no key to hash or sort by. Their pairs fall into disjoint parts: those
    # whose first variable bound on both sides is the i-th, joined by its equality, and those with none, all of which are answers but for other conditions.
    @staticmethod
    def _keyless(left: Solution, right: Solution, shared: list[str]) -> bool:
        return bool(shared) and not any(v in left.certain and v in right.certain for v in shared)

    @staticmethod
    def _parts(left: Solution, right: Solution, r: DataFrame, shared: list[str], extra: Column | None = None) -> list[tuple[DataFrame, DataFrame, Column]]:
        """(left rows, right rows, condition) of each part."""
        sides = [(left.df[f"`{_named(v)}`"], r[f"`r_{_named(v)}`"]) for v in shared]
        more = F.lit(True) if extra is None else extra
        apart = [a.isNull() | b.isNull() for a, b in sides]
        parts = []
        for i, (a, b) in enumerate(sides):
            later = [(x == y) | z for (x, y), z in zip(sides[i + 1 :], apart[i + 1 :], strict=True)]
            parts.append((left.df.where(a.isNotNull()), r.where(b.isNotNull()), functools.reduce(Column.__and__, [a == b, *apart[:i], *later, more])))
        (a, b), rest = sides[0], functools.reduce(Column.__and__, apart[1:], more)
        if shared[0] not in left.certain:
            parts.append((left.df.where(a.isNull()), r, rest))
        if shared[0] not in right.certain:
            parts.append((left.df.where(a.isNotNull()), r.where(b.isNull()), rest))
        return parts

    @staticmethod
    def _inner(parts: list[tuple[DataFrame, DataFrame, Column]]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [a.join(b, cond, "inner") for a, b, cond in parts])

    @staticmethod
    def _without(left: Solution, right: Solution, r: DataFrame, shared: list[str], extra: Column | None = None) -> DataFrame:
        """Rows of left in no part."""
        out, parts = left.df, Compiler._parts(left, right, r, shared, extra)
        for _, b, cond in parts[: len(shared)]:
            out = out.join(b, cond, "left_anti")
        a = left.df[f"`{_named(shared[0])}`"]
        rest = parts[-1][2]
        unbound = out.where(a.isNull()).join(r, rest, "left_anti") if shared[0] not in left.certain else None
        bound = out.where(a.isNotNull())
        if shared[0] not in right.certain:
            bound = bound.join(r.where(r[f"`r_{_named(shared[0])}`"].isNull()), rest, "left_anti")
        return bound if unbound is None else bound.unionByName(unbound)

    def optional(self, left: Solution, group: Group) -> Solution:
        filters = [e for p in group.parts if p.kind == "filter" for e in conjuncts(p.args[0])]
        plain = [e for e in filters if not any(x.op == "exists" for x in walk(e))]
        inner = Group([p for p in group.parts if p.kind != "filter"])
        right = self.group(inner)
        for e in filters:
            if e not in plain:
                right = self.filter(right, e)
        r, shared, cond = self._sides(left, right)
        cond = F.lit(True) if cond is None else cond
        extra = None
        if plain:
            def column_of(v):
                if v in shared and v not in left.certain:
                    return F.coalesce(left.df[f"`{_named(v)}`"], r[f"`r_{_named(v)}`"])
                return left.df[f"`{_named(v)}`"] if v in left.vars else r[f"`{_named(v)}`"] if v in right.vars else None

            compiled = Expressions(column_of)
            extra = functools.reduce(Column.__and__, [F.coalesce(compiled(e).truth, F.lit(False)) for e in plain])
            cond = cond & extra
        if self._keyless(left, right, shared):
            met = self._inner(self._parts(left, right, r, shared, extra))
            alone = self._without(left, right, r, shared, extra).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in r.schema.fields])
            return self._merge(met.unionByName(alone), left, right, shared, True)
        a, b, dealt = self._dealt(left, right, r, shared)
        return self._merge(a.join(b, cond, "left"), left, right, shared, True, dealt)

    def exists(self, left: Solution, group: Group, negated: bool) -> Solution:
        """Rows of left with (or without) a compatible solution of group; its own filters may use variables of left."""
        outer_filters, parts = [], []
        for p in group.parts:
            if p.kind == "filter":
                for e in conjuncts(p.args[0]):
                    if any(x.op == "exists" for x in walk(e)):
                        parts.append(type(p)("filter", (e,)))
                    else:
                        outer_filters.append(e)
            else:
                parts.append(p)
        right = self.group(Group(parts))
        own = [e for e in outer_filters if expr_vars(e) <= set(right.vars)]
        for e in own:
            right = self.filter(right, e)
        r, shared, cond = self._sides(left, right)
        rest = [e for e in outer_filters if e not in own]
        if rest:
            column_of = lambda v: left.df[f"`{_named(v)}`"] if v in left.vars else r[f"`{_named(v)}`"] if v in right.vars else None
            for e in rest:
                found = F.coalesce(Expressions(column_of)(e).truth, F.lit(False))
                cond = found if cond is None else cond & found
        if cond is None:
            cond = F.lit(True)
            r = r.limit(1)
        a, b, dealt = self._dealt(left, right, r, shared)
        return Solution(a.join(b, cond, "left_anti" if negated else "left_semi"), left.vars, left.certain, dealt)

    def minus(self, left: Solution, right: Solution) -> Solution:
        r, shared, cond = self._sides(left, right)
        if not shared:
            return left
        if self._keyless(left, right, shared):  # only solutions that share a bound variable
            out = left.df
            for _, b, part in self._parts(left, right, r, shared)[: len(shared)]:
                out = out.join(b, part, "left_anti")
            return Solution(out, left.vars, left.certain)
        a, b, dealt = self._dealt(left, right, r, shared)
        return Solution(a.join(b, cond, "left_anti"), left.vars, left.certain, dealt)

    def union(self, members: list[Solution]) -> Solution:
        names: list[str] = []
        for m in members:
            names += [v for v in m.vars if v not in names]
        certain = set.intersection(*[m.certain for m in members])
        frames = [m.select(names).df for m in members]
        return Solution(functools.reduce(DataFrame.unionByName, frames), names, certain)

    def filter(self, left: Solution, e: Expr) -> Solution:
        for part in conjuncts(e):
            inner, negated = part, False
            while inner.op == "not":
                inner, negated = inner.args[0], not negated
            if inner.op == "exists":
                left = self.exists(left, inner.extra["group"], negated)
            elif any(x.op == "exists" for x in walk(part)):
                left = self._mixed_exists(left, part)
            else:
                left = Solution(left.df.where(Expressions(left.column)(part).truth), left.vars, left.certain)
        return left

    def _mixed_exists(self, left: Solution, e: Expr) -> Solution:
        """EXISTS below other operators: mark the rows first."""
        marks: dict[int, str] = {}
        for k, x in enumerate(y for y in walk(e) if y.op == "exists"):
            name = f"_x{k}"
            yes = self.exists(left, x.extra["group"], False)
            no = self.exists(left, x.extra["group"], True)
            df = yes.df.withColumn(_named(name), F.lit(T.TRUE)).unionByName(no.df.withColumn(_named(name), F.lit(T.FALSE)))
            left = Solution(df, [*left.vars, name], left.certain | {name})
            marks[id(x)] = name

        def swap(x: Expr) -> Expr:
            if id(x) in marks:
                return Expr("var", [marks[id(x)]])
            return Expr(x.op, [swap(a) if isinstance(a, Expr) else a for a in x.args], x.extra)

        kept = left.df.where(Expressions(left.column)(swap(e)).truth)
        names = [v for v in left.vars if v not in marks.values()]
        return Solution(kept, left.vars, left.certain).select(names)

    @staticmethod
    def _computed(left: Solution, e: Expr, compiled) -> tuple[DataFrame, Column]:
        """The rows of left with the steps of a number as columns, and the term of e over them.

        A term names its number many times, and a number its variables; as columns they are computed once for each row.
        """
        if not any(x.op in _NUMERIC for x in walk(e)):
            return left.df, compiled(left.column)(e).term
        df, ready = spread(left.df), {}
        for name in sorted({a.args[0] for x in walk(e) if x.op in _NUMERIC for a in x.args if isinstance(a, Expr) and a.op == "var"} & set(left.vars)):
            k = f"n_{_named(name)}"
            v = Val(_c(name))
            df = df.withColumns({f"{k}_{n}": c for n, c in (("dbl", v.dbl), ("dec", v.dec), ("rank", v.rank)) if f"{k}_{n}" not in df.columns})
            ready[name] = _Read(_c(name), k, ("dbl", "dec", "rank"))
        found = compiled(lambda name: ready[name] if name in ready else _c(name) if name in left.vars else None)(e)
        if isinstance(found, Num):
            df = df.withColumns({"n_dbl": found.dbl, "n_dec": found.dec, "n_rank": found.rank})
            found = Num(F.col("n_dbl"), F.col("n_dec"), F.col("n_rank"))
        return df, found.term

    # groups
    def group(self, g: Group) -> Solution:
        out: Solution | None = None
        filters = []
        for p in g.parts:
            if p.kind == "filter":
                filters.append(p.args[0])
                continue
            left = out or self.unit()
            if p.kind == "optional":
                out = self.optional(left, p.args[0])
            elif p.kind == "minus":
                out = self.minus(left, self.group(p.args[0]))
            elif p.kind == "bind":
                v, e = p.args
                if v.name in left.vars:
                    raise SparqlError(f"BIND to ?{v.name}, which is in scope already")
                df, term = self._computed(left, e, lambda column_of: Expressions(column_of))
                out = Solution(df.withColumn(_named(v.name), term), [*left.vars, v.name], left.certain).select([*left.vars, v.name])
            else:
                found = self.part(p)
                out = found if out is None else self.join(out, found)
        out = out or self.unit()
        for e in filters:
            out = self.filter(out, e)
        return out

    def part(self, p) -> Solution:
        if p.kind == "bgp":
            return self.bgp(p.args[0])
        if p.kind == "union":
            return self.union([self.group(g) for g in p.args])
        if p.kind == "group":
            return self.group(p.args[0])
        if p.kind == "values":
            return self.values(*p.args)
        if p.kind == "select":
            return self.select(p.args[0])
        if p.kind == "graph":
            return self.in_graph(*p.args)
        if p.kind == "service":
            raise SparqlError("SERVICE (remote federation) is not supported")
        raise SparqlError(f"unknown pattern {p.kind}")

    def in_graph(self, name: object, g: Group) -> Solution:
        inner = Compiler(self.quads)
        inner.active = self.quads.where(F.col("g") == name) if not isinstance(name, Var) else self.quads.where(F.col("g").isNotNull())
        inner.graph_var = name.name if isinstance(name, Var) else None
        return inner.group(g)

    def values(self, names: list[Var], rows: list[tuple]) -> Solution:
        cols = [v.name for v in names]
        df = local_frame(self.spark, [tuple(r) for r in rows], [_named(v) for v in cols])
        return Solution(df, cols, {v for k, v in enumerate(cols) if all(r[k] is not None for r in rows)})

    # select
    def select(self, s: Select) -> Solution:
        found = self.group(s.where)
        if s.values:
            found = self.join(found, self.values(*s.values))
        has_aggs = any(x.op == "agg" for e in [*(e for _, e in s.columns or [] if e), *s.having, *(e for e, _ in s.order_by)] for x in walk(e))
        aggregates: dict = {}
        if s.group_by or has_aggs:
            if s.columns is None:
                raise SparqlError("SELECT * with grouping")
            found, aggregates = self.aggregate(found, s)
        compiled = lambda sol, column_of=None: Expressions(column_of or sol.column, {k: v(sol) for k, v in aggregates.items()})
        for v, e in s.columns or []:
            if e is not None:
                if v.name in found.vars:
                    raise SparqlError(f"?{v.name} is in scope already")
                df, term = self._computed(found, e, lambda column_of, sol=found: compiled(sol, column_of))
                found = Solution(df.withColumn(_named(v.name), term), [*found.vars, v.name], found.certain)
        for e in s.having:
            found = Solution(found.df.where(compiled(found)(e).truth), found.vars, found.certain)
        names = [v for v in found.vars if not v.startswith("_")] if s.columns is None else [v.name for v, _ in s.columns]
        if s.distinct:
            found = self._order(Solution(found.select(names).df.distinct(), names, found.certain & set(names)), s, compiled) if s.order_by else Solution(found.select(names).df.distinct(), names, found.certain & set(names))
        elif s.order_by:
            found = self._order(found, s, compiled)
        if s.offset:
            found = Solution(found.df.offset(s.offset), found.vars, found.certain)
        if s.limit is not None:
            found = Solution(found.df.limit(s.limit), found.vars, found.certain)
        return found.select(names)

    @staticmethod
    def _order(found: Solution, s: Select, compiled) -> Solution:
        keys = []
        for e, up in s.order_by:
            keys += [k.asc_nulls_first() if up else k.desc_nulls_last() for k in order_keys(compiled(found)(e))]
        return Solution(found.df.orderBy(*keys), found.vars, found.certain)

    def aggregate(self, found: Solution, s: Select) -> tuple[Solution, dict]:
        df, keys = found.df, []
        for v, e in s.group_by:
            if e is not None:
                df = df.withColumn(_named(v.name), Expressions(found.column)(e).term)
            elif v.name not in found.vars:
                df = df.withColumn(_named(v.name), F.lit(None).cast("string"))
            keys.append(v.name)
        scope = Solution(df, list(dict.fromkeys([*found.vars, *keys])), found.certain)
        columns, views = [], {}
        roots = [*(e for _, e in s.columns or [] if e), *s.having, *(e for e, _ in s.order_by)]
        found_aggs = [x for e in roots for x in walk(e) if x.op == "agg"]
        # what the aggregates read is computed once for each row, below them
        own: dict[int, Val] = {}
        inputs, compiled = {}, Expressions(scope.column)
        for k, x in enumerate(found_aggs):
            if x.args:
                v, kind = compiled(x.args[0]), x.extra["name"]
                read = {"term": v.term} if kind in ("COUNT", "SAMPLE") else {"text": v.text} if kind == "GROUP_CONCAT" else {"term": v.term, "dbl": v.dbl, "dec": v.dec, "rank": v.rank} if kind in ("SUM", "AVG") else {"term": v.term, "dbl": v.dbl, "text": v.text}
                inputs |= {f"i{k}_{n}": c for n, c in read.items()}
                own[id(x)] = _Read(F.col(f"i{k}_term") if "term" in read else F.lit(None).cast("string"), f"i{k}", read)
        if inputs:
            scope = Solution(scope.df.withColumns(inputs), scope.vars, scope.certain)
        for k, x in enumerate(found_aggs):
            made, view = self._aggregate(f"a{k}", x, own.get(id(x)), scope)
            columns += made
            views[id(x)] = view
        # plain variables that are grouped by nothing are errors, as the standard says
        allowed = set(keys)
        for v, e in s.columns or []:
            used = {v.name} if e is None else {y.args[0] for y in walk_outside(e)}
            new = {w.name for w, f in s.columns or [] if f is not None}
            if not used - new <= allowed:
                raise SparqlError(f"?{sorted(used - new - allowed)[0]} is neither grouped nor aggregated")
        grouped = scope.df.groupBy(*[F.col(f"`{_named(v)}`") for v in keys]) if keys else scope.df.groupBy()
        out = grouped.agg(*(columns or [F.count(F.lit(1)).alias("_rows")]))
        return Solution(out, keys, found.certain & set(keys)), views

    def _aggregate(self, name: str, x: Expr, v: Val | None, scope: Solution) -> tuple[list[Column], object]:
        kind, distinct = x.extra["name"], x.extra["distinct"]
        if kind == "COUNT":
            if not x.args:
                if distinct:
                    made = F.count_distinct(F.struct(*[_c(v) for v in scope.vars])) if scope.vars else F.count(F.lit(1))
                else:
                    made = F.count(F.lit(1))
            else:
                t = v.term
                made = F.count_distinct(t) if distinct else F.count(t)
            return [made.alias(name)], lambda sol: integer(F.col(name))
        if kind in ("SUM", "AVG"):
            dbl, dec, rank = v.dbl, v.dec, F.max(v.rank)
            total = F.sum_distinct if distinct else F.sum
            made = [total(dbl).alias(f"{name}_dbl"), total(dec).cast("decimal(38,10)").alias(f"{name}_dec"), rank.alias(f"{name}_rank"), F.count(v.term).alias(f"{name}_n"), (F.count_distinct(dbl) if distinct else F.count(dbl)).alias(f"{name}_k")]

            def view(sol):
                n, k = F.col(f"{name}_n"), F.col(f"{name}_k")
                fine = (n == k) if not distinct else F.lit(True)
                d, c, r = F.coalesce(f"{name}_dbl", F.lit(0.0)), F.coalesce(f"{name}_dec", F.lit(0).cast("decimal(38,10)")), F.coalesce(f"{name}_rank", F.lit(1))
                if kind == "SUM":
                    return Num(F.when(fine, d), F.when(fine, c), F.when(fine, r))
                return Num(F.when(k > 0, d / k).when(n == 0, F.lit(0.0)), F.when(k > 0, (c / k).cast("decimal(38,10)")).when(n == 0, F.lit(0)).cast("decimal(38,10)"), F.when(fine, F.when(k > 0, F.greatest(r, F.lit(2))).otherwise(F.lit(1))))

            return made, view
        if kind in ("MIN", "MAX"):
            run = F.min if kind == "MIN" else F.max
            k = order_keys(v)
            made = run(F.when(v.term.isNotNull(), F.struct(k[0].alias("a"), k[1].alias("b"), k[2].alias("c"), k[3].alias("d"))))
            return [made.alias(name)], lambda sol: Val(F.col(name)["d"])
        if kind == "SAMPLE":
            return [F.min(v.term).alias(name)], lambda sol: Val(F.col(name))
        if kind == "GROUP_CONCAT":
            made = F.array_join(F.array_sort(F.collect_set(v.text) if distinct else F.collect_list(v.text)), x.extra["separator"])
            return [made.alias(name)], lambda sol: Val(T.plain_literal(F.col(name)))
        raise SparqlError(f"unknown aggregate {kind}")


class _Read(Val):
    """A value whose views are columns already."""

    def __init__(self, term: Column, prefix: str, names):
        super().__init__(term)
        for n in names:
            if n != "term":
                setattr(self, n, F.col(f"`{prefix}_{n}`"))


def walk_outside(e: Expr):
    """Variables of e outside aggregates."""
    if e.op == "agg":
        return
    if e.op == "var":
        yield e
    for a in e.args:
        if isinstance(a, Expr):
            yield from walk_outside(a)


# queries and updates ---------------------------------------------------------------------------


def fill(template: list[Triple], found: Solution) -> DataFrame:
    """Distinct well-formed triples of a template over solutions; its blank nodes are new for each solution."""
    row = F.concat_ws("|", *[F.coalesce(_c(v), F.lit("")) for v in found.vars]) if found.vars else F.lit("")

    def at(x: object) -> Column:
        if not isinstance(x, Var):
            return F.lit(x)
        if x.name in found.vars:
            return _c(x.name)
        return F.concat(F.lit("_:t"), F.md5(F.concat(F.lit(x.name), row))) if x.name.startswith("_b") else F.lit(None).cast("string")

    made = F.array(*[F.struct(at(t.s).alias("s"), at(t.p).alias("p"), at(t.o).alias("o")) for t in template])
    rows = found.df.select(F.explode(made).alias("t")).select("t.s", "t.p", "t.o")
    return rows.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & ~T.is_literal(F.col("s")) & T.is_iri(F.col("p"))).distinct()


def run_query(quads: DataFrame, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """SELECT: a column per variable; ASK: one row, result; CONSTRUCT and DESCRIBE: s, p, o."""
    q: Query = parse_query(text, prefixes)
    c = Compiler(quads, q.froms)
    if q.kind == "select":
        out = c.select(q.select)
        return out.df.toDF(*out.vars) if out.vars else out.df
    if q.kind == "ask":
        found = c.group(q.select.where)
        return found.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))
    s = q.select
    if q.kind == "construct":
        return fill(q.template, c.select(Select(None, False, s.where, order_by=s.order_by, limit=s.limit, offset=s.offset)) if not any(v.startswith("_") for v in _template_vars(q.template)) else c.group(s.where))
    names = [x.name for x in q.describe if isinstance(x, Var)]
    found = c.group(s.where)
    if "*" in q.describe:
        names = [v for v in found.vars if not v.startswith("_")]
    wanted = c.spark.createDataFrame([(x,) for x in q.describe if isinstance(x, str) and x != "*"], "n string")
    for v in names:
        wanted = wanted.union(found.df.select(_c(v).alias("n")))
    return quads.join(wanted.distinct(), F.col("s") == F.col("n"), "left_semi").select("s", "p", "o").distinct()


def _template_vars(template: list[Triple]) -> set[str]:
    return {x.name for t in template for x in (t.s, t.p, t.o) if isinstance(x, Var)}


def run_update(quads: DataFrame, text: str, prefixes: dict[str, str] | None = None) -> tuple[DataFrame, list[tuple[DataFrame | None, DataFrame | None]]]:
    """The quads after the update, and for each operation the triples (s, p, o) it asked to delete and to insert."""
    steps = []
    for u in parse_update(text, prefixes):
        u: Update
        c = Compiler(quads)
        if u.kind == "clear":
            steps.append((quads.select("s", "p", "o"), None))
            quads = quads.limit(0)
            continue
        found = c.group(u.where) if u.where is not None else c.unit()
        gone = fill(u.delete, found) if u.delete else None
        new = fill(u.insert, found) if u.insert else None
        if gone is not None:
            marked = gone.withColumn("g", F.lit(None).cast("string"))
            cond = (quads["s"] == marked["s"]) & (quads["p"] == marked["p"]) & (quads["o"] == marked["o"]) & quads["g"].isNull()
            quads = quads.join(marked, cond, "left_anti")
        if new is not None:
            quads = quads.unionByName(new.withColumn("g", F.lit(None).cast("string"))).distinct()
        steps.append((gone, new))
    return quads, steps
