"""Statistics, diff, lint, feedback, enforcement packs and shape validation over graphs."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.plans.closure import closure

#: What the statistics leave out (fixed values).
BUILTIN_CLASSES = [f"<{T.OWL}Class>", f"<{T.RDFS}Class>", f"<{T.OWL}Thing>", f"<{T.OWL}Nothing>", f"<{T.RDFS}Resource>", f"<{T.RDFS}Literal>"]
SCHEMA_TYPES = [f"<{T.OWL}Class>", f"<{T.RDFS}Class>", f"<{T.OWL}ObjectProperty>", f"<{T.OWL}DatatypeProperty>", f"<{T.OWL}Ontology>"]
BUILTIN_NAMESPACES = [T.RDF, T.RDFS, T.OWL]


def _typed(g: Graph, *types: str) -> DataFrame:
    return g.triples.where((F.col("p") == T.TYPE) & F.col("o").isin(*types)).select(F.col("s").alias("e")).distinct()


def _place(g: Graph, predicate: str, place: str) -> DataFrame:
    return g.triples.where(F.col("p") == predicate).select(F.col(place).alias("e"))


def stats(g: Graph) -> DataFrame:
    """One row: triples, classes, properties, individuals, object_properties (all of them), data_properties (0)."""
    t = g.triples
    schema = {f"<{T.OWL}Class>", f"<{T.RDFS}Class>"}
    classes = functools.reduce(DataFrame.union, [_typed(g, *schema), *[_place(g, p, w) for p, w in ((T.SUBCLASS, "s"), (T.SUBCLASS, "o"), (T.DOMAIN, "o"), (T.RANGE, "o"), (T.EQUIVALENT_CLASS, "s"))]])
    classes = classes.where(T.is_iri(F.col("e")) & ~F.col("e").isin(*BUILTIN_CLASSES)).distinct()
    kinds = [f"<{T.OWL}ObjectProperty>", f"<{T.OWL}DatatypeProperty>", f"<{T.RDF}Property>"]
    props = functools.reduce(DataFrame.union, [_typed(g, *kinds), _place(g, T.DOMAIN, "s"), _place(g, T.RANGE, "s"), _place(g, T.SUBPROPERTY, "s"), _place(g, T.SUBPROPERTY, "o")])
    builtin = functools.reduce(Column.__or__, [F.col("e").startswith(f"<{n}") for n in BUILTIN_NAMESPACES])
    props = props.where(T.is_iri(F.col("e")) & ~builtin).distinct()
    people = t.where((F.col("p") == T.TYPE) & ~F.col("o").isin(*SCHEMA_TYPES)).select(F.col("s").alias("e")).distinct()
    counted = g.quads.agg(F.count(F.lit(1)).alias("triples"))
    for name, df in (("classes", classes), ("properties", props), ("individuals", people)):
        counted = counted.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return counted.select("triples", "classes", "properties", "individuals", F.col("properties").alias("object_properties"), F.lit(0).cast("long").alias("data_properties"))


def diff(old: Graph, new: Graph) -> DataFrame:
    """(change, s, p, o): triples that were added or removed."""
    key = ["s", "p", "o"]
    added = new.all_triples.distinct().join(old.all_triples, key, "left_anti").select(F.lit("added").alias("change"), *key)
    return added.unionByName(old.all_triples.distinct().join(new.all_triples, key, "left_anti").select(F.lit("removed").alias("change"), *key))


def _without(entities: DataFrame, have: DataFrame) -> DataFrame:
    return entities.join(have.distinct(), "e", "left_anti")


def lint(g: Graph) -> DataFrame:
    """(rule, severity, entity): classes without label or comment, properties without domain."""
    classes = _typed(g, T.CLASS)
    props = _typed(g, T.OBJECT_PROPERTY, T.DATATYPE_PROPERTY)
    found = []
    for rule, severity, entities, predicate in (("missing_label", "warning", classes, T.LABEL), ("missing_comment", "warning", classes, T.COMMENT), ("missing_domain", "info", props, T.DOMAIN)):
        found.append(_without(entities, _place(g, predicate, "s")).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("e").alias("entity")))
    return functools.reduce(DataFrame.unionByName, found)


SUPPRESS_AT, DOWNGRADE_AT = 3, 2


def apply_feedback(issues: DataFrame, feedback: DataFrame, tool: str) -> DataFrame:
    """Issues (rule, severity, entity, ...) after feedback (tool, rule_id, entity, accepted).

    Any acceptance keeps an issue; ``SUPPRESS_AT`` dismissals drop it, ``DOWNGRADE_AT`` lower its severity.
    """
    votes = feedback.where(F.col("tool") == tool).groupBy(F.col("rule_id").alias("rule"), "entity").agg(F.sum(F.when(F.col("accepted"), 1).otherwise(0)).alias("yes"), F.sum(F.when(F.col("accepted"), 0).otherwise(1)).alias("no"))
    joined = issues.join(votes, ["rule", "entity"], "left")
    counts = (F.coalesce("yes", F.lit(0)) == 0) & (F.col("no") >= SUPPRESS_AT)
    lower = (F.coalesce("yes", F.lit(0)) == 0) & (F.col("no") >= DOWNGRADE_AT)
    severity = F.when(F.coalesce(lower, F.lit(False)), F.when(F.col("severity") == "error", "warning").otherwise("info")).otherwise(F.col("severity"))
    return joined.where(~F.coalesce(counts, F.lit(False))).withColumn("severity", severity).select(*issues.columns)


# enforcement packs -------------------------------------------------------------------------------

FLAT_CHILDREN, MIN_DEPTH, MIN_AVG_DEPTH, MIN_DENSITY = 5, 3, 2.0, 0.05
PACKS = {
    "generic": ["orphan_class", "missing_domain", "missing_range", "missing_label"],
    "boro": ["missing_state"],
    "value_partition": ["not_disjoint"],
    "hierarchy": ["flat_hierarchy", "shallow_hierarchy", "low_avg_depth", "low_hierarchy_density"],
}


def _found(df: DataFrame, rule: str, severity: str, message: str | Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("e").alias("entity"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def orphan_class(g: Graph) -> DataFrame:
    """Classes that are no sub- or superclass, domain or range."""
    tied = functools.reduce(DataFrame.union, [_place(g, T.SUBCLASS, "s"), _place(g, T.SUBCLASS, "o"), _place(g, T.DOMAIN, "o"), _place(g, T.RANGE, "o")])
    return _found(_without(_typed(g, T.CLASS), tied), "orphan_class", "warning", "class has no hierarchy or property ties")


def missing_domain(g: Graph) -> DataFrame:
    return _found(_without(_typed(g, T.OBJECT_PROPERTY, T.DATATYPE_PROPERTY), _place(g, T.DOMAIN, "s")), "missing_domain", "warning", "property has no domain")


def missing_range(g: Graph) -> DataFrame:
    return _found(_without(_typed(g, T.OBJECT_PROPERTY, T.DATATYPE_PROPERTY), _place(g, T.RANGE, "s")), "missing_range", "warning", "property has no range")


def missing_label(g: Graph) -> DataFrame:
    return _found(_without(_typed(g, T.CLASS), _place(g, T.LABEL, "s")), "missing_label", "info", "class has no label")


def missing_state(g: Graph, entity: str = "Entity", state: str = "State") -> DataFrame:
    """Direct subclasses of an Entity class without a subclass of their own that is also under a State class."""
    sub = g.triples.where(F.col("p") == T.SUBCLASS).select("s", "o")
    kinds = sub.where(T.local(F.col("o")) == entity).select(F.col("s").alias("e")).distinct()
    states = sub.where(T.local(F.col("o")) == state).select("s").distinct()
    return _found(_without(kinds, sub.join(states, "s").select(F.col("o").alias("e"))), "missing_state", "error", "entity has no state class")


def not_disjoint(g: Graph) -> DataFrame:
    """Root parents with two or more children, of which a pair is not disjoint in either direction; one row for each pair."""
    sub = g.triples.where((F.col("p") == T.SUBCLASS) & T.is_iri(F.col("o")) & T.is_iri(F.col("s"))).select("s", "o").distinct()
    roots = sub.join(sub.select(F.col("s").alias("x")), F.col("o") == F.col("x"), "left_anti")
    left, right = roots.select(F.col("o").alias("e"), F.col("s").alias("a")), roots.select(F.col("o").alias("e"), F.col("s").alias("b"))
    apart = g.triples.where(F.col("p") == T.DISJOINT).select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()
    pairs = left.join(right, "e").where(F.col("a") < F.col("b")).join(apart, ["a", "b"], "left_anti")
    return _found(pairs, "not_disjoint", "warning", F.concat(F.lit("not disjoint: "), F.col("a"), F.lit(" "), F.col("b")))


def flat_hierarchy(g: Graph) -> DataFrame:
    kids = g.triples.where(F.col("p") == T.SUBCLASS).select("s", "o").distinct().join(_typed(g, T.CLASS).select(F.col("e").alias("s")), "s")
    wide = kids.groupBy(F.col("o").alias("e")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("s")), " ").alias("kids")).where(F.col("n") > FLAT_CHILDREN)
    return _found(wide, "flat_hierarchy", "warning", F.concat(F.col("n").cast("string"), F.lit(" direct children: "), F.col("kids")))


def _depths(g: Graph) -> DataFrame:
    """(s, depth): distinct ancestors of every class with one."""
    return closure(g.triples.where(F.col("p") == T.SUBCLASS).select("s", "o")).groupBy("s").agg(F.count("*").alias("depth"))


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumn("e", F.lit("(hierarchy)"))


def shallow_hierarchy(g: Graph) -> DataFrame:
    """The most ancestors that any class has is under MIN_DEPTH; a graph without a hierarchy passes."""
    top = _whole(_depths(g).agg(F.max("depth").alias("d"))).where(F.col("d") < MIN_DEPTH)
    return _found(top, "shallow_hierarchy", "info", F.concat(F.lit("greatest ancestor count "), F.col("d").cast("string")))


def low_avg_depth(g: Graph) -> DataFrame:
    mean = _whole(_depths(g).agg(F.coalesce(F.avg("depth"), F.lit(0.0)).alias("d"))).where(F.col("d") < MIN_AVG_DEPTH)
    return _found(mean, "low_avg_depth", "info", F.concat(F.lit("mean ancestor count "), F.round("d", 2).cast("string")))


def low_hierarchy_density(g: Graph) -> DataFrame:
    share = _whole(g.triples.agg(F.coalesce(F.try_divide(F.count_if(F.col("p") == T.SUBCLASS), F.count(F.lit(1))), F.lit(0.0)).alias("d"))).where(F.col("d") < MIN_DENSITY)
    return _found(share, "low_hierarchy_density", "info", F.concat(F.lit("share of subclass triples "), F.round("d", 4).cast("string")))


@dataclass
class CustomRule:
    """An ASK query whose truth is a violation; a SELECT always passes."""

    id: str
    pack: str
    query: str
    severity: str = "warning"
    message: str = ""


def enforce(g: Graph, pack: str = "generic", custom: list[CustomRule] | None = None, feedback: DataFrame | None = None) -> DataFrame:
    """(rule, severity, entity, message) of a pack's rules and the custom rules of that pack ("all": every pack)."""
    rules = [r for name, rs in PACKS.items() if pack in (name, "all") for r in rs]
    parts = [globals()[r](g) for r in rules]
    for rule in custom or []:
        if rule.pack == pack or pack == "all":
            hit = g.query(rule.query)
            if hit.columns == ["result"] and hit.dtypes[0][1] == "boolean":
                parts.append(_found(hit.where("result").withColumn("e", F.lit("(graph)")), rule.id, rule.severity, rule.message))
    if not parts:
        return g.spark.createDataFrame([], "rule string, severity string, entity string, message string")
    out = functools.reduce(DataFrame.unionByName, parts)
    return out if feedback is None else apply_feedback(out, feedback, "enforce")


def compliance(g: Graph, pack: str = "generic", custom: list[CustomRule] | None = None) -> dict:
    """Rules passed over rules in total (1.0 without rules); feedback does not count."""
    rules = [r for name, rs in PACKS.items() if pack in (name, "all") for r in rs] + [r.id for r in custom or [] if r.pack == pack or pack == "all"]
    failed = {r["rule"] for r in enforce(g, pack, custom).select("rule").distinct().collect()}  # at most the rules
    total = len(rules)
    return {"rule_pack": pack, "total": total, "passed": total - len(failed), "failed": sorted(failed), "compliance": (total - len(failed)) / total if total else 1.0}


# shapes ------------------------------------------------------------------------------------------


@dataclass
class Constraint:
    target: str
    path: str
    kind: str  # min_count, max_count, datatype; with extended=True also class, pattern, min_inclusive, max_inclusive, in
    value: str
    severity: str = "violation"
    message: str = ""


def shapes_from_triples(triples: list[tuple[str, str, str]], extended: bool = False) -> list[Constraint]:
    """Constraints of the node shapes with a target class, whose property paths are IRIs."""
    by: dict[str, list[tuple[str, str]]] = {}
    for s, p, o in triples:
        by.setdefault(s, []).append((p, o))
    get = lambda s, name: [o for p, o in by.get(s, []) if p == f"<{T.SH}{name}>"]
    kinds = {"minCount": "min_count", "maxCount": "max_count", "datatype": "datatype"}
    if extended:
        kinds |= {"class": "class", "pattern": "pattern", "minInclusive": "min_inclusive", "maxInclusive": "max_inclusive"}
    out = []
    for shape in sorted(s for s, po in by.items() if (T.TYPE, f"<{T.SH}NodeShape>") in po):
        for target in get(shape, "targetClass"):
            for prop in get(shape, "property"):
                for path in get(prop, "path"):
                    if not path.startswith("<"):
                        continue
                    for name, kind in kinds.items():
                        for v in get(prop, name):
                            messages = get(prop, "message") or ['""']
                            out += [Constraint(target, path, kind, T.value_of(v) if not v.startswith("<") else v, "violation", T.value_of(m)) for m in messages]
    return [c for c in out if not (c.kind == "min_count" and c.value == "0")]


def validate_shapes(g: Graph, constraints: list[Constraint]) -> DataFrame:
    """(focus_node, path, kind, severity, message, value) of all violations, in one pass for all constraints.

    The constraints are a small broadcast table; data joins it on class and path and is counted once for each focus node.
    """
    spark: SparkSession = g.spark
    rows = [(k, c.target, c.path, c.kind, c.value, c.severity, c.message) for k, c in enumerate(constraints)]
    table = F.broadcast(spark.createDataFrame(rows, "k int, cls string, path string, kind string, bound string, severity string, message string"))  # the shapes given
    t = g.triples
    focus = t.where(F.col("p") == T.TYPE).select(F.col("s").alias("focus_node"), F.col("o").alias("cls")).join(table, "cls")
    paths, kinds = sorted({c.path for c in constraints}), {c.kind for c in constraints}
    values = t.where(F.col("p").isin(*paths)) if paths else t.limit(0)
    values = values.select(F.col("s").alias("focus_node"), F.col("p").alias("path"), F.col("o").alias("value"))
    cols = ["focus_node", "path", "kind", "severity", "message", "value"]
    v, bound = F.col("value"), F.col("bound").try_cast("bigint")
    out = []
    if kinds & {"min_count", "max_count"}:
        joined = focus.where(F.col("kind").isin("min_count", "max_count")).join(values, ["focus_node", "path"], "left")
        counted = joined.groupBy("k", "focus_node", "path", "kind", "bound", "severity", "message").agg(F.count("value").alias("n"))
        short = counted.where(((F.col("kind") == "min_count") & (F.col("n") < bound)) | ((F.col("kind") == "max_count") & (F.col("n") > bound)))
        out.append(short.withColumn("value", F.col("n").cast("string")).select(*cols))
    number, limit = T.number(v), F.col("bound").try_cast("double")
    wrong = {
        "datatype": T.is_literal(v) & (F.concat(F.lit("<"), T.datatype_of(v), F.lit(">")) != F.col("bound")),
        "pattern": ~F.regexp_like(T.lex(v), F.col("bound")),
        "min_inclusive": number < limit,
        "max_inclusive": number > limit,
    }
    if present := [k for k in wrong if k in kinds]:
        broken = functools.reduce(Column.__or__, [(F.col("kind") == k) & wrong[k] for k in present])
        out.append(focus.where(F.col("kind").isin(*present)).join(values, ["focus_node", "path"]).where(broken).select(*cols))
    if "class" in kinds:
        typed = t.where(F.col("p") == T.TYPE).select(F.col("s").alias("value"), F.col("o").alias("bound"))
        out.append(focus.where(F.col("kind") == "class").join(values, ["focus_node", "path"]).join(typed, ["value", "bound"], "left_anti").select(*cols))
    return functools.reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], ", ".join(f"{c} string" for c in cols))


def report(violations: DataFrame, most: int = 10_000) -> str:
    """The JSON report; the violations listed are at most the given number, the count covers all."""
    n = violations.count()
    rows = violations.orderBy("focus_node", "path", "kind").limit(most).collect()
    listed = [{"severity": r["severity"], "focus_node": r["focus_node"], "path": r["path"], "constraint": r["kind"], "message": r["message"]} for r in rows]
    return json.dumps({"conforms": n == 0, "violation_count": n, "violations": listed})


def validate_partitioned(g: Graph, constraints: list[Constraint], partition_of: DataFrame) -> DataFrame:
    """(partition, conforms, violations): validation for each partition of (focus_node, partition).

    Focus nodes without a partition form one of their own; a constraint that cannot be read raises.
    """
    known = {"min_count", "max_count", "datatype", "class", "pattern", "min_inclusive", "max_inclusive"}
    if bad := [c.kind for c in constraints if c.kind not in known]:
        raise ValueError(f"unknown constraints: {bad}")
    found = validate_shapes(g, constraints).groupBy("focus_node").agg(F.count("*").alias("n"))
    parts = partition_of.select("focus_node", "partition").distinct()
    counted = parts.join(found, "focus_node", "full_outer").groupBy(F.coalesce("partition", F.lit("(none)")).alias("partition")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    return counted.select("partition", (F.col("violations") == 0).alias("conforms"), "violations")
