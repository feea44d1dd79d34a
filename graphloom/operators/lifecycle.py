"""Change plans, locks, versions, lineage, watchers, and grounding of claims."""

from __future__ import annotations

import functools
import json
import urllib.request
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.operators.matching import drift_terms, rename_candidates
from graphloom.session import materialize, shared_dir

# plans -------------------------------------------------------------------------------------------


def plan_changes(old: Graph, new: Graph) -> DataFrame:
    """(change, iri, kind) of classes and properties."""
    return drift_terms(old, new)


def blast_radius(g: Graph, removed: DataFrame) -> DataFrame:
    """(iri, references): for each removed iri, how often it stands in a triple; a triple counts once for each place."""
    places = g.quads.select(F.explode(F.array("s", "p", "o")).alias("iri"))
    counts = places.join(removed.select("iri").distinct(), "iri", "left_semi").groupBy("iri").agg(F.count("*").alias("references"))
    return removed.select("iri").distinct().join(counts, "iri", "left").select("iri", F.coalesce("references", F.lit(0)).alias("references"))


def plan_risk(changes: DataFrame, radius: DataFrame) -> DataFrame:
    """One row (risk, added, removed, references): high if a class goes that is referred to, medium if anything goes, else low."""
    refs = radius.agg(F.coalesce(F.sum("references"), F.lit(0)).alias("references"))
    counts = changes.agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"), F.count_if((F.col("change") == "removed") & (F.col("kind") == "class")).alias("classes"))
    both = counts.crossJoin(refs)  # one row each
    return both.select(F.when((F.col("classes") > 0) & (F.col("references") > 0), "high").when(F.col("removed") > 0, "medium").otherwise("low").alias("risk"), "added", "removed", "references")


class LockedError(RuntimeError):
    """A change that would remove locked terms."""


class BlockedError(RuntimeError):
    """A safe change while a watcher blocks."""


@dataclass
class Planner:
    """Plans and applies changes of one graph; kept for as long as the plan matters."""

    graph: Graph
    locks: dict[str, str] | None = None
    blocked: bool = False
    pending: Graph | None = None

    def lock(self, iri: str, reason: str = "") -> None:
        self.locks = {**(self.locks or {}), iri: reason}

    def is_locked(self, iri: str) -> bool:
        return iri in (self.locks or {})

    def locked_removals(self, changes: DataFrame) -> list[str]:
        names = sorted(self.locks or {})
        return [r["iri"] for r in changes.where((F.col("change") == "removed") & F.col("iri").isin(*names)).orderBy("iri").collect()] if names else []

    def plan(self, new: Graph) -> dict:
        changes = plan_changes(self.graph, new)
        radius = blast_radius(self.graph, changes.where("change = 'removed'"))
        row = plan_risk(changes, radius).first()
        self.pending = new
        return {**row.asDict(), "locked": self.locked_removals(changes)}

    def apply(self, mode: str = "safe") -> Graph:
        """safe: refused while blocked or if locked terms would go; force: as planned; migrate: with bridges from removed terms."""
        if self.pending is None:
            raise RuntimeError("No plan found")
        changes = plan_changes(self.graph, self.pending)
        if mode != "force":
            if mode == "safe" and self.blocked:
                raise BlockedError("a watcher blocks changes")
            if locked := self.locked_removals(changes):
                raise LockedError(f"locked terms would be removed: {locked}")
        done = self.pending.add(migration_triples(self.graph, self.pending)) if mode == "migrate" else self.pending
        self.graph, self.pending = done, None
        return done


def migration_triples(old: Graph, new: Graph) -> DataFrame:
    """Removed terms stay as deprecated ones, bridged to the best rename candidate where there is one."""
    changes = drift_terms(old, new).where("change = 'removed'")
    best = rename_candidates(old, new).groupBy("from_iri").agg(F.max(F.struct("confidence", "to_iri")).alias("b")).select(F.col("from_iri").alias("iri"), F.col("b.to_iri").alias("to"))
    joined = changes.join(best, "iri", "left")
    bridge = F.when(F.col("kind") == "class", T.EQUIVALENT_CLASS).otherwise(T.EQUIVALENT_PROPERTY)
    note = F.when(F.col("to").isNotNull(), T.plain_literal(F.concat(F.lit("Replaced by "), T.lex(F.col("to")))))
    made = F.array(
        F.struct(F.when(F.col("to").isNotNull(), bridge).alias("p"), F.col("to").alias("o")),
        F.struct(F.lit(f"<{T.OWL}deprecated>").alias("p"), F.lit(T.TRUE).alias("o")),
        F.struct(F.lit(T.COMMENT).alias("p"), note.alias("o")),
    )
    return joined.select(F.col("iri").alias("s"), F.explode(made).alias("t")).select("s", "t.p", "t.o").where("p IS NOT NULL AND o IS NOT NULL")


# versions ----------------------------------------------------------------------------------------


class Versions:
    """Snapshots of a graph as Parquet under a folder, with a table of what they are."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_dir(spark)}/graphloom-versions-{uuid.uuid4().hex}"
        self.entries: list[dict] = []

    def save(self, g: Graph, label: str) -> dict:
        entry = {"id": len(self.entries) + 1, "label": label, "path": f"{self.folder}/{len(self.entries) + 1}"}
        g.quads.write.mode("overwrite").parquet(entry["path"])
        entry["triple_count"] = self.spark.read.parquet(entry["path"]).count()
        self.entries.append(entry)
        return entry

    def history(self) -> list[dict]:
        """Newest first."""
        return sorted(self.entries, key=lambda e: -e["id"])

    def rollback(self, label: str) -> Graph:
        """The latest version of that label."""
        for e in self.history():
            if e["label"] == label:
                return Graph(self.spark.read.parquet(e["path"]))
        raise KeyError(label)


# lineage -----------------------------------------------------------------------------------------

#: Codes of event types (fixed values).
EVENT_CODES = {"plan": "P", "apply": "A", "drift": "D", "enforce": "E", "monitor": "M", "align": "AL", "align_feedback": "AF", "lint_feedback": "LF", "enforce_feedback": "EF"}


def with_sequence(events: DataFrame, session: str = "session_id", order: list[str] | None = None) -> DataFrame:
    """events with seq: 1, 2, ... within each session by the order columns."""
    w = Window.partitionBy(session).orderBy(*(order or ["timestamp"]))
    return events.withColumn("seq", F.row_number().over(w))


def compact(events: DataFrame) -> DataFrame:
    """(session_id, seq, line): session:seq:ts:type:op:details."""
    return events.select("session_id", "seq", F.concat_ws(":", "session_id", "seq", F.col("timestamp").cast("string"), "event_type", "operation", "details").alias("line"))


# watchers ----------------------------------------------------------------------------------------


@dataclass
class Watcher:
    """A query with ?count, or another check (value 0); over the threshold it alerts and takes its action."""

    id: str
    query: str = ""
    threshold: float = 0.0
    check_type: str = "sparql"
    severity: str = "warning"
    action: str = "notify"  # notify, block, auto_rollback, log; any other text notifies
    message: str = ""
    webhook_url: str | None = None
    enabled: bool = True
    webhook_headers: dict[str, str] | None = None


def watch_values(g: Graph, watchers: list[Watcher]) -> DataFrame:
    """(id, value, threshold, alert, severity, action) of the enabled watchers, in one job."""
    parts = []
    for w in watchers:
        if not w.enabled:
            continue
        action = w.action if w.action in ("notify", "block", "auto_rollback", "log") else "notify"
        value = g.query(w.query).select(F.coalesce(T.number(F.col("count")), F.lit(0.0)).alias("value")).limit(1) if w.check_type == "sparql" and w.query else g.spark.range(1).select(F.lit(0.0).alias("value"))
        parts.append(value.select(F.lit(w.id).alias("id"), "value", F.lit(float(w.threshold)).alias("threshold"), (F.col("value") > w.threshold).alias("alert"), F.lit(w.severity).alias("severity"), F.lit(action).alias("action")))
    if not parts:
        return g.spark.createDataFrame([], "id string, value double, threshold double, alert boolean, severity string, action string")
    return functools.reduce(DataFrame.unionByName, parts)


def deliver(url: str, payload: dict, headers: dict[str, str] | None = None, timeout: float = 5.0) -> bool:
    """POST a JSON payload with further headers; failures are reported, not raised."""
    try:
        request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **(headers or {})})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return 200 <= r.status < 300
    except OSError:
        return False


class Monitor:
    def __init__(self, watchers: list[Watcher], versions: Versions | None = None, send=deliver):
        self.watchers, self.versions, self.blocked, self.send = watchers, versions, False, send

    def run(self, g: Graph) -> tuple[dict, Graph]:
        """The sweep's result, and the graph after it (another one only after a rollback, at most one in a sweep)."""
        rows = watch_values(g, self.watchers).collect()
        alerts = [r for r in rows if r["alert"]]
        rolled, after = False, g
        by_id = {w.id: w for w in self.watchers}
        for r in alerts:
            if r["action"] == "block":
                self.blocked = True
            elif r["action"] == "auto_rollback" and not rolled and self.versions is not None and self.versions.entries:
                after, rolled = self.versions.rollback(self.versions.history()[0]["label"]), True
            if by_id[r["id"]].webhook_url:
                told = by_id[r["id"]].webhook_headers
                self.send(by_id[r["id"]].webhook_url, {"watcher": r["id"], "value": r["value"], "severity": r["severity"], "message": by_id[r["id"]].message}, *([told] if told else []))
        status = "auto_rolled_back" if rolled else "blocked" if self.blocked else "alert" if alerts else "ok"
        return {"status": status, "checked": len(rows), "alerts": [{"watcher": r["id"], "value": r["value"], "threshold": r["threshold"], "severity": r["severity"], "action": r["action"]} for r in alerts]}, after

    def clear(self) -> None:
        self.blocked = False


# grounding ---------------------------------------------------------------------------------------

#: Prefixes tried, in this order, for names without a scheme (fixed values).
ENTITY_PREFIXES = ["", "http://example.org/", "http://dbpedia.org/resource/", "urn:"]
PREDICATE_PREFIXES = ["", "http://schema.org/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://xmlns.com/foaf/0.1/", "http://example.org/"]


def ground(g: Graph, claims: DataFrame) -> DataFrame:
    """claims (s, p, o names) plus status, confidence and evidence_count.

    Every claim is tried under prefix combinations in order of subject, predicate, object; the first with evidence counts,
    with its contradictions, else the most contradictions of any.
    """
    def tried(c: str, prefixes: list[str]):
        schemed = F.col(c).startswith("http://") | F.col(c).startswith("https://") | F.col(c).startswith("urn:")
        return F.when(schemed, F.array(F.lit(""))).otherwise(F.array(*[F.lit(p) for p in prefixes]))

    ids = claims.select(F.xxhash64("s", "p", "o").alias("claim"), F.col("s").alias("cs"), F.col("p").alias("cp"), F.col("o").alias("co")).distinct()
    ids = materialize(ids, "claims")
    spread = ids.select("claim", "cs", "cp", "co", F.posexplode(tried("cs", ENTITY_PREFIXES)).alias("i", "sp")).select("*", F.posexplode(tried("cp", PREDICATE_PREFIXES)).alias("j", "pp"))
    spread = spread.select("claim", "co", "i", "j", F.concat(F.lit("<"), "sp", "cs", F.lit(">")).alias("s"), F.concat(F.lit("<"), "pp", "cp", F.lit(">")).alias("p"))
    met = spread.join(g.triples.withColumnRenamed("o", "value"), ["s", "p"])
    each = met.select("claim", "i", "j", "value", F.posexplode(tried("co", ENTITY_PREFIXES)).alias("k", "op"), "co")
    full = F.concat("op", "co")
    hit = (F.col("value") == F.concat(F.lit("<"), full, F.lit(">"))) | (F.col("value") == T.plain_literal(full))
    counted = each.groupBy("claim", "i", "j", "k").agg(F.count_if(hit).alias("evidence"), F.count_if(~hit).alias("contra"))
    first = F.min(F.when(F.col("evidence") > 0, F.struct("i", "j", "k", "evidence", "contra")))
    summed = counted.groupBy("claim").agg(first.alias("f"), F.max("contra").alias("most"))
    found = ids.join(summed, "claim", "left").select("cs", "cp", "co", F.coalesce("f.evidence", F.lit(0)).alias("evidence_count"), F.coalesce(F.when(F.col("f").isNotNull(), F.col("f.contra")), F.col("most"), F.lit(0)).alias("contra"))
    n = F.col("evidence_count")
    status = F.when(n > 0, "grounded").when(F.col("contra") > 0, "contradicted").otherwise("unknown")
    confidence = F.when((n > 0) & (F.col("contra") == 0), F.least(50 + 15 * n, F.lit(100))).when(n > 0, F.least(30 + 10 * n, F.lit(70))).otherwise(0)
    told = found.select("cs", "cp", "co", status.alias("status"), confidence.cast("long").alias("confidence"), "evidence_count")
    same = claims["s"].eqNullSafe(told["cs"]) & claims["p"].eqNullSafe(told["cp"]) & claims["o"].eqNullSafe(told["co"])
    return claims.join(told, same).drop("cs", "cp", "co")


def consistency(g: Graph, claims: DataFrame) -> dict:
    """Conflicts of the graph with the claims (triples) added: sameAs and differentFrom of one pair, individuals of disjoint classes.

    Looks at a copy, so the graph keeps its triples.
    """
    t = g.add(claims).triples
    pairs = lambda p: t.where(F.col("p") == p).select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()
    same = pairs(T.SAME_AS).join(pairs(f"<{T.OWL}differentFrom>"), ["a", "b"]).count()
    types = t.where(F.col("p") == T.TYPE).select("s", "o")
    apart = pairs(T.DISJOINT)
    clash = types.select("s", F.col("o").alias("a")).join(apart, "a").join(types.select("s", F.col("o").alias("b")), ["s", "b"]).select("s", "a", "b").distinct().count()
    return {"consistent": same + clash == 0, "same_different": same, "disjoint_types": clash}
