"""The tool surface: one object with a method for each tool, answering dictionaries, and the batch runner over it.

Everything operates on the registry's active graph. Results that are tables come back as at most ``ROWS`` rows with the full
count; use graphloom.graph.Graph for the DataFrames themselves.
"""

from __future__ import annotations

import fnmatch
import inspect
import json
import shlex
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.functions import vectors as V
from graphloom.graph import Graph
from graphloom.operators import checks, lifecycle, mapping, matching
from graphloom.plans import dl
from graphloom.plans.reason import reason
from graphloom.session import bounded_rows
from graphloom.sources import rdf, store, tabular
from graphloom.state import State

ROWS = 10_000
#: Tools by group, for filters.
GROUPS = {
    "core": ["status", "validate", "convert", "load", "query", "update", "save", "stats", "diff", "lint", "clear"],
    "cache": ["unload", "recompile", "cache_status", "cache_list", "cache_remove", "repo_list", "repo_load"],
    "remote": ["pull", "push", "import_", "marketplace"],
    "versions": ["version", "history", "rollback", "plan", "apply", "lock", "drift", "lineage"],
    "data": ["ingest", "map", "sql_ingest", "import_schema", "extend"],
    "reasoning": ["reason", "dl_explain", "dl_check", "shacl", "enforce", "consistency", "ground"],
    "alignment": ["align", "align_feedback", "crosswalk", "enrich", "validate_clinical", "embed", "search", "similarity"],
    "monitoring": ["monitor", "monitor_clear", "lint_feedback", "enforce_feedback"],
}


class Filtered(PermissionError):
    """A tool that the filter does not allow."""


class Engine:
    def __init__(self, spark: SparkSession, repositories: list[str] | None = None, allow: list[str] | None = None, deny: list[str] | None = None, state: State | None = None):
        self.spark = spark
        self.state = state
        self.registry = store.Registry(spark)
        self.repositories = repositories or []
        self.versions = lifecycle.Versions(spark)
        self.planner: lifecycle.Planner | None = None
        self.locks: dict[str, str] = {}
        self.watchers: list[lifecycle.Watcher] = []
        self.monitor_ = lifecycle.Monitor(self.watchers, self.versions)
        self.custom_rules: list[checks.CustomRule] = []
        self.feedback: list[tuple] = []
        self.align_votes: list[tuple] = []
        self.events: list[tuple] = []
        self.session_id = uuid.uuid4().hex[:12]
        self.crosswalk_table: DataFrame | None = None
        self.vectors: DataFrame | None = None
        self.allow, self.deny = allow, deny or []

    # plumbing
    @classmethod
    def tools(cls) -> list[str]:
        return sorted(t for ts in GROUPS.values() for t in ts)

    def allowed(self, tool: str) -> bool:
        """Names, patterns and @groups; deny beats allow."""
        def among(patterns):
            return any(tool in GROUPS.get(p[1:], []) if p.startswith("@") else fnmatch.fnmatch(tool, p) for p in patterns)

        return (self.allow is None or among(self.allow)) and not among(self.deny)

    def call(self, tool: str, **args: Any) -> dict:
        """A tool's answer; its errors come back as {"error": ...}."""
        tool = {"import": "import_", "monitor-clear": "monitor_clear"}.get(tool, tool)
        if tool not in self.tools():
            return {"error": f"unknown tool {tool!r}"}
        if not self.allowed(tool):
            return {"error": f"tool {tool!r} is not allowed"}
        try:
            return getattr(self, tool)(**args)
        except Exception as e:  # the surface reports, callers of the library get exceptions
            return {"error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"}

    @property
    def graph(self) -> Graph:
        return self.registry.graph()

    def put(self, g: Graph) -> Graph:
        return self.registry.put(g, self.registry.active or "default")

    def record(self, kind: str, operation: str, details: str = "") -> None:
        event = (self.session_id, len(self.events) + 1, int(time.time()), lifecycle.EVENT_CODES[kind], operation, details)
        self.events.append(event)
        self.keep("lineage_events", dict(zip(("session_id", "seq", "timestamp", "event_type", "operation", "details"), event, strict=True)))

    def keep(self, table: str, row: dict) -> None:
        """Add a row to the state tables, if there are any."""
        if self.state is not None:
            self.state.append(table, [row])

    def restore(self) -> None:
        """Take up locks, votes, rules and watchers that earlier sessions left in the state tables."""
        rows = lambda t: [r.asDict() for r in self.state.current(t).collect()]
        self.locks = {r["iri"]: r["reason"] or "" for r in rows("iri_locks")}
        self.feedback = [(r["tool"], r["rule_id"], r["entity"], r["accepted"]) for r in rows("tool_feedback")]
        self.align_votes = [(r["source_iri"], r["target_iri"], r["predicted_relation"], r["accepted"], r["signals_json"]) for r in rows("align_feedback")]
        self.custom_rules = [checks.CustomRule(r["id"], r["rule_pack"], r["query"], r["severity"], r["message"] or "") for r in rows("enforce_rules") if r["enabled"]]
        self.watchers[:] = [lifecycle.Watcher(r["id"], r["query"] or "", r["threshold"], r["check_type"], r["severity"], r["action"], r["message"] or "", r["webhook_url"], r["enabled"], json.loads(r["webhook_headers"]) if r["webhook_headers"] else None) for r in rows("monitor_watchers")]
        self.monitor_.blocked = any(r["key"] == "blocked" and r["value"] == "true" for r in rows("monitor_state"))

    def add_rule(self, rule: checks.CustomRule) -> None:
        self.custom_rules.append(rule)
        self.keep("enforce_rules", {"id": rule.id, "rule_pack": rule.pack, "query": rule.query, "severity": rule.severity, "message": rule.message, "enabled": True})

    @staticmethod
    def rows(df: DataFrame, most: int = ROWS) -> list[dict]:
        return [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in df.limit(most).collect()]

    def text(self, source: str, inline: bool) -> str:
        if inline:
            return source
        with open(source, encoding="utf-8") as f:
            return f.read()

    def parsed(self, path: str) -> Graph:
        return rdf.load_files(self.spark, path)

    # core
    def status(self) -> dict:
        return {"status": "ok", "tools": len(self.tools()), "triples": self.graph.count(), **self.registry.status()}

    def validate(self, input: str, inline: bool = False) -> dict:
        return rdf.validate(self.text(input, inline), None if inline else rdf.detect_format(input))

    def convert(self, path: str, to: str, output: str | None = None) -> dict:
        out = rdf.convert(self.text(path, False), to, rdf.detect_format(path))
        if output:
            with open(output, "w", encoding="utf-8") as f:
                f.write(out)
        return {"ok": True, **({"output": output} if output else {"content": out})}

    def load(self, path: str | None = None, turtle: str | None = None, name: str | None = None, auto_refresh: bool = False, force_recompile: bool = False) -> dict:
        if turtle is not None:
            g = self.registry.put(self.graph.add(rdf.load_text(self.spark, turtle, "turtle").quads), name or self.registry.active or "default")
            return {"ok": True, "triple_count": g.count()}
        return {"ok": True, **self.registry.load(path, name, auto_refresh, force_recompile)}

    def query(self, query: str) -> dict:
        df = self.graph.query(query)
        if df.columns == ["result"] and df.dtypes[0][1] == "boolean":
            return {"result": df.first()["result"]}
        if df.columns == ["s", "p", "o"] and not query.lower().lstrip().startswith("select") and "select" not in query.lower().split("{")[0]:
            return {"triples": [" ".join(r) + " ." for r in df.limit(ROWS).collect()]}
        return {"variables": df.columns, "results": self.rows(df)}

    def update(self, query: str) -> dict:
        done = self.graph.update_counted(query)
        self.put(done.graph)
        return {"ok": True, "affected": done.affected, "added": done.added, "removed": done.removed}

    def save(self, path: str, format: str = "turtle") -> dict:
        out = rdf.serialize(self.graph, format)
        with open(path, "w", encoding="utf-8") as f:
            f.write(out)
        return {"ok": True, "path": path}

    def stats(self) -> dict:
        return checks.stats(self.graph).first().asDict()

    def diff(self, old_path: str, new_path: str) -> dict:
        rows = self.rows(checks.diff(self.parsed(old_path), self.parsed(new_path)).orderBy("s", "p", "o"))
        pick = lambda c: [f"{r['s']} {r['p']} {r['o']}" for r in rows if r["change"] == c]
        return {"added": pick("added"), "removed": pick("removed"), "added_count": len(pick("added")), "removed_count": len(pick("removed"))}

    def _votes(self) -> DataFrame:
        return self.spark.createDataFrame(self.feedback, "tool string, rule_id string, entity string, accepted boolean")

    def lint(self, input: str, inline: bool = False) -> dict:
        g = rdf.load_text(self.spark, self.text(input, inline), None if inline else rdf.detect_format(input))
        rows = self.rows(checks.apply_feedback(checks.lint(g), self._votes(), "lint").orderBy("rule", "entity"))
        return {"issues": rows, "issue_count": len(rows)}

    def clear(self) -> dict:
        self.put(Graph.empty(self.spark))
        return {"ok": True}

    # cache and repositories
    def unload(self, delete_cache: bool = False, name: str | None = None) -> dict:
        return {"ok": self.registry.unload(name, delete_cache)}

    def recompile(self, name: str | None = None) -> dict:
        return {"ok": True, **self.registry.recompile(name)}

    def cache_status(self) -> dict:
        return self.registry.status()

    def cache_list(self) -> dict:
        return {"entries": self.registry.listed()}

    def cache_remove(self, name: str, delete_file: bool = True) -> dict:
        return {"ok": self.registry.remove(name, delete_file)}

    def repo_list(self, dir: str | None = None, recursive: bool = False, glob: str | None = None, limit: int = store.PAGE, offset: int = 0) -> dict:
        at = store.resolve_within(dir or ".", self.repositories)
        return {"files": [r["path"] for r in store.list_files(self.spark, at, recursive, glob, limit, offset).collect()]}

    def repo_load(self, name: str, registry_name: str | None = None, auto_refresh: bool = False, force_recompile: bool = False) -> dict:
        return self.load(store.resolve_target(name, self.repositories), None, registry_name, auto_refresh, force_recompile)

    # remote
    def pull(self, url: str, sparql: bool = False, query: str | None = None) -> dict:
        text = tabular.fetch_sparql(url, query or "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }") if sparql else tabular.fetch(url)
        g = self.put(self.graph.add(rdf.load_text(self.spark, text, "ntriples" if sparql else None, url).quads))
        return {"ok": True, "triple_count": g.count()}

    def push(self, endpoint: str, graph: str | None = None) -> dict:
        tabular.push_sparql(endpoint, self.graph.all_triples.distinct())
        return {"ok": True}

    def import_(self, max_depth: int = store.IMPORT_DEPTH, follow_remote: bool = True) -> dict:
        g, log = store.import_closure(self.graph, tabular.fetch, max_depth, follow_remote)
        self.put(g)
        return {"imports": log}

    def marketplace(self, action: str, id: str | None = None, domain: str | None = None) -> dict:
        if action == "list":
            return {"entries": self.rows(store.catalogue(self.spark, domain).orderBy("id"))}
        entry = store.catalogue_entry(id or "")
        if entry is None:
            return {"error": f"unknown id {id!r}"}
        return self.pull(entry["url"]) if action == "install" else entry

    # versions and change
    def version(self, label: str) -> dict:
        return {"ok": True, **{k: v for k, v in self.versions.save(self.graph, label).items() if k != "path"}}

    def history(self) -> dict:
        return {"versions": [{k: v for k, v in e.items() if k != "path"} for e in self.versions.history()]}

    def rollback(self, label: str) -> dict:
        return {"ok": True, "triple_count": self.put(self.versions.rollback(label)).count()}

    def plan(self, new_turtle: str) -> dict:
        self.planner = lifecycle.Planner(self.graph, dict(self.locks), self.monitor_.blocked)
        out = self.planner.plan(rdf.load_text(self.spark, new_turtle, "turtle"))
        self.record("plan", "plan", out["risk"])
        return out

    def apply(self, mode: str = "safe") -> dict:
        if self.planner is None:
            raise RuntimeError("No plan found")
        self.planner.blocked, self.planner.locks = self.monitor_.blocked, dict(self.locks)
        g = self.put(self.planner.apply(mode))
        self.record("apply", mode)
        return {"ok": True, "mode": mode, "triple_count": g.count()}

    def lock(self, iris: list[str], reason: str = "") -> dict:
        new = {i if i.startswith("<") else f"<{i}>": reason for i in iris}
        self.locks |= new
        for iri, why in new.items():
            self.keep("iri_locks", {"iri": iri, "reason": why})
        return {"ok": True, "locked": sorted(self.locks)}

    def drift(self, version_a: str, version_b: str) -> dict:
        a, b = self.versions.rollback(version_a), self.versions.rollback(version_b)
        terms = self.rows(matching.drift_terms(a, b).orderBy("iri"))
        self.record("drift", f"{version_a}->{version_b}")
        return {"terms": terms, "renames": self.rows(matching.rename_candidates(a, b).orderBy(F.col("confidence").desc(), "from_iri", "to_iri")), "velocity": matching.drift_velocity(a, b)}

    def lineage(self, session_id: str | None = None) -> dict:
        wanted = session_id or self.session_id
        return {"session": wanted, "events": [":".join(map(str, e)) for e in self.events if e[0] == wanted]}

    # data
    def _mapping(self, df: DataFrame, text: str | None, inline: bool, base_iri: str) -> mapping.Mapping:
        return mapping.Mapping.from_json(self.text(text, inline)) if text else mapping.Mapping.from_headers(df.columns, base_iri)

    def _ingest(self, df: DataFrame, m: mapping.Mapping) -> dict:
        made = mapping.rows_to_triples(df, m)
        g = self.put(self.graph.add(made))
        return {"ok": True, "rows": df.count(), "triple_count": g.count()}

    def ingest(self, path: str, format: str | None = None, mapping: str | None = None, inline_mapping: bool = False, base_iri: str = mapping.DEFAULT_BASE) -> dict:
        df = tabular.read_file(self.spark, path, format)
        return self._ingest(df, self._mapping(df, mapping, inline_mapping, base_iri))

    def map(self, data_path: str, format: str | None = None, save_path: str | None = None) -> dict:
        df = tabular.read_file(self.spark, data_path, format)
        names = matching.vocabulary(self.graph)
        pick = lambda kind: [r["iri"] for r in names.where(F.col("kind") == kind).limit(ROWS).collect()]
        out = mapping.propose(df.columns, pick("class"), pick("property"))
        if save_path:
            with open(save_path, "w", encoding="utf-8") as f:
                json.dump(out["mapping"], f)
        return out

    def sql_ingest(self, connection: str, sql: str, mapping: str | None = None, inline_mapping: bool = False, base_iri: str = mapping.DEFAULT_BASE) -> dict:
        df = tabular.sql_rows(self.spark, sql, connection)
        return self._ingest(df, self._mapping(df, mapping, inline_mapping, base_iri))

    def import_schema(self, connection: str = "spark", views: list[str] | None = None, tables: list[mapping.TableSchema] | None = None, base_iri: str = mapping.SCHEMA_BASE) -> dict:
        """An ontology of a database's tables, of views of the session, or of tables described by the caller."""
        driver = tabular.sql_driver(connection)
        if tables:
            found = tables
        elif driver == "duckdb":
            import duckdb

            with duckdb.connect(tabular.duckdb_target(connection), read_only=True) as c:
                found = mapping.introspect_duckdb(c)
        elif driver == "postgres":
            found = mapping.introspect_postgres(lambda sql: [r.asDict() for r in tabular.sql_rows(self.spark, sql, connection).collect()])
        else:
            found = [mapping.introspect(v, self.spark.table(v)) for v in views or []]
        g = self.put(self.graph.add(self.spark.createDataFrame(mapping.schema_triples(found, base_iri), "s string, p string, o string")))
        return {"ok": True, "tables": len(found), "triple_count": g.count()}

    def extend(self, data_path: str, format: str | None = None, mapping: str | None = None, inline_mapping: bool = False, base_iri: str = mapping.DEFAULT_BASE, shapes: str | None = None, inline_shapes: bool = False, reason_profile: str | None = None, stop_on_violations: bool = True) -> dict:
        """Ingest, validate, reason; violations stop it before reasoning, with the data loaded."""
        out = {"ingest": self.ingest(data_path, format, mapping, inline_mapping, base_iri)}
        if shapes:
            out["shacl"] = self.shacl(shapes, inline_shapes)
            if not out["shacl"]["conforms"] and stop_on_violations:
                return {**out, "stopped": True}
        if reason_profile:
            out["reason"] = self.reason(reason_profile)
        return out

    # checks and reasoning
    def reason(self, profile: str = "rdfs", materialize: bool = True) -> dict:
        if profile == "owl-dl":
            out = json.loads(dl.classification_report(self.graph))
            if materialize:
                self.put(self.graph.add(dl.inferred_subclasses(self.graph)))
            return out
        done = reason(self.graph, profile)
        out = json.loads(done.report(materialize))
        if materialize:
            self.put(done.graph)
        return out

    def dl_explain(self, class_iri: str) -> dict:
        return dl.explain(dl.ontology_of(self.graph), class_iri)

    def dl_check(self, sub_class: str, super_class: str) -> dict:
        return dl.check_subsumption(dl.ontology_of(self.graph), sub_class, super_class)

    def shacl(self, shapes: str, inline: bool = False, extended: bool = False) -> dict:
        constraints = checks.shapes_from_triples([t[:3] for t in rdf.parse_turtle(self.text(shapes, inline))], extended)
        return json.loads(checks.report(checks.validate_shapes(self.graph, constraints), ROWS)) if constraints else {"conforms": True, "violation_count": 0, "violations": []}

    def enforce(self, rule_pack: str = "generic") -> dict:
        found = self.rows(checks.enforce(self.graph, rule_pack, self.custom_rules, self._votes()).orderBy("rule", "entity"))
        self.record("enforce", rule_pack)
        return {**checks.compliance(self.graph, rule_pack, self.custom_rules), "violations": found}

    def ground(self, triples: list[dict]) -> dict:
        claims = self.spark.createDataFrame([(t["s"], t["p"], t["o"]) for t in triples], "s string, p string, o string")
        return {"results": self.rows(lifecycle.ground(self.graph, claims))}

    def consistency(self, turtle: str) -> dict:
        return lifecycle.consistency(self.graph, rdf.load_text(self.spark, turtle, "turtle").triples)

    def monitor(self, watchers: str | None = None) -> dict:
        for w in json.loads(watchers) if watchers else []:
            self.watchers.append(lifecycle.Watcher(**w))
            headers = self.watchers[-1].webhook_headers
            self.keep("monitor_watchers", vars(self.watchers[-1]) | {"webhook_headers": json.dumps(headers) if headers else None})
        out, after = self.monitor_.run(self.graph)
        if after is not self.graph and out["status"] == "auto_rolled_back":
            self.put(after)
        self.keep("monitor_state", {"key": "blocked", "value": str(self.monitor_.blocked).lower()})
        self.record("monitor", out["status"])
        return out

    def monitor_clear(self) -> dict:
        self.monitor_.clear()
        self.keep("monitor_state", {"key": "blocked", "value": "false"})
        return {"ok": True}

    def _vote(self, tool: str, rule_id: str, entity: str, accepted: bool) -> dict:
        self.feedback.append((tool, rule_id, entity, accepted))
        self.keep("tool_feedback", {"tool": tool, "rule_id": rule_id, "entity": entity, "accepted": accepted})
        self.record(f"{tool}_feedback", rule_id, entity)
        return {"ok": True}

    def lint_feedback(self, rule_id: str, entity: str, accepted: bool) -> dict:
        return self._vote("lint", rule_id, entity, accepted)

    def enforce_feedback(self, rule_id: str, entity: str, accepted: bool) -> dict:
        return self._vote("enforce", rule_id, entity, accepted)

    # alignment, crosswalks, vectors
    def align(self, source: str, target: str | None = None, min_confidence: float = matching.ALIGN_THRESHOLD, dry_run: bool = True) -> dict:
        a = self.parsed(source)
        b = self.parsed(target) if target else self.graph
        votes = self.spark.createDataFrame(self.align_votes, "source_iri string, target_iri string, predicted_relation string, accepted boolean, signals_json string")
        found = matching.align(a, b, min_confidence, matching.learn_align_weights(votes))
        if not dry_run:
            self.put(self.graph.add(matching.alignment_triples(found)))
        self.record("align", source)
        rows = self.rows(found.orderBy(F.col("confidence").desc(), "source", "target"))
        return {"candidates": rows, "count": len(rows), "dry_run": dry_run}

    def align_feedback(self, source_iri: str, target_iri: str, accepted: bool, signals: dict | None = None, predicted_relation: str = "") -> dict:
        self.align_votes.append(matching.feedback_row(source_iri, target_iri, predicted_relation, accepted, signals))
        self.keep("align_feedback", dict(zip(("source_iri", "target_iri", "predicted_relation", "accepted", "signals_json"), self.align_votes[-1], strict=True)))
        self.record("align_feedback", source_iri, target_iri)
        return {"ok": True}

    def crosswalk(self, code: str, source_system: str) -> dict:
        return {"mappings": self.rows(matching.crosswalk_lookup(self.crosswalk_table, code, source_system))}

    def enrich(self, class_iri: str, code: str, system: str) -> dict:
        iri = class_iri if class_iri.startswith("<") else f"<{class_iri}>"
        made = matching.enrich(self.graph, iri, self.crosswalk_table, code, system)
        self.put(self.graph.add(made))
        return {"added": self.rows(made)}

    def validate_clinical(self) -> dict:
        labels = self.graph.with_predicate(T.LABEL).select(F.col("s").alias("iri"), T.lex(F.col("o")).alias("label"))
        return {"labels": self.rows(matching.validate_labels(labels, self.crosswalk_table))}

    def embed(self, struct_dim: int = 32, struct_epochs: int = 100) -> dict:
        t = self.graph.triples
        classes = t.where((F.col("p") == T.TYPE) & (F.col("o") == T.CLASS)).select(F.col("s").alias("iri")).distinct()
        labels = t.where(F.col("p") == T.LABEL).groupBy(F.col("s").alias("iri")).agg(F.min("o").alias("label"))
        named = classes.join(labels, "iri", "left").withColumn("text", F.coalesce(T.lex(F.col("label")), T.local(F.col("iri"))))
        edges = bounded_rows(t.where((F.col("p") == T.SUBCLASS) & T.is_iri(F.col("o"))).select("o", "s"), dl.MAX_AXIOMS)
        names = bounded_rows(classes, dl.MAX_AXIOMS)
        if edges is None or names is None:
            raise ValueError(f"the hierarchy has over {dl.MAX_AXIOMS} classes or edges; its training holds it in driver memory")
        placed = V.train_hierarchy([(r["o"], r["s"]) for r in edges], [r["iri"] for r in names], struct_dim, struct_epochs)
        struct = self.spark.createDataFrame(list(placed.items()), "iri string, struct_vec array<double>")
        self.vectors = named.withColumn("text_vec", V.hashed_ngrams("text").cast("array<double>")).join(struct, "iri").select("iri", "text_vec", "struct_vec").persist()
        return {"ok": True, "embedded": self.vectors.count(), "text_dim": 128, "struct_dim": struct_dim}

    def search(self, query: str, top_k: int = 10, mode: str = "product", alpha: float = 0.5) -> dict:
        """text: by cosine; structure: by distance from the best text match; product: both, seen from the origin."""
        q = self.spark.createDataFrame([(query,)], "query string").withColumn("q_text", V.hashed_ngrams("query").cast("array<double>"))
        size = len(self.vectors.first()["struct_vec"])
        origin = q.withColumn("q_struct", F.array_repeat(F.lit(0.0), size))
        if mode == "structure":
            best = V.top_k(self.vectors, origin, 1, "cosine").first()["iri"]
            origin = self.vectors.where(F.col("iri") == best).select(F.lit(query).alias("query"), F.col("text_vec").alias("q_text"), F.col("struct_vec").alias("q_struct"))
        kind = {"text": "cosine", "structure": "poincare", "product": "product"}[mode]
        return {"results": [{"iri": r["iri"], "score": round(r["score"], 3)} for r in V.top_k(self.vectors, origin, top_k, kind, alpha).orderBy("rank").collect()]}

    def similarity(self, iri_a: str, iri_b: str) -> dict:
        side = lambda i, x: self.vectors.where(F.col("iri") == i).select(F.col("text_vec").alias(f"{x}t"), F.col("struct_vec").alias(f"{x}s"))
        cos, dist = V.cosine(F.col("at"), F.col("bt")), V.poincare(F.col("as"), F.col("bs"))
        row = side(iri_a, "a").join(side(iri_b, "b"), F.lit(True)).select(cos.alias("cosine"), dist.alias("poincare"), V.product_score(cos, dist).alias("product")).first()  # one row each
        return {k: round(v, 3) for k, v in row.asDict().items()} if row else {"error": "not embedded"}


# batch -------------------------------------------------------------------------------------------


def parse_batch(text: str) -> list[tuple[str, dict | list]]:
    """Commands of a batch: a JSON array of {command, args}, JSON lines of the same, or lines of words; # begins a comment."""
    stripped = text.lstrip()
    if stripped.startswith("["):
        return [(c["command"], c.get("args", {})) for c in json.loads(stripped)]
    out = []
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("{"):
            c = json.loads(line)
            out.append((c["command"], c.get("args", {})))
        elif line and not line.startswith("#"):
            words = shlex.split(line)
            out.append((words[0], words[1:]))
    return out


def run_batch(engine: Engine, text: str, bail: bool = False, emit=print) -> int:
    """Run a batch; one JSON line for each command. The number of failures, after which bail stops."""
    failures = 0
    for k, (command, args) in enumerate(parse_batch(text), 1):
        tool = {"import": "import_", "monitor-clear": "monitor_clear"}.get(command, command)
        if isinstance(args, list):
            names = [p for p in inspect.signature(getattr(Engine, tool)).parameters if p != "self"] if tool in Engine.tools() else []
            args = dict(zip(names, args, strict=False))
            if tool in ("lock",) and "iris" in args:
                args["iris"] = args["iris"].split(",")
        answer = engine.call(tool, **args)
        emit(json.dumps({"seq": k, "command": command, "result": answer}, default=str, ensure_ascii=False))
        if "error" in answer:
            failures += 1
            if bail:
                break
    return failures
