"""Repositories of RDF files, the cache of parsed ones, the slots of loaded graphs, the catalogue, and imports."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.sources import rdf
from graphloom.session import shared_dir

#: File endings of RDF (fixed values), and the page size of listings.
RDF_ENDINGS = ["ttl", "turtle", "nt", "ntriples", "rdf", "xml", "owl", "nq", "trig", "jsonld"]
PAGE = 1_000

#: The catalogue of public vocabularies: id, name, domain, format, address (fixed values).
CATALOGUE = [
    ("owl", "OWL 2", "foundational", "turtle", "https://www.w3.org/2002/07/owl#"),
    ("rdfs", "RDF Schema", "foundational", "turtle", "https://www.w3.org/2000/01/rdf-schema#"),
    ("rdf", "RDF Concepts", "foundational", "turtle", "https://www.w3.org/1999/02/22-rdf-syntax-ns"),
    ("ies-top", "IES Top Level Ontology (ToLO)", "upper-ontology", "turtle", "https://raw.githubusercontent.com/IES-Org/ies-top/main/spec/ies-top.ttl"),
    ("ies-core", "IES Core Ontology", "upper-ontology", "turtle", "https://raw.githubusercontent.com/IES-Org/ies-core/main/spec/ies-core.ttl"),
    ("ies", "IES Common (Information Exchange Standard)", "upper-ontology", "turtle", "https://raw.githubusercontent.com/IES-Org/ont-ies/main/docs/specification/ies-common.ttl"),
    ("bfo", "BFO (Basic Formal Ontology)", "upper-ontology", "rdfxml", "https://raw.githubusercontent.com/BFO-ontology/BFO/v2019-08-26/bfo_classes_only.owl"),
    ("dolce", "DOLCE/DUL (Descriptive Ontology)", "upper-ontology", "turtle", "http://www.ontologydesignpatterns.org/ont/dul/DUL.owl"),
    ("schema-org", "Schema.org", "general", "turtle", "https://schema.org/version/latest/schemaorg-current-https.ttl"),
    ("foaf", "FOAF (Friend of a Friend)", "people", "rdfxml", "http://xmlns.com/foaf/spec/index.rdf"),
    ("skos", "SKOS (Simple Knowledge Organization System)", "knowledge-organization", "rdfxml", "https://www.w3.org/2009/08/skos-reference/skos.rdf"),
    ("dc-elements", "Dublin Core Elements", "metadata", "turtle", "http://www.dublincore.org/specifications/dublin-core/dcmi-terms/dublin_core_elements.ttl"),
    ("dc-terms", "Dublin Core Terms", "metadata", "turtle", "https://www.dublincore.org/specifications/dublin-core/dcmi-terms/dublin_core_terms.ttl"),
    ("dcat", "DCAT (Data Catalog Vocabulary)", "data-catalogs", "turtle", "https://www.w3.org/ns/dcat.ttl"),
    ("void", "VoID (Vocabulary of Interlinked Datasets)", "data-catalogs", "turtle", "https://raw.githubusercontent.com/cygri/void/master/rdfs/void.ttl"),
    ("doap", "DOAP (Description of a Project)", "software", "rdfxml", "https://raw.githubusercontent.com/ewilderj/doap/master/schema/doap.rdf"),
    ("prov-o", "PROV-O (Provenance Ontology)", "provenance", "turtle", "https://www.w3.org/ns/prov-o.ttl"),
    ("owl-time", "OWL-Time", "temporal", "turtle", "https://www.w3.org/2006/time.ttl"),
    ("org", "W3C Organization Ontology", "organizations", "turtle", "https://www.w3.org/ns/org.ttl"),
    ("ssn", "SSN (Semantic Sensor Network)", "iot", "turtle", "https://raw.githubusercontent.com/w3c/sdw-sosa-ssn/gh-pages/ssn/rdf/ontology/core/ssn.ttl"),
    ("sosa", "SOSA (Sensor, Observation, Sample, Actuator)", "iot", "turtle", "https://raw.githubusercontent.com/w3c/sdw-sosa-ssn/gh-pages/ssn/rdf/ontology/core/sosa.ttl"),
    ("geosparql", "GeoSPARQL", "geospatial", "turtle", "https://opengeospatial.github.io/ogc-geosparql/geosparql11/geo.ttl"),
    ("locn", "LOCN (Location Core Vocabulary)", "geospatial", "turtle", "https://www.w3.org/ns/locn.ttl"),
    ("shacl", "SHACL (Shapes Constraint Language)", "validation", "turtle", "https://www.w3.org/ns/shacl.ttl"),
    ("vcard", "vCard Ontology", "people", "turtle", "http://www.w3.org/2006/vcard/ns"),
    ("odrl", "ODRL (Open Digital Rights Language)", "rights", "turtle", "https://www.w3.org/ns/odrl/2/ODRL22.ttl"),
    ("cc", "Creative Commons", "rights", "rdfxml", "https://creativecommons.org/schema.rdf"),
    ("sioc", "SIOC (Semantically-Interlinked Online Communities)", "social", "rdfxml", "https://raw.githubusercontent.com/VisualDataWeb/OWL2VOWL/master/ontologies/sioc.rdf"),
    ("adms", "ADMS (Asset Description Metadata Schema)", "egovernment", "turtle", "https://www.w3.org/ns/adms.ttl"),
    ("goodrelations", "GoodRelations", "commerce", "rdfxml", "http://www.heppnetz.de/ontologies/goodrelations/v1.owl"),
    ("fibo", "FIBO (Financial Industry Business Ontology)", "finance", "rdfxml", "https://spec.edmcouncil.org/fibo/ontology/master/latest/MetadataFIBO.rdf"),
    ("qudt", "QUDT (Quantities, Units, Dimensions, Types)", "science", "turtle", "http://qudt.org/2.1/schema/qudt"),
]


def catalogue(spark: SparkSession, domain: str | None = None) -> DataFrame:
    rows = spark.createDataFrame(CATALOGUE, "id string, name string, domain string, format string, url string")
    return rows if domain is None else rows.where(F.col("domain") == domain)


def catalogue_entry(id_: str) -> dict | None:
    return next((dict(zip(("id", "name", "domain", "format", "url"), e, strict=True)) for e in CATALOGUE if e[0] == id_), None)


# repositories ------------------------------------------------------------------------------------


def list_files(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """(path, name, length, modified) of RDF files under a folder that Spark reads, a page at a time; glob matches names in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified")).where(F.lower("name").rlike(r"\.(" + "|".join(RDF_ENDINGS) + ")$"))
    if glob:
        found = found.where(F.lower("name").rlike(fnmatch.translate(glob.lower()).replace("(?s:", "(?:").replace(r")\Z", ")$").replace(r"\z", "$")))
    return found.orderBy("path").offset(offset).limit(limit)


class RepositoryError(ValueError):
    """A name that is outside the repositories, unknown, or not unique."""


def resolve_within(path: str, repositories: list[str]) -> str:
    """The real path of a folder or file inside one of the repositories."""
    for repo in repositories:
        base = os.path.realpath(repo)
        full = os.path.realpath(path if os.path.isabs(path) else os.path.join(base, path))
        if (full == base or full.startswith(base + os.sep)) and os.path.exists(full):
            return full
    raise RepositoryError(f"{path!r} is in none of the repositories")


def resolve_target(name: str, repositories: list[str]) -> str:
    """The file a name stands for: a path inside a repository, or a bare stem that only one file has."""
    try:
        found = resolve_within(name, repositories)
        if os.path.isfile(found):
            return found
    except RepositoryError:
        pass
    hits = sorted({os.path.join(d, f) for repo in repositories for d, _, fs in os.walk(repo) for f in fs if f.rpartition(".")[2].lower() in RDF_ENDINGS and (f == name or f.rpartition(".")[0] == name)})
    if len(hits) != 1:
        raise RepositoryError(f"{name!r} is {'not unique' if hits else 'unknown'}")
    return hits[0]


# cache and slots ---------------------------------------------------------------------------------

HASHED_PREFIX = 64 * 1024


@dataclass(frozen=True)
class Fingerprint:
    """What tells whether a source changed: its time, size, and the hash of its beginning."""

    modified: float
    size: int
    sha256: str

    @classmethod
    def of(cls, path: str) -> Fingerprint:
        st = os.stat(path)
        with open(path, "rb") as f:
            return cls(st.st_mtime, st.st_size, hashlib.sha256(f.read(HASHED_PREFIX)).hexdigest())


@dataclass
class CacheEntry:
    name: str
    source: str
    fingerprint: Fingerprint
    path: str
    triple_count: int
    compiled_at: float = field(default_factory=time.time)
    last_access: float = field(default_factory=time.time)


@dataclass
class Slot:
    name: str
    source: str | None
    graph: Graph | None
    auto_refresh: bool = False
    last_access: float = field(default_factory=time.time)


def derive_name(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0] or "default"


class Registry:
    """Loaded graphs by name. Parsed sources are kept as Parquet in the shared folder; idle slots lose their memory, not their
    table, and come back from it when they are used."""

    def __init__(self, spark: SparkSession, folder: str | None = None, idle_seconds: float = 0.0):
        self.spark, self.idle_seconds = spark, idle_seconds
        self.folder = folder or f"{shared_dir(spark)}/graphloom-cache"
        self.cache: dict[str, CacheEntry] = {}
        self.slots: dict[str, Slot] = {}
        self.active: str | None = None
        self.lock = threading.RLock()

    def _compiled(self, path: str, name: str, force: bool) -> tuple[Graph, bool]:
        print_ = Fingerprint.of(path)
        entry = self.cache.get(name)
        if entry and not force and entry.source == path and entry.fingerprint == print_:
            entry.last_access = time.time()
            return Graph(self.spark.read.parquet(entry.path)), True
        safe = re.sub(r"[^A-Za-z0-9._-]", "_", name)
        out = f"{self.folder}/{safe}-{print_.sha256[:16]}-{time.time_ns()}"
        rdf.load_files(self.spark, path).quads.write.parquet(out)
        g = Graph(self.spark.read.parquet(out))
        self.cache[name] = CacheEntry(name, path, print_, out, g.count())
        return g, False

    def load(self, path: str, name: str | None = None, auto_refresh: bool = False, force: bool = False) -> dict:
        with self.lock:
            name = name or derive_name(path)
            g, hit = self._compiled(path, name, force)
            self.slots[name] = Slot(name, path, g.cached(), auto_refresh)
            self.active = name
            return {"name": name, "triple_count": self.cache[name].triple_count, "cached": hit}

    def put(self, g: Graph, name: str = "default") -> Graph:
        with self.lock:
            old = self.slots.get(name)
            self.slots[name] = Slot(name, old.source if old else None, g)
            self.active = name
            return g

    def graph(self) -> Graph:
        """The active graph, loaded again if it was evicted, or if its source changed and it refreshes."""
        with self.lock:
            if self.active is None:
                return Graph.empty(self.spark)
            slot = self.slots[self.active]
            slot.last_access = time.time()
            stale = slot.auto_refresh and slot.source and self.cache[slot.name].fingerprint != Fingerprint.of(slot.source)
            if slot.graph is None or stale:
                slot.graph = self._compiled(slot.source, slot.name, bool(stale))[0].cached()
            return slot.graph

    def evict_idle(self) -> list[str]:
        """Free slots that nothing used for idle_seconds (0: never); only those that a source brings back."""
        with self.lock:
            gone = []
            for slot in self.slots.values():
                if self.idle_seconds and slot.graph is not None and slot.source and time.time() - slot.last_access >= self.idle_seconds:
                    slot.graph.quads.unpersist()
                    slot.graph = None
                    gone.append(slot.name)
            return gone

    def unload(self, name: str | None = None, delete_cache: bool = False) -> bool:
        with self.lock:
            name = name or self.active
            slot = self.slots.pop(name, None)
            if slot is None:
                return False
            if slot.graph is not None:
                slot.graph.quads.unpersist()
            if delete_cache:
                self.remove(name)
            if self.active == name:
                self.active = next(iter(self.slots), None)
            return True

    def recompile(self, name: str | None = None) -> dict:
        slot = self.slots[name or self.active]
        if not slot.source:
            raise ValueError(f"{slot.name!r} has no source")
        return self.load(slot.source, slot.name, slot.auto_refresh, force=True)

    def remove(self, name: str, delete_file: bool = True) -> bool:
        entry = self.cache.pop(name, None)
        if entry and delete_file:
            from graphloom.session import discard

            df = self.spark.createDataFrame([], "x int")
            df._graphloom_path = entry.path
            discard(df)
        return entry is not None

    def listed(self) -> list[dict]:
        return [{"name": e.name, "source": e.source, "triple_count": e.triple_count, "in_memory": bool((s := self.slots.get(e.name)) and s.graph)} for e in self.cache.values()]

    def status(self) -> dict:
        slot = self.slots.get(self.active) if self.active else None
        return {"active": self.active, "loaded": bool(slot and slot.graph is not None), "slots": sorted(self.slots), "cached": len(self.cache), "idle_seconds": self.idle_seconds}


def start_evictor(registry: Registry, every: float = 30.0) -> threading.Event:
    """A thread that evicts idle slots until the returned event is set."""
    stop = threading.Event()

    def loop():
        while not stop.wait(every):
            registry.evict_idle()

    threading.Thread(target=loop, daemon=True).start()
    return stop


# imports -----------------------------------------------------------------------------------------

IMPORT_DEPTH = 3


def import_closure(g: Graph, fetch, max_depth: int = IMPORT_DEPTH, follow_remote: bool = True) -> tuple[Graph, list[dict]]:
    """g with what it imports, breadth first; fetch(iri) gives the text. Each import is tried once; failures are reported."""
    seen: set[str] = set()
    log: list[dict] = []
    frontier = g
    for depth in range(1, max_depth + 1):
        todo = sorted({r["o"] for r in frontier.with_predicate(f"<{T.OWL}imports>").select("o").distinct().collect()} - seen)  # import statements
        if not todo:
            break
        frontier = Graph.empty(g.spark)
        for t in todo:
            seen.add(t)
            if not follow_remote and T.value_of(t).startswith(("http://", "https://")):
                log.append({"iri": t, "depth": depth, "status": "skipped"})
                continue
            try:
                part = rdf.load_text(g.spark, fetch(T.value_of(t)))
            except (OSError, ValueError) as e:
                log.append({"iri": t, "depth": depth, "status": "failed", "error": str(e)})
                continue
            log.append({"iri": t, "depth": depth, "status": "loaded"})
            frontier = frontier.add(part.quads)
        g = g.add(frontier.quads)
    return g, log
