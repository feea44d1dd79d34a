"""Drift between versions, alignment of ontologies, and crosswalk lookups."""

from __future__ import annotations

import functools
import json
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.functions.text import jaccard, jaro_winkler, jaro_winkler_udf, normal_label
from graphloom.graph import Graph
from graphloom.session import bounded_rows, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# drift -------------------------------------------------------------------------------------------

DRIFT_THRESHOLD, DRIFT_MIN_ROWS = 0.3, 10
DRIFT_WEIGHTS = [0.25, 0.25, 0.25, 0.25]


def vocabulary(g: Graph) -> DataFrame:
    """(iri, kind, label, domain, range) of classes and properties; of several values the greatest."""
    t = g.triples
    kinds = t.where((F.col("p") == T.TYPE) & F.col("o").isin(T.CLASS, T.OBJECT_PROPERTY, T.DATATYPE_PROPERTY))
    kinds = kinds.groupBy(F.col("s").alias("iri")).agg(F.min(F.when(F.col("o") == T.CLASS, "class").otherwise("property")).alias("kind"))
    told = t.where(F.col("p").isin(T.LABEL, T.DOMAIN, T.RANGE)).groupBy(F.col("s").alias("iri")).agg(*[F.max(F.when(F.col("p") == p, F.col("o"))).alias(n) for p, n in ((T.LABEL, "label"), (T.DOMAIN, "domain"), (T.RANGE, "range"))])
    return kinds.join(told, "iri", "left").select("iri", "kind", T.lex(F.col("label")).alias("label"), "domain", "range")


def drift_terms(old: Graph, new: Graph) -> DataFrame:
    """(change, iri, kind): vocabulary terms added or removed."""
    a, b = vocabulary(old), vocabulary(new)
    added = b.join(a, "iri", "left_anti").select(F.lit("added").alias("change"), "iri", "kind")
    return added.unionByName(a.join(b, "iri", "left_anti").select(F.lit("removed").alias("change"), "iri", "kind"))


def drift_velocity(old: Graph, new: Graph) -> float:
    """Changed terms over terms in both versions."""
    total = vocabulary(old).count() + vocabulary(new).count()
    return drift_terms(old, new).count() / total if total else 0.0


def rename_signals(pairs: DataFrame) -> DataFrame:
    """Signals of (a_, b_) vocabulary pairs: domain_range, label_sim, same_kind, hierarchy (not tracked, 0)."""
    known = F.coalesce(F.col("a_domain"), F.col("a_range"), F.col("b_domain"), F.col("b_range")).isNotNull()
    same = F.col("a_domain").eqNullSafe(F.col("b_domain")) & F.col("a_range").eqNullSafe(F.col("b_range"))
    name = lambda x: F.coalesce(F.col(f"{x}_label"), T.local(F.col(f"{x}_iri")))
    return pairs.withColumns({
        "domain_range": (known & same).cast("double"), "label_sim": jaro_winkler_udf(name("a"), name("b")),
        "same_kind": (F.col("a_kind") == F.col("b_kind")).cast("double"), "hierarchy": F.lit(0.0),
    })


def rename_candidates(old: Graph, new: Graph, weights: list[float] | None = None, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """(from_iri, to_iri, confidence, signals): removed terms that may have become added ones.

    Terms of different kinds without a common domain and range have nothing but their labels, so unless labels alone may reach the
    threshold, the pairs are those of removed and added terms of one kind, or of one domain and range: a product of changes, not of vocabularies.
    """
    w = weights or DRIFT_WEIGHTS
    a, b = vocabulary(old), vocabulary(new)
    side = lambda df, x: df.select(*[F.col(c).alias(f"{x}_{c}") for c in df.columns])
    gone, came = side(a.join(b, "iri", "left_anti"), "a"), side(b.join(a, "iri", "left_anti"), "b")
    same_kind = F.col("a_kind") == F.col("b_kind")
    if w[1] > threshold:
        pairs = gone.join(came, F.lit(True))
    else:
        placed = (F.col("a_domain") == F.col("b_domain")) & (F.col("a_range") == F.col("b_range"))
        pairs = gone.join(came, same_kind).unionByName(gone.join(came, placed).where(~same_kind))
    scored = rename_signals(pairs)
    names = ["domain_range", "label_sim", "same_kind", "hierarchy"]
    confidence = functools.reduce(Column.__add__, [F.col(n) * x for n, x in zip(names, w, strict=True)])
    return scored.withColumn("confidence", confidence).where(F.col("confidence") > threshold).select(F.col("a_iri").alias("from_iri"), F.col("b_iri").alias("to_iri"), "confidence", *names)


def learn_drift_weights(feedback: DataFrame) -> list[float]:
    """Weights from (signal_domain_range, signal_label_sim, signal_hierarchy, signal_individuals, predicted, actual)."""
    right = (F.col("predicted") == F.col("actual")).cast("double")
    names = ["signal_domain_range", "signal_label_sim", "signal_hierarchy", "signal_individuals"]
    row = feedback.agg(F.count("*").alias("n"), *[F.sum(F.col(n).cast("double") * right).alias(n) for n in names]).first()
    total = sum(row[n] or 0.0 for n in names)
    if row["n"] < DRIFT_MIN_ROWS or not total:
        return list(DRIFT_WEIGHTS)
    return [(row[n] or 0.0) / total for n in names]


# alignment ---------------------------------------------------------------------------------------

LABEL_LEAST, ALIGN_THRESHOLD, NO_STRUCTURE = 0.75, 0.85, 0.85
#: label, properties, parents, instances, restrictions, neighbourhood; the seventh is the embedding (fixed values).
ALIGN_WEIGHTS = [0.25, 0.20, 0.15, 0.15, 0.15, 0.10]
ALIGN_WEIGHTS_7 = [0.20, 0.15, 0.12, 0.12, 0.12, 0.09, 0.20]
SIGNALS = ["label", "property", "parent", "instance", "restriction", "neighborhood"]
OBO = "http://www.geneontology.org/formats/oboInOwl#"
#: Labels a task compares with a block of others at once.
BLOCK_LABELS = 4_000


def class_labels(g: Graph) -> DataFrame:
    """(iri, label): normalised label variants of owl classes; the local name where there is none."""
    t = g.triples
    classes = t.where((F.col("p") == T.TYPE) & (F.col("o") == T.CLASS) & T.is_iri(F.col("s"))).select(F.col("s").alias("iri")).distinct()
    of = lambda *ps: t.where(F.col("p").isin(*ps)).select(F.col("s").alias("iri"), F.col("o").alias("label"))
    main = of(T.LABEL)
    preferred = of(f"<{T.SKOS}prefLabel>").join(main.select("iri").distinct(), "iri", "left_anti")
    nodes = of(f"<{OBO}hasRelatedSynonym>", f"<{OBO}hasExactSynonym>").select("iri", F.col("label").alias("node"))
    synonyms = nodes.join(main.select(F.col("iri").alias("node"), "label"), "node").select("iri", "label")
    told = main.union(preferred).union(of(f"<{T.SKOS}altLabel>")).union(synonyms).where(T.is_literal(F.col("label"))).select("iri", T.lex(F.col("label")).alias("label"))
    named = classes.join(told, "iri", "left").withColumn("label", F.coalesce("label", T.local(F.col("iri"))))
    return named.select("iri", normal_label(F.col("label")).alias("label")).where("label != ''").distinct()


def class_signals(g: Graph) -> DataFrame:
    """(iri, property, parent, instance, restriction, neighborhood): sets of local names for each class that has any."""
    t = g.triples
    of = lambda p: t.where(F.col("p") == p)
    domain = of(T.DOMAIN).select(F.col("o").alias("iri"), F.col("s").alias("prop"))
    ranges = of(T.RANGE).select(F.col("s").alias("prop"), F.col("o").alias("r"))
    parents = of(T.SUBCLASS).where(T.is_iri(F.col("o"))).select(F.col("s").alias("iri"), F.col("o").alias("parent"))
    props = domain.select("iri", T.local(F.col("prop")).alias("x")).union(domain.join(ranges, "prop").select("iri", T.local(F.col("r")).alias("x")))
    kids = of(T.TYPE).where(T.is_iri(F.col("s"))).select(F.col("o").alias("iri"), T.local(F.col("s")).alias("x"))
    on = of(T.ON_PROPERTY).select(F.col("s").alias("r"), T.local(F.col("o")).alias("prop"))
    fill = t.where(F.col("p").isin(f"<{T.OWL}someValuesFrom>", f"<{T.OWL}allValuesFrom>")).select(F.col("s").alias("r"), T.local(F.col("o")).alias("filler"))
    bound = of(T.SUBCLASS).select(F.col("s").alias("iri"), F.col("o").alias("r")).join(on, "r").join(fill, "r").select("iri", F.concat("prop", F.lit("→"), "filler").alias("x"))
    near = domain.select("iri", "prop").union(parents.join(domain.select(F.col("iri").alias("parent"), "prop"), "parent").select("iri", "prop")).union(ranges.select(F.col("r").alias("iri"), "prop")).select("iri", T.local(F.col("prop")).alias("x"))
    parts = [("property", props), ("parent", parents.select("iri", T.local(F.col("parent")).alias("x"))), ("instance", kids), ("restriction", bound), ("neighborhood", near)]
    rows = functools.reduce(DataFrame.union, [df.select("iri", F.lit(n).alias("n"), "x") for n, df in parts])
    return rows.groupBy("iri").agg(*[F.collect_set(F.when(F.col("n") == n, F.col("x"))).alias(n) for n, _ in parts])


def _compare_block(left: pd.DataFrame, right: pd.DataFrame, least: float) -> pd.DataFrame:
    """Pairs of two blocks with similar labels. Shared characters bound Jaro-Winkler from above, so most pairs are settled by one
    matrix operation; the word overlap is counted for all pairs that share a word. Pairs that either could lift to least are scored."""
    if left.empty or right.empty:
        return _pairs([])
    chars = sorted({c for x in (*left["label"], *right["label"]) for c in x})
    place = {c: k for k, c in enumerate(chars)}

    def counts(labels):
        out = np.zeros((len(labels), len(chars)), np.int16)
        for k, x in enumerate(labels):
            for c in x:
                out[k, place[c]] += 1
        return out

    la, lb = left["label"].tolist(), right["label"].tolist()
    ca, cb = counts(la), counts(lb)
    na, nb = ca.sum(1), cb.sum(1)
    words_b = [set(x.split()) for x in lb]
    sizes_b = np.array([len(w) for w in words_b])
    having: dict[str, list[int]] = {}
    for j, ws in enumerate(words_b):
        for w in ws:
            having.setdefault(w, []).append(j)
    rows = []
    for k, x in enumerate(la):
        m = np.minimum(ca[k][None, :], cb).sum(1)
        top = (m / max(na[k], 1) + m / np.maximum(nb, 1) + (m > 0)) / 3
        best = top + PREFIX_CAP * (1 - top)
        words = set(x.split())
        both = np.zeros(len(lb))
        for w in words & having.keys():
            both[having[w]] += 1
        overlap = both / np.maximum(len(words) + sizes_b - both, 1)
        for j in np.flatnonzero((best >= least) | (overlap >= least)):
            sim = max(jaro_winkler(x, lb[j]), float(overlap[j]))
            if sim >= least:
                rows.append((left["iri"].iat[k], right["iri"].iat[j], sim))
    return _pairs(rows)


def _pairs(rows: list[tuple[str, str, float]]) -> pd.DataFrame:
    return pd.DataFrame({"a": pd.Series([r[0] for r in rows], dtype=object), "b": pd.Series([r[1] for r in rows], dtype=object), "label": np.array([r[2] for r in rows], float)})


PREFIX_CAP = 0.4


def similar_labels(a: DataFrame, b: DataFrame, least: float = LABEL_LEAST, block: int = BLOCK_LABELS) -> DataFrame:
    """(a, b, label): best label similarity of class pairs at or above least.

    All pairs are settled, block by block: labels are dealt into blocks by hash, each pair of blocks is one group, and a task holds
    two blocks at a time.
    """
    na, nb = max(1, -(-a.count() // block)), max(1, -(-b.count() // block))
    left = a.withColumn("i", F.pmod(F.xxhash64("iri", "label"), F.lit(na))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)).cast("array<bigint>")))
    right = b.withColumn("j", F.pmod(F.xxhash64("iri", "label"), F.lit(nb))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(na - 1)).cast("array<bigint>")))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return _compare_block(x, y, least)

    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, "a string, b string, label double")
    return pairs.where("a != b").groupBy("a", "b").agg(F.max("label").alias("label"))


def relation(label: Column, prop: Column, parent: Column) -> Column:
    return F.when((label > 0.8) & (prop > 0.5), T.EQUIVALENT_CLASS).when(label > 0.8, T.EXACT_MATCH).when(parent > 0.5, T.SUBCLASS).when(label > 0.6, T.EXACT_MATCH).otherwise(T.CLOSE_MATCH)


def align_candidates(source: Graph, target: Graph, threshold: float = ALIGN_THRESHOLD, weights: list[float] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(source, target, confidence, relation, label, property, parent, instance, restriction, neighborhood).

    vectors: (iri, text_vec) adds the cosine as a seventh signal. Without structural evidence the confidence is a share of the
    label similarity alone.
    """
    pairs = similar_labels(class_labels(source), class_labels(target))
    rename = lambda df, x: df.select(F.col("iri").alias(x), *[F.col(n).alias(f"{x}_{n}") for n in SIGNALS[1:]])
    joined = pairs.join(rename(class_signals(source), "a"), "a", "left").join(rename(class_signals(target), "b"), "b", "left")
    none = F.array().cast("array<string>")
    for n in SIGNALS[1:]:
        joined = joined.withColumn(n, jaccard(F.coalesce(f"a_{n}", none), F.coalesce(f"b_{n}", none)))
    names = list(SIGNALS)
    w = weights or ALIGN_WEIGHTS
    if vectors is not None:
        from graphloom.functions.vectors import cosine

        va, vb = (vectors.select(F.col("iri").alias(x), F.col("text_vec").alias(f"{x}_vec")) for x in "ab")
        joined = joined.join(va, "a", "left").join(vb, "b", "left").withColumn("embedding", F.coalesce(cosine(F.col("a_vec"), F.col("b_vec")), F.lit(0.0)))
        names, w = [*names, "embedding"], weights or ALIGN_WEIGHTS_7
    structure = functools.reduce(Column.__add__, [F.col(n) for n in SIGNALS[1:]])
    weighted = functools.reduce(Column.__add__, [F.col(n) * x for n, x in zip(names, w, strict=True)])
    confidence = F.when(structure == 0, F.col("label") * NO_STRUCTURE).otherwise(weighted)
    scored = joined.withColumn("confidence", F.round(confidence, 3)).where(confidence >= threshold)
    return scored.select(F.col("a").alias("source"), F.col("b").alias("target"), "confidence", relation(F.col("label"), F.col("property"), F.col("parent")).alias("relation"), *names)


#: Candidates that are settled in driver memory at once.
DRIVER_CANDIDATES = 100_000


def _greedy(rows: list) -> list:
    """The rows that the greedy choice takes, one by one in its order."""
    used, taken, out = set(), set(), []
    for r in sorted(rows, key=lambda r: (-r["confidence"], r["source"], r["target"])):
        if r["source"] not in used and r["target"] not in taken:
            used.add(r["source"])
            taken.add(r["target"])
            out.append(r)
    return out


def _best_pairs(left: DataFrame) -> DataFrame:
    """Pairs of left that the greedy choice takes for sure: mutual best ones, and in a tied block, the pairs of equal rank.

    A tied block is a set of sources with the same best targets, which have just these sources as their best ones.
    """
    tops = left.withColumns({f"__{x}": F.max("confidence").over(Window.partitionBy(x)) for x in ("source", "target")}).where("confidence = __source AND confidence = __target").select("source", "target", "confidence")
    # best pairs of both ends; of each end, all pairs at its best confidence must be among them
    at_best = lambda x: left.groupBy(x, "confidence").agg(F.count("*").alias(f"__n_{x}"))
    other = {"source": "target", "target": "source"}
    signed = tops
    for x in ("source", "target"):
        o = other[x]
        sign = tops.groupBy(x, "confidence").agg(F.count("*").alias(f"__k_{x}"), F.bit_xor(F.xxhash64(o)).alias(f"__h_{x}"), F.bit_xor(F.xxhash64(F.lit(7919), o)).alias(f"__g_{x}"))
        signed = signed.join(sign.join(at_best(x), [x, "confidence"]), [x, "confidence"])
    whole = signed.where("__k_source = __n_source AND __k_target = __n_target")
    # complete: the sources of one target set are as many as each of its targets has
    block = ["confidence", "__k_source", "__h_source", "__g_source"]
    many = whole.select(*block, "source").distinct().groupBy(*block).agg(F.count("*").alias("__m"))
    full = whole.join(many, block).where("__m = __k_target")
    full = full.join(full.groupBy(*block).agg(F.count("*").alias("__e")), block).where("__e = __m * __k_source")
    rank = lambda x: full.select(*block, x).distinct().withColumn(f"__r_{x}", F.row_number().over(Window.partitionBy(*block).orderBy(x)))
    tied = full.join(rank("source"), [*block, "source"]).join(rank("target"), [*block, "target"]).where("__r_source = __r_target").select("source", "target")
    order = [F.col("confidence").desc(), F.col("source"), F.col("target")]
    best = left.withColumns({f"of_{x}": F.row_number().over(Window.partitionBy(x).orderBy(*order)) for x in ("source", "target")})
    return best.where("of_source = 1 AND of_target = 1").select("source", "target").unionByName(tied).distinct()


def one_to_one(candidates: DataFrame, driver_candidates: int = DRIVER_CANDIDATES) -> DataFrame:
    """The greedy one-to-one choice by confidence, ties by source, then target.

    Rounds of mutual best pairs, and of tied blocks by rank, give the same choice as taking pairs one by one in that order. They go on
    until no candidates are left, or at most driver_candidates, which are settled in driver memory.
    """
    left = materialize(candidates, "candidates")
    chosen = None
    while True:
        rows = bounded_rows(left.select("source", "target", "confidence"), driver_candidates) if driver_candidates else None
        if rows is not None:
            keys = left.sparkSession.createDataFrame([(r["source"], r["target"]) for r in _greedy(rows)], left.select("source", "target").schema)
        elif left.isEmpty():
            return chosen if chosen is not None else left
        else:
            keys = _best_pairs(left)
        taken = materialize(left.join(keys, ["source", "target"], "left_semi"), "chosen")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        if rows is not None:
            return chosen
        left = materialize(left.join(taken.select("source"), "source", "left_anti").join(taken.select("target"), "target", "left_anti"), "candidates")


def align(source: Graph, target: Graph, threshold: float = ALIGN_THRESHOLD, weights: list[float] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    return one_to_one(align_candidates(source, target, threshold, weights, vectors))


def alignment_triples(aligned: DataFrame) -> DataFrame:
    return aligned.select(F.col("source").alias("s"), F.col("relation").alias("p"), F.col("target").alias("o"))


def learn_align_weights(feedback: DataFrame, prior: list[float] | None = None) -> list[float]:
    """Weights from feedback (accepted, signals_json): ratios of means over accepted and rejected rows, blended with the prior."""
    prior = prior or ALIGN_WEIGHTS
    parsed = feedback.select("accepted", F.from_json("signals_json", "map<string, double>").alias("s")).where("s IS NOT NULL")
    row = parsed.agg(F.count("*").alias("n"), F.count_if("accepted").alias("yes"), *[F.avg(F.when(F.col("accepted") == flag, F.coalesce(F.col("s")[n], F.lit(0.0)))).alias(f"{n}_{flag}") for n in SIGNALS for flag in (True, False)]).first()
    if row["n"] < 10 or row["yes"] < 3 or row["n"] - row["yes"] < 3:
        return list(prior)
    ratios = [min(10.0, max(0.1, (row[f"{n}_True"] + 0.01) / (row[f"{n}_False"] + 0.01))) for n in SIGNALS]
    total = sum(r * p for r, p in zip(ratios, prior, strict=False))
    blended = [0.7 * r * p / total + 0.3 * p for r, p in zip(ratios, prior, strict=False)]
    return [b / sum(blended) for b in blended]


# crosswalks --------------------------------------------------------------------------------------

FUZZY_LEAST, FUZZY_MOST = 0.6, 20
CROSSWALK = "source_code string, source_system string, target_code string, target_system string, relation string, source_label string, target_label string"


def load_crosswalk(spark, path: str) -> DataFrame:
    """A crosswalk table from Parquet, its seven columns as text."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(c.split(" ")[0]).cast("string") for c in CROSSWALK.split(", ")])


def crosswalk_lookup(crosswalk: DataFrame, code: str, system: str) -> DataFrame:
    return crosswalk.where((F.col("source_code") == code) & (F.col("source_system") == system))


def fuzzy_labels(crosswalk: DataFrame, text: str, most: int = FUZZY_MOST) -> DataFrame:
    """Rows whose better label is similar to text, best first; the limit is the feature."""
    of = lambda c: F.coalesce(jaro_winkler_udf(F.lower(c), F.lit(text.lower())), F.lit(0.0))
    scored = crosswalk.withColumn("score", F.greatest(of(F.col("source_label")), of(F.col("target_label"))))
    return scored.where(F.col("score") > FUZZY_LEAST).orderBy(F.col("score").desc(), "source_code", "target_code").limit(most)


def validate_labels(labels: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(iri, label, best, score, matches): for every label (iri, label) its best crosswalk label and how many are similar (at most 20)."""
    known = crosswalk.select(F.explode(F.array("source_label", "target_label")).alias("known")).where("known IS NOT NULL").distinct()
    a = labels.select("iri", F.lower("label").alias("label"))
    pairs = similar_labels(a.select(F.concat_ws("\x01", "iri", "label").alias("iri"), "label"), known.select(F.col("known").alias("iri"), F.lower("known").alias("label")), FUZZY_LEAST)
    scored = pairs.where(F.col("label") > FUZZY_LEAST).groupBy("a").agg(F.max(F.struct(F.col("label").alias("score"), F.col("b").alias("best"))).alias("top"), F.least(F.count("*"), F.lit(FUZZY_MOST)).alias("matches"))
    joined = a.join(scored, F.concat_ws("\x01", a["iri"], a["label"]) == F.col("a"), "left")
    return joined.select("iri", "label", F.col("top.best").alias("best"), F.col("top.score").alias("score"), F.coalesce("matches", F.lit(0)).alias("matches"))


def enrich(g: Graph, class_iri: str, crosswalk: DataFrame, code: str, system: str) -> DataFrame:
    """Triples for a class from the first mapping (by target) of a code: an exact match and its label."""
    first = crosswalk_lookup(crosswalk, code, system).agg(F.min(F.struct("target_code", "target_system", "target_label")).alias("m")).where("m IS NOT NULL")
    target = F.concat(F.lit("<http://example.org/"), F.lower(F.regexp_replace("m.target_system", "[^A-Za-z0-9]+", "-")), F.lit("/"), F.col("m.target_code"), F.lit(">"))
    made = F.array(F.struct(F.lit(T.EXACT_MATCH).alias("p"), target.alias("o")), F.struct(F.lit(T.LABEL).alias("p"), F.when(F.col("m.target_label").isNotNull(), T.plain_literal(F.col("m.target_label"))).alias("o")))
    return first.select(F.lit(class_iri).alias("s"), F.explode(made).alias("t")).select("s", "t.p", "t.o").where("o IS NOT NULL")


def scores(predicted: DataFrame, gold: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., tp, fp, fn, precision, recall, f1) of predicted against gold key rows."""
    by = by or []
    cols = by + key
    a = predicted.select(*cols).distinct().withColumn("p", F.lit(1))
    b = gold.select(*cols).distinct().withColumn("q", F.lit(1))
    both = a.join(b, cols, "full_outer")
    out = both.groupBy(*by).agg(F.count_if(F.col("p").isNotNull() & F.col("q").isNotNull()).alias("tp"), F.count_if(F.col("q").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return with_prf(out)


def with_prf(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    out = counts.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def feedback_row(source: str, target: str, predicted: str, accepted: bool, signals: dict | None = None) -> tuple:
    """An alignment feedback row (source_iri, target_iri, predicted_relation, accepted, signals_json)."""
    return source, target, predicted, accepted, json.dumps(signals) if signals is not None else None
