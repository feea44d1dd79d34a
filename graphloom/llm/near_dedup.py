"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its distinct shingles of ``SHINGLE_WORDS`` words unless told otherwise (64-bit hashes of words split at ASCII
white space, A-Z lower-cased); a text of fewer words is one shingle. Documents of one set form a class; its smallest id stands for it. Each class has a signature of
``POSITIONS`` minima, cut to 16 bits each. The multi-index splits a signature into ``CHUNKS`` chunks and indexes,
for each chunk, every way to leave one position out (the allowed chunk error). By the pigeonhole principle two
signatures that differ in at most ``CHUNKS * (1 + 1) - 1`` positions agree in some chunk but for one position,
so every such pair meets in a bucket; beyond that distance most pairs still do: two sets of similarity 0.8
miss each other in all buckets with a probability of 3e-7. Candidates are confirmed on full sets.

Buckets are never expanded into all pairs:
1. each class is compared with one centre, that of the bucket it shares most buckets with: the member that is in most shared buckets, as the
   copies with the fewest edits are, since they are nearest to all others;
2. confirmed links give components; buckets that lie in one component are done;
3. members of the buckets left ("mixed") that are outside the largest component of one are held against the mixed
   members of other components by their rarest shingles: with shingles in one global order, rarest among the mixed members first,
   two linked sets share a shingle among the first fifth of both, and the first that they share leaves enough
   behind it on both sides (prefix, length and positional filters). This is exact, and a member whose own edits alone
   rule out a link costs no pair. What is confirmed joins components.
So every pair that meets in a bucket and is linked ends in one component.

Scale: bucket centres are pre-aggregated; joins on buckets and classes are splittable when skewed; texts are
shuffled once, to pick those of candidates. Intermediates go to the shared folder.

Edge cases: null or blank text: the empty set, linked with nothing. Fewer words than a shingle has: a set of one. A null id is
linked with nothing and kept. Rows that repeat an id each get a row; rows of one id with different texts are
linked only by what their texts say, but where that id stands for both classes they count as one document.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm._common import discard, materialize, table
from graphloom.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a shingle: of the operator, and of the contract query.
SHINGLE_WORDS, QUERY_WORDS = 5, 2
POSITIONS = 64
CHUNKS = 12
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
WORDS_CACHED = 1_000_000
#: Ratio of neighbouring size bands in the comparison of mixed members.
BAND = 1.05

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, elementwise."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _series(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


MULTIPLIERS = _series(11, POSITIONS) | _U(1)
OFFSETS = _series(23, POSITIONS)
_words: dict[bytes, int] = {}


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > WORDS_CACHED:
        _words.clear()
    for w in set(words):
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = mix(h[: len(h) - size + 1] + _U(size))
    for k in range(1, size):
        out = mix(out * _U(0x9E3779B97F4A7C15) + mix(h[k : len(h) - size + 1 + k] + _U(0x632BE59BD9B4E019)))
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """POSITIONS minima of a non-empty set, 16 bits each."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):
        block = s[k : k + 2048]
        np.minimum(least, (block[None, :] * MULTIPLIERS[:, None] + OFFSETS[:, None]).min(axis=1), out=least)
    return (mix(least) & _U(0xFFFF)).astype(np.uint16)


def bucket_keys(sigs: np.ndarray) -> np.ndarray:
    """For signatures (n, POSITIONS): the keys (n, POSITIONS) of each chunk with one position left out."""
    place = np.arange(POSITIONS, dtype=np.uint64)
    parts = mix(sigs.astype(np.uint64) + (place << _U(16)) + _U(1 << 40))
    bounds = np.linspace(0, POSITIONS, CHUNKS + 1).round().astype(int)
    sums = np.concatenate([np.repeat(parts[:, a:b].sum(axis=1, keepdims=True), b - a, axis=1) for a, b in zip(bounds, bounds[1:], strict=False)], axis=1)
    return mix(sums - parts + mix(place + _U(77)))


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, h1, h2, sigs = batch.column(0), [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), size)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                n.append(len(s))
                h1.append(int.from_bytes(digest[:8], "little", signed=True))
                h2.append(int.from_bytes(digest[8:], "little", signed=True))
                sigs.append(signature(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "n_shingles", "h1", "h2", "sig"])

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            sigs = np.frombuffer(b"".join(x.as_py() for x in part.column(1)), np.uint16).reshape(-1, POSITIONS)
            keys = bucket_keys(sigs).view(np.int64).ravel()
            ids = np.repeat(part.column(0).to_numpy(), POSITIONS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys)], names=["id", "key"])


def _tokens(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, n, token) for every shingle of (id, text)."""
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = [shingles(x.as_py(), size) for x in part.column(1)]
                sizes = np.array([len(x) for x in sets], np.int64)
                if sizes.sum():
                    ids = np.repeat(part.column(0).to_numpy(), sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "n", "token"])

    return run


def _confirm(percent: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            linked = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                ta = ta.as_py()
                if last[0] != ta:
                    last = (ta, shingles(ta, size))
                x, y = last[1], shingles(tb.as_py(), size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return run


def _linked(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    sides = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return sides.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent, size), "a long, b long")


def _mixed_pairs(shared: DataFrame, joined: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b) of different components among the members of mixed buckets that may be linked."""
    placed = shared.join(joined.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("largest")).where("parts > 1").select("key", F.col("largest.component").alias("major"))
    members = materialize(placed.join(mixed, "key").groupBy("id", "component").agg(F.max(F.col("component") != F.col("major")).alias("minor")), "mixed")

    tokens = texts.join(members.select("id").distinct(), "id", "left_semi").select("id", "text").mapInArrow(_tokens(size), "id long, n long, token long")
    tokens = materialize(tokens, "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("id").orderBy("often", "token")
    prefix = (
        tokens.join(often, "token")
        .withColumn("at", F.row_number().over(rarest) - 1)
        .where(F.col("at") * 100 <= F.col("n") * (100 - percent))
        .join(members, "id")
        .select("id", "n", "token", "at", "component", "minor")
    )
    prefix = materialize(prefix, "prefix")
    band = lambda n: F.floor(F.log(n) / F.log(F.lit(BAND)))
    least, most = F.col("n") * percent / 100, (F.col("n") - F.col("at")) * (100 + percent) / percent - F.col("n")
    asks = prefix.where("minor").where(most >= least).withColumn("band", F.explode(F.sequence(band(least), band(most))))
    asks = asks.select("token", "band", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("component").alias("cx"))
    have = prefix.select("token", band(F.col("n")).alias("band"), F.col("id").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), F.col("component").alias("cy"))
    enough = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    met = asks.join(have, ["token", "band"]).where((F.col("cx") != F.col("cy")) & enough).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    near = materialize(met.distinct(), "near")
    for done in (members, tokens, prefix):
        discard(done)
    return near


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = SHINGLE_WORDS, read: list[DataFrame] | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row per row of docs. read: takes up the tables that the result is read from."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = materialize(own.mapInArrow(_describe(words), "id long, n_shingles long, h1 long, h2 long, sig binary"), "sets")
    member = rows.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = materialize(member.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.max("sig").alias("sig")), "classes")

    keys = classes.select("id", "sig").mapInArrow(_index, "id long, key long")
    several = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("top")).where(F.col("least") < F.col("top")).select("key")
    met = materialize(keys.join(several, "key"), "buckets")
    central = met.join(met.groupBy("id").agg(F.count("*").alias("n")), "id")
    centres = central.groupBy("key").agg(F.max(F.struct("n", (-F.col("id")).alias("minus"))).alias("most")).select("key", (-F.col("most.minus")).alias("centre"))
    shared = materialize(met.join(centres, "key").select("key", "id", "centre"), "centres")
    wanted = shared.select("id").distinct()
    texts = materialize(own.join(wanted, "id", "left_semi"), "texts")

    often = shared.where("id != centre").groupBy("id", "centre").agg(F.count("*").alias("n"))
    nearest = often.groupBy("id").agg(F.max(F.struct("n", (-F.col("centre")).alias("minus"))).alias("best")).select((-F.col("best.minus")).alias("a"), F.col("id").alias("b"))
    links = materialize(_linked(nearest, texts, percent, words), "links")
    joined = materialize(components(links), "components")

    near = _mixed_pairs(shared, joined, texts, percent, words)
    more = materialize(_linked(near, texts, percent, words), "links")
    if not more.isEmpty():
        before = joined
        joined = materialize(components(links.unionByName(more)), "components")
        discard(before)
    for done in (texts, met, shared, near, links, more):
        discard(done)
    if read is not None:
        read += [rows, classes, joined]

    named = classes.select("h1", "h2", F.col("id").alias("head")).join(joined.withColumnRenamed("node", "head"), "head", "left").select("h1", "h2", F.coalesce("component", "head").alias("component"))
    found = member.select("id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"])
    alone = rows.where((F.col("n_shingles") == 0) | F.col("id").isNull()).withColumn("component", F.col("id"))
    out = ["id", "n_shingles", "component"]
    both = found.select(*out).unionByName(alone.select(*out))
    return both.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), words=QUERY_WORDS)


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
         ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM words),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN twoway e ON e.a = r.b),
least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least_of l ON l.a = s.doc_id
"""
