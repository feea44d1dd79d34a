"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

Texts and items are normalised alike: A-Z are lower-cased, words are maximal runs of digits, letters and non-ASCII
characters, joined by single spaces. A window is ``WINDOW_WORDS`` consecutive words of an item, or the whole item if it
has fewer. The automaton holds every window between spaces, so one scan of a normalised text finds all their
occurrences, overlapping ones too; a word inside an occurrence is hit. Hits map back to code point offsets of the
original text.

Scale: one narrow pass over the texts, no shuffle. Windows are cut and pre-aggregated on the executors. Windows of up to
``BLOCK_CHARS`` characters (about 60,000, with the ids of their items) are one automaton, which goes out as a broadcast and is built
once a worker. A larger set is dealt into blocks of that size by a hash of the window: every block is a pass of its own over the texts, one automaton
and one bounded broadcast at a time; what the passes behind the first find, a row for each distinct text with hits, is joined by two hashes of the
text. The driver holds one block at a time.

Edge cases: a null text or item has no words; a text without words is clean; items without words or id match
nothing; windows that several items share count for each; rows that repeat are each judged; a very long text is one row of a batch;
columns of the documents that have the name of a result give way to it; an empty table of items leaves all texts clean.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import append_arrow, discard, materialize, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW_WORDS = 10
BLOCK_CHARS = 4_000_000
#: Names that columns of the documents give way to; runs is one on the way.
RESULTS = ["n_words", "n_hit", "items", "spans", "runs"]

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_RUNS = "runs array<struct<first: int, end: int, char_start: long, char_end: long>>"


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def item_windows(text: str | None, n: int = WINDOW_WORDS) -> list[bytes]:
    words = normal_words(text)
    if not words:
        return []
    return [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]


def item_windows_table(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(window, words, items): the distinct windows, their numbers of words, and the ids of their items, ascending."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                windows = item_windows(text.as_py(), n)
                for k in range(0, len(windows), 10_000):
                    part = windows[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in part], pa.string()), pa.array([w.count(b" ") + 1 for w in part], pa.int32()), pa.repeat(item, len(part))], names=["window", "words", "item"])

    items = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("t")).where("item IS NOT NULL AND t IS NOT NULL")
    return items.mapInArrow(cut, "window string, words int, item long").groupBy("window", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def window_blocks(windows: DataFrame, block_chars: int):
    """Broadcasts of the windows in blocks of about block_chars characters, one after the other."""
    sc = windows.sparkSession.sparkContext
    stored = materialize(windows, "windows")
    total = stored.agg(F.sum(F.length("window") + 8 * F.size("items"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for k in range(n):
        block = stored.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k)
        yield sc.broadcast({"windows": [(r["window"], (r["words"], r["items"])) for r in block.collect()]})  # a bounded block
    discard(stored)


def _automaton(shared):
    """The automaton of a block; a worker builds it once, in place of the broadcast windows."""
    if "windows" in shared.value:
        found = ahocorasick.Automaton()
        for window, held in shared.value.pop("windows"):
            found.add_word(f" {window} ", held)
        if len(found):
            found.make_automaton()
        shared.value["automaton"] = found
    return shared.value["automaton"]


def text_hits(text: str | None, automaton) -> tuple[int, np.ndarray | None, set]:
    """A text's number of words, which of them are hit (None: none), and the items with occurring windows."""
    words = normal_words(text)
    if not words or not len(automaton):
        return len(words), None, set()
    flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    met = list(automaton.iter(flat))
    if not met:
        return len(words), None, set()
    spaces = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    step, items = np.zeros(len(words) + 1, np.int64), set()
    for end, (length, ids) in met:
        k = int(np.searchsorted(spaces, end))
        step[k - length] += 1
        step[k] -= 1
        items.update(ids)
    return len(words), np.cumsum(step)[:-1] > 0, items


def hit_runs(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words: their numbers, and their span in code points of the original text."""
    places = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"first": int(a), "end": int(b), "char_start": places[a][0], "char_end": places[b - 1][1]} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def merged_runs(runs: list[dict]) -> list[dict]:
    """Runs that overlap or touch as one."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: r["first"]):
        if out and r["first"] <= out[-1]["end"]:
            if r["end"] > out[-1]["end"]:
                out[-1] |= {"end": r["end"], "char_end": r["char_end"]}
        else:
            out.append(dict(r))
    return out


def _run_type() -> pa.DataType:
    return pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64())]))


def _pass(text_col: str, shared):
    """n_words, runs and items of a batch of texts by one automaton."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        automaton, rows = _automaton(shared), []
        for text in batch.column(batch.schema.get_field_index(text_col)):
            text = text.as_py()
            n, hit, items = text_hits(text, automaton)
            rows.append((n, [] if hit is None else hit_runs(text, hit), sorted(items)))
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), _run_type(), pa.list_(pa.int64())))]

    return run


def _merge(batch: pa.RecordBatch) -> list[pa.Array]:
    runs = [merged_runs(x or []) for x in batch.column(batch.schema.get_field_index("runs")).to_pylist()]
    items = [sorted(set(x or [])) for x in batch.column(batch.schema.get_field_index("items")).to_pylist()]
    return [pa.array(runs, _run_type()), pa.array(items, pa.list_(pa.int64()))]


def scan_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window_words: int = WINDOW_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs plus n_words, n_hit, items (ids, ascending) and spans (start, end in code points of the text)."""
    fields = f"n_words long, {_RUNS}, items array<long>"
    docs = docs.select(*[c for c in docs.columns if c.lower() not in RESULTS])
    blocks = window_blocks(item_windows_table(benchmark, item_id, item_text, window_words), block_chars)
    found = append_arrow(docs, _pass(text_col, next(blocks)), fields)
    keys = {"__h1": F.xxhash64(text_col), "__h2": F.xxhash64(F.lit(7919), text_col)}
    more = []
    for shared in blocks:
        texts = docs.select(F.col(text_col).alias("__text")).where("__text IS NOT NULL")
        met = append_arrow(texts, _pass("__text", shared), fields).where(F.size("runs") > 0)
        met = met.select(F.xxhash64("__text").alias("__h1"), F.xxhash64(F.lit(7919), "__text").alias("__h2"), "runs", "items").dropDuplicates(["__h1", "__h2"])
        more.append(materialize(met, "hits"))
        shared.destroy()
    if more:
        rest = functools.reduce(DataFrame.unionByName, more).groupBy("__h1", "__h2").agg(F.flatten(F.collect_list("runs")).alias("__runs"), F.flatten(F.collect_list("items")).alias("__items"))
        both = found.withColumns(keys).join(rest, ["__h1", "__h2"], "left")
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
        both = both.withColumns({"runs": F.concat("runs", none(F.col("__runs"), _RUNS.removeprefix("runs "))), "items": F.concat("items", none(F.col("__items"), "array<long>"))})
        found = append_arrow(both.select(*docs.columns, "n_words", "runs", "items"), _merge, f"{_RUNS}, items array<long>")
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["first"])
    spans = F.transform("runs", lambda r: F.struct(r["char_start"].alias("start"), r["char_end"].alias("end")))
    return found.select(*docs.columns, "n_words", n_hit.alias("n_hit"), "items", spans.alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
met AS (SELECT p.doc_id, p.n, p.k, i.item_id FROM places p JOIN wins i ON i.n = p.n AND i.win = p.win),
hit AS (SELECT doc_id, count(DISTINCT k + d) AS n_hit FROM (SELECT DISTINCT doc_id, k, unnest(range(0, n)) AS d FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
