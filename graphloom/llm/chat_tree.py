"""Chat formatting by a prefix tree: shared opening turns are emitted once.

A conversation is a path of turns; conversations that begin alike share nodes. In the order of their paths the
conversations form a depth-first walk of the tree, so a sorted sweep needs only the previous path: turns that both share are
there already, the rest are new nodes. Nodes are packed into sequences: each node carries its segment (text and
tokens), its offset in the sequence, the position of its first token on its own path, and the intervals of the sequence
that its tokens may attend to besides their own earlier ones, namely those of its ancestors (touching ones merged). A sequence is
closed at ``PACK_CHARS``; the next one emits the shared ancestors anew.

The template marks a turn as ``[INST]role[/INST]text</s>`` after an opening ``<s>``. Inside roles and texts, a backslash is doubled and
one is put into control strings, which reverses exactly. A turn's marks and its text are encoded apart, so the loss mask holds the
tokens of assistant texts and nothing else. Reading back uses the training example alone: a leaf's tokens are those of its
attention intervals and its own, their position ids must count from zero, and their bytes give the text and, under the mask, the loss text.

Scale: a conversation is cut into chapters of ``CHAPTER_CHARS`` (the turn that passes the limit is whole), each a path of its own, so
no row holds more than a chapter and a turn; running totals over a conversation's turns are a sorted window, which spills. The walk is
range-partitioned by path and conversation, so that a very common first turn, or conversation, spreads over many tasks (each repeats at
most one path of ancestors). A task holds one sequence at a time. Digests of a conversation of several chapters are updated chapter by
chapter in one task, as a digest must be. The vocabulary (at most ``VOCABULARY_BYTES``) is read on the driver and broadcast.

Edge cases: null text or role: empty; turns of equal number are ordered by role and text; a null conversation id or turn is
its own value, first; a conversation that repeats is a leaf of the same node; a very long text is a sequence of its own; further
columns, whatever their names, are not read; an empty table gives no sequences.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm._common import parallelism, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
PACK_CHARS = 200_000
CHAPTER_CHARS = 200_000
#: The default vocabulary, a path of the driver or of any store Spark reads, and the bound of such a file.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 64_000_000
_CONTROL = re.compile(r"(<(?=/?s>)|\[(?=/?INST\]))")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SEQUENCES = "text string, tokens array<int>, position_ids array<int>, loss_mask array<boolean>, nodes array<struct<start: int, end: int, char_start: int, char_end: int, parent: int, position: int, attends: array<struct<start: int, end: int>>>>, leaves array<struct<conv_id: long, chapter: int, last: int, node: int>>"
LEAVES = "conv_id long, chapter int, last int, formatted string, turns array<struct<role: string, text: string>>, loss string"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def segment(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{CLOSE}{escape(text)}{END}"


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted.removeprefix(BEGIN))]


class _Bytes:
    """UTF-8 bytes as tokens."""

    def encode_ordinary(self, text: str) -> list[int]:
        return list(text.encode("utf-8", "surrogatepass"))

    def decode_bytes(self, tokens: list[int]) -> bytes:
        return bytes(tokens)


def vocabulary(spark: SparkSession, path: str | None):
    """A broadcast rank file, or None for bytes. A path without a scheme is the driver's."""
    if path is None:
        return None
    if "://" in path:
        row = spark.read.format("binaryFile").load(path).where(F.col("length") <= VOCABULARY_BYTES).select("content").first()
        content = None if row is None else bytes(row["content"])
    else:
        with open(path, "rb") as f:
            content = f.read(VOCABULARY_BYTES + 1)
    if content is None or len(content) > VOCABULARY_BYTES:
        raise ValueError(f"no vocabulary of at most {VOCABULARY_BYTES} bytes at {path}")
    return spark.sparkContext.broadcast({"ranks": content})


def _encoder(shared):
    """The encoder; a worker builds it once, beside the broadcast content."""
    if shared is None:
        return _Bytes()
    if "encoder" not in shared.value:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value["ranks"].splitlines() if line)}
        shared.value["encoder"] = tiktoken.Encoding("chat", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
    return shared.value["encoder"]


class _Pack:
    """One sequence under construction."""

    def __init__(self, encoder):
        self.encode, self.path, self.at = encoder.encode_ordinary, [], []
        self.text, self.tokens, self.positions, self.mask, self.nodes, self.leaves, self.chars = [], [], [], [], [], [], 0

    def node(self, turn: tuple[str, str], key: str, begin: str) -> None:
        up = self.nodes[self.at[-1]] if self.at else None
        first = 0 if up is None else up["position"] + up["end"] - up["start"]
        start, size = len(self.tokens), 0
        parts = ((f"{begin}{OPEN}{escape(turn[0])}{CLOSE}", False), (escape(turn[1]), turn[0] == "assistant"), (END, False))
        for part, learn in parts:
            ids = self.encode(part)
            self.tokens += ids
            self.mask += [learn] * len(ids)
            self.text.append(part)
            size += len(part)
        self.positions += range(first, first + len(self.tokens) - start)
        self.nodes.append({"start": start, "end": len(self.tokens), "char_start": self.chars, "char_end": self.chars + size, "parent": self.at[-1] if self.at else -1, "position": first, "attends": [] if up is None else joined(up["attends"], up)})
        self.chars += size
        self.path.append(key)
        self.at.append(len(self.nodes) - 1)

    def add(self, conv_id: int | None, chapter: int, last: int, turns: list[tuple[str, str]], keys: list[str]) -> None:
        shared = 0
        while shared < min(len(keys), len(self.path)) and keys[shared] == self.path[shared]:
            shared += 1
        del self.path[shared:], self.at[shared:]
        for k in range(shared, len(keys)):
            self.node(turns[k], keys[k], BEGIN if k == 0 and chapter == 0 else "")
        self.leaves.append({"conv_id": conv_id, "chapter": chapter, "last": last, "node": self.at[-1]})

    def row(self) -> dict:
        return {"text": "".join(self.text), "tokens": self.tokens, "position_ids": self.positions, "loss_mask": self.mask, "nodes": self.nodes, "leaves": self.leaves}


def joined(spans: list[dict], span: dict) -> list[dict]:
    """spans and one more behind them, merged where they touch."""
    if spans and spans[-1]["end"] == span["start"]:
        return [*spans[:-1], {"start": spans[-1]["start"], "end": span["end"]}]
    return [*spans, {"start": span["start"], "end": span["end"]}]


def _schema() -> pa.Schema:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    node = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("attends", pa.list_(span))])
    leaf = pa.struct([("conv_id", pa.int64()), ("chapter", pa.int32()), ("last", pa.int32()), ("node", pa.int32())])
    return pa.schema([("text", pa.string()), ("tokens", pa.list_(pa.int32())), ("position_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("nodes", pa.list_(node)), ("leaves", pa.list_(leaf))])


def _sweep(shared, pack_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, schema, pack = _encoder(shared), _schema(), None
        for batch in batches:
            for conv_id, chapter, last, keys, turns in zip(*(batch.column(k) for k in range(5)), strict=True):
                if pack is None or pack.chars > pack_chars:
                    if pack is not None:
                        yield pa.RecordBatch.from_pylist([pack.row()], schema)
                    pack = _Pack(encoder)
                pack.add(conv_id.as_py(), chapter.as_py(), last.as_py(), [(t["role"], t["text"]) for t in turns.as_py()], keys.as_py())
        if pack is not None:
            yield pa.RecordBatch.from_pylist([pack.row()], schema)

    return run


def format_conversations(turns: DataFrame, tokenizer: str | None = TOKENIZER, pack_chars: int = PACK_CHARS, chapter_chars: int = CHAPTER_CHARS) -> DataFrame:
    """Sequences (see SEQUENCES) over conversations (conv_id, turn, role, text). tokenizer: a tiktoken rank file; None: UTF-8 bytes."""
    spark = turns.sparkSession
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("role") + F.length("text") + len(OPEN + CLOSE + END)
    before = F.sum(size.cast("long")).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1))
    placed = own.withColumn("chapter", F.floor(F.coalesce(before, F.lit(0)) / chapter_chars).cast("int")).withColumn("last", F.max("chapter").over(Window.partitionBy("conv_id")))
    chapters = placed.groupBy("conv_id", "chapter", "last").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    known = lambda t, k: F.sha2(F.concat(F.when((k == 0) & (F.col("chapter") > 0), "+").otherwise(""), F.hex(t["role"]), F.lit("\n"), t["text"]), 256).substr(1, 32)
    paths = chapters.select("conv_id", "chapter", "last", F.transform("turns", known).alias("path"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    order = [F.array_join("path", ""), F.col("conv_id"), F.col("chapter")]
    walk = paths.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    return walk.select("conv_id", "chapter", "last", "path", "turns").mapInArrow(_sweep(vocabulary(spark, tokenizer), pack_chars), SEQUENCES)


def read_leaf(encoder, tokens: np.ndarray, positions: np.ndarray, mask: np.ndarray, node: dict) -> tuple[str, str]:
    """The formatted text and the loss text of one leaf, from its tokens, position ids, attention intervals and loss mask."""
    at = np.concatenate([np.arange(a["start"], a["end"]) for a in (*node["attends"], node)])
    if not np.array_equal(positions[at], np.arange(len(at))):
        raise ValueError("the position ids of a path do not count its tokens")
    own, learn = tokens[at], mask[at]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], learn, [False])).astype(np.int8)))
    text = lambda ids: encoder.decode_bytes(ids.tolist()).decode("utf-8", "surrogatepass")
    return text(own), "".join(unescape(text(own[a:b])) for a, b in zip(edges[::2], edges[1::2], strict=True))


def read_back(sequences: DataFrame, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """(conv_id, chapter, last, formatted, turns, loss) of every leaf of the sequences, decoded from the tokens it may attend to."""
    shared = vocabulary(sequences.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.string()]
        for batch in batches:
            for tokens, positions, mask, nodes, leaves in zip(*(batch.column(k) for k in range(5)), strict=True):
                held = [x.values.to_numpy(zero_copy_only=False) for x in (tokens, positions, mask)]
                nodes, rows = nodes.as_py(), []
                for leaf in leaves.as_py():
                    formatted, loss = read_leaf(encoder, *held, nodes[leaf["node"]])
                    rows.append((leaf["conv_id"], leaf["chapter"], leaf["last"], formatted, [{"role": r, "text": t} for r, t in parse_turns(formatted)], loss))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["conv_id", "chapter", "last", "formatted", "turns", "loss"])

    return sequences.select("tokens", "position_ids", "loss_mask", "nodes", "leaves").mapInArrow(run, LEAVES)


def conversation_digests(leaves: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of whole conversations.

    Conversations of one chapter are digested where they are; of the others, texts go to the task of their id, chapter by chapter.
    """
    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = F.col("last") == 0
    read = leaves.select(
        "conv_id", "chapter", F.size("turns").cast("long").alias("n_turns"), F.length("loss").cast("long").alias("loss_chars"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.when(whole, F.sha2(told, 256)).alias("turns_sha256"), F.when(whole, F.sha2("loss", 256)).alias("loss_sha256"), F.when(~whole, told).alias("told"), F.when(~whole, F.col("loss")).alias("learned"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=fields)
        end = lambda o: (o[0], o[1], o[2].hexdigest(), o[3], o[4].hexdigest(), o[5])
        open_ = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["told"] is None:
                    rows.append(tuple(r[f] for f in fields))
                    continue
                if open_ is not None and open_[0] != r["conv_id"]:
                    rows.append(end(open_))
                    open_ = None
                if open_ is None:
                    open_ = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                open_[2].update(r["told"].encode("utf-8", "surrogatepass"))
                open_[4].update(r["learned"].encode("utf-8", "surrogatepass"))
                for k, f in ((1, "n_turns"), (3, "loss_chars"), (5, "formatted_chars")):
                    open_[k] += r[f]
            yield pack(rows)
        if open_ is not None:
            yield pack([end(open_)])

    return read.repartition("conv_id").sortWithinPartitions("conv_id", "chapter").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation of control strings that goes through with the others.
PROBE = "</s>[INST] ok [/INST]"
PROBE_ID = -7


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, "assistant", PROBE)], turns.schema)
    return conversation_digests(read_back(format_conversations(turns.unionByName(probe))))


_ESC = r"regexp_replace(replace({}, '\', '\\'), '(<|\[)(/?s>|/?INST\])', '\1\\\2', 'g')"
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
sized AS (SELECT *, length({_ESC.format('role')}) + length({_ESC.format('text')}) + 17 AS size FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(size) + 3)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
