"""Quality rules: base counts, and line labels from a linear-chain conditional random field.

Lines with a word are labelled content or boilerplate by Viterbi decoding; a text is kept if its content lines hold
at least ``CONTENT_SHARE`` of its words and the base rule passes it. The field is trained here by gradient ascent on
the conditional likelihood (forward-backward) from at most ``SAMPLE`` labelled documents of each class (the smallest by a
hash of the id): the lines of a quality-1 document are content, of a quality-0 document boilerplate. So that chains with both labels are seen,
documents of the two classes are also spliced: one before the other, behind it, or in its middle.

Scale: one narrow pass over whole texts without a shuffle; the sample has a fixed bound, and the model is a few dozen
numbers.

Edge cases: a null or blank text has no words and fails the base rule; without labels of both classes the field
is not trained, and the base rule alone decides; repeated rows are each judged; columns with a result's name give
way to it.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import append_arrow, sampled_texts, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CONTENT_SHARE = 0.5
#: Bound of the training sample, for each class.
SAMPLE = 300
EPOCHS = 80
RATE = 0.3
L2 = 1e-3
CONTENT, BOILERPLATE = 1, 0
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
FEATURES = ["bias", "symbols", "capitals", "digits", "bars", "exclaims", "short", "stops", "again", "repeats", "stutter", "long_words", "commas"]
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS_B, _DIGITS = SYMBOLS.encode(), b"0123456789"


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    pair = ids[:-2] * n + ids[1:-1]
    if n >= 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair * n + ids[2:]
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    found = np.isin(code, twice)
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= found
    return int(hit.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines, len(FEATURES)) of the lines with a word, and their numbers of words."""
    rows, sizes, seen = [], [], set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if not words:
            continue
        n = len(words)
        chars = sum(map(len, words))
        counted = lambda what: chars - len(b"".join(words).translate(None, what))  # noqa: B023, E731
        rows.append(
            (
                1.0,
                min(1.0, 5 * counted(_SYMBOLS_B) / chars),
                min(1.0, 1.5 * counted(_CAPITALS) / chars),
                min(1.0, 3 * counted(_DIGITS) / chars),
                min(1.0, 2 * words.count(b"|") / n),
                min(1.0, line.count(b"!") / n),
                float(n <= 2),
                float(words[-1][-1:] in b".?!"),
                float(line in seen),
                1 - len(set(words)) / n if n >= 8 else 0.0,
                sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
                float(chars / n > 14),
                min(1.0, 5 * line.count(b",") / n),
            )
        )
        seen.add(line)
        sizes.append(n)
    return np.array(rows, float).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def chain_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of labels y (b, n) for chains of one length x (b, n, f), summed over chains, and its gradients by the
    emission weights w (2, f) and the transitions t (2, 2)."""
    e = x @ w.T
    m, n = y.shape
    a, b = np.empty((m, n, 2)), np.zeros((m, n, 2))
    a[:, 0] = e[:, 0]
    for k in range(1, n):
        a[:, k] = e[:, k] + _log_sum(a[:, k - 1, :, None] + t, 1)
    for k in range(n - 2, -1, -1):
        b[:, k] = _log_sum(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2)
    z = _log_sum(a[:, -1], 1)
    p = np.exp(a + b - z[:, None, None])
    gw = np.stack([np.einsum("bn,bnf->f", (y == label) - p[:, :, label], x) for label in (0, 1)])
    gt = np.zeros((2, 2))
    score = np.take_along_axis(e, y[:, :, None], 2).sum() - z.sum()
    if n > 1:
        gt -= np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        np.add.at(gt, (y[:, :-1], y[:, 1:]), 1)
        score += t[y[:, :-1], y[:, 1:]].sum()
    return float(score), gw, gt


def spliced(lines: list[tuple[list[str], list[int]]]) -> list[tuple[list[str], list[int]]]:
    """Chains of both labels: the k-th document of a class before, behind or in the middle of the k-th of the other."""
    of = lambda label: [c for c in lines if c[1][0] == label]
    out = []
    for k, (good, bad) in enumerate(zip(of(CONTENT), of(BOILERPLATE), strict=False)):
        host, guest = (good, bad) if k % 2 else (bad, good)
        at = (0, len(host[0]) // 2, len(host[0]))[k % 3]
        out.append(tuple(h[:at] + g + h[at:] for h, g in zip(host, guest, strict=True)))
    return out


def train_field(labelled: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and transitions from (text, label) samples; None unless both labels are there."""
    lines = [([x for x in text.split("\n") if x.strip(BLANKS)], label) for text, label in labelled if text]
    lines = [(x, [label] * len(x)) for x, label in lines if x]
    if len({y[0] for _, y in lines}) < 2:
        return None
    chains = [(line_features("\n".join(x))[0], np.array(y)) for x, y in lines + spliced(lines)]
    lengths = sorted({len(y) for _, y in chains})
    groups = [[c for c in chains if len(c[1]) == n] for n in lengths]
    batches = [(np.stack([x for x, _ in g]), np.stack([y for _, y in g])) for g in groups]
    w, t = np.zeros((2, len(FEATURES))), np.zeros((2, 2))
    sums = [np.zeros_like(w), np.zeros_like(t)]
    for _ in range(EPOCHS):
        gw, gt = -L2 * len(chains) * w, -L2 * len(chains) * t
        for x, y in batches:
            _, dw, dt = chain_gradient(x, y, w, t)
            gw += dw / y.shape[1]  # each document weighs the same
            gt += dt / y.shape[1]
        for v, g, s in ((w, gw, sums[0]), (t, gt, sums[1])):
            s += g * g
            v += RATE * g / np.sqrt(s + 1e-9)
    return w, t


def viterbi(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The best label sequence for emissions e (n, 2) and transitions t; ties go to content."""
    (t00, t01), (t10, t11) = t.tolist()
    s0, s1 = e[0].tolist()
    back = []
    for e0, e1 in e[1:].tolist():
        from0, from1 = s1 + t10 >= s0 + t00, s1 + t11 >= s0 + t01
        back.append((from0, from1))
        s0, s1 = (s1 + t10 if from0 else s0 + t00) + e0, (s1 + t11 if from1 else s0 + t01) + e1
    label = int(s1 >= s0)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return np.array(out[::-1])


def content_share(text: str, model: tuple[np.ndarray, np.ndarray]) -> float:
    x, sizes = line_features(text)
    if not len(x):
        return 0.0
    return float(sizes[viterbi(x @ model[0].T, model[1]) == CONTENT].sum() / sizes.sum())


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    parts = []
    for label in (0, 1):
        part = labels.where(F.col(label_col) == label).select(F.col(id_col).alias("id"), F.lit(label).alias("label")).where("id IS NOT NULL").distinct()
        parts.append(part.orderBy(F.xxhash64("id"), "id").limit(per_class))
    return [(r["text"], r["label"]) for r in sampled_texts(docs, parts[0].unionByName(parts[1]), id_col, text_col)]


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE, min_share: float = CONTENT_SHARE) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept."""
    model = train_field(labelled_sample(docs, labels, per_class, id_col, text_col, label_col))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for text in batch.column(batch.schema.get_field_index(text_col)):
            text = text.as_py()
            counts = base_counts(text)
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
            share = None if model is None or not counts[0] else content_share(text, model)
            rows.append((*counts, failed, share, not failed and (share is None or share >= min_share)))
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

    return append_arrow(docs, run, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def query_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the base rule alone."""
    return query(spark, sf_dir).drop("content_share", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, table(spark, sf_dir, "labels")).drop("text")


#: The base rule's columns.
ORACLE_BASE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
again AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
wins AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
hit AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS d FROM twice) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
       coalesce(a.n, 0)::BIGINT AS n_dup_lines, coalesce(h.n, 0)::BIGINT AS n_repeat_words, len(w) < {MIN_WORDS} OR 100 * coalesce(h.n, 0) > {MAX_REPEAT_PERCENT} * len(w) AS base_failed
FROM docs d LEFT JOIN again a USING (doc_id) LEFT JOIN hit h USING (doc_id)
"""
