"""Secret scans: base patterns, and random strings told from identifiers by character Markov models.

Two first-order character models, of random strings and of ordinary identifiers, are trained from labelled samples.
A candidate is a run of ``MIN_LENGTH`` or more token characters that touches no non-ASCII letter and no base span; punctuation and
digits of any script may touch it, and so may letters of scripts written without spaces (ideographs, kana, Hangul, Thai), which end a token. It is a
finding ("random") if the log likelihood ratio of the two models is over ``MIN_RATIO`` nats a character.

The samples: random strings are drawn from usual key alphabets by a fixed seed; ordinary ones are words of at most ``SAMPLE`` documents labelled as
good, in whatever languages these have, alone and composed as compounds and identifiers are, and identifiers composed from a word list, and
rulers, dates and the like. Accents are taken off for this, as identifiers are written without.

Scale: one narrow pass over whole texts without a shuffle; the models are two tables of a few thousand numbers.

Edge cases: a null text is empty; offsets are code points, ends exclusive; within a kind, base matches are leftmost and do not
overlap, and a match that is too short is dropped after it has consumed its characters; repeated rows are each scanned;
columns with a result's name give way to it.
"""

from __future__ import annotations

import random
import re
import string
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import append_arrow, sampled_texts, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ["assign", "access", "hex", "random"]
ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
MIN_LENGTH = 20
MIN_RATIO = 0.25
#: Documents and words of the ordinary sample.
SAMPLE, SAMPLE_WORDS, DRAWN = 300, 20_000, 4_000


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
#: Letters that never continue a token, and marks that belong to the letter before them.
_APART, _MARKS = "\u0e00-\u0e7f\u1100-\u11ff\u3005-\u3007\u3040-\u30ff\u3130-\u318f\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff", "\u0300-\u036f"
_CHARS = r"A-Za-z0-9+/_.=-"
_TOKEN = re.compile(rf"(?:(?<![^\W\d_])|(?<=[{_APART}]))(?<![{_MARKS}{_CHARS}])[{_CHARS}]{{{MIN_LENGTH},}}(?![{_MARKS}{_CHARS}])(?:(?![^\W\d_])|(?=[{_APART}]))")
_HINTS = ("password", "passwd", "secret", "token", "api")
_CODES = np.full(128, len(ALPHABET), np.int64)
_CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

_WORDS = "account active address array batch buffer button cache client column config content context count create current customer data default delete description device document element error event export field file filter folder format function group handler header image import index input invoice item label language layout length level list loader location manager message method model module name network number object option order output package page parent password path payment position process product profile project property query queue record reference region request response result return sample schema script section select server service session setting source start state status stream string style summary table target template text thread time title token total type update upload user value version view widget window worker".split()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in any order."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def random_strings(n: int, seed: int) -> list[str]:
    """Labelled samples of random keys: hex, base64, alphanumeric and upper-case ones."""
    draw = random.Random(seed)
    kinds = ["0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "_-"]
    return ["".join(draw.choices(kinds[k % len(kinds)], k=draw.randint(20, 64))) for k in range(n)]


def identifiers(n: int, seed: int, known: list[str] | None = None) -> list[str]:
    """Labelled samples of ordinary identifiers: words in snake, kebab, camel, dotted, constant, path and compound style."""
    draw = random.Random(seed)
    known = known or _WORDS
    out = []
    for k in range(n):
        words = draw.choices(known, k=draw.randint(3, 7))
        number = str(draw.randint(0, 2030)) if draw.random() < 0.3 else ""
        style = k % 7
        text = ["_".join(words), "-".join(words), words[0] + "".join(w.title() for w in words[1:]), ".".join(words), "_".join(words).upper(), "/".join(words), "".join(words)][style]
        out.append(text + (("_" if style in (0, 4) else "") + number if number else ""))
    return out


def marks(n: int, seed: int) -> list[str]:
    """Labelled samples of ordinary strings that are not words: rulers, dates, versions, alphabets in order."""
    draw = random.Random(seed)
    day = lambda: f"{draw.randint(1970, 2040)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}"
    ruled = ALPHABET + 10 * "+/_.=-"
    series = [string.ascii_lowercase, string.ascii_uppercase, string.digits * 4]
    kinds = [
        lambda: ruled[k // len(kinds) % len(ruled)] * draw.randint(20, 80),
        lambda: draw.choice("/.-").join(day() for _ in range(draw.randint(2, 3))),
        lambda: f"{day()}T{draw.randint(0, 23):02}.{draw.randint(0, 59):02}.{draw.randint(0, 59):02}/{day()}",
        lambda: ".".join(str(draw.randint(0, 40)) for _ in range(draw.randint(8, 12))),
        lambda: draw.choice(series)[draw.randint(0, 5) :],
    ]
    out = []
    for k in range(n):
        out.append(kinds[k % len(kinds)]())
    return out


def _codes(text: str) -> np.ndarray:
    return _CODES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def train_models(rand: list[str], plain: list[str]) -> np.ndarray:
    """Log likelihood ratios (from, to) of random over plain; row and column len(ALPHABET) are the outside."""
    n = len(ALPHABET) + 1
    logs = []
    for samples in (rand, plain):
        counts = np.full((n, n), 0.1)
        for text in samples:
            c = np.concatenate(([n - 1], _codes(text)))
            np.add.at(counts, (c[:-1], c[1:]), 1)
        first = counts.sum(0)
        smooth = counts + 5.0 * first[None, :] / first.sum()  # unseen rows lean on the single characters
        logs.append(np.log(smooth / smooth.sum(1, keepdims=True)))
    return logs[0] - logs[1]


def ratio(text: str, model: np.ndarray) -> float:
    """Nats a character by which text is likelier random than ordinary."""
    c = np.concatenate(([len(ALPHABET)], _codes(text)))
    return float(model[c[:-1], c[1:]].mean())


def all_spans(text: str, model: np.ndarray, min_ratio: float = MIN_RATIO) -> list[tuple[int, int, str]]:
    """Base and random spans by start, then kind."""
    found = base_spans(text)
    base = list(found)
    for m in _TOKEN.finditer(text):
        token = m[0].strip(".-")
        start = m.start() + m[0].index(token) if token else m.start()
        end = start + len(token)
        if len(token) >= MIN_LENGTH and not any(a < end and start < b for a, b, _ in base) and ratio(token, model) > min_ratio:
            found.append((start, end, "random"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def plain_words(text: str) -> list[str]:
    """The words of a text that can serve as ordinary samples: base spans left out, accents taken off, letters alone."""
    for start, end, _ in sorted(base_spans(text), reverse=True):
        text = text[:start] + " " + text[end:]
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss")) if not unicodedata.combining(c))
    return re.findall(r"(?<!\S)[A-Za-z]{3,}(?![^\s.,;:!?])", bare)


def ordinary_words(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, n_docs: int, n_words: int) -> list[str]:
    """Words of a bounded sample of documents labelled good, at most n_words, as many of each document."""
    ids = labels.where("quality = 1").select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(n_docs)
    found = [plain_words(r["text"] or "") for r in sampled_texts(docs, ids, id_col, text_col)]
    each = max(1, n_words // max(1, len(found)))
    return [w for words in found for w in words[:each]][:n_words]


def build_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The models' log likelihood ratios, trained from the corpus's words and from composed samples."""
    words = ordinary_words(docs, labels, id_col, text_col, SAMPLE, SAMPLE_WORDS)
    plain = identifiers(DRAWN, 5) + marks(DRAWN // 4, 8) + words + (identifiers(DRAWN, 6, words) if words else [])
    return train_models(random_strings(DRAWN, 7), plain)


def scan_secrets(docs: DataFrame, model: np.ndarray, text_col: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """docs plus secrets: array of (kind, start, end), by start and kind."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        spans = [[{"kind": k, "start": a, "end": b} for a, b, k in all_spans(t.as_py() or "", model, min_ratio)] for t in batch.column(batch.schema.get_field_index(text_col))]
        return [pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

    return append_arrow(docs, run, "secrets array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, spans_col: str = "secrets", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace each merged span of spans_col by mark."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for t, spans in zip(batch.column(batch.schema.get_field_index(text_col)), batch.column(batch.schema.get_field_index(spans_col)), strict=True):
            text, at, parts = t.as_py(), 0, []
            for s in spans.as_py() or []:
                if s["end"] <= at:
                    continue
                if s["start"] >= at:
                    parts += [text[at : s["start"]], mark]
                at = s["end"]
            out.append(None if text is None else "".join(parts) + text[at:])
        return [pa.array(out, pa.string())]

    return append_arrow(docs, run, f"{text_col} string")


def query_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the base rule alone."""
    return query(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, build_model(docs, table(spark, sf_dir, "labels")))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("secrets")).alias("spans"))


def _places(kind: int, name: str, pattern: str, least: int, group: int = 0) -> str:
    """SQL for the spans of a pattern: matches, and where they start, from the lengths of what lies between them."""
    return f"""
  SELECT doc_id, {kind} AS k, '{name}' AS kind, list_sum([length(x) FOR x IN parts[:i]]) + coalesce(list_sum([length(x) FOR x IN met[:i - 1]]), 0) AS start, length(met[i]) AS size
  FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS parts, regexp_extract_all(text, '{pattern}') AS met, regexp_extract_all(text, '{pattern}', {group}) AS held, unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS i FROM docs)
  WHERE length(held[i]) >= {least}"""


_QUOTES = """["'']?"""
_SQL_ASSIGN = f"({_NAMES}){_QUOTES}\\x20*[:=]\\x20*{_QUOTES}([A-Za-z0-9+/_.=-]+)"
#: The base rule's columns.
ORACLE_BASE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_places(0, 'assign', _SQL_ASSIGN, 6, 2)} UNION ALL {_places(1, 'access', 'AKIA[A-Z0-9]+', 20)} UNION ALL {_places(2, 'hex', '[0-9a-f]{24,}', 24)}),
told AS (
  SELECT doc_id, count_if(k = 0) AS a, count_if(k = 1) AS c, count_if(k = 2) AS h, string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, k) AS said FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(said, '')) AS base_sha256
FROM docs LEFT JOIN told USING (doc_id)
"""
