"""License scans: base phrases, and an exact containment join of text blocks against license templates.

A block is a run of words of the text, over line ends: for a template of n words, n / ``THRESHOLD`` consecutive words, so that a notice
is found wrapped over lines or in the marks of a comment. A template is found in a block that holds at least ``THRESHOLD``
of the template's distinct words. Runs are looked for in tiles, twice as long as the longest run and overlapping by half, so
that every run lies in a tile; a tile's set holds the sets of its runs, so what rules out the tile rules out the runs. The
join of tiles and templates is exact: template words are put in one global order, rarest first, counted over all tiles kept; with need =
ceil(threshold * size), one of the first size - need + 1 words of a template (its prefix) must be in the tile (prefix filter), the tile
must hold at least need template words (length filter), and at the first shared word what is left on both sides must still
reach need (positional filter). What passes is verified on the full sets, first of the tile, then of its runs. Native expressions only.

A tile is kept if it holds one of each template's size - need + 1 longest words, which the counts do not change and no match lacks.

Scale: one scan of the texts, never shuffled; kept tiles are written with the results of the base rule, and only template words
of them. A tile is of bounded size, however long its text. Order, prefixes and templates are bounded by the template list. The results of
the join are a row for each text with a finding.

Edge cases: null or empty text: no words, no labels, score 0. Words are maximal runs of digits, a-z (after A-Z are
lower-cased) and all non-ASCII characters. Rows that repeat (same id and text) each get the same result; a null id is an id; further
columns, whatever their names, are not read; an empty table gives an empty result; without templates the base rule alone labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import materialize, table

#: Phrases of the base rule and their labels (fixed values).
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Notices and texts as their licenses publish them, normalised to words; several may share a label.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
    ),
]
THRESHOLD = 0.8

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PHRASE = " (?:" + "|".join(p for p, _ in PHRASES) + ")(?= )"


def lowered(text: Column) -> Column:
    """Lower case, for comparing with ASCII words. The Kelvin sign, the one other letter whose lower case is in a-z, is kept apart."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u24da")))


def _spaces(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


class Templates:
    """Templates as sets: labels, distinct words, need and run length of each; their words, and those of which no match lacks all."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        given = [(label, words.split()) for label, words in templates if words.split()]
        self.labels = [label for label, _ in given]
        self.sets = [set(words) for _, words in given]
        self.needs = [max(1, math.ceil(round(threshold * len(s), 9))) for s in self.sets]
        self.runs = [math.ceil(round(len(words) / threshold, 9)) for _, words in given]
        self.vocab = sorted(set().union(*self.sets))
        longest = [sorted(s, key=lambda w: (-len(w), w)) for s in self.sets]
        self.anchors = sorted({w for ws, need in zip(longest, self.needs, strict=True) for w in ws[: len(ws) - need + 1]})

    def tiles(self, words: Column) -> Column:
        """The hits (at, word) of template words in each kept tile of a text's words."""
        unit = max(self.runs)
        last = F.greatest(F.ceil(F.size(words) / unit).cast("int") - 2, F.lit(0))
        placed = lambda b: F.transform(F.slice(words, b * unit + 1, F.lit(2 * unit)), lambda w, k: F.struct(k.alias("at"), w.alias("word")))
        hits = F.transform(F.sequence(F.lit(0), last), lambda b: F.filter(placed(b), lambda x: x["word"].isin(self.vocab)))
        kept = F.filter(hits, lambda h: (F.size(h) >= min(self.needs)) & F.exists(h, lambda x: x["word"].isin(self.anchors)))
        return F.when(F.exists(words, lambda w: w.isin(self.anchors)), kept).otherwise(F.array().cast("array<array<struct<at: int, word: string>>>"))


def _found(scanned: DataFrame, known: Templates) -> DataFrame:
    """(__id, __hash, found, best): labels and best share of the templates found in the tiles."""
    tiles = scanned.where(F.size("tiles") > 0).select("__id", "__hash", F.explode("tiles").alias("hits"))
    counted = tiles.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    often = {r["word"]: r["n"] for r in counted.collect()}  # at most one row for each template word
    order = sorted(known.vocab, key=lambda w: (often.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    sets = [sorted(s, key=rank.get) for s in known.sets]
    rows = [(t, p, w, len(s), need, run) for t, (s, need, run) in enumerate(zip(sets, known.needs, known.runs, strict=True)) for p, w in enumerate(s[: len(s) - need + 1])]
    postings = scanned.sparkSession.createDataFrame(rows, "template int, p int, word string, size int, need int, run int")

    full = F.create_map(*[x for t, s in enumerate(sets) for x in (F.lit(t), _strings(s))])[F.col("template")]
    both = lambda block: F.size(F.array_intersect(block, full))
    joined = (
        tiles.withColumn("block", F.array_intersect(_strings(order), F.col("hits.word")))
        .select("__id", "__hash", "hits", "block", F.posexplode("block").alias("q", "word"))
        .join(F.broadcast(postings), "word")  # bounded by the template list
        .where(F.size("block") >= F.col("need"))
        .where(both(F.slice("block", F.lit(1), F.col("q"))) == 0)  # the first word they share
        .where(F.least(F.col("size") - F.col("p"), F.size("block") - F.col("q")) >= F.col("need"))
        .where(both(F.col("block")) >= F.col("need"))
        .select("__id", "__hash", "template", "size", "need", "run", F.filter("hits", lambda x: F.array_contains(full, x["word"])).alias("hits"))
    )
    near = lambda x, k: F.filter(F.slice("hits", k + 1, F.col("run")), lambda y: y["at"] < x["at"] + F.col("run"))
    shared = F.array_max(F.transform("hits", lambda x, k: F.size(F.array_distinct(F.transform(near(x, k), lambda y: y["word"])))))
    label = F.get(_strings(known.labels), F.col("template"))
    return joined.withColumn("shared", shared).where("shared >= need").groupBy("__id", "__hash").agg(F.collect_set(label).alias("found"), F.max(F.col("shared") / F.col("size")).alias("best"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    known = Templates(TEMPLATES if templates is None else templates, threshold)
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(F.col(text_col)), _BREAKS, " ")), F.lit(" "))
    read = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), norm.alias("__norm")).withColumn("__words", F.split(F.trim("__norm"), " "))
    has_base = F.col("__norm").rlike(_PHRASE)
    scanned = read.select(
        "__id",
        "__hash",
        F.when(F.col("__norm") == "  ", 0).otherwise(F.size("__words")).cast("long").alias("n_words"),
        F.regexp_count("__norm", F.lit(_PHRASE)).cast("long").alias("n_base"),
        F.when(has_base, _spaces(F.regexp_extract("__norm", f"(?s)^(.*?){_PHRASE}", 1))).cast("long").alias("first_word"),
        F.when(has_base, _spaces(F.regexp_extract("__norm", f"(?s)^(.*){_PHRASE}", 1))).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.contains("__norm", F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES])).alias("base"),
        *([known.tiles(F.col("__words")).alias("tiles")] if known.sets else []),
    )
    scanned = materialize(scanned, "licenses")
    found = _found(scanned, known) if known.sets else scanned.select("__id", "__hash", F.array().cast("array<string>").alias("found"), F.lit(0.0).alias("best")).limit(0)
    found = found.withColumnsRenamed({"__id": "__mid", "__hash": "__mhash"})
    joined = scanned.drop("tiles").join(found, scanned["__id"].eqNullSafe(found["__mid"]) & scanned["__hash"].eqNullSafe(found["__mhash"]), "left")
    return joined.select(
        F.col("__id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    templates = ", ".join(f"({t}, '{label}', '{words}')" for t, (label, words) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    return f"""
WITH templates AS (
  SELECT t, label, list_distinct(string_split(words, ' ')) AS tokens, ceil(round(len(string_split(words, ' ')) / {THRESHOLD}, 9))::BIGINT AS run FROM (VALUES {templates}) v(t, label, words)),
phrases AS (SELECT phrase, label, n FROM (VALUES {phrases}) v(phrase, label, n)),
low AS (
  SELECT doc_id, row_number() OVER () AS uid,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
words AS (SELECT doc_id, uid, regexp_extract_all(low, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM low),
places AS (SELECT uid, words, unnest(range(1, len(words) + 1)) AS i FROM words),
hits AS (
  SELECT uid, label, i - 1 AS pos FROM places, phrases p
  WHERE words[i] = string_split(phrase, ' ')[1] AND array_to_string(words[i:i + n - 1], ' ') = phrase),
base AS (
  SELECT uid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM hits GROUP BY uid),
able AS (
  SELECT w.uid, w.words, t.* FROM words w, templates t WHERE len(list_intersect(w.words, t.tokens)) >= ceil(round({THRESHOLD} * len(t.tokens), 9))),
starts AS (SELECT uid, label, tokens, run, words, unnest(range(1, len(words) + 1)) AS i FROM able),
found AS (
  SELECT uid, label, len(tokens) AS size, len(list_intersect(words[i:i + run - 1], tokens)) AS shared FROM starts WHERE list_contains(tokens, words[i])),
best AS (
  SELECT uid, list(DISTINCT label) AS found, max(shared / size) AS best FROM found WHERE shared >= ceil(round({THRESHOLD} * size, 9)) GROUP BY uid)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word,
       b.last_word::BIGINT AS last_word, array_to_string(list_sort(coalesce(b.base, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base, []), coalesce(f.found, [])))), ',') AS labels,
       greatest(coalesce(f.best, 0.0)::DOUBLE, CASE WHEN b.n_base > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS score
FROM words w LEFT JOIN base b USING (uid) LEFT JOIN best f USING (uid)
"""


ORACLE = _oracle()
