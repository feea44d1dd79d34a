"""RDF sources and sinks: N-Triples and N-Quads in parallel by line, Turtle, TriG and RDF/XML by whole file."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import xml.etree.ElementTree as ET
from urllib.parse import urljoin

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.graph import QUADS, Graph
from graphloom.session import local_frame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Formats by file name ending, and by name (fixed values). Other endings mean Turtle; other names are errors.
EXTENSIONS = {"ttl": "turtle", "nt": "ntriples", "rdf": "rdfxml", "xml": "rdfxml", "owl": "rdfxml", "nq": "nquads", "trig": "trig"}
NAMES = {"turtle": "turtle", "ttl": "turtle", "ntriples": "ntriples", "nt": "ntriples", "rdfxml": "rdfxml", "rdf": "rdfxml", "xml": "rdfxml", "owl": "rdfxml", "nquads": "nquads", "nq": "nquads", "trig": "trig"}


class RdfError(ValueError):
    """Text that does not parse in its format."""


def detect_format(path: str) -> str:
    return EXTENSIONS.get(os.path.splitext(path)[1][1:].lower(), "turtle")


def format_by_name(name: str) -> str:
    if name.lower() not in NAMES:
        raise RdfError(f"unknown format {name!r}")
    return NAMES[name.lower()]


def sniff(content: str) -> str:
    """rdfxml or turtle, by how a text begins."""
    head = content.lstrip("﻿ \t\r\n")
    return "rdfxml" if head.startswith(("<?xml", "<rdf:RDF", "<!DOCTYPE", "<!--")) else "turtle"


# lines -------------------------------------------------------------------------------------------

_TERM = r'(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*{_TERM}\s*(<[^>]*>)\s*{_TERM}\s*(<[^>]*>|_:[^\s]+)?\s*\.\s*(?:#.*)?$"


def canonical(t):
    """A term column in canonical form: plain instead of xsd:string, lower-case language tags."""
    tail = T.tail_of(t)
    body = F.substr(t, F.lit(1), F.length(t) - F.length(tail))
    return F.when(~T.is_literal(t), t).when(tail == f"^^<{T.STRING}>", body).when(tail.startswith("@"), F.concat(body, F.lower(tail))).otherwise(t)


def read_ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(s, p, o, g) from N-Triples or N-Quads files, line by line. A line that does not parse raises, or is left out with strict=False."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    parts = lines.select("value", *[F.nullif(F.regexp_extract("value", _LINE, k), F.lit("")).alias(c) for k, c in ((1, "s"), (2, "p"), (3, "o"), (4, "g"))])
    if strict:
        bad = F.raise_error(F.concat(F.lit("not an N-Triples line: "), F.substring("value", 1, 200)))
        parts = parts.withColumn("s", F.when(F.col("s").isNull(), bad).otherwise(F.col("s")))
    return parts.where(F.col("s").isNotNull()).select("s", "p", canonical(F.col("o")).alias("o"), "g")


def write_ntriples(g: Graph, path: str) -> None:
    """The triples of all graphs as N-Triples text, without graph names."""
    g.all_triples.distinct().select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.text(path)


def write_nquads(g: Graph, path: str) -> None:
    g.quads.select(F.concat_ws(" ", "s", "p", "o", "g", F.lit(".")).alias("value")).write.text(path)


# Turtle and TriG ---------------------------------------------------------------------------------

_LEX = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)
  |(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  |(?P<str>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  |(?P<num>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)
  |(?P<pname>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  |(?P<word>[A-Za-z]+)
  |(?P<op>\^\^|[.;,()\[\]{}=])""",
    re.X | re.S,
)


class TurtleParser:
    """A Turtle and TriG parser to (s, p, o, g) rows. Blank labels are stable: a hash of the source name and their place."""

    def __init__(self, text: str, base: str | None = None, source: str = ""):
        self.text, self.base, self.rows = text, base or "", []
        self.scope = hashlib.sha256((source or text).encode("utf-8", "surrogatepass")).hexdigest()[:12]
        self.prefixes: dict[str, str] = {}
        self.tokens, self.k, self.fresh, self.graph = self._lex(), 0, 0, None

    def _lex(self):
        out, at = [], 0
        while at < len(self.text):
            m = _LEX.match(self.text, at)
            if not m:
                line = self.text.count("\n", 0, at) + 1
                raise RdfError(f"unexpected text in line {line}: {self.text[at : at + 30]!r}")
            if m.lastgroup != "ws":
                out.append((m.lastgroup, m[0], at))
            at = m.end()
        out.append(("end", "", at))
        return out

    def peek(self):
        return self.tokens[self.k][:2]

    def next(self):
        token = self.tokens[self.k]
        self.k += 1
        return token[:2]

    def accept(self, op):
        if self.peek() == ("op", op):
            self.k += 1
            return True
        return False

    def fail(self, what):
        line = self.text.count("\n", 0, self.tokens[min(self.k, len(self.tokens) - 1)][2]) + 1
        raise RdfError(f"expected {what} in line {line}, found {self.peek()[1]!r}")

    def expect(self, op):
        if not self.accept(op):
            self.fail(repr(op))

    def parse(self) -> list[tuple[str, str, str, str | None]]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            word = text.lower().lstrip("@")
            if kind in ("at", "word") and word in ("prefix", "base"):
                self.k += 1
                if word == "prefix":
                    name = self.next()[1]
                    self.prefixes[name[:-1]] = self.resolve(self.next()[1])
                else:
                    self.base = self.resolve(self.next()[1])
                if kind == "at":
                    self.expect(".")
            elif kind == "word" and word == "graph":
                self.k += 1
                self.graph_block(self.subject())
            elif (kind, text) == ("op", "{"):
                self.graph_block(None)
            else:
                s, listed = (self.subject(), False) if (kind, text) not in (("op", "["), ("op", "(")) else (self.object(), True)
                if self.peek() == ("op", "{"):
                    self.graph_block(s)
                    continue
                if not (listed and self.peek() == ("op", ".")):
                    self.predicates(s)
                self.expect(".")
        return self.rows

    def graph_block(self, name):
        self.expect("{")
        self.graph = name
        while not self.accept("}"):
            s = self.object() if self.peek() in (("op", "["), ("op", "(")) else self.subject()
            if self.peek() not in (("op", "."), ("op", "}")):
                self.predicates(s)
            if self.peek() != ("op", "}"):
                self.expect(".")
        self.graph = None
        self.accept(".")

    def resolve(self, bracketed):
        value = T.unescape(bracketed[1:-1])
        return urljoin(self.base, value) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) else value

    def iri(self):
        kind, text = self.next()
        if kind == "iri":
            return f"<{self.resolve(text)}>"
        if kind == "pname":
            prefix, _, rest = text.partition(":")
            if prefix not in self.prefixes:
                raise RdfError(f"unknown prefix {prefix!r}")
            return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', rest)}>"
        self.k -= 1
        self.fail("an IRI")

    def new_blank(self):
        self.fresh += 1
        return f"_:b{self.scope}x{self.fresh}"

    def subject(self):
        if self.peek()[0] == "blank":
            return f"_:n{self.scope}{self.next()[1][2:]}"
        return self.iri()

    def predicates(self, s):
        while True:
            p = T.TYPE if self.peek() == ("word", "a") else None
            if p:
                self.k += 1
            else:
                p = self.iri()
            while True:
                self.rows.append((s, p, self.object(), self.graph))
                if not self.accept(","):
                    break
            if not self.accept(";"):
                return
            while self.accept(";"):
                pass
            if self.peek() in (("op", "."), ("op", "]"), ("op", "}")):
                return

    def object(self):
        kind, text = self.peek()
        if self.accept("["):
            b = self.new_blank()
            if not self.accept("]"):
                self.predicates(b)
                self.expect("]")
            return b
        if self.accept("("):
            items = []
            while not self.accept(")"):
                items.append(self.object())
            cells = [self.new_blank() for _ in items] + [T.NIL]
            for k, x in enumerate(items):
                self.rows += [(cells[k], T.FIRST, x, self.graph), (cells[k], T.REST, cells[k + 1], self.graph)]
            return cells[0]
        if kind == "str":
            self.k += 1
            value = T.unescape(text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1])
            if self.peek()[0] == "at":
                return T.literal(value, lang=self.next()[1][1:])
            return T.literal(value, self.iri()[1:-1]) if self.accept("^^") else T.literal(value)
        if kind == "num":
            self.k += 1
            return T.literal(text, T.DOUBLE if "e" in text.lower() else T.DECIMAL if "." in text else T.INTEGER)
        if kind == "word" and text in ("true", "false"):
            self.k += 1
            return T.literal(text, T.BOOLEAN)
        return self.subject()


def parse_turtle(text: str, base: str | None = None, source: str = "") -> list[tuple]:
    """(s, p, o, g) rows of Turtle or TriG text."""
    return TurtleParser(text, base, source).parse()


# RDF/XML -----------------------------------------------------------------------------------------

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + T.RDF + "}"


class RdfXmlParser:
    def __init__(self, text: str, base: str | None = None, source: str = ""):
        self.base, self.rows, self.fresh = base or "", [], 0
        self.scope = hashlib.sha256((source or text).encode("utf-8", "surrogatepass")).hexdigest()[:12]
        try:
            self.root = ET.fromstring(text)
        except ET.ParseError as e:
            raise RdfError(str(e)) from e

    def blank(self, name: str | None = None) -> str:
        self.fresh += name is None
        return f"_:n{self.scope}{name}" if name else f"_:b{self.scope}x{self.fresh}"

    def iri(self, value: str, base: str) -> str:
        return f"<{urljoin(base, value) if base and not re.match(r'[A-Za-z][A-Za-z0-9+.-]*:', value) else value}>"

    @staticmethod
    def name(tag: str) -> str:
        return f"<{tag[1:].replace('}', '', 1)}>" if tag.startswith("{") else f"<{tag}>"

    def parse(self) -> list[tuple]:
        base, lang = self.root.get(f"{_XML}base", self.base), self.root.get(f"{_XML}lang")
        for x in list(self.root) if self.root.tag == f"{_R}RDF" else [self.root]:
            self.node(x, base, lang)
        return self.rows

    def node(self, x: ET.Element, base: str, lang: str | None) -> str:
        base, lang = x.get(f"{_XML}base", base), x.get(f"{_XML}lang", lang)
        if x.get(f"{_R}about") is not None:
            s = self.iri(x.get(f"{_R}about"), base)
        elif x.get(f"{_R}ID"):
            s = self.iri("#" + x.get(f"{_R}ID"), base)
        else:
            s = self.blank(x.get(f"{_R}nodeID"))
        if x.tag != f"{_R}Description":
            self.rows.append((s, T.TYPE, self.name(x.tag), None))
        for key, value in x.attrib.items():
            if key == f"{_R}type":
                self.rows.append((s, T.TYPE, self.iri(value, base), None))
            elif not key.startswith((_R, _XML)):
                self.rows.append((s, self.name(key), T.literal(value, lang=lang), None))
        counter = 0
        for child in x:
            tag = child.tag
            if tag == f"{_R}li":
                counter += 1
                tag = f"{_R}_{counter}"
            self.property(s, self.name(tag), child, base, lang)
        return s

    def property(self, s: str, p: str, x: ET.Element, base: str, lang: str | None) -> None:
        base, lang = x.get(f"{_XML}base", base), x.get(f"{_XML}lang", lang)
        kind = x.get(f"{_R}parseType")
        kids = list(x)
        if x.get(f"{_R}resource") is not None:
            o = self.iri(x.get(f"{_R}resource"), base)
        elif kind == "Resource":
            o = self.blank()
            for child in kids:
                self.property(o, self.name(child.tag), child, base, lang)
        elif kind == "Collection":
            cells = [self.blank() for _ in kids] + [T.NIL]
            o = cells[0]
            for k, child in enumerate(kids):
                self.rows += [(cells[k], T.FIRST, self.node(child, base, lang), None), (cells[k], T.REST, cells[k + 1], None)]
        elif kind == "Literal":
            o = T.literal((x.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in kids), f"{T.RDF}XMLLiteral")
        elif kids:
            o = self.node(kids[0], base, lang)
        elif x.get(f"{_R}nodeID"):
            o = self.blank(x.get(f"{_R}nodeID"))
        else:
            own = {k: v for k, v in x.attrib.items() if not k.startswith((_R, _XML))}
            if own and not (x.text or "").strip():
                o = self.blank()
                for key, value in own.items():
                    self.rows.append((o, self.name(key), T.literal(value, lang=lang), None))
            else:
                datatype = x.get(f"{_R}datatype")
                o = T.literal(x.text or "", self.iri(datatype, base)[1:-1]) if datatype else T.literal(x.text or "", lang=lang)
        self.rows.append((s, p, o, None))


def parse_text(text: str, fmt: str | None = None, base: str | None = None, source: str = "") -> list[tuple]:
    """(s, p, o, g) rows of a text in a format by name; sniffed without one."""
    fmt = format_by_name(fmt) if fmt else sniff(text)
    if fmt == "rdfxml":
        return RdfXmlParser(text, base, source).parse()
    if fmt in ("ntriples", "nquads"):
        rows = []
        for k, line in enumerate(text.split("\n"), 1):
            if line.strip() and not line.lstrip().startswith("#"):
                m = re.match(_LINE, line.rstrip("\r"))
                if not m:
                    raise RdfError(f"line {k} is no N-Triples line")
                rows.append((m[1], m[2], _plain(m[3]), m[4]))
        return rows
    return parse_turtle(text, base, source)


def _plain(t: str) -> str:
    if t.startswith('"'):
        value, datatype, lang = T.split_literal(t)
        return T.literal(value, None if lang else datatype, lang)
    return t


def load_text(spark: SparkSession, text: str, fmt: str | None = None, base: str | None = None) -> Graph:
    return Graph.of(local_frame(spark, parse_text(text, fmt, base), ["s", "p", "o", "g"]))


def load_files(spark: SparkSession, path: str, fmt: str | None = None, base: str | None = None) -> Graph:
    """RDF files at a path (a file, folder or glob of one format); N-Triples by line, others one file a row on the executors."""
    fmt = format_by_name(fmt) if fmt else detect_format(path)
    if fmt in ("ntriples", "nquads"):
        return Graph.of(read_ntriples(spark, path))

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = parse_text(content.as_py().decode("utf-8"), fmt, base, name.as_py())
                for k in range(0, len(rows), 20_000):
                    cols = list(zip(*rows[k : k + 20_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["s", "p", "o", "g"])

    return Graph.of(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, QUADS))


def validate(text: str, fmt: str | None = None) -> dict:
    """{valid, triple_count, errors}."""
    try:
        return {"valid": True, "triple_count": len(set(parse_text(text, fmt))), "errors": []}
    except RdfError as e:
        return {"valid": False, "triple_count": 0, "errors": [str(e)]}


# writers -----------------------------------------------------------------------------------------


def to_turtle(rows: list[tuple], prefixes: dict[str, str] | None = None) -> str:
    """Turtle text of triples, grouped by subject."""
    prefixes = {"rdf": T.RDF, "rdfs": T.RDFS, "owl": T.OWL, "xsd": T.XSD} | (prefixes or {})
    order = sorted(prefixes.items(), key=lambda kv: -len(kv[1]))

    def short(t: str) -> str:
        if t == T.TYPE:
            return "a"
        if t.startswith("<"):
            for name, base in order:
                rest = t[1:-1].removeprefix(base)
                if rest != t[1:-1] and re.fullmatch(r"[A-Za-z_][\w-]*", rest):
                    return f"{name}:{rest}"
        return t

    by: dict[str, dict[str, list[str]]] = {}
    for r in sorted(set(tuple(x[:3]) for x in rows)):
        by.setdefault(r[0], {}).setdefault(r[1], []).append(r[2])
    head = "".join(f"@prefix {n}: <{b}> .\n" for n, b in sorted(prefixes.items()))
    body = [f"{short(s)} " + " ;\n    ".join(f"{short(p)} {', '.join(short(o) if o.startswith('<') else o for o in os_)}" for p, os_ in po.items()) + " .\n" for s, po in by.items()]
    return head + "\n" + "\n".join(body)


def to_rdfxml(rows: list[tuple]) -> str:
    from xml.sax.saxutils import escape, quoteattr

    spaces: dict[str, str] = {T.RDF: "rdf"}
    out = []
    by: dict[str, list[tuple[str, str]]] = {}
    for r in sorted(set(tuple(x[:3]) for x in rows)):
        by.setdefault(r[0], []).append((r[1], r[2]))
    for s, pairs in by.items():
        who = f"rdf:about={quoteattr(s[1:-1])}" if s.startswith("<") else f'rdf:nodeID="{s[2:]}"'
        out.append(f"  <rdf:Description {who}>")
        for p, o in pairs:
            m = re.fullmatch(r"<(.*?)([A-Za-z_][\w.-]*)>", p)
            if not m:
                raise RdfError(f"{p} cannot be an element name")
            tag = f"{spaces.setdefault(m[1], f'ns{len(spaces)}')}:{m[2]}"
            if o.startswith("<"):
                out.append(f"    <{tag} rdf:resource={quoteattr(o[1:-1])}/>")
            elif o.startswith("_:"):
                out.append(f'    <{tag} rdf:nodeID="{o[2:]}"/>')
            else:
                value, datatype, lang = T.split_literal(o)
                extra = f' xml:lang="{lang}"' if lang else f" rdf:datatype={quoteattr(datatype)}" if datatype != T.STRING else ""
                out.append(f"    <{tag}{extra}>{escape(value)}</{tag}>")
        out.append("  </rdf:Description>")
    names = " ".join(f"xmlns:{n}={quoteattr(u)}" for u, n in spaces.items())
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF {names}>\n' + "\n".join(out) + "\n</rdf:RDF>\n"


#: Triples that the single-text formats may hold; larger graphs are written by write_ntriples.
TEXT_TRIPLES = 1_000_000


def serialize(g: Graph, fmt: str = "turtle") -> str:
    """The graph as one text; for graphs of at most TEXT_TRIPLES triples."""
    from graphloom.session import bounded_rows

    fmt = format_by_name(fmt)
    found = bounded_rows(g.all_triples.distinct(), TEXT_TRIPLES)
    if found is None:
        raise RdfError(f"over {TEXT_TRIPLES} triples; use write_ntriples")
    rows = [tuple(r) for r in found]
    if fmt in ("ntriples", "nquads"):
        return "".join(f"{s} {p} {o} .\n" for s, p, o in sorted(rows))
    return to_rdfxml(rows) if fmt == "rdfxml" else to_turtle(rows)


def convert(text: str, to: str, fmt: str | None = None) -> str:
    rows = [r[:3] for r in parse_text(text, fmt)]
    to = format_by_name(to)
    if to in ("ntriples", "nquads"):
        return "".join(f"{s} {p} {o} .\n" for s, p, o in sorted(set(rows)))
    return to_rdfxml(rows) if to == "rdfxml" else to_turtle(rows)
