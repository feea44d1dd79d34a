"""RDF terms as strings in N-Triples form, and column expressions over them.

``<iri>``, ``_:label``, ``"text"``, ``"text"@lang`` and ``"text"^^<datatype>``. A plain literal and one typed xsd:string are the same
term and are kept plain; language tags are lower case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"

TYPE = f"<{RDF}type>"
FIRST, REST, NIL = f"<{RDF}first>", f"<{RDF}rest>", f"<{RDF}nil>"
LABEL, COMMENT = f"<{RDFS}label>", f"<{RDFS}comment>"
SUBCLASS, SUBPROPERTY = f"<{RDFS}subClassOf>", f"<{RDFS}subPropertyOf>"
DOMAIN, RANGE = f"<{RDFS}domain>", f"<{RDFS}range>"
CLASS, OBJECT_PROPERTY, DATATYPE_PROPERTY = f"<{OWL}Class>", f"<{OWL}ObjectProperty>", f"<{OWL}DatatypeProperty>"
EQUIVALENT_CLASS, EQUIVALENT_PROPERTY = f"<{OWL}equivalentClass>", f"<{OWL}equivalentProperty>"
DISJOINT, SAME_AS, INVERSE_OF = f"<{OWL}disjointWith>", f"<{OWL}sameAs>", f"<{OWL}inverseOf>"
RESTRICTION, ON_PROPERTY = f"<{OWL}Restriction>", f"<{OWL}onProperty>"
EXACT_MATCH, CLOSE_MATCH = f"<{SKOS}exactMatch>", f"<{SKOS}closeMatch>"

INTEGER, DECIMAL, DOUBLE, FLOAT = f"{XSD}integer", f"{XSD}decimal", f"{XSD}double", f"{XSD}float"
BOOLEAN, STRING, DATE, DATETIME = f"{XSD}boolean", f"{XSD}string", f"{XSD}date", f"{XSD}dateTime"
NUMERIC = [INTEGER, DECIMAL, DOUBLE, FLOAT, *(f"{XSD}{x}" for x in ("long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte"))]
TRUE, FALSE = f'"true"^^<{BOOLEAN}>', f'"false"^^<{BOOLEAN}>'


# plain Python ------------------------------------------------------------------------------------


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, k = [], 0
    plain = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "'": "'", "\\": "\\", "b": "\b", "f": "\f"}
    while k < len(text):
        c = text[k]
        if c != "\\" or k + 1 == len(text):
            out.append(c)
            k += 1
        elif text[k + 1] == "u":
            out.append(chr(int(text[k + 2 : k + 6], 16)))
            k += 6
        elif text[k + 1] == "U":
            out.append(chr(int(text[k + 2 : k + 10], 16)))
            k += 10
        else:
            out.append(plain.get(text[k + 1], text[k + 1]))
            k += 2
    return "".join(out)


def iri(value: str) -> str:
    return f"<{value}>"


def literal(value: str, datatype: str | None = None, lang: str | None = None) -> str:
    if lang:
        return f'"{escape(value)}"@{lang.lower()}'
    if datatype and datatype != STRING:
        return f'"{escape(value)}"^^<{datatype}>'
    return f'"{escape(value)}"'


def split_literal(term: str) -> tuple[str, str | None, str | None]:
    """(text, datatype, language) of a literal term."""
    body, _, tail = term.rpartition('"')
    text = unescape(body[1:])
    if tail.startswith("@"):
        return text, None, tail[1:]
    return text, tail[3:-1] if tail.startswith("^^<") else STRING, None


def value_of(term: str) -> str:
    """The IRI without brackets, or the text of a literal."""
    if term.startswith("<"):
        return term[1:-1]
    return split_literal(term)[0] if term.startswith('"') else term


def local_name(term: str) -> str:
    """After the last '#'; without one, after the last '/'; else the whole IRI."""
    value = value_of(term)
    if "#" in value:
        return value.rpartition("#")[2]
    return value.rpartition("/")[2] if "/" in value else value


# columns -----------------------------------------------------------------------------------------


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def tail_of(t: Column) -> Column:
    """What follows the closing quote of a literal."""
    return F.substring_index(t, '"', -1)


def escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\\\"), F.lit("\x01"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x01", "\\")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.contains(c, F.lit("\\")), out).otherwise(c)


def lex(t: Column) -> Column:
    """The text of a literal, or the IRI without brackets, or the blank label."""
    inner = F.substr(t, F.lit(2), F.length(t) - F.length(tail_of(t)) - 2)
    return F.when(is_literal(t), unescaped(inner)).when(is_iri(t), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def datatype_of(t: Column) -> Column:
    """The datatype IRI (no brackets) of a literal; null for others; rdf:langString with a language."""
    tail = tail_of(t)
    typed = F.when(tail.startswith("^^<"), F.substr(tail, F.lit(4), F.length(tail) - 4)).when(tail.startswith("@"), F.lit(f"{RDF}langString")).otherwise(F.lit(STRING))
    return F.when(is_literal(t), typed)


def lang_of(t: Column) -> Column:
    tail = tail_of(t)
    return F.when(is_literal(t), F.when(tail.startswith("@"), F.substr(tail, F.lit(2))).otherwise(F.lit("")))


def plain_literal(c: Column) -> Column:
    return F.concat(F.lit('"'), escaped(c), F.lit('"'))


def typed_literal(c: Column, datatype: str) -> Column:
    return F.concat(F.lit('"'), escaped(c.cast("string")), F.lit(f'"^^<{datatype}>'))


def number_literal(c: Column, datatype: str) -> Column:
    """The literal of a number or date column, whose text holds nothing to escape."""
    return F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<{datatype}>'))


def make_iri(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def local(t: Column) -> Column:
    """local_name as a column."""
    v = lex(t)
    return F.when(F.contains(v, F.lit("#")), F.substring_index(v, "#", -1)).otherwise(F.substring_index(v, "/", -1))


def number(t: Column) -> Column:
    """The value of a numeric literal as a double; null for other terms."""
    tail = tail_of(t)
    inner = F.substr(t, F.lit(2), F.length(t) - F.length(tail) - 2)
    return F.when(is_literal(t) & tail.isin(*[f"^^<{d}>" for d in NUMERIC]), unescaped(inner).try_cast("double"))
