"""SPARQL expressions as Spark columns. An error or an unbound value is null, so filters drop the row."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.plans.sparql_parser import Expr, SparqlError

DEC = "decimal(38,10)"


class Val:
    """A value with the views its users ask for: term, text, truth, and as a number dbl, dec and rank (1 integer, 2 decimal, 3 double)."""

    const: str | None = None

    def __init__(self, term: Column):
        self._term = term

    @property
    def term(self) -> Column:
        return self._term

    @functools.cached_property
    def text(self) -> Column:
        return T.lex(self.term)

    @functools.cached_property
    def datatype(self) -> Column:
        return T.datatype_of(self.term)

    @functools.cached_property
    def dbl(self) -> Column:
        return T.number(self.term)

    @functools.cached_property
    def dec(self) -> Column:
        return F.when(self.datatype.isin(*T.NUMERIC), self.text.try_cast(DEC))

    @functools.cached_property
    def rank(self) -> Column:
        d = self.datatype
        return F.when(d.isin(T.DOUBLE, T.FLOAT), 3).when(d == T.DECIMAL, 2).when(d.isin(*T.NUMERIC), 1)

    @functools.cached_property
    def truth(self) -> Column:
        d = self.datatype
        number = F.when(self.dbl.isNotNull(), (self.dbl != 0) & ~F.isnan(self.dbl)).otherwise(F.lit(False))
        return F.when(d == T.BOOLEAN, self.text.isin("true", "1")).when(d.isin(*T.NUMERIC), number).when(d.isin(T.STRING, f"{T.RDF}langString"), F.length(self.text) > 0)

    @property
    def plain(self) -> Column:
        """Text of string literals only."""
        return F.when(self.datatype.isin(T.STRING, f"{T.RDF}langString"), self.text)


class Const(Val):
    def __init__(self, term: str):
        super().__init__(F.lit(term))
        self.const = term
        if term.startswith('"'):
            text, datatype, lang = T.split_literal(term)
            self.text = F.lit(text)
            self.datatype = F.lit(f"{T.RDF}langString" if lang else datatype)
            if datatype in T.NUMERIC:
                self.dbl, self.dec = F.lit(float(text)), F.lit(text).cast(DEC)
                self.rank = F.lit(3 if datatype in (T.DOUBLE, T.FLOAT) else 2 if datatype == T.DECIMAL else 1)
                self.is_number = True
                self.truth = F.lit(float(text) != 0)
                return
        else:
            self.text = F.lit(T.value_of(term))
        self.is_number = False


class Bool(Val):
    def __init__(self, c: Column):
        super().__init__(F.when(c, T.TRUE).when(~c, T.FALSE))
        self.truth = c


class Str(Val):
    def __init__(self, c: Column, like: Val | None = None):
        super().__init__(F.concat(T.plain_literal(c), F.when(T.tail_of(like.term).startswith("@"), T.tail_of(like.term)).otherwise("")) if like is not None else T.plain_literal(c))
        self.text = c
        self.datatype = F.lit(T.STRING)
        self.dbl = self.dec = F.lit(None).cast("double")
        self.truth = F.length(c) > 0


class Iri(Val):
    def __init__(self, c: Column):
        super().__init__(T.make_iri(c))
        self.text = c


def decimal_text(c: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(c.cast("string"), r"\.?0+$", "")


class Num(Val):
    def __init__(self, dbl: Column, dec: Column, rank: Column):
        self.dbl, self.dec, self.rank = dbl, dec, rank
        as_dec = F.when(dec == 0, F.lit("0")).otherwise(decimal_text(dec))
        self.text = F.when(rank == 3, dbl.cast("string")).otherwise(as_dec)
        self.datatype = F.when(rank == 1, T.INTEGER).when(rank == 2, T.DECIMAL).when(rank == 3, T.DOUBLE)
        self.truth = (dbl != 0) & ~F.isnan(dbl)
        super().__init__(F.concat(F.lit('"'), self.text, F.lit('"^^<'), self.datatype, F.lit(">")))


def integer(c: Column) -> Num:
    return Num(c.cast("double"), c.cast(DEC), F.when(c.isNotNull(), F.lit(1)))


def arithmetic(op: str, a: Val, b: Val) -> Num:
    rank = F.greatest(a.rank, b.rank)
    rank = F.when(a.rank.isNotNull() & b.rank.isNotNull(), rank)
    if op == "/":
        return Num(F.try_divide(a.dbl, b.dbl), F.try_divide(a.dec, b.dec).cast(DEC), F.when(b.dbl != 0, F.greatest(rank, F.lit(2))).when(rank == 3, 3))
    run = {"+": (lambda x, y: x + y, F.try_add), "-": (lambda x, y: x - y, F.try_subtract), "*": (lambda x, y: x * y, F.try_multiply)}[op]
    return Num(run[0](a.dbl, b.dbl), run[1](a.dec, b.dec).cast(DEC), rank)


def _moment(v: Val) -> Column:
    return F.when(v.datatype.isin(T.DATE, T.DATETIME), v.text.try_cast("timestamp"))


def compare(op: str, a: Val, b: Val) -> Bool:
    run = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    equal = op in ("=", "!=")
    for x, y in ((a, b), (b, a)):
        if y.const is not None and equal and (not y.const.startswith('"')):
            return Bool(run(x.term, y.term))
    if isinstance(a, Num) or isinstance(b, Num) or getattr(a, "is_number", False) or getattr(b, "is_number", False):
        return Bool(run(a.dbl, b.dbl))
    ta, tb = a.datatype, b.datatype
    dated = ta.isin(T.DATE, T.DATETIME) & (ta == tb)
    numeric = a.dbl.isNotNull() & b.dbl.isNotNull()
    stringy = (ta == T.STRING) & (tb == T.STRING)
    truths = (ta == T.BOOLEAN) & (tb == T.BOOLEAN)
    out = F.when(numeric, run(a.dbl, b.dbl)).when(dated, run(_moment(a), _moment(b)))
    out = out.when(truths, run(a.truth.cast("int"), b.truth.cast("int"))) if not equal else out
    out = out.when(stringy, run(a.text, b.text))
    return Bool(out.otherwise(run(a.term, b.term)) if equal else out)


def order_keys(v: Val) -> list[Column]:
    """Sort keys: unbound < blank < IRI < literal, then numbers by value, then text."""
    t = v.term
    kind = F.when(t.isNull(), 0).when(T.is_blank(t), 1).when(T.is_iri(t), 2).otherwise(3)
    return [kind, v.dbl, v.text, t]


class Expressions:
    """Compiles Expr over a scope that maps variable names to columns; aggregates come from a prepared table."""

    def __init__(self, column_of, aggregates: dict | None = None):
        self.column_of, self.aggregates = column_of, aggregates or {}

    def __call__(self, e: Expr) -> Val:
        if e.op == "var":
            c = self.column_of(e.args[0])
            return c if isinstance(c, Val) else Val(c if c is not None else F.lit(None).cast("string"))
        if e.op == "term":
            return Const(e.args[0])
        if e.op == "agg":
            return self.aggregates[id(e)]
        if e.op == "exists":
            raise SparqlError("EXISTS is supported as a filter and within its conditions")
        if e.op in ("and", "or"):
            a, b = (self(x).truth for x in e.args)
            return Bool((a & b) if e.op == "and" else (a | b))
        if e.op == "not":
            return Bool(~self(e.args[0]).truth)
        if e.op == "neg":
            return arithmetic("-", Const('"0"^^<%s>' % T.INTEGER), self(e.args[0]))
        if e.op in ("=", "!=", "<", ">", "<=", ">="):
            return compare(e.op, self(e.args[0]), self(e.args[1]))
        if e.op in ("+", "-", "*", "/"):
            return arithmetic(e.op, self(e.args[0]), self(e.args[1]))
        if e.op == "in":
            left = self(e.args[0])
            rest = [self(x) for x in e.args[1:]]
            if rest and all(r.const is not None and not r.const.startswith('"') for r in rest):
                return Bool(left.term.isin(*[r.const for r in rest]))
            out = F.lit(False)
            for r in rest:
                out = out | compare("=", left, r).truth
            return Bool(out)
        if e.op == "call":
            return self.call(e.extra["name"], e.args)
        raise SparqlError(f"unknown expression {e.op}")

    def call(self, name: str, args: list[Expr]) -> Val:
        if name == "BOUND":
            return Bool(self(args[0]).term.isNotNull())
        if name == "COALESCE":
            return Val(F.coalesce(*[self(a).term for a in args])) if args else Val(F.lit(None).cast("string"))
        if name == "IF":
            c, a, b = (self(x) for x in args)
            return Val(F.when(c.truth, a.term).when(~c.truth, b.term))
        v = [self(a) for a in args]
        if name.startswith("<"):
            return self.cast(name[1:-1], v[0])
        if name in _FUNCTIONS:
            return _FUNCTIONS[name](*v)
        raise SparqlError(f"unknown function {name}")

    @staticmethod
    def cast(datatype: str, v: Val) -> Val:
        t = v.text
        if datatype == T.STRING:
            return Str(t)
        if datatype in (T.INTEGER, f"{T.XSD}long", f"{T.XSD}int"):
            whole = F.coalesce(t.try_cast("bigint"), t.try_cast("double").try_cast("bigint"))
            return integer(F.when(v.datatype == T.BOOLEAN, v.truth.cast("bigint")).otherwise(whole))
        if datatype in (T.DECIMAL, T.DOUBLE, T.FLOAT):
            return Num(t.try_cast("double"), t.try_cast(DEC), F.when(t.try_cast("double").isNotNull(), F.lit(2 if datatype == T.DECIMAL else 3)))
        if datatype == T.BOOLEAN:
            return Bool(F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False).when(v.dbl.isNotNull(), v.dbl != 0))
        if datatype in (T.DATETIME, T.DATE):
            fine = t.try_cast("timestamp").isNotNull()
            text = t if datatype == T.DATETIME else F.substring(t, 1, 10)
            return Val(F.when(fine, T.typed_literal(text, datatype)))
        raise SparqlError(f"no cast to <{datatype}>")


def _part(v: Val, k: int) -> Column:
    return F.nullif(F.regexp_extract(F.when(v.datatype.isin(T.DATETIME, T.DATE), v.text), r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?", k), F.lit(""))


def _math(run_dbl, run_dec):
    return lambda v: Num(run_dbl(v.dbl).cast("double"), run_dec(v.dec).cast(DEC), v.rank)


def _round(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def _regex(text: Val, pattern: Val, flags: Val | None = None) -> Val:
    mode = T.value_of(flags.const) if flags is not None and flags.const else ""
    p = F.concat(F.lit("(?u" + "".join(c for c in mode if c in "ismx") + ")"), pattern.text) if mode else pattern.text
    return Bool(F.regexp_like(text.plain, p))


def _replace(text: Val, pattern: Val, by: Val, flags: Val | None = None) -> Val:
    mode = T.value_of(flags.const) if flags is not None and flags.const else ""
    p = F.concat(F.lit("(?u" + "".join(c for c in mode if c in "ismx") + ")"), pattern.text) if mode else pattern.text
    return Str(F.regexp_replace(text.plain, p, by.text), text)


def _substr(text: Val, start: Val, length: Val | None = None) -> Val:
    at = start.dbl.cast("int")
    return Str(F.substr(text.plain, at, length.dbl.cast("int")) if length is not None else F.substr(text.plain, at), text)


def _before(a: Val, b: Val) -> Val:
    at = F.position(b.text, a.plain)
    return Str(F.when(at > 0, F.substr(a.plain, F.lit(1), at - 1)).when(at == 0, ""), a)


def _after(a: Val, b: Val) -> Val:
    at = F.position(b.text, a.plain)
    return Str(F.when(at > 0, F.substr(a.plain, at + F.length(b.text))).when(at == 0, ""), a)


def _seconds(v: Val) -> Num:
    t = _part(v, 6)
    return Num(t.cast("double"), t.cast(DEC), F.when(t.isNotNull(), 2))


def _timezone(v: Val) -> Val:
    z = _part(v, 7)
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    sign = F.when(z.startswith("-"), "-").otherwise("")
    text = F.concat(sign, F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    return Val(T.typed_literal(F.when(z == "Z", "PT0S").when((hours == 0) & (minutes == 0), "PT0S").when(z.isNotNull(), text), f"{T.XSD}dayTimeDuration"))


def _same(a: Val, b: Val) -> Val:
    return Bool(a.term == b.term)


def _langmatches(a: Val, b: Val) -> Val:
    lang, rng = F.lower(a.text), F.lower(b.text)
    return Bool(F.when(rng == "*", F.length(lang) > 0).otherwise((lang == rng) | lang.startswith(F.concat(rng, F.lit("-")))))


_FUNCTIONS = {
    "STR": lambda v: Str(F.when(~T.is_blank(v.term), v.text)),
    "LANG": lambda v: Str(T.lang_of(v.term)),
    "DATATYPE": lambda v: Iri(v.datatype),
    "IRI": lambda v: Iri(v.text),
    "URI": lambda v: Iri(v.text),
    "ISIRI": lambda v: Bool(T.is_iri(v.term)),
    "ISURI": lambda v: Bool(T.is_iri(v.term)),
    "ISBLANK": lambda v: Bool(T.is_blank(v.term)),
    "ISLITERAL": lambda v: Bool(T.is_literal(v.term)),
    "ISNUMERIC": lambda v: Bool(F.when(v.term.isNotNull(), v.dbl.isNotNull())),
    "SAMETERM": _same,
    "LANGMATCHES": _langmatches,
    "STRDT": lambda v, d: Val(F.when(d.text == T.STRING, T.plain_literal(v.text)).otherwise(F.concat(T.plain_literal(v.text), F.lit("^^"), d.term))),
    "STRLANG": lambda v, g: Val(F.concat(T.plain_literal(v.text), F.lit("@"), F.lower(g.text))),
    "BNODE": lambda *v: Val(F.concat(F.lit("_:b"), F.md5(v[0].text) if v else F.replace(F.uuid(), F.lit("-"), F.lit("")))),
    "STRLEN": lambda v: integer(F.length(v.plain)),
    "SUBSTR": _substr,
    "UCASE": lambda v: Str(F.upper(v.plain), v),
    "LCASE": lambda v: Str(F.lower(v.plain), v),
    "STRSTARTS": lambda a, b: Bool(a.plain.startswith(b.text)),
    "STRENDS": lambda a, b: Bool(a.plain.endswith(b.text)),
    "CONTAINS": lambda a, b: Bool(F.contains(a.plain, b.text)),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "CONCAT": lambda *v: Str(F.concat(*[x.plain for x in v]) if v else F.lit("")),
    "ENCODE_FOR_URI": lambda v: Str(F.replace(F.replace(F.replace(F.url_encode(v.plain), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))),
    "REGEX": _regex,
    "REPLACE": _replace,
    "ABS": _math(F.abs, F.abs),
    "CEIL": _math(F.ceil, F.ceil),
    "FLOOR": _math(F.floor, F.floor),
    "ROUND": _math(_round, _round),
    "SQRT": lambda v: Num(F.sqrt(v.dbl), F.sqrt(v.dbl).try_cast(DEC), F.when(v.dbl.isNotNull(), 3)),  # an extension
    "RAND": lambda: Num(F.rand(), F.rand().cast(DEC), F.lit(3)),
    "NOW": lambda: Val(T.typed_literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), T.DATETIME)),
    "YEAR": lambda v: integer(_part(v, 1).cast("bigint")),
    "MONTH": lambda v: integer(_part(v, 2).cast("bigint")),
    "DAY": lambda v: integer(_part(v, 3).cast("bigint")),
    "HOURS": lambda v: integer(_part(v, 4).cast("bigint")),
    "MINUTES": lambda v: integer(_part(v, 5).cast("bigint")),
    "SECONDS": _seconds,
    "TZ": lambda v: Str(F.coalesce(_part(v, 7), F.when(_part(v, 1).isNotNull(), ""))),
    "TIMEZONE": _timezone,
    "MD5": lambda v: Str(F.md5(v.plain)),
    "SHA1": lambda v: Str(F.sha1(v.plain)),
    "SHA256": lambda v: Str(F.sha2(v.plain, 256)),
    "SHA384": lambda v: Str(F.sha2(v.plain, 384)),
    "SHA512": lambda v: Str(F.sha2(v.plain, 512)),
    "UUID": lambda: Iri(F.concat(F.lit("urn:uuid:"), F.uuid())),
    "STRUUID": lambda: Str(F.uuid()),
}
