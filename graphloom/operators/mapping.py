"""Rows to triples, auto mappings, and relational schemas to ontologies."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from graphloom import terms as T

DEFAULT_BASE = "http://example.org/data/"
SCHEMA_BASE = "http://example.org/db/"
#: Characters that an IRI may not hold; each becomes "_" (fixed values).
UNSAFE = " <>{}|\\^`?"


@dataclass
class Field:
    field: str
    predicate: str
    datatype: str | None = None
    lookup: bool = False


@dataclass
class Mapping:
    base_iri: str = DEFAULT_BASE
    id_field: str | None = None
    cls: str = f"{DEFAULT_BASE}Thing"
    mappings: list[Field] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str) -> Mapping:
        d = json.loads(text)
        fields = [Field(m["field"], m["predicate"], m.get("datatype"), bool(m.get("lookup", False))) for m in d["mappings"]]
        return cls(d["base_iri"], d.get("id_field"), d["class"], fields)

    @classmethod
    def from_headers(cls, headers: list[str], base_iri: str = DEFAULT_BASE, class_iri: str | None = None) -> Mapping:
        """The first header in sorted order is the id; every column, the id too, becomes a string property."""
        names = sorted(set(headers))
        return cls(base_iri, names[0] if names else None, class_iri or f"{base_iri}Thing", [Field(h, f"{base_iri}ont#{h}", T.STRING) for h in names])

    def to_json(self) -> str:
        return json.dumps({"base_iri": self.base_iri, "id_field": self.id_field, "class": self.cls, "mappings": [vars(m) for m in self.mappings]})


def sanitize(c: Column) -> Column:
    return F.translate(c, UNSAFE, "_" * len(UNSAFE))


def _expand(name: str, base: str) -> str:
    return name if "://" in name or name.startswith("urn:") else f"{base}{name}"


def stringified(df: DataFrame) -> DataFrame:
    """Every column as text; nulls become empty, nested values JSON, dates ISO text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        c = F.to_json(c) if kind in ("struct", "array", "map") else F.hex(c) if kind == "binary" else c.cast("string")
        cols.append(F.coalesce(c, F.lit("")).alias(f.name))
    return df.select(*cols)


def rows_to_triples(df: DataFrame, mapping: Mapping) -> DataFrame:
    """One rdf:type triple for each row, and one for each mapped field with text.

    A row without an id gets one from a hash of its values, so equal rows share it. One narrow pass.
    """
    rows = stringified(df)
    names = set(rows.columns)
    hashed = F.concat(F.lit("_auto_"), F.sha2(F.concat_ws("\x01", *[F.col(f"`{c}`") for c in sorted(names)]), 256).substr(1, 32))
    id_ = F.col(f"`{mapping.id_field}`") if mapping.id_field in names else F.lit("")
    id_ = F.when(id_ == "", hashed).otherwise(id_)
    subject = F.concat(F.lit(f"<{mapping.base_iri}"), sanitize(id_), F.lit(">"))
    made = [F.struct(F.lit(T.TYPE).alias("p"), F.lit(f"<{mapping.cls}>").alias("o"))]
    for m in mapping.mappings:
        if m.field not in names:
            continue
        v = F.col(f"`{m.field}`")
        if m.lookup:
            o = F.concat(F.lit(f"<{mapping.base_iri}"), sanitize(v), F.lit(">"))
        elif m.datatype and m.datatype != T.STRING:
            o = T.typed_literal(v, m.datatype)
        else:
            o = T.plain_literal(v)
        made.append(F.struct(F.lit(f"<{m.predicate}>").alias("p"), F.when(v != "", o).alias("o")))
    return rows.select(subject.alias("s"), F.explode(F.array(*made)).alias("t")).select("s", "t.p", "t.o").where(F.col("o").isNotNull())


def propose(headers: list[str], classes: list[str], properties: list[str], base_iri: str = DEFAULT_BASE) -> dict:
    """A mapping to start from, with the vocabulary it may draw on; the class is the first one found."""
    mapping = Mapping.from_headers(headers, base_iri, T.value_of(sorted(classes)[0]) if classes else None)
    return {"headers": sorted(set(headers)), "classes": sorted(classes), "properties": sorted(properties), "mapping": json.loads(mapping.to_json())}


# relational schemas ------------------------------------------------------------------------------

#: SQL type names and the XSD types they map to (fixed values).
SQL_TO_XSD = {
    "integer": "integer", "int": "integer", "int2": "integer", "int4": "integer", "int8": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer", "serial": "integer", "bigserial": "integer", "hugeint": "integer",
    "numeric": "decimal", "decimal": "decimal", "real": "decimal", "double": "decimal", "double precision": "decimal", "float": "decimal", "float4": "decimal", "float8": "decimal", "money": "decimal",
    "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "dateTime", "timestamp without time zone": "dateTime", "timestamp with time zone": "dateTime", "timestamptz": "dateTime", "timestamp_ntz": "dateTime", "datetime": "dateTime",
    "time": "time", "time without time zone": "time", "bytea": "hexBinary", "blob": "hexBinary", "binary": "hexBinary", "varbinary": "hexBinary",
}


def sql_to_xsd(sql_type: str) -> str:
    name = sql_type.partition("(")[0].strip().lower()
    return T.XSD + SQL_TO_XSD.get(name, "string")


def pascal_case(name: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in name.split("_"))


@dataclass
class TableColumn:
    name: str
    sql_type: str
    nullable: bool = True
    primary_key: bool = False


@dataclass
class TableSchema:
    name: str
    columns: list[TableColumn]
    foreign_keys: dict[str, str] = field(default_factory=dict)  # column: parent table


def spark_sql_type(t: DataType) -> str:
    return {"long": "bigint", "string": "varchar", "byte": "tinyint", "short": "smallint"}.get(t.typeName(), t.simpleString())


def introspect(name: str, df: DataFrame, primary_key: str | None = None, foreign_keys: dict[str, str] | None = None, not_null: list[str] | None = None) -> TableSchema:
    cols = [TableColumn(f.name, spark_sql_type(f.dataType), f.name not in (not_null or []) and f.name != primary_key, f.name == primary_key) for f in df.schema.fields]
    return TableSchema(name, cols, foreign_keys or {})


def introspect_duckdb(connection) -> list[TableSchema]:
    """Tables of an open DuckDB connection, with their primary and foreign keys."""
    keys: dict[str, set[str]] = {}
    parents: dict[str, dict[str, str]] = {}
    for table, kind, names, text in connection.execute("SELECT table_name, constraint_type, constraint_column_names, constraint_text FROM duckdb_constraints()").fetchall():
        if kind == "PRIMARY KEY":
            keys.setdefault(table, set()).update(names)
        elif kind == "FOREIGN KEY":
            parent = text.upper().partition("REFERENCES")[2].partition("(")[0].strip().lower().strip('"')
            parents.setdefault(table, {}).update({n: parent for n in names})
    found: dict[str, list[TableColumn]] = {}
    for table, name, kind, nullable in connection.execute("SELECT table_name, column_name, data_type, is_nullable FROM information_schema.columns WHERE table_schema = 'main' ORDER BY table_name, ordinal_position").fetchall():
        found.setdefault(table, []).append(TableColumn(name, kind, nullable in ("YES", True), name in keys.get(table, ())))
    return [TableSchema(t, cols, parents.get(t, {})) for t, cols in found.items()]


#: What a PostgreSQL server is asked for its columns and keys.
POSTGRES_COLUMNS = "SELECT table_name, column_name, data_type, is_nullable FROM information_schema.columns WHERE table_schema = 'public' ORDER BY table_name, ordinal_position"
POSTGRES_KEYS = """SELECT tc.constraint_type, kcu.table_name, kcu.column_name, ccu.table_name AS parent FROM information_schema.table_constraints tc
  JOIN information_schema.key_column_usage kcu ON kcu.constraint_name = tc.constraint_name AND kcu.table_schema = tc.table_schema
  LEFT JOIN information_schema.constraint_column_usage ccu ON ccu.constraint_name = tc.constraint_name AND ccu.table_schema = tc.table_schema
  WHERE tc.table_schema = 'public' AND tc.constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY')"""


def introspect_postgres(run) -> list[TableSchema]:
    """Tables of a PostgreSQL schema; run(sql) gives rows as dictionaries (sources.tabular.sql_rows, collected: catalogue rows)."""
    primary, parents = set(), {}
    for r in run(POSTGRES_KEYS):
        if r["constraint_type"] == "PRIMARY KEY":
            primary.add((r["table_name"], r["column_name"]))
        else:
            parents.setdefault(r["table_name"], {})[r["column_name"]] = r["parent"]
    found: dict[str, list[TableColumn]] = {}
    for r in run(POSTGRES_COLUMNS):
        found.setdefault(r["table_name"], []).append(TableColumn(r["column_name"], r["data_type"], r["is_nullable"] == "YES", (r["table_name"], r["column_name"]) in primary))
    return [TableSchema(t, cols, parents.get(t, {})) for t, cols in found.items()]


def schema_triples(tables: list[TableSchema], base: str = SCHEMA_BASE) -> list[tuple[str, str, str]]:
    """Tables become classes, columns datatype properties, foreign keys object properties, primary keys functional ones, and
    columns that may not be null a minimum cardinality of 1."""
    out = []
    for t in tables:
        cls = f"<{base}{pascal_case(t.name)}>"
        out += [(cls, T.TYPE, T.CLASS), (cls, T.LABEL, T.literal(t.name))]
        for c in t.columns:
            prop = f"<{base}{t.name}_{c.name}>"
            parent = t.foreign_keys.get(c.name)
            out += [(prop, T.TYPE, T.OBJECT_PROPERTY if parent else T.DATATYPE_PROPERTY), (prop, T.LABEL, T.literal(c.name)), (prop, T.DOMAIN, cls)]
            out.append((prop, T.RANGE, f"<{base}{pascal_case(parent)}>" if parent else f"<{sql_to_xsd(c.sql_type)}>"))
            if c.primary_key:
                out.append((prop, T.TYPE, f"<{T.OWL}FunctionalProperty>"))
            if not c.nullable:
                node = f"_:r_{t.name}_{c.name}"
                out += [(cls, T.SUBCLASS, node), (node, T.TYPE, T.RESTRICTION), (node, T.ON_PROPERTY, prop), (node, f"<{T.OWL}minCardinality>", T.literal("1", f"{T.XSD}nonNegativeInteger"))]
    return out
