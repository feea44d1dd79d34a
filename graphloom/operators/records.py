"""Record cleaning and geometry, dashboards, verification, rule cascades and axiom extraction, all as columns and joins."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import terms as T
from graphloom.graph import Graph
from graphloom.operators.checks import validate_shapes
from graphloom.plans.closure import closure

# dates -------------------------------------------------------------------------------------------

#: Patterns by precision, tried in order (fixed values).
DAY_PATTERNS = ["d MMMM yyyy", "d-MMM-yyyy", "MMMM d yyyy", "d/M/yyyy", "yyyy-MM-dd"]
MONTH_PATTERNS = ["MMMM yyyy", "MMM yyyy", "M/yyyy", "yyyy-MM"]
CIRCA = r"(?i)^(c\.?|circa|ca\.?)\s+"
CENTURY = 1900


def partial_date(raw: Column, century: int = CENTURY) -> Column:
    """Struct (value, kind, approximate): a date, gYearMonth or gYear from free text; all null if it is none.

    Two-digit years (as in 23-Jun-43) are years of the given century.
    """
    text = F.trim(raw)
    circa = text.rlike(CIRCA)
    text = F.trim(F.regexp_replace(text, CIRCA, ""))
    short = F.regexp_extract(text, r"^\d{1,2}-[A-Za-z]{3}-(\d{2})$", 1)
    text = F.when(short != "", F.concat(F.substring_index(text, "-", 2), F.lit("-"), (F.lit(century) + short.try_cast("int")).cast("string"))).otherwise(text)
    day = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DAY_PATTERNS])
    # a month pattern reads a text with a first day added
    month = F.coalesce(*[F.try_to_timestamp(F.concat(F.lit("1 "), text), F.lit(f"d {p}")) for p in MONTH_PATTERNS])
    year = F.when(text.rlike(r"^\d{4}$"), text)
    value = F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.date_format(month, "yyyy-MM"), year)
    kind = F.when(day.isNotNull(), "date").when(month.isNotNull(), "gYearMonth").when(year.isNotNull(), "gYear")
    return F.struct(value.alias("value"), kind.alias("kind"), F.when(value.isNotNull(), circa).alias("approximate"))


# fields ------------------------------------------------------------------------------------------

FEET = 0.3048
#: Rights texts and the statements they stand for (fixed values).
RIGHTS = {
    "Crown Copyright Expired": "http://rightsstatements.org/vocab/NoC-OKLR/1.0/",
    "Crown Copyright": "https://www.nationalarchives.gov.uk/information-management/re-using-public-sector-information/uk-government-licensing-framework/crown-copyright/",
    "Public Domain (US)": "http://rightsstatements.org/vocab/NoC-US/1.0/",
}
#: Collection codes (fixed values).
COLLECTIONS = ["RAF", "NARA", "USAAF", "USAF", "USN", "DOS", "JARIC", "OS", "HEXAGON", "CORONA", "GAMBIT", "ZENIT", "NCAP", "Luftwaffe", "BCM"]
#: Focal lengths in millimetres by camera number (fixed values).
FOCAL_MM = {"49": 152.4, "52": 914.4, "63": 304.8}
METRES_PER_DEGREE = 111_111.0


def feet_to_metres(c: Column) -> Column:
    return F.round(c.try_cast("double") * FEET, 1)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def rights_iri(c: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in RIGHTS.items() for x in kv])
    return mapping[F.trim(c)]


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")


def collection(ref: Column) -> Column:
    """Struct (collection, local) of a reference like CODE/rest; an unknown code gives an empty one."""
    code = F.substring_index(ref, "/", 1)
    known = F.contains(ref, F.lit("/")) & code.isin(*COLLECTIONS)
    return F.struct(F.when(known, code).otherwise("").alias("collection"), F.when(known, F.substr(ref, F.length(code) + 2)).otherwise(ref).alias("local"))


def focal_length(camera: Column, told: Column | None = None) -> Column:
    inches = F.regexp_extract(camera, r"(\d+)[-\s]?inch", 1).try_cast("double") * 25.4
    number = F.create_map(*[F.lit(x) for kv in FOCAL_MM.items() for x in kv])[F.regexp_extract(camera, r"\bF\.?(\d+)\b", 1)]
    return F.coalesce(*([told.try_cast("double")] if told is not None else []), inches, number)


# geometry ----------------------------------------------------------------------------------------


def _six(c: Column) -> Column:
    """A number with up to six decimals."""
    return F.regexp_replace(c.cast("decimal(20,6)").cast("string"), r"\.?0+$", "")


def polygon(points: Column) -> Column:
    """WKT of an array of (lon, lat) structs."""
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(points, lambda p: F.concat(_six(p["lon"]), F.lit(" "), _six(p["lat"]))), ", "), F.lit("))"))


def footprint(lat: Column, lon: Column, altitude_m: Column, focal_mm: Column, edge_mm: Column | None = None, heading: Column | None = None) -> Column:
    """Closed ground footprint, an array of (lon, lat), of a vertical photograph; turned by its heading in degrees."""
    half = (edge_mm if edge_mm is not None else F.lit(230.0)) * altitude_m / focal_mm / 2
    turn = F.radians(heading if heading is not None else F.lit(0.0))
    per_lat, per_lon = F.lit(1 / METRES_PER_DEGREE), 1 / (METRES_PER_DEGREE * F.cos(F.radians(lat)))

    def corner(e: int, n: int) -> Column:
        east, north = half * (e * F.cos(turn) - n * F.sin(turn)), half * (e * F.sin(turn) + n * F.cos(turn))
        return F.struct((lon + east * per_lon).alias("lon"), (lat + north * per_lat).alias("lat"))

    return F.when((altitude_m > 0) & (focal_mm > 0) & valid_coordinates(lat, lon), F.array(*[corner(*c) for c in ((-1, 1), (1, 1), (1, -1), (-1, -1), (-1, 1))]))


def buffered(lat: Column, lon: Column, half: float = 0.025) -> Column:
    corner = lambda x, y: F.struct((lon + x * half).alias("lon"), (lat + y * half).alias("lat"))
    return F.array(*[corner(*c) for c in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])


def ground_sample(altitude_m: Column, focal_mm: Column, pixel_mm: Column) -> Column:
    """Metres a pixel."""
    return F.when(focal_mm > 0, pixel_mm * altitude_m / focal_mm)


def parse_polygon(wkt: Column) -> Column:
    """Array of (lon, lat) of a POLYGON text; null if it is none."""
    inner = F.nullif(F.regexp_extract(wkt, r"POLYGON\s*\(\(([^)]+)\)\)", 1), F.lit(""))
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.transform(F.split(inner, ","), lambda p: F.struct(F.get(pair(p), F.lit(0)).try_cast("double").alias("lon"), F.get(pair(p), F.lit(1)).try_cast("double").alias("lat")))


def bounds(points: Column) -> Column:
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("x0"), F.array_min(lat).alias("y0"), F.array_max(lon).alias("x1"), F.array_max(lat).alias("y1"))


def overlap(a: Column, b: Column) -> Column:
    """Share of box a that box b covers; 0 for an empty box."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    return F.coalesce(F.try_divide(w * h, (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])), F.lit(0.0))


STEREO_LEAST, STEREO_MOST = 0.3, 0.95


def stereo_pairs(frames: DataFrame, group: str, frame: str, iri: str, box: str = "box", cell: float | None = None) -> DataFrame:
    """(a, b, group, overlap): frames of one group, a before b, whose boxes overlap by 0.3 to 0.95 of a's.

    Range join: with a cell size, boxes meet only in the grid cells that they touch, so large groups are no all-pairs work;
    the pair is taken in the cell of its intersection's corner alone, so it is found once.
    """
    side = lambda x: frames.select(F.col(group).alias("grp"), F.col(frame).alias(f"{x}_f"), F.col(iri).alias(x), F.col(box).alias(f"{x}_box"))
    a, b = side("a"), side("b")
    keys = ["grp"]
    if cell:
        at = lambda v: F.floor(v / cell)

        def dealt(df, x):
            c = F.col(f"{x}_box")
            return df.withColumn("cx", F.explode(F.sequence(at(c["x0"]), at(c["x1"])))).withColumn("cy", F.explode(F.sequence(at(c["y0"]), at(c["y1"]))))

        a, b, keys = dealt(a, "a"), dealt(b, "b"), ["grp", "cx", "cy"]
    before = (F.col("a_f") < F.col("b_f")) | ((F.col("a_f") == F.col("b_f")) & (F.col("a") < F.col("b")))
    joined = a.join(b, keys).where(before)
    if cell:
        left, low = F.greatest(F.col("a_box.x0"), F.col("b_box.x0")), F.greatest(F.col("a_box.y0"), F.col("b_box.y0"))
        joined = joined.where((F.floor(left / cell) == F.col("cx")) & (F.floor(low / cell) == F.col("cy")))
    return joined.withColumn("overlap", overlap(F.col("a_box"), F.col("b_box"))).where(F.col("overlap").between(STEREO_LEAST, STEREO_MOST)).select("a", "b", F.col("grp").alias("group"), "overlap")


# dashboards and verification ---------------------------------------------------------------------


def distribution(df: DataFrame, key: Column, name: str = "value") -> DataFrame:
    """(name, n, percent) of a key."""
    counted = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counted.crossJoin(total).select(name, "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("percent"))  # total is one row


def self_assessment(g: Graph, constraints: list, tier_predicate: str) -> DataFrame:
    """(metric, value): triples, violations, and records of each tier."""
    tiers = g.with_predicate(tier_predicate).groupBy(F.concat(F.lit("tier:"), T.lex(F.col("o"))).alias("metric")).agg(F.count("*").alias("value"))
    total = g.quads.agg(F.count("*").alias("value")).select(F.lit("triples").alias("metric"), "value")
    bad = validate_shapes(g, constraints).agg(F.count("*").alias("value")).select(F.lit("violations").alias("metric"), "value")
    return total.unionByName(bad).unionByName(tiers)


def verify_references(references: DataFrame, known: DataFrame, expected: list[str]) -> DataFrame:
    """references (id, ref) with status: missing, wrong_type or ok; known: (ref, types array)."""
    joined = references.join(known, "ref", "left")
    status = F.when(F.col("types").isNull(), "missing").when(F.arrays_overlap("types", F.array(*[F.lit(x) for x in expected])), "ok").otherwise("wrong_type")
    return joined.select("id", "ref", status.alias("status"))


def manifests(df: DataFrame, id_col: str, label_col: str, base: str, metadata: list[str]) -> DataFrame:
    """(id, manifest): one JSON presentation manifest for each record."""
    uri = F.concat(F.lit(base), F.col(id_col).cast("string"))
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in metadata])
    body = F.struct(F.lit("Manifest").alias("type"), uri.alias("id"), F.col(label_col).cast("string").alias("label"), F.filter(pairs, lambda p: p["value"] != "").alias("metadata"))
    return df.select(F.col(id_col).alias("id"), F.to_json(body).alias("manifest"))


def records_to_graph(df: DataFrame, subject: Column, fields: list[tuple[str, Column]], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(triples, errors): records that lack a required column go to errors (s, missing), the rest become triples."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required]))
    marked = df.withColumn("__missing", missing).withColumn("__s", subject)
    errors = marked.where(F.size("__missing") > 0).select(F.col("__s").alias("s"), F.array_join("__missing", ",").alias("missing"))
    made = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in fields])
    triples = marked.where(F.size("__missing") == 0).select(F.col("__s").alias("s"), F.explode(made).alias("t")).select("s", "t.p", "t.o").where("o IS NOT NULL")
    return triples, errors


def grounding_degree(claims: DataFrame, g: Graph, structural: list[str] | None = None) -> DataFrame:
    """One row (claims, grounded, degree, coverage): shares of claims found in the graph, and of the graph's subjects claimed."""
    t = g.triples if structural is None else g.with_predicate(*structural)
    c = claims.select("s", "p", "o").distinct()
    met = c.join(t, ["s", "p", "o"], "left_semi")
    counts = c.agg(F.count("*").alias("claims")).crossJoin(met.agg(F.count("*").alias("grounded"), F.countDistinct("s").alias("touched"))).crossJoin(t.agg(F.countDistinct("s").alias("subjects")))  # one row each
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return counts.select("claims", "grounded", share("grounded", "claims").alias("degree"), share("touched", "subjects").alias("coverage"))


@dataclass
class Rule:
    """The first rule whose conditions hold decides; conditions map a column to its allowed values."""

    label: str
    reason: str
    conditions: dict[str, list[str]]


def cascade(df: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """df plus predicted and reason."""
    holds = lambda r: functools.reduce(Column.__and__, [F.coalesce(F.col(c).isin(*v), F.lit(False)) for c, v in r.conditions.items()])
    label = reason = None
    for r in rules:
        label = F.when(holds(r), r.label) if label is None else label.when(holds(r), r.label)
        reason = F.when(holds(r), r.reason) if reason is None else reason.when(holds(r), r.reason)
    return df.withColumns({"predicted": label.otherwise(default) if rules else F.lit(default), "reason": reason.otherwise("default") if rules else F.lit("default")})


def confusion(df: DataFrame, actual: str, predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n)."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def column_coverage(columns: DataFrame, names: DataFrame) -> DataFrame:
    """columns (column, keyword) with covered: whether any of names (name) holds the keyword, in any case."""
    hit = columns.join(names.select("name"), F.contains(F.lower(F.col("name")), F.lower(F.col("keyword")))).select("column").distinct().withColumn("covered", F.lit(True))
    return columns.select("column").distinct().join(hit, "column", "left").select("column", F.coalesce("covered", F.lit(False)).alias("covered"))


def all_parts_under(parts: DataFrame, g: Graph, top: str) -> DataFrame:
    """Wholes of parts (whole, part) of which every part is under the class top; wholes without parts are left out."""
    under = closure(g.triples.where(F.col("p") == T.SUBCLASS).select("s", "o")).where(F.col("o") == top).select(F.col("s").alias("cls")).union(g.spark.createDataFrame([(top,)], "cls string"))
    typed = g.triples.where(F.col("p") == T.TYPE).select(F.col("s").alias("part"), F.col("o").alias("cls")).join(under, "cls", "left_semi").select("part").distinct()
    fails = parts.join(typed, "part", "left_anti").select("whole").distinct()
    return parts.select("whole").distinct().join(fails, "whole", "left_anti")


def axiom_name(t: Column) -> Column:
    """A term's name for soft matching: local name, camel case split, lower case, separators to spaces."""
    c = F.regexp_replace(T.local(t), "([a-z])([A-Z])", "$1 $2")
    c = F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.translate(F.trim(F.lower(c)), "_-", "  ")


def axioms(g: Graph) -> DataFrame:
    """(kind, a, b) by name: subclassof, subproperty, domain, range, and disjoint pairs in either order, AllDisjointClasses too."""
    t = g.triples
    named = t.where(T.is_iri(F.col("s")) & T.is_iri(F.col("o")) & (F.col("s") != F.col("o")))
    w3 = lambda c: c.startswith("<http://www.w3.org/")
    labels = t.where((F.col("p") == T.LABEL) & T.lang_of(F.col("o")).isin("", "en")).groupBy(F.col("s").alias("x")).agg(F.min("o").alias("l"))
    out = [named.where((F.col("p") == p) & ~w3(F.col("s")) & ~w3(F.col("o"))).select(F.lit(k).alias("kind"), F.col("s").alias("a"), F.col("o").alias("b")) for p, k in ((T.SUBCLASS, "subclassof"), (T.SUBPROPERTY, "subproperty"))]
    props = t.where((F.col("p") == T.TYPE) & F.col("o").isin(T.OBJECT_PROPERTY, T.DATATYPE_PROPERTY)).select("s").distinct()
    out += [t.where((F.col("p") == p) & ~T.is_blank(F.col("o"))).join(props, "s", "left_semi").select(F.lit(k).alias("kind"), F.col("s").alias("a"), F.col("o").alias("b")) for p, k in ((T.DOMAIN, "domain"), (T.RANGE, "range"))]
    from graphloom.plans.reason import list_members

    pair = named.where(F.col("p") == T.DISJOINT).select(F.col("s").alias("a"), F.col("o").alias("b"))
    sets = t.where((F.col("p") == T.TYPE) & (F.col("o") == f"<{T.OWL}AllDisjointClasses>")).select("s")
    heads = t.where(F.col("p") == f"<{T.OWL}members>").join(sets, "s", "left_semi").select(F.col("o").alias("head"))
    members = list_members(t, heads).where(T.is_iri(F.col("member"))).select("head", "member")
    every = members.select("head", F.col("member").alias("a")).join(members.select("head", F.col("member").alias("b")), "head").where("a < b").select("a", "b")  # what the axiom states
    out.append(pair.union(every).select(F.lit("disjoint").alias("kind"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    rows = functools.reduce(DataFrame.unionByName, out).distinct()
    for c in ("a", "b"):
        rows = rows.join(labels.select(F.col("x").alias(c), F.col("l").alias(f"{c}_l")), c, "left").withColumn(f"{c}_n", F.coalesce(F.translate(F.trim(F.lower(T.lex(F.col(f"{c}_l")))), "_-", "  "), axiom_name(F.col(c))))
    low, high = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    disjoint = F.col("kind") == "disjoint"
    return rows.select("kind", F.when(disjoint, low).otherwise(F.col("a_n")).alias("a"), F.when(disjoint, high).otherwise(F.col("b_n")).alias("b")).distinct()
