"""Cleaning and normalising messy register columns, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgauge.operators.ordering import medians, running_total

# Spellings of "no figure published".
NO_VALUE = ("", "-", "n/a", "na", "..", ".", "null", "[x]", "[z]")
# Council words dropped before names are compared.
COUNCIL_WORDS = (
    "city of|county of|royal borough of|london borough of|district|borough|council|ua|the|city"
)
COUNCIL_PREFIXES = "^(city of |royal borough of |london borough of )"
# Grid-site words dropped before substation names are compared.
SITE_WORDS = (
    "grid supply point", "supply point", "substation", "switching", "station", "s/s", "gsp",
    "bsp", "grid", "no.", "number",
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
METRES_PER_STOREY = 3.2
HEIGHT_RANGE = (1.5, 400.0)


# ---- headers ---------------------------------------------------------------


def _squash(name: str) -> str:
    return re.sub(r"\s+", " ", name.replace("﻿", "")).strip().lower()


def match_column(columns: Sequence[str], candidates: Sequence[str], contains: bool = False) -> str | None:
    """First candidate that equals a header; then, if asked, one contained in a header.

    A candidate wrapped in slashes is a regular expression for the whole header.
    """
    seen = {_squash(c): c for c in columns}
    for cand in candidates:
        if cand.startswith("/") and cand.endswith("/"):
            hit = next((c for s, c in seen.items() if re.fullmatch(cand[1:-1], s)), None)
        else:
            hit = seen.get(_squash(cand))
        if hit is not None:
            return hit
    if contains:
        for cand in candidates:
            hit = next((c for s, c in seen.items() if _squash(cand) in s), None)
            if hit is not None:
                return hit
    return None


def resolve_columns(
    df: DataFrame, wanted: dict[str, Sequence[str]], contains: bool = False, required: Sequence[str] = ()
) -> DataFrame:
    """Selects the canonical columns found in `df`; missing optional ones become null."""
    out = []
    for canon, candidates in wanted.items():
        hit = match_column(df.columns, candidates, contains)
        if hit is None and canon in required:
            raise ValueError(f"no column for {canon!r} among {df.columns}")
        out.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(canon))
    return df.select(*out)


# ---- numbers, flags, dates -------------------------------------------------


def parse_number(col: Column, positive: bool = False) -> Column:
    text = F.lower(F.trim(col))
    bare = F.regexp_replace(text, r"[,£\s]|m$", "")
    value = F.when(~text.isin(*NO_VALUE), bare.try_cast("double"))
    ok = ~F.isnan(value) & (F.abs(value) < float("inf"))
    if positive:
        ok = ok & (value > 0)
    return F.when(ok, value)


def first_int(col: Column) -> Column:
    digits = F.regexp_extract(col, r"\d[\d,]*", 0)
    return F.regexp_replace(digits, ",", "").try_cast("bigint")


def parse_bool(col: Column) -> Column:
    text = F.lower(F.trim(col))
    return F.when(text.isin("true", "t", "1", "yes", "y"), True).when(
        text.isin("false", "f", "0", "no", "n"), False
    )


def parse_iso_date(col: Column) -> Column:
    text = F.trim(col)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def parse_yymmdd(col: Column, pivot: int = 60) -> Column:
    yy = F.substring(col, 1, 2)
    century = F.when(yy.try_cast("int") < pivot, "20").otherwise("19")
    return F.when(col.rlike(r"^\d{6}$"), F.try_to_date(F.concat(century, col), "yyyyMMdd"))


def month_key(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def clock_seconds(col: Column) -> Column:
    """HH:MM:SS to seconds; hours may pass 24."""
    p = F.split(F.trim(col), ":")
    return F.when(
        F.trim(col).rlike(r"^\d{1,2}:\d{2}:\d{2}$"),
        p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int"),
    )


def hhmm_minutes(col: Column) -> Column:
    """HHMM, with H for a half minute, to minutes; 0000 and blanks mean no time."""
    text = F.regexp_extract(F.trim(col), r"^(\d{4})H?$", 1)
    whole = F.substring(text, 1, 2).try_cast("int") * 60 + F.substring(text, 3, 2).try_cast("int")
    return F.when((text != "") & (text != "0000"), whole)


# ---- names, keys, ids ------------------------------------------------------


def _spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def norm_name(col: Column, profile: str = "alnum") -> Column:
    low = F.lower(F.trim(col))
    if profile == "alnum":
        return F.regexp_replace(low, "[^a-z0-9]", "")
    if profile == "station":
        low = F.regexp_replace(low, r"\(.*?\)", " ")
        low = F.regexp_replace(low, r"\b(rail|railway)?\s*station\b", " ")
        return _spaces(F.regexp_replace(low, "[^a-z0-9]+", " "))
    if profile == "authority":
        return F.regexp_replace(low, COUNCIL_PREFIXES, "")
    if profile == "council":
        low = F.regexp_replace(low, "[^a-z0-9 ]", " ")
        low = F.regexp_replace(low, rf"\b({COUNCIL_WORDS})\b", " ")
        return _spaces(F.regexp_replace(low, " and ", " "))
    if profile == "gridsite":
        plain = F.regexp_replace(low, "|".join(re.escape(w) for w in SITE_WORDS), " ")
        return F.regexp_replace(plain, r"\b\d+\s*k?v\b|[^a-z0-9]+", "")
    raise ValueError(profile)


def norm_postcode(col: Column, spaced: bool = False) -> Column:
    bare = F.upper(F.regexp_replace(col, r"\s+", ""))
    if not spaced:
        return bare
    return F.when(
        F.length(bare) > 3, F.concat(F.expr("''"), bare.substr(F.lit(1), F.length(bare) - 3), F.lit(" "), F.right(bare, F.lit(3)))
    ).otherwise(bare)


def address_key(*parts: Column) -> Column:
    return F.regexp_replace(F.upper(F.concat_ws(" ", *parts)), "[^A-Z0-9]", "")


def address_keys(saon: Column, paon: Column, street: Column) -> Column:
    """Preference-ordered keys: a flat needs its unit, a house may match on street or number."""
    flat = F.array(address_key(saon, paon, street), address_key(saon, paon))
    house = F.array(address_key(paon, street), address_key(paon))
    keys = F.when(F.coalesce(F.trim(saon), F.lit("")) != "", flat).otherwise(house)
    return F.filter(keys, lambda k: k != "")


def slug(col: Column, sep: str = "_") -> Column:
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", sep), F.lit(sep))


def stable_id(dataset: str, geom_text: Column) -> Column:
    digest = F.md5(F.concat(F.lit(dataset), F.lit("|"), geom_text))
    return F.concat(F.lit(f"{dataset}-"), F.substring(digest, 1, 16))


def suffix_duplicates(df: DataFrame, id_col: str, order: str, tie: str) -> DataFrame:
    """Second and later rows of an id become id-2, id-3 ... in arrival order."""
    counted = running_total(df, [id_col], order, tie, F.lit(1), "_nth")
    renamed = F.when(F.col("_nth") > 1, F.concat_ws("-", F.col(id_col), F.col("_nth")))
    return counted.withColumn(id_col, F.coalesce(renamed, F.col(id_col).cast("string"))).drop("_nth")


def hash_jitter(id_col: Column) -> tuple[Column, Column]:
    """Deterministic offsets (degrees) from the first two digest bytes of the id."""
    h = F.md5(id_col.cast("string"))

    def byte(at: int) -> Column:
        return F.conv(F.substring(h, at, 2), 16, 10).cast("double")

    return (byte(1) / 255 - 0.5) * 0.0004, (byte(3) / 255 - 0.5) * 0.00025


# ---- tags ------------------------------------------------------------------


def _tag_parts(col: Column) -> Column:
    return F.filter(F.split(F.trim(col), r"\s*;\s*"), lambda p: p != "")


def parse_height(col: Column) -> Column:
    """Tallest of the ;-separated heights, in metres (feet converted)."""

    def one(p: Column) -> Column:
        text = F.lower(F.trim(p))
        metres = F.regexp_extract(text, r"^([\d.]+)\s*(m|metres?|meters?)?$", 1).try_cast("double")
        feet = F.regexp_extract(text, r"^([\d.]+)\s*(ft|feet|')$", 1).try_cast("double")
        return F.coalesce(metres, feet * 0.3048)

    return F.array_max(F.transform(_tag_parts(col), one))


def parse_levels(col: Column) -> Column:
    nums = F.transform(
        _tag_parts(col), lambda p: F.regexp_replace(p, r"[^\d.]", "").try_cast("double")
    )
    return F.array_max(F.filter(nums, lambda n: n > 0))


def height_storeys(height: Column, levels: Column) -> tuple[Column, Column]:
    """Each measure stands in for the other; absurd heights lose both."""
    h = F.coalesce(height, F.round(levels * METRES_PER_STOREY, 1))
    s = F.coalesce(levels, F.round(height / METRES_PER_STOREY))
    ok = (h > HEIGHT_RANGE[0]) & (h < HEIGHT_RANGE[1])
    return F.when(ok, F.round(h, 1)), F.when(ok, F.floor(s).cast("int"))


def parse_kv(col: Column) -> Column:
    """Largest of a ;-separated voltage list, volts to kV."""
    volts = F.transform(_tag_parts(col), lambda p: F.trim(p).try_cast("double"))
    return F.array_max(volts) / 1000


def hstore_get(col: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(col, f'"{re.escape(key)}"=>"([^"]*)"', 1), F.lit(""))


# ---- coordinates in text ---------------------------------------------------


def parse_point_text(col: Column) -> tuple[Column, Column]:
    """(first, second) number of 'lat, lon' text or of WKT POINT(x y)."""
    number = r"(-?\d+\.?\d*)"
    wkt = rf"(?i)point\s*\(\s*{number}\s+{number}\s*\)"
    pair = rf"{number}[,;\s]+{number}"

    def part(i: int) -> Column:
        return F.coalesce(
            F.regexp_extract(col, wkt, i).try_cast("double"),
            F.regexp_extract(col, pair, i).try_cast("double"),
        )

    return part(1), part(2)


def in_bounds(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


GB_BOX = (-8.7, 49.8, 1.9, 60.9)
GRID_BOX = (0.0, 0.0, 700_000.0, 1_300_000.0)


def coordinate_system(x: Column, y: Column) -> Column:
    """grid | lonlat | latlon by magnitude; null outside the country."""
    return (
        F.when((F.abs(x) > 1000) & in_bounds(x, y, GRID_BOX), "grid")
        .when(in_bounds(x, y, GB_BOX), "lonlat")
        .when(in_bounds(y, x, GB_BOX), "latlon")
    )


# ---- units, json, text -----------------------------------------------------


def infer_scale(
    df: DataFrame, col: str, rules: Sequence[tuple[float, float]], plausible: tuple[float, float]
) -> DataFrame:
    """Rescales `col` by the first (limit, factor) whose limit the median is under.

    The median is one exact row, inlined as a scalar subquery; a column whose
    rescaled median is implausible becomes null (refused).
    """
    med = medians(df.select(F.lit(0).alias("_k"), col), ["_k"], {"v": F.col(col)}).select("v_med").scalar()
    out = df.withColumn("_med", med)
    factor = F
    for limit, times in rules:
        factor = factor.when(F.col("_med") <= limit, F.lit(float(times)))
    factor = factor.otherwise(F.lit(1.0))
    scaled = F.when((F.col("_med") * factor).between(*plausible), F.col(col) * factor)
    return out.withColumn(col, scaled).drop("_med")


def json_number(doc: Column, key: str) -> Column:
    """A JSON number, or a numeric string, under `key`; anything else is null."""
    text = F.get_json_object(doc, f"$.{key}")
    return F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), text.try_cast("double"))


def props_merge(left: Column, right: Column) -> Column:
    """Right wins; needs spark.sql.mapKeyDedupPolicy=LAST_WIN (set by the session helper)."""
    return F.map_concat(left, right)


def props_drop(props: Column, *keys: str) -> Column:
    return F.map_filter(props, lambda k, v: ~k.isin(*keys))


def props_project(props: Column, *keys: str) -> Column:
    return F.map_filter(props, lambda k, v: k.isin(*keys))


def props_strip_nulls(props: Column) -> Column:
    return F.map_filter(props, lambda k, v: v.isNotNull())


def tidy_text(col: Column, n: int | None = None, title: bool = False) -> Column:
    text = _spaces(col)
    if n:
        text = F.substring(text, 1, n)
    if title:
        text = F.initcap(text)
    return F.nullif(text, F.lit(""))


# How far into its year a period mark lies, in order of precedence; quarters come before them all.
PERIOD_MARKS = {
    "h1": 0.45, "h2": 0.9, "end": 0.9,
    **{month: (i + 1) / 12 for i, month in enumerate(MONTHS)},
}


def period_score(col: Column) -> Column:
    """Rough decimal year of a free-text period; forecasts score 0, no year means 2000.

    The first year and the first quarter of the text count ("Q4 2024 / Q1 2025" is late 2024).
    """
    text = F.coalesce(F.lower(col), F.lit(""))
    year = F.coalesce(F.regexp_extract(text, r"20\d\d", 0).try_cast("double"), F.lit(2000.0))
    quarter = F.regexp_extract(text, "q([1-4])", 1).try_cast("double") * 0.25 - 0.1
    shares = F.create_map(*[F.lit(x) for mark, share in PERIOD_MARKS.items() for x in (mark, share)])
    # the first mark of the table that the text has
    found = F.filter(F.array(*[F.lit(mark) for mark in PERIOD_MARKS]), lambda mark: F.contains(text, mark))
    within = F.coalesce(quarter, shares[F.get(found, F.lit(0))], F.lit(0.0))
    return F.when(F.contains(text, F.lit("forecast")), F.lit(0.0)).otherwise(year + within)
