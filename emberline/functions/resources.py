"""Equipment text -> resource categories -> normative rank, as native expressions.

Everything here is a per-row Column expression built from higher-order array
functions (``transform``/``filter``/``aggregate``) and literal maps, so parsing
and nearest-prototype ranking are map-only: no explode, no shuffle, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the source application's definitions)
# ---------------------------------------------------------------------------

# Numeric vehicle code -> resource category, in the source's order.
EQUIPMENT_CODES = [
    (11, "AC"), (49, "AC"), (52, "AC"), (53, "AC"), (54, "AC"), (55, "AC"), (56, "AC"),
    (57, "AC_T"), (58, "APS"), (59, "APS"), (60, "APS"), (61, "APS"), (45, "APP"), (14, "ANR"),
    (50, "ANVD"), (15, "APT"), (16, "AP"), (17, "AKT"), (35, "AGT"), (19, "AGVT"), (12, "PNS"),
    (44, "PPP"), (62, "PPP"), (18, "AA"), (63, "APS_T"), (64, "APS_TR"), (65, "APS_E"),
    (66, "PSAAM"), (67, "PNRK"), (68, "PANRK"), (69, "AC_L"), (23, "AL"), (24, "APK"), (70, "APKL"),
    (71, "ALC"), (72, "APKC"), (73, "APTM"), (43, "ASA"), (74, "AT"), (28, "ASO"), (27, "AG"),
    (33, "AR"), (26, "AD"), (75, "AOPT"), (51, "ABG"), (76, "PKS"), (29, "ASH"), (34, "ALP"),
    (77, "SPEKL"), (78, "AOS"), (79, "APRSS"), (80, "ADPT"), (25, "APTS"), (81, "PAKM"), (82, "AVZ"),
    (20, "TRAIN"), (21, "SHIP"), (22, "HELI"), (40, "PLANE"), (30, "MOTORPUMP"), (48, "ROBOT_G"),
    (13, "PNS_TRAILER"), (31, "CUSTOM"), (83, "ROBOT_A"), (84, "ROBOT_W"), (39, "SMOKE_EXTRACTOR"),
    (42, "TRACTOR"), (32, "OTHER"), (46, "RESCUE"), (47, "RESCUE_EQ"),
]

# Abbreviation searched (as a substring of the upper-cased token) -> category, first hit wins.
ABBREVIATIONS = [("АЦ", "AC"), ("АЦЛ", "AC"), ("АПС", "APS"), ("АЛ", "AL"), ("АР", "AR"), ("АГ", "AG")]

NORMATIVE_VERSION = "rank_resource_normatives_v1"

# The normative table: rank, label, display name, description, sort order,
# minimum equipment count, resource vector.
NORMATIVES = [
    (1.0, "1", "Ранг 1", "Минимальный выезд", 1, 1, {"AC": 1}),
    (1.5, "1-бис", "Ранг 1-бис", "Усиленный минимальный выезд", 2, 2, {"AC": 2}),
    (2.0, "2", "Ранг 2", "Два автоцистерны и автолестница", 3, 3, {"AC": 2, "AL": 1}),
    (3.0, "3", "Ранг 3", "Тактическое усиление", 4, 5, {"AC": 3, "AL": 1, "APS": 1}),
    (4.0, "4", "Ранг 4", "Высокий ранг усиления", 5, 8, {"AC": 4, "AL": 2, "APS": 1, "AG": 1}),
    (5.0, "5", "Ранг 5", "Максимальный ранг усиления", 6, 12, {"AC": 5, "AL": 2, "APS": 2, "AG": 1, "AR": 1}),
]

# Human-readable rank descriptions; other ranks read "Ранг <rank>".
RANK_DESCRIPTIONS = [
    (1.0, "Ранг 1 (1 единица техники)"),
    (1.5, "Ранг 1-бис (2 единицы техники)"),
    (2.0, "Ранг 2"),
    (3.0, "Ранг 3"),
    (4.0, "Ранг 4"),
    (5.0, "Ранг 5 (5+ единиц техники)"),
]

FLAG_MISSING = "missing_or_unparsed_resources"
FLAG_PARTIAL = "partially_unparsed_resources"
FLAG_CONFLICT = "resource_parse_conflict"
FLAG_MISSING_COUNT = "missing_resources"

# ---------------------------------------------------------------------------
# End of fixed values
# ---------------------------------------------------------------------------


def normative_categories(normatives=NORMATIVES) -> list[str]:
    """Sorted union of categories named by the normative vectors."""
    return sorted({k for row in normatives for k in row[6]})


def normative_maxima(normatives=NORMATIVES) -> dict[str, int]:
    out: dict[str, int] = {}
    for row in normatives:
        for k, v in row[6].items():
            out[k] = max(out.get(k, 0), v)
    return out


def _code_map() -> Column:
    return F.create_map(*[x for code, cat in EQUIPMENT_CODES for x in (F.lit(code), F.lit(cat))])


def tokens(c: Column | str) -> Column:
    """Comma/semicolon separated parts, stripped, empties dropped."""
    col = F.col(c) if isinstance(c, str) else c
    s = strip(col)
    parts = F.transform(F.split(s, "[,;]"), lambda t: strip(t))
    return F.when(s.isNull() | (s == "") | (F.lower(s) == "nan"), F.array().cast("array<string>")) \
        .otherwise(F.filter(parts, lambda t: t != ""))


def token_category(t: Column) -> Column:
    """Leading integer looked up in the code table, else the first abbreviation found."""
    code = F.regexp_extract(t, r"^([0-9]+)", 1)
    by_code = F.when(code != "", F.element_at(_code_map(), code.try_cast("bigint")))
    upper = F.upper(t)
    by_abbrev = F.lit(None).cast("string")
    for abbrev, cat in reversed(ABBREVIATIONS):
        by_abbrev = F.when(upper.contains(abbrev), F.lit(cat)).otherwise(by_abbrev)
    return F.coalesce(by_code, by_abbrev)


def token_categories(c: Column | str) -> Column:
    """array<string>: category per token (null = not recognised)."""
    return F.transform(tokens(c), token_category)


def equipment_map(c: Column | str) -> Column:
    """map<string,int> category -> count, keys in order of first appearance."""
    return equipment_map_from_categories(token_categories(c))


def equipment_map_from_categories(cats_with_nulls: Column) -> Column:
    cats = F.filter(cats_with_nulls, lambda x: x.isNotNull())
    return F.map_from_entries(F.transform(
        F.array_distinct(cats),
        lambda k: F.struct(k.alias("key"), F.size(F.filter(cats, lambda x: x == k)).alias("value"))))


def resource_vector(map_col: Column, categories: list[str] | None = None) -> Column:
    """Dense array<double> of counts over ``categories`` (normative ones by default).

    Built with one ``element_at`` per category rather than a lambda that captures
    the map: a captured column counts as a single reference for Catalyst's
    CollapseProject, which would then inline the upstream parse into the lambda
    and re-run it once per category.
    """
    return F.array(*[F.coalesce(F.element_at(map_col, F.lit(k)), F.lit(0)).cast("double")
                     for k in (categories or normative_categories())])


def normalise(vec: Column, categories: list[str] | None = None, maxima: dict[str, int] | None = None) -> Column:
    """Element-wise count / normative maximum, capped at 1 (0 where the maximum is 0)."""
    cats = categories or normative_categories()
    mx = maxima or normative_maxima()
    mxs = F.array(*[F.lit(float(mx.get(k, 1))) for k in cats])
    return F.zip_with(vec, mxs, lambda v, m: F.when(m > 0, F.least(v / m, F.lit(1.0))).otherwise(F.lit(0.0)))


def _prototype_matrix(normatives=NORMATIVES):
    """(per-category rows of prototype values, per-prototype (ord, rank)) in sort order."""
    cats = normative_categories(normatives)
    mx = normative_maxima(normatives)
    ordered = sorted(normatives, key=lambda r: r[4])
    protos = [[min(r[6].get(k, 0) / mx[k], 1.0) if mx[k] > 0 else 0.0 for k in cats] for r in ordered]
    by_cat = [[protos[j][i] for j in range(len(ordered))] for i in range(len(cats))]
    meta = [(r[4], float(r[0])) for r in ordered]
    return by_cat, meta


def nearest_from_norm(norm: Column, total: Column, normatives=NORMATIVES) -> Column:
    """struct<rank, distance> nearest to an already-normalised vector; null when ``total`` <= 0.

    ``norm`` is only ever an argument of ``zip_with`` (never captured by a
    lambda), so it is evaluated once per row. Squared differences are summed in
    category order, and ``array_min`` over (distance, sort order) keeps the
    earlier rank on exact ties.
    """
    by_cat, meta = _prototype_matrix(normatives)
    pm = F.array(*[F.array(*[F.lit(x) for x in row]) for row in by_cat])
    sq = F.zip_with(norm, pm, lambda a, row: F.transform(row, lambda b: (a - b) * (a - b)))
    zeros = F.array(*[F.lit(0.0) for _ in meta])
    sums = F.aggregate(sq, zeros, lambda acc, row: F.zip_with(acc, row, lambda u, v: u + v))
    info = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(r).alias("rank")) for o, r in meta])
    cands = F.zip_with(sums, info, lambda d, m: F.struct(F.sqrt(d).alias("distance"), m["ord"].alias("ord"),
                                                         m["rank"].alias("rank")))
    # struct<distance, ord, rank>: callers read .rank / .distance
    return F.when(total > 0, F.array_min(cands))


def vector_total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def nearest_rank(vec: Column, normatives=NORMATIVES) -> Column:
    """struct<rank double, distance double>: closest normative prototype.

    Euclidean distance in normalised space; ties keep the earlier sort order;
    an all-zero vector has no rank. Prefer :func:`nearest_from_norm` on a
    materialised normalised column inside wide plans.
    """
    cats = normative_categories(normatives)
    mx = normative_maxima(normatives)
    return nearest_from_norm(normalise(vec, cats, mx), vector_total(vec), normatives)


def rank_by_count(c: Column | str) -> Column:
    """struct<rank, distance> from the equipment count (auxiliary proxy)."""
    n = (F.col(c) if isinstance(c, str) else c).cast("double")
    rank = (F.when(n.isNull() | (n < 1), None)
            .when(n == 1, 1.0).when(n == 2, 1.5).when(n == 3, 2.0).when(n == 4, 3.0).when(n == 5, 4.0)
            .otherwise(5.0))
    dist = (F.when(n.isNull() | (n < 1), None)
            .when(n.isin(1, 2, 3, 4, 5), 0.0)
            .otherwise((n - 5) * 0.1))
    return F.struct(rank.alias("rank"), dist.alias("distance"))


def rank_from_resources(c: Column | str, normatives=NORMATIVES, null_as_rank1: bool = True) -> Column:
    """Rank whose minimum equipment count is nearest (ties -> lower rank); null -> 1.0."""
    n = (F.col(c) if isinstance(c, str) else c).cast("double")
    cands = [F.struct(F.abs(n - F.lit(float(r[5]))).alias("d"), F.lit(r[4]).alias("ord"), F.lit(float(r[0])).alias("rank"))
             for r in sorted(normatives, key=lambda r: r[4])]
    best = F.array_min(F.array(*cands))["rank"]
    return F.when(n.isNull(), F.lit(1.0) if null_as_rank1 else F.lit(None).cast("double")).otherwise(best)


def rank_description(c: Column | str) -> Column:
    r = (F.col(c) if isinstance(c, str) else c).cast("double")
    m = F.create_map(*[x for rank, text in RANK_DESCRIPTIONS for x in (F.lit(rank), F.lit(text))])
    return F.coalesce(F.element_at(m, r), F.concat(F.lit("Ранг "), r.cast("string")))


def rank_label(c: Column | str, normatives=NORMATIVES) -> Column:
    r = (F.col(c) if isinstance(c, str) else c).cast("double")
    m = F.create_map(*[x for row in normatives for x in (F.lit(float(row[0])), F.lit(row[1]))])
    return F.element_at(m, r)


def json_string_list(arr: Column) -> Column:
    """JSON text of a string array with ``", "`` separators; null when empty."""
    body = F.array_join(F.transform(arr, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    return F.when(F.size(arr) > 0, F.concat(F.lit("["), body, F.lit("]")))
