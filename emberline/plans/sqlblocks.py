"""DuckDB-dialect building blocks for the oracle SQL of every registered query.

These strings are the independent, set-based statement of each operator's
semantics that the driver runs next to the Spark plan. They are generated from
the same fixed column lists and lookup tables as the Spark side so both read
the same definitions, but the logic is written out in SQL.
"""

from __future__ import annotations

from .. import schema as S
from ..functions import resources as R
from ..functions.text import HOURS_ONLY_PATTERN, TIME_PATTERN

INCIDENT_VIEW = r"""
li AS (
  SELECT l_orderkey, count(*) AS n_units,
         string_agg(code, ', ' ORDER BY code) AS equipment
  FROM (SELECT l_orderkey,
               CASE l_partkey % 8 WHEN 0 THEN '23' WHEN 1 THEN '58' WHEN 2 THEN '27' WHEN 3 THEN '33'
                    WHEN 4 THEN 'АЦ-40' WHEN 5 THEN '11' WHEN 6 THEN '52'
                    ELSE CASE WHEN l_suppkey % 20 = 0 THEN '999' ELSE '49' END END AS code
        FROM lineitem) t
  GROUP BY l_orderkey),
base AS (
  SELECT o.o_orderkey AS row_id,
    CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE concat(cast(100 + c.c_nationkey AS varchar), ' (', n.n_name, ')') END AS region,
    CASE WHEN o.o_orderkey % 97 = 0 THEN cast(o.o_orderdate AS date) ELSE cast(o.o_orderdate + INTERVAL 60 MONTH AS date) END AS fire_date,
    o.o_orderpriority AS settlement_type,
    concat(cast(10 + o.o_custkey % 12 AS varchar), ' (', c.c_mktsegment, ')') AS enterprise_type,
    CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE cast(1 + o.o_orderkey % 30 AS double) END AS building_floors,
    CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE cast((o.o_orderkey * 7) % 26 - 1 AS double) END AS fire_floor,
    CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE cast((o.o_custkey % 140) AS double) / 8 END AS distance_to_station,
    CASE WHEN o.o_orderkey % 5 = 0 THEN cast(o.o_custkey % 3 AS double) END AS fatalities,
    CASE WHEN o.o_orderkey % 4 = 0 THEN cast(o.o_custkey % 5 AS double) END AS injuries,
    CASE WHEN o.o_orderkey % 3 = 0 THEN NULL WHEN o.o_orderkey % 50 = 1 THEN 0.0 ELSE o.o_totalprice END AS direct_damage,
    concat(lpad(cast(o.o_orderkey % 25 AS varchar), 2, '0'), ':', lpad(cast(o.o_custkey % 62 AS varchar), 2, '0')) AS t_detect,
    concat(lpad(cast(o.o_orderkey % 24 AS varchar), 2, '0'), ':', lpad(cast((o.o_custkey + 5) % 60 AS varchar), 2, '0')) AS t_report,
    concat(lpad(cast(o.o_orderkey % 24 AS varchar), 2, '0'), ':', lpad(cast((o.o_custkey + 17) % 60 AS varchar), 2, '0'),
           CASE WHEN o.o_orderkey % 7 = 0 THEN ':00' ELSE '' END) AS t_arrival,
    concat(cast(1 + o.o_custkey % 4 AS varchar), ' (', o.o_orderstatus, ')') AS fire_protection,
    CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE cast(o.o_custkey % 40 AS varchar) END AS source_item,
    c.c_name AS object_name, c.c_mktsegment AS address,
    li.equipment,
    CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE cast(li.n_units + CASE WHEN o.o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS double) END AS equipment_count
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey),
incidents AS (
  SELECT 'БД-1...2000--2020 (1+2)' AS source_sheet, 0 AS sheet_ord, base.*,
         cast(row_id % 4 AS double) AS nozzle_count FROM base
  UNION ALL
  SELECT CASE WHEN row_id % 2 = 0 THEN '1...2000-2008' ELSE '2...2009-2020' END AS source_sheet, 1 AS sheet_ord, base.*,
         cast(row_id % 4 + CASE WHEN row_id % 20 = 0 THEN 1 ELSE 0 END AS double) AS nozzle_count
  FROM base WHERE row_id % 5 = 0)"""

VIEW_COLUMNS = ["source_sheet", "sheet_ord", "row_id", "region", "fire_date", "settlement_type", "enterprise_type",
                "building_floors", "fire_floor", "distance_to_station", "fatalities", "injuries", "direct_damage",
                "t_detect", "t_report", "t_arrival", "fire_protection", "source_item", "object_name", "address",
                "equipment", "equipment_count", "nozzle_count"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def first_int(x: str) -> str:
    t = f"regexp_extract(cast({x} AS varchar), '([0-9]+)', 1)"
    return f"(CASE WHEN {t} <> '' THEN TRY_CAST({t} AS DOUBLE) END)"


def norm_text(x: str) -> str:
    return f"lower({strip(f'cast({x} AS varchar)')})"


def norm_free_text(x: str) -> str:
    return f"coalesce(regexp_replace(lower({strip(f'cast({x} AS varchar)')}), '\\s+', ' ', 'g'), '')"


def time_minutes(x: str) -> str:
    s = strip(x)
    h = f"TRY_CAST(regexp_extract({s}, '{TIME_PATTERN}', 1) AS INTEGER)"
    m = f"TRY_CAST(regexp_extract({s}, '{TIME_PATTERN}', 2) AS INTEGER)"
    ho = f"TRY_CAST({s} AS INTEGER)"
    return (f"(CASE WHEN {x} IS NULL THEN NULL "
            f"WHEN regexp_matches({s}, '{TIME_PATTERN}') THEN CASE WHEN {h} < 24 AND {m} < 60 THEN {h} * 60 + {m} END "
            f"WHEN regexp_matches({s}, '{HOURS_ONLY_PATTERN}') THEN CASE WHEN {ho} < 24 THEN {ho} * 60 END END)")


def time_invalid(x: str) -> str:
    s = strip(x)
    h = f"TRY_CAST(regexp_extract({s}, '{TIME_PATTERN}', 1) AS INTEGER)"
    m = f"TRY_CAST(regexp_extract({s}, '{TIME_PATTERN}', 2) AS INTEGER)"
    ho = f"TRY_CAST({s} AS INTEGER)"
    return (f"(CASE WHEN {x} IS NULL THEN false "
            f"WHEN regexp_matches({s}, '{TIME_PATTERN}') THEN ({h} >= 24 OR {m} >= 60) "
            f"WHEN regexp_matches({s}, '{HOURS_ONLY_PATTERN}') THEN {ho} >= 24 ELSE true END)")


def source_priority(x: str) -> str:
    name = f"lower({strip(f'coalesce({x}, {q(str())})')})"
    whens = " ".join(f"WHEN contains({name}, {q(k)}) THEN {v}" for k, v in S.SOURCE_PRIORITY)
    return f"(CASE {whens} ELSE {S.DEFAULT_SOURCE_PRIORITY} END)"


def sheet_period(x: str) -> str:
    whens = " ".join(f"WHEN starts_with({x}, {q(k)}) THEN {q(v)}" for k, v in S.PERIOD_BY_PREFIX)
    return f"(CASE {whens} ELSE 'other' END)"


def falsy(cond: str) -> str:
    return f"coalesce({cond}, false)"


def stage1() -> str:
    """CTE ``stage1``: typed, flagged incidents (before the data-dependent steps)."""
    raw = [c for c in S.EN_COLS]
    view = set(VIEW_COLUMNS)
    # columns missing from the view are null text, like the Spark side's ensure_columns
    src = ", ".join([*(c for c in VIEW_COLUMNS), *(f"CAST(NULL AS varchar) AS {c}" for c in raw if c not in view)])
    year = "year(fire_date)"
    outlier = falsy(f"({year} < {S.MIN_YEAR} OR {year} > {S.MAX_YEAR})")
    passthrough = [c for c in ["source_sheet", "sheet_ord", *raw] if c not in set(S.NUM_COLS) | {"fire_date"}]
    cols = list(passthrough)
    cols += [f"CASE WHEN NOT {outlier} THEN fire_date END AS fire_date",
             f"CASE WHEN NOT {outlier} THEN {year} END AS year",
             f"CASE WHEN NOT {outlier} THEN month(fire_date) END AS month",
             f"{outlier} AS flag_date_outlier"]
    for c in S.CODE_COLS:
        cols += [f"{first_int(c)} AS {c}_code", f"{norm_text(c)} AS {c}_text"]
    for c in S.NUM_COLS:
        if c in ("equipment_count", "nozzle_count"):
            cols.append(f"{first_int(c)} AS {c}")
        else:
            cols.append(f"TRY_CAST({c} AS DOUBLE) AS {c}")
    for c in S.TIME_COLS:
        cols += [f"{time_minutes(c)} AS {c}_min", f"{time_invalid(c)} AS {c}_invalid"]
    neg = " OR ".join(falsy(f"{c} < 0") for c in S.NUM_COLS)
    tinv = " OR ".join(f"{c}_invalid" for c in S.TIME_COLS)
    dlog = "CASE WHEN direct_damage > -1 THEN ln(1 + direct_damage) END"
    allmiss = "(fatalities IS NULL AND injuries IS NULL AND direct_damage IS NULL)"
    return (f"raw_in AS (SELECT {src} FROM incidents),\n"
            f"s1a AS (SELECT {', '.join(cols)} FROM raw_in),\n"
            f"stage1 AS (SELECT *, {dlog} AS direct_damage_log,\n"
            f"  CASE WHEN NOT {allmiss} THEN coalesce(fatalities, 0) * 5 + coalesce(injuries, 0) * 2 + ({dlog}) END AS severity_score,\n"
            f"  {falsy(f'building_floors > {S.MAX_FLOORS}')} AS flag_floor_outlier,\n"
            f"  {falsy(f'distance_to_station > {S.MAX_DISTANCE}')} AS flag_distance_outlier,\n"
            f"  {falsy('fire_floor > building_floors')} AS flag_floor_inconsistent,\n"
            f"  ({neg}) AS flag_negative_values,\n"
            f"  ({tinv}) AS flag_time_invalid,\n"
            f"  {allmiss} AS flag_missing_outputs FROM s1a)")


def cleaned() -> str:
    """CTEs ``sev_q``, ``dmg_q`` and ``cleaned`` (requires ``stage1``)."""
    return (
        "sev_q AS (SELECT quantile_cont(severity_score, 0.25) AS q25, quantile_cont(severity_score, 0.5) AS q50,\n"
        "  quantile_cont(severity_score, 0.75) AS q75 FROM stage1 WHERE severity_score > 0),\n"
        f"dmg_q AS (SELECT quantile_cont(direct_damage, {S.DAMAGE_OUTLIER_QUANTILE}) AS lim FROM stage1),\n"
        "cleaned AS (SELECT stage1.*,\n"
        "  CASE WHEN severity_score = 0 THEN 1.0 WHEN severity_score > 0 THEN\n"
        "    CASE WHEN severity_score <= q25 THEN 2.0 WHEN severity_score <= q50 THEN 3.0\n"
        "         WHEN severity_score <= q75 THEN 4.0 ELSE 5.0 END END AS rank_ref,\n"
        "  coalesce(direct_damage > lim, false) AS flag_damage_outlier\n"
        "  FROM stage1, sev_q, dmg_q)")


def _int_text(x: str) -> str:
    return f"coalesce(cast(trunc(cast({x} AS double))::BIGINT AS varchar), '')"


def identity(src: str = "cleaned", order_cols=("sheet_ord", "row_id"), prefix: str = "", where: str = "true") -> str:
    """CTEs ``<prefix>idk0/idk/grp/ident`` over ``src`` (event identity + duplicate policy)."""
    p = prefix
    parts = [_int_text("row_id"), "coalesce(strftime(fire_date, '%Y-%m-%d'), '')", _int_text("year"),
             _int_text("region_code"), _int_text("settlement_type_code"), _int_text("enterprise_type_code"),
             _int_text("building_floors"), _int_text("fire_floor"), norm_free_text("object_name"),
             norm_free_text("address")]
    present = " + ".join(f"(CASE WHEN {x} <> '' THEN 1 ELSE 0 END)" for x in parts)
    full = "concat_ws('|', " + ", ".join(parts) + ")"
    fb = "concat_ws('|', " + ", ".join(parts[1:]) + ")"
    compl = " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in S.COMPLETENESS_COLUMNS)
    order = ", ".join(order_cols)
    fp = "CASE WHEN event_id_low_confidence THEN _fb_fp ELSE _full_fp END"
    conflict = " OR ".join(f"count(DISTINCT {c}) > 1" for c in S.CONFLICT_FIELDS)
    return (
        f"{p}idk0 AS (SELECT *, ({present}) < {S.LOW_CONFIDENCE_MIN_PARTS} AS event_id_low_confidence,\n"
        f"  {full} AS _full_fp, {fb} AS _fb_fp, ({compl}) AS _completeness,\n"
        f"  {source_priority('source_sheet')} AS source_priority FROM {src} WHERE {where}),\n"
        f"{p}idk AS (SELECT * EXCLUDE (_full_fp, _fb_fp), {fp} AS event_fingerprint,\n"
        f"  CASE WHEN regexp_replace({fp}, '^\\|+|\\|+$', '', 'g') <> '' THEN 'evt_' || substr(sha256({fp}), 1, 24) END AS event_id,\n"
        "  CASE WHEN regexp_replace(_fb_fp, '^\\|+|\\|+$', '', 'g') <> '' THEN 'dup_' || substr(sha256(_fb_fp), 1, 24) END\n"
        f"       AS duplicate_group_id FROM {p}idk0),\n"
        f"{p}grp AS (SELECT duplicate_group_id AS _gid, count(*) AS _gsize, ({conflict}) AS _gconflict\n"
        f"  FROM {p}idk WHERE duplicate_group_id IS NOT NULL GROUP BY duplicate_group_id),\n"
        f"{p}ident AS (SELECT * EXCLUDE (_completeness, _gid, _gsize, _gconflict),\n"
        "  coalesce(CASE WHEN duplicate_group_id IS NULL THEN false ELSE\n"
        f"    row_number() OVER (PARTITION BY duplicate_group_id ORDER BY _completeness DESC, source_priority DESC, {order}) = 1 END, false)\n"
        "    AS is_canonical_event_record,\n"
        "  CASE WHEN _gconflict THEN 'conflict_kept' WHEN _gsize > 1 THEN 'canonical_event_only' ELSE 'unique' END AS duplicate_policy\n"
        f"  FROM {p}idk LEFT JOIN {p}grp ON duplicate_group_id = _gid)")


def _code_map() -> str:
    return "MAP {" + ", ".join(f"{code}: {q(cat)}" for code, cat in R.EQUIPMENT_CODES) + "}"


def token_category(t: str) -> str:
    code = f"regexp_extract({t}, '^([0-9]+)', 1)"
    abbrev = " ".join(f"WHEN contains(upper({t}), {q(a)}) THEN {q(c)}" for a, c in R.ABBREVIATIONS)
    return (f"coalesce(CASE WHEN {code} <> '' THEN {_code_map()}[TRY_CAST({code} AS BIGINT)] END, "
            f"CASE {abbrev} END)")


def parsed(src: str, text: str = "equipment", declared: str = "equipment_count") -> str:
    """CTEs ``pz0``/``parsed``: per-row tokens, categories, counts, diagnostics."""
    s = strip(f"cast({text} AS varchar)")
    toks = (f"CASE WHEN {s} IS NULL OR {s} = '' OR lower({s}) = 'nan' THEN []::varchar[] ELSE "
            f"list_filter(list_transform(string_split_regex({s}, '[,;]'), lambda t: {strip('t')}), lambda t: t <> '') END")
    cats = R.normative_categories()
    mx = R.normative_maxima()
    dense = ", ".join(f"cast(len(list_filter(_cats, lambda x: x = {q(k)})) AS double) AS _n_{k}" for k in cats)
    return (
        f"pz0 AS (SELECT *, {s} IS NULL OR {s} = '' AS _empty, {toks} AS _toks FROM {src}),\n"
        f"pz1 AS (SELECT *, list_transform(_toks, lambda t: {token_category('t')}) AS _cats,\n"
        f"  cast({declared} AS double) AS resource_count_declared FROM pz0),\n"
        f"pz2 AS (SELECT *, len(_toks) AS _nparts, len(list_filter(_cats, lambda x: x IS NOT NULL)) AS _parsed, {dense} FROM pz1),\n"
        "pz3 AS (SELECT *, CASE WHEN _nparts > 0 THEN _parsed / _nparts ELSE 0.0 END AS _ratio,\n"
        "  abs(_parsed - resource_count_declared) AS _delta,\n"
        "  coalesce(abs(_parsed - resource_count_declared) > 0.01, false) AS _conflict FROM pz2),\n"
        "parsed AS (SELECT *,\n"
        "  (_empty OR _parsed = 0) AS _f_missing, (NOT _empty AND _parsed > 0 AND _ratio < 1.0) AS _f_partial,\n"
        "  (NOT _empty AND _conflict) AS _f_conflict,\n"
        "  round(CASE WHEN _empty OR _parsed = 0 THEN 0.0 WHEN _conflict THEN _ratio * 0.5 ELSE _ratio END, 4)\n"
        "    AS resource_parse_confidence,\n"
        "  CASE WHEN _empty THEN 0 ELSE _parsed END AS resource_count_parsed,\n"
        "  CASE WHEN NOT _empty THEN cast(_delta AS double) END AS resource_count_conflict,\n"
        + ",\n".join(f"  least(_n_{k} / {float(mx[k])}, 1.0) AS _v_{k}" for k in cats) + "\n"
        "  FROM pz3)")


def flags_json() -> str:
    items = [("_f_missing", R.FLAG_MISSING), ("_f_partial", R.FLAG_PARTIAL), ("_f_conflict", R.FLAG_CONFLICT)]
    arr = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(v)} END" for c, v in items) + "], lambda x: x IS NOT NULL)"
    return (f"CASE WHEN len({arr}) > 0 THEN '[' || array_to_string(list_transform({arr}, lambda x: '\"' || x || '\"'), ', ') || ']' END")


def ranked(src: str = "parsed") -> str:
    """CTE ``ranked``: nearest normative rank per parsed row (R7, R9 vector)."""
    cats = R.normative_categories()
    mx = R.normative_maxima()
    dists = []
    for row in sorted(R.NORMATIVES, key=lambda r: r[4]):
        proto = row[6]
        terms = " + ".join(f"(_v_{k} - {min(proto.get(k, 0) / mx[k], 1.0)!r}) * (_v_{k} - {min(proto.get(k, 0) / mx[k], 1.0)!r})"
                           for k in cats)
        dists.append(f"sqrt({terms})")
    ranks = [float(r[0]) for r in sorted(R.NORMATIVES, key=lambda r: r[4])]
    whens = []
    for i, d in enumerate(dists):
        conds = [f"_d{i} <= _d{j}" for j in range(i + 1, len(dists))]
        whens.append(f"WHEN {' AND '.join(conds) if conds else 'true'} THEN {ranks[i]!r}")
    total = " + ".join(f"_n_{k}" for k in cats)
    return (
        f"rk0 AS (SELECT *, " + ", ".join(f"{d} AS _d{i}" for i, d in enumerate(dists)) + f", ({total}) AS _vsum FROM {src}),\n"
        "rk1 AS (SELECT *, (_f_missing OR _f_partial) AS _blocked,\n"
        f"  CASE WHEN _vsum > 0 THEN CASE {' '.join(whens)} END END AS _near_rank,\n"
        f"  CASE WHEN _vsum > 0 THEN least({', '.join(f'_d{i}' for i in range(len(dists)))}) END AS _near_dist FROM rk0),\n"
        "ranked AS (SELECT *, CASE WHEN NOT _blocked THEN _near_rank END AS rank_tz_vector,\n"
        "  CASE WHEN NOT _blocked THEN _near_dist END AS rank_distance,\n"
        f"  {flags_json()} AS resource_parse_flags_json,\n"
        "  coalesce(is_canonical_event_record, true) AND NOT _blocked AND NOT _f_conflict AND _near_rank IS NOT NULL\n"
        "    AS usable_for_training FROM rk1)")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
