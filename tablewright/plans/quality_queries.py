"""Queries of the core problems on table data (p2, p4, p6) and their SQL twins."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tablewright.operators import badrows, quality, units
from tablewright.session import remove, shared_dir
from tablewright.sources.tables import table


def _from_counts(spark: SparkSession, sf: str, read) -> DataFrame:
    """read(cells, variables, path) over a value-count table in the shared folder, which goes once the result is kept."""
    path = f"{shared_dir(spark)}/value_counts_{uuid.uuid4().hex}"
    out = read(table(spark, sf, "table_cells"), table(spark, sf, "dataset_variables"), path).checkpoint()
    remove(spark, path)
    return out


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _from_counts(spark, sf, quality.quality_checks)


def p6_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _from_counts(spark, sf, quality.full_profile)


def _p4_tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, name) for name in ("raw_rows", "dataset_structures", "dataset_variables")]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return badrows.failed_rows(*_p4_tables(spark, sf)).select("dataset_id", "line_no", "reason")


def p4_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """The records that load, as cells."""
    return badrows.loaded_rows(*_p4_tables(spark, sf))


def _p2_tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, name) for name in ("dataset_variables", "column_contexts", "variable_definitions", "unit_list")]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return units.other_units(*_p2_tables(spark, sf))


def p2_converted(spark: SparkSession, sf: str) -> DataFrame:
    """Every variable's statistics in the common unit."""
    return units.common_statistics(*_p2_tables(spark, sf))


def _dates(sql: str) -> str:
    """Writes out <DATE x>: x as yyyymmdd if it is a real date in exactly the format form, else null."""
    spread = "replace(replace(replace(form,'%Y','YYYY'),'%m','MM'),'%d','DD')"
    part = lambda x, mark, size: f"substr({x}, instr({spread}, '{mark}'), {size})"
    shape = f"regexp_replace(regexp_replace(replace({spread},'.','\\.'),'YYYY','[0-9]{{4}}'),'MM|DD','[0-9]{{2}}','g')"
    return re.sub(
        r"<DATE (\w+)>",
        lambda m: f"CASE WHEN regexp_full_match({m[1]}, {shape}) AND try_cast({part(m[1], 'YYYY', 4)} || '-' || {part(m[1], 'MM', 2)} || '-' || {part(m[1], 'DD', 2)} AS DATE) IS NOT NULL "
        f"THEN CAST({part(m[1], 'YYYY', 4)} || {part(m[1], 'MM', 2)} || {part(m[1], 'DD', 2)} AS DOUBLE) END",
        sql,
    )


_VALUES = r"""
WITH v AS (SELECT DISTINCT dataset_id, pos, load_no, coalesce(lower(var_type),'string') AS kind, coalesce(var_format,'default') AS form,
             coalesce(missing_values, []) AS tokens, coalesce(var_role,'') AS role, stat_missing, stat_distinct, trim(stat_min) AS smin, trim(stat_max) AS smax
           FROM dataset_variables),
c AS (SELECT DISTINCT dataset_id, pos, load_no, row_no, coalesce(trim(raw, ' '), '') AS value FROM table_cells),
g AS (SELECT dataset_id, pos, load_no, value, count(*) AS n FROM c GROUP BY ALL),
j AS (SELECT g.*, kind, form, (value = '' OR list_contains(tokens, value)) AS miss,
        CASE kind
          WHEN 'integer' THEN CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN try_cast(value AS DOUBLE) END
          WHEN 'number' THEN CASE WHEN regexp_full_match(value, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(value AS DOUBLE) END
          WHEN 'date' THEN <DATE value>
        END AS x FROM g JOIN v USING (dataset_id, pos, load_no)),
k AS (SELECT *, NOT miss AND CASE kind WHEN 'integer' THEN x IS NOT NULL WHEN 'number' THEN x IS NOT NULL WHEN 'date' THEN x IS NOT NULL
        WHEN 'boolean' THEN lower(value) IN ('true','t','yes','y','false','f','no','n')
        ELSE form = 'default' OR regexp_full_match(value, form) END AS good FROM j),
p AS (SELECT dataset_id, pos, load_no, any_value(kind) AS kind, any_value(form) AS form, sum(n)::BIGINT AS cells, coalesce(sum(n) FILTER (miss), 0)::BIGINT AS missing,
        count(*) FILTER (NOT miss) AS uniq, coalesce(sum(n) FILTER (NOT miss AND NOT good), 0)::BIGINT AS misfits,
        min(x) FILTER (good) AS low, max(x) FILTER (good) AS high, coalesce(sum(n) FILTER (good), 0) AS fitting,
        sum(n * x) FILTER (good) / sum(n) FILTER (good) AS mean, sum(n * x * x) FILTER (good) AS squares,
        sum(CASE WHEN NOT miss THEN n * log2(n) ELSE 0 END) AS nlogn FROM k GROUP BY dataset_id, pos, load_no)
"""

P6_FOUND = (
    _VALUES
    + r""",
q AS (SELECT p.*, role, stat_missing, stat_distinct, smin, smax FROM p JOIN v USING (dataset_id, pos, load_no)),
lim AS (SELECT *, CASE kind WHEN 'date' THEN <DATE smin>
           ELSE CASE WHEN regexp_full_match(smin, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') AND (kind <> 'integer' OR regexp_full_match(smin, '[+-]?[0-9]+')) THEN try_cast(smin AS DOUBLE) END END AS bmin,
         CASE kind WHEN 'date' THEN <DATE smax>
           ELSE CASE WHEN regexp_full_match(smax, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') AND (kind <> 'integer' OR regexp_full_match(smax, '[+-]?[0-9]+')) THEN try_cast(smax AS DOUBLE) END END AS bmax FROM q),
sh AS (SELECT a.dataset_id, a.pos, coalesce(a.load_no, b.load_no + 1) AS load_no, a.value, a.n AS n1, b.n AS n0 FROM (SELECT * FROM k WHERE good) a LEFT JOIN (SELECT * FROM k WHERE good) b
        ON a.dataset_id = b.dataset_id AND a.pos = b.pos AND a.value = b.value AND a.load_no = b.load_no + 1
       UNION ALL SELECT b.dataset_id, b.pos, b.load_no + 1, b.value, 0, b.n FROM (SELECT * FROM k WHERE good) b),
st AS (SELECT DISTINCT sh.dataset_id, sh.pos, sh.load_no FROM sh JOIN p c ON c.dataset_id = sh.dataset_id AND c.pos = sh.pos AND c.load_no = sh.load_no
        JOIN p o ON o.dataset_id = sh.dataset_id AND o.pos = sh.pos AND o.load_no = sh.load_no - 1
        WHERE (c.kind = 'boolean' OR (c.kind = 'string' AND c.form = 'default')) AND c.fitting >= 10 AND o.fitting >= 10
          AND (n1 > 0 AND abs(n1 / c.fitting - coalesce(n0, 0) / o.fitting) > 0.5
            OR n1 = 0 AND abs(coalesce((SELECT any_value(n) FROM k z WHERE z.good AND z.dataset_id = sh.dataset_id AND z.pos = sh.pos AND z.load_no = sh.load_no AND z.value = sh.value), 0) / c.fitting - n0 / o.fitting) > 0.5))
SELECT DISTINCT dataset_id, pos, load_no, check_name FROM (
  SELECT dataset_id, pos, load_no, 'missing' AS check_name FROM lim WHERE stat_missing <> missing
  UNION ALL SELECT dataset_id, pos, load_no, 'distinct' FROM lim WHERE stat_distinct <> uniq
  UNION ALL SELECT dataset_id, pos, load_no, 'min' FROM lim WHERE kind IN ('integer','number','date') AND smin IS NOT NULL AND bmin IS DISTINCT FROM low
  UNION ALL SELECT dataset_id, pos, load_no, 'max' FROM lim WHERE kind IN ('integer','number','date') AND smax IS NOT NULL AND bmax IS DISTINCT FROM high
  UNION ALL SELECT dataset_id, pos, load_no, 'pattern' FROM lim WHERE misfits > 0
  UNION ALL SELECT a.dataset_id, a.pos, a.load_no, 'shift' FROM lim a JOIN lim b ON a.dataset_id = b.dataset_id AND a.pos = b.pos AND b.load_no = a.load_no - 1
    WHERE a.role <> 'identifier' AND (abs(a.missing / a.cells - b.missing / b.cells) > 0.25
      OR a.kind IN ('integer','number') AND a.fitting >= 10 AND b.fitting >= 10 AND (b.squares - b.fitting * b.mean * b.mean) > 0
         AND abs(a.mean - b.mean) > 2 * sqrt((b.squares - b.fitting * b.mean * b.mean) / (b.fitting - 1)))
  UNION ALL SELECT st.dataset_id, st.pos, st.load_no, 'shift' FROM st JOIN v USING (dataset_id, pos, load_no) WHERE role <> 'identifier')
"""
)
P6_PROFILE = (
    _VALUES
    + """SELECT dataset_id, pos, load_no, cells AS n_cells, missing AS n_missing, uniq AS n_distinct, misfits AS n_misfits,
  round(CASE WHEN cells > missing THEN log2(cells - missing) - nlogn / (cells - missing) END, 4) AS entropy_bits FROM p"""
)

_ROWS = r"""
WITH d AS (SELECT DISTINCT dataset_id, CASE WHEN lower(delimiter) = 'tab' THEN chr(9) ELSE delimiter END AS dl, quote_char AS qc, coalesce(header_row, 0) AS hr, field_count AS fc FROM dataset_structures),
v AS (SELECT DISTINCT ON (dataset_id, pos) dataset_id, pos, lower(var_type) AS kind, coalesce(var_format, 'default') AS form, coalesce(missing_values, []) AS tokens FROM dataset_variables ORDER BY dataset_id, pos, load_no DESC),
l AS (SELECT DISTINCT dataset_id, line_no, raw_line, dl, qc, fc, CASE WHEN dl IS NULL THEN '' ELSE '[' || CASE WHEN dl = chr(9) THEN chr(9) ELSE dl END || ']' END AS dr,
        CASE WHEN dl IS NULL THEN '(?s:.)' ELSE '[^' || dl || ']' END AS nd
      FROM raw_rows JOIN d USING (dataset_id) WHERE line_no > hr AND regexp_replace(coalesce(raw_line, ''), '\s', '', 'g') <> ''),
f AS (SELECT *, CASE WHEN qc IS NULL THEN nd || '*' ELSE '(?:' || qc || '(?:[^' || qc || ']|' || qc || qc || ')*' || qc || '|[^' || qc || coalesce(dl, '') || ']' || nd || '*|)' END AS fld FROM l),
r AS (SELECT *, regexp_full_match(raw_line, fld || '(?:' || dr || fld || ')*') AS sound FROM f),
e AS (SELECT *, CASE WHEN sound THEN regexp_extract_all(dl || raw_line, dr || fld) END AS parts FROM r),
u AS (SELECT dataset_id, line_no, fc, sound, len(parts) AS n, unnest(list_transform(parts, lambda x: x[2:])) AS part, generate_subscripts(parts, 1) AS pos, qc FROM e WHERE sound AND len(parts) = fc),
w AS (SELECT u.dataset_id, u.line_no, u.pos, CASE WHEN qc IS NOT NULL AND part[1] = qc THEN replace(part[2:-2], qc || qc, qc) ELSE part END AS raw FROM u),
t AS (SELECT w.*, kind, form, tokens, trim(raw, ' ') AS value FROM w JOIN v USING (dataset_id, pos)),
bad AS (SELECT DISTINCT dataset_id, line_no FROM t WHERE value <> '' AND NOT list_contains(tokens, value) AND NOT coalesce(CASE kind
   WHEN 'integer' THEN regexp_full_match(value, '[+-]?[0-9]+') WHEN 'number' THEN regexp_full_match(value, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')
   WHEN 'boolean' THEN lower(value) IN ('true','t','yes','y','false','f','no','n') WHEN 'date' THEN <DATE value> IS NOT NULL
   ELSE form = 'default' OR regexp_full_match(value, form) END, false))
"""
P4_FOUND = (
    _ROWS
    + """SELECT dataset_id, line_no, 'quoting' AS reason FROM e WHERE NOT sound
UNION ALL SELECT dataset_id, line_no, 'field_count' FROM e WHERE sound AND len(parts) <> fc
UNION ALL SELECT dataset_id, line_no, 'value' FROM bad"""
)
P4_LOADED = _ROWS + "SELECT dataset_id, line_no, pos, raw FROM w ANTI JOIN bad USING (dataset_id, line_no)"

QUERIES = {"p2_found": p2_found, "p2_converted": p2_converted, "p4_found": p4_found, "p4_loaded": p4_loaded, "p6_found": p6_found, "p6_profile": p6_profile}
ORACLE = {"p4_found": _dates(P4_FOUND), "p4_loaded": _dates(P4_LOADED), "p6_found": _dates(P6_FOUND), "p6_profile": _dates(P6_PROFILE)}
