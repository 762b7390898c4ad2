"""Queries on column types, profiles and name matching (D, E, F, H), each with its SQL twin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.config import COMMON_MISSING, SENTINELS, SPREADSHEET_ERRORS
from tablewright.functions import text as T
from tablewright.operators import histogram as H
from tablewright.operators import matching as M
from tablewright.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


_TOKENS = ", ".join("'" + t + "'" for t in (*COMMON_MISSING, *SPREADSHEET_ERRORS) if t)
_BOOL = "('true','t','yes','y','false','f','no','n')"
_NUM = r"'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?'"

_COLUMNS = {
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:s",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:s o_orderpriority:s",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
}


def _columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in _COLUMNS[name].split()]


def hist_sql(*names: str) -> str:
    """The value histogram in SQL."""
    parts = []
    for name in names:
        for pos, (c, kind) in enumerate(_columns(name), 1):
            text = {"d": f"CAST(CAST({c} AS DECIMAL(24,4)) AS VARCHAR)", "i": f"CAST({c} AS VARCHAR)"}.get(kind, f"CAST({c} AS VARCHAR)")
            parts.append(f"SELECT '{name}' AS dataset_id, {pos} AS pos, '{c}' AS name, nullif(trim({text}), '') AS value FROM {name}")
    return f"cells AS ({' UNION ALL '.join(parts)}), hist AS (SELECT dataset_id, pos, name, value, count(*) AS n FROM cells GROUP BY ALL), pres AS (SELECT * FROM hist WHERE value IS NOT NULL AND value NOT IN ({_TOKENS}))"


def hist(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [H.histogram_of(table(spark, sf, n), n, [c for c, _ in _columns(n)]) for n in names])


@query("e01_profile_lineitem", f"WITH {hist_sql('lineitem')} SELECT dataset_id, pos, name, sum(n)::BIGINT AS cells, coalesce(sum(n) FILTER (value IS NULL OR value IN ({_TOKENS})), 0)::BIGINT AS missing, count(DISTINCT value) FILTER (value NOT IN ({_TOKENS})) AS distinct_values FROM hist GROUP BY ALL")
def e01(spark, sf):
    return H.census(hist(spark, sf, "lineitem"))


@query("e02_numeric_stats", f"WITH {hist_sql('lineitem', 'part')}, x AS (SELECT *, value::DOUBLE AS x FROM pres WHERE regexp_full_match(value, {_NUM})), m AS (SELECT dataset_id, pos, name, sum(n)::BIGINT AS count, min(x) AS min, max(x) AS max, sum(x*n)/sum(n) AS m FROM x GROUP BY ALL) SELECT m.dataset_id, m.pos, m.name, count, min, max, round(m, 5) AS mean, round(sqrt((SELECT sum(n*(x-m.m)^2) FROM x WHERE x.dataset_id = m.dataset_id AND x.pos = m.pos)/(count-1)), 6) AS std FROM m")
def e02(spark, sf):
    return H.numeric_stats(hist(spark, sf, "lineitem", "part")).withColumn("mean", F.round("mean", 5))


@query("e04_top_values", f"WITH {hist_sql('orders', 'customer')}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, pos ORDER BY n DESC, value) AS rank FROM pres) SELECT dataset_id, pos, name, value, n, rank FROM r WHERE rank <= 10")
def e04(spark, sf):
    return H.top_values(hist(spark, sf, "orders", "customer"))


@query("e05_quartiles", "SELECT event_type, quantile_cont(value::DOUBLE, 0.25) AS q1, quantile_cont(value::DOUBLE, 0.5) AS median, quantile_cont(value::DOUBLE, 0.75) AS q3 FROM events GROUP BY event_type")
def e05(spark, sf):
    numbers = table(spark, sf, "events").groupBy("event_type", F.col("value").cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return H.quartiles(numbers, ["event_type"])


_SENT = ", ".join(str(s) for s in SENTINELS)


@query("e06_sentinels", f"WITH x AS (SELECT event_type AS name, CASE WHEN event_id % 97 = 0 THEN -999.0 WHEN event_id % 89 = 0 THEN -9.0 ELSE round(value::DOUBLE, 2) END AS x FROM events), o AS (SELECT name, count(*) AS others, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM x WHERE x NOT IN ({_SENT}) GROUP BY name) SELECT x.name, x.x AS sentinel, count(*) AS n FROM x JOIN o USING (name) WHERE x.x IN ({_SENT}) AND others >= 4 AND abs(x.x - m) > 10 * greatest(iqr, 1e-9) GROUP BY ALL")
def e06(spark, sf):
    e = table(spark, sf, "events")
    x = F.when(F.col("event_id") % 97 == 0, -999.0).when(F.col("event_id") % 89 == 0, -9.0).otherwise(F.round(F.col("value").cast("double"), 2))
    c = e.select(F.lit("events").alias("dataset_id"), F.crc32(F.col("event_type").cast("binary")).alias("pos"), F.col("event_type").alias("name"), x.cast("string").alias("value"))
    return H.sentinel_report(H.histogram(c)).select("name", "sentinel", "n")


_TYPES = f"""a AS (SELECT dataset_id, pos, name, sum(n)::BIGINT AS total, count(*) AS dist, bool_and(lower(value) IN {_BOOL}) AS b, bool_and(regexp_full_match(value, '[+-]?[0-9]+') AND try_cast(value AS BIGINT) IS NOT NULL) AS i,
  bool_and(regexp_full_match(value, {_NUM})) AS f, bool_or(regexp_full_match(value, '0[0-9]+')) AS z, bool_and(regexp_full_match(value, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') AND try_cast(value AS DATE) IS NOT NULL) AS d, bool_and(regexp_full_match(value, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}} [0-9]{{1,2}}:[0-9]{{1,2}}:[0-9]{{1,2}}') AND try_cast(value AS TIMESTAMP) IS NOT NULL) AS dt FROM pres GROUP BY ALL),
t AS (SELECT *, CASE WHEN b THEN 'boolean' WHEN i AND NOT z THEN 'integer' WHEN f AND NOT z THEN 'number' WHEN dt THEN 'datetime' WHEN d THEN 'date' ELSE 'string' END AS type FROM a)"""


@query("d10_infer_types", f"WITH {hist_sql('orders', 'part', 'customer', 'lineitem')}, {_TYPES} SELECT dataset_id, pos, name, type, CASE type WHEN 'boolean' THEN 'categorical' WHEN 'integer' THEN CASE WHEN dist = total THEN 'identifier' ELSE 'measure' END WHEN 'number' THEN 'measure' WHEN 'date' THEN 'temporal' WHEN 'datetime' THEN 'temporal' ELSE CASE WHEN dist <= 20 AND dist < total THEN 'categorical' WHEN dist = total THEN 'identifier' ELSE 'text' END END AS role, CASE type WHEN 'date' THEN '%Y-%m-%d' WHEN 'datetime' THEN '%Y-%m-%d %H:%M:%S' END AS format FROM t")
def d10(spark, sf):
    return H.infer_types(hist(spark, sf, "orders", "part", "customer", "lineitem")).select(*H.KEY, "name", "type", "role", "format")


_SPOILED = "CASE c_custkey % 11 WHEN 0 THEN 'NA' WHEN 1 THEN ' n/a ' WHEN 2 THEN '' WHEN 3 THEN '#REF!' ELSE CAST(c_nationkey AS VARCHAR) END"


def _spoiled(spark, sf):
    k = F.col("c_custkey") % 11
    raw = F.when(k == 0, "NA").when(k == 1, " n/a ").when(k == 2, "").when(k == 3, "#REF!").otherwise(F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", raw.alias("raw"))


@query("d01_not_missing", f"SELECT c_custkey, trim({_SPOILED}) AS value FROM customer WHERE trim({_SPOILED}) NOT IN ('', {_TOKENS})")
def d01(spark, sf):
    rows = _spoiled(spark, sf).select("c_custkey", F.trim("raw").alias("value"))
    return H.present(rows.withColumn("value", F.nullif("value", F.lit(""))))


@query("d02_typed_nulls", f"SELECT c_custkey, CASE WHEN trim({_SPOILED}) IN ('', {_TOKENS}) THEN NULL ELSE CAST(trim({_SPOILED}) AS BIGINT) END AS raw FROM customer")
def d02(spark, sf):
    return H.typed(_spoiled(spark, sf).withColumn("c_custkey", F.col("c_custkey").cast("string")), {"c_custkey": "integer", "raw": "integer"})


@query("d06_cast_tests", f"WITH {hist_sql('orders', 'part')} SELECT dataset_id, pos, name, bool_and(regexp_full_match(value, {_NUM})) AS all_numbers, bool_and(lower(value) IN {_BOOL}) AS all_boolean, bool_or(regexp_full_match(value, '0[0-9]+')) AS leading_zero, bool_and(regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS all_iso_dates FROM pres GROUP BY ALL")
def d06(spark, sf):
    v = F.col("value")
    return H.present(hist(spark, sf, "orders", "part")).groupBy(*H.KEY, "name").agg(
        F.every(H.is_number(v)).alias("all_numbers"), F.every(F.lower(v).isin(*H.BOOLEAN_WORDS)).alias("all_boolean"), F.bool_or(v.rlike(H.LEADING_ZERO)).alias("leading_zero"),
        F.every(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).alias("all_iso_dates"),
    )


@query("d11_missing_tokens", f"WITH r AS (SELECT nullif(trim({_SPOILED}), '') AS value FROM customer) SELECT count(*) FILTER (value IS NULL OR value IN ({_TOKENS})) AS missing, (SELECT string_agg(DISTINCT value, '|' ORDER BY value) FROM r WHERE value IN ({_TOKENS})) AS tokens FROM r")
def d11(spark, sf):
    c = _spoiled(spark, sf).select(F.lit("customer").alias("dataset_id"), F.lit(1).alias("pos"), F.lit("raw").alias("name"), F.nullif(F.trim("raw"), F.lit("")).alias("value"))
    return H.missing_census(H.histogram(c)).select("missing", "tokens")


@query("d12_blocking_examples", f"WITH {hist_sql('orders', 'part')}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, pos ORDER BY value) AS r FROM pres WHERE NOT regexp_full_match(value, {_NUM})) SELECT dataset_id, pos, name, string_agg(value, '|' ORDER BY value) AS examples FROM r WHERE r <= 5 GROUP BY ALL")
def d12(spark, sf):
    return H.blocking_examples(hist(spark, sf, "orders", "part"))


_OVER = "SELECT 'orders' AS ds, 'custkey' AS norm, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION SELECT 'customer', 'custkey', CAST(c_custkey AS VARCHAR) FROM customer UNION SELECT 'lineitem', 'suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem UNION SELECT 'supplier', 'suppkey', CAST(s_suppkey AS VARCHAR) FROM supplier UNION SELECT 'customer', 'nationkey', CAST(c_nationkey AS VARCHAR) FROM customer UNION SELECT 'supplier', 'nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier"


@query("f27_value_overlap", f"WITH k AS ({_OVER}), s AS (SELECT ds, norm, count(*) AS size FROM k GROUP BY ALL) SELECT a.ds AS a, b.ds AS b, a.norm, count(*) AS common, round(count(*) / least(any_value(sa.size), any_value(sb.size)), 3) AS overlap FROM k a JOIN k b ON a.norm = b.norm AND a.v = b.v AND a.ds < b.ds JOIN s sa ON sa.ds = a.ds AND sa.norm = a.norm JOIN s sb ON sb.ds = b.ds AND sb.norm = b.norm GROUP BY a.ds, b.ds, a.norm HAVING count(*) / least(any_value(sa.size), any_value(sb.size)) >= 0.2")
def f27(spark, sf):
    parts = []
    for name, own in (("orders", {"o_custkey": "Cust_Key"}), ("customer", {"c_custkey": "custkey", "c_nationkey": "nation key"}), ("lineitem", {"l_suppkey": "supp.key"}), ("supplier", {"s_suppkey": "suppkey", "s_nationkey": "nationkey"})):
        t = table(spark, sf, name)
        parts.append(H.histogram_of(t.select(*[F.col(c).alias(n) for c, n in own.items()]), name))
    return H.shared_variables(reduce(DataFrame.unionByName, parts))


@query("f28_canonical_values", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(CAST(p_size AS DOUBLE) AS VARCHAR) WHEN 1 THEN CAST(CAST(p_size AS DOUBLE) AS VARCHAR) ELSE 'size ' || p_size END AS v FROM part")
def f28(spark, sf):
    k, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    raw = F.when(k == 0, s).when(k == 1, F.concat(s, F.lit(".00"))).otherwise(F.concat(F.lit(" size "), s))
    return table(spark, sf, "part").select("p_partkey", H.canonical_value(raw).alias("v"))


# Names: columns are the table columns, definitions are derived from nations and regions.
_DEFS = "SELECT n_nationkey AS definition_pos, CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN replace(n_name, ' ', '_') || ' (cm)' WHEN 3 THEN substr(n_name, 1, 3) || 'x' || substr(n_name, 4) ELSE 'zz' || n_name END AS name FROM nation"


def _pairs(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey") % 5
    name = (
        F.when(k == 0, F.col("n_name")).when(k == 1, F.lower("n_name")).when(k == 2, F.concat(F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(" (cm)")))
        .when(k == 3, F.concat(F.substring("n_name", 1, 3), F.lit("x"), F.expr("substring(n_name, 4)"))).otherwise(F.concat(F.lit("zz"), "n_name"))
    )
    columns = n.select(F.lit("d").alias("dataset_id"), F.col("n_name").alias("column"), F.col("n_nationkey").cast("int").alias("column_pos"))
    definitions = n.select(F.lit("d").alias("dataset_id"), name.alias("name"), F.col("n_nationkey").cast("int").alias("definition_pos"))
    return columns, definitions


_NORM = lambda c: f"lower(regexp_replace(regexp_replace(strip_accents({c}), '\\s*[(\\[][^()\\[\\]]*[)\\]]\\s*$', ''), '[\\s_\\-.]+', '', 'g'))"


@query("f12_assignment")
def f12(spark, sf):
    return M.match(*_pairs(spark, sf))


@query("h04_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def h04(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf, "orders").select("o_custkey"))


# Summaries.
