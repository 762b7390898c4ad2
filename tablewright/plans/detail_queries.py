"""Queries on single steps of typing and scoping, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import histogram as H
from tablewright.operators import linking as L
from tablewright.plans.table_queries import _TYPES, hist, hist_sql
from tablewright.sources import files
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


@query("a05_magic", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'ole' ELSE 'none' END AS kind FROM documents")
def a05(spark, sf):
    k = F.col("doc_id") % 4
    mark = F.when(k == 0, F.unhex(F.lit("255044462D"))).when(k == 1, F.unhex(F.lit("504B0304"))).when(k == 2, F.unhex(F.lit("D0CF11E0"))).otherwise(F.unhex(F.lit("61626364")))
    content = F.concat(mark, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", files.magic_kind(content).alias("kind"))




@query("d07_all_in_set", f"WITH {hist_sql('lineitem', 'orders')} SELECT dataset_id, pos, bool_and(value IN ('A','N','R','F','O','P')) AS coded FROM pres GROUP BY ALL")
def d07(spark, sf):
    return H.present(hist(spark, sf, "lineitem", "orders")).groupBy(*H.KEY).agg(F.every(F.col("value").isin("A", "N", "R", "F", "O", "P")).alias("coded"))


@query("d08_leading_zeros", f"WITH {hist_sql('part', 'customer')} SELECT dataset_id, pos, bool_or(regexp_full_match(value, '0[0-9]+')) AS zeros FROM pres GROUP BY ALL")
def d08(spark, sf):
    return H.present(hist(spark, sf, "part", "customer")).groupBy(*H.KEY).agg(F.bool_or(F.col("value").rlike(H.LEADING_ZERO)).alias("zeros"))


@query("d13_text_roles", f"WITH {hist_sql('customer', 'part')}, {_TYPES} SELECT dataset_id, pos, CASE WHEN dist <= 20 AND dist < total THEN 'categorical' WHEN dist = total THEN 'identifier' ELSE 'text' END AS role FROM t WHERE type = 'string'")
def d13(spark, sf):
    return H.infer_types(hist(spark, sf, "customer", "part")).filter("type = 'string'").select(*H.KEY, "role")


@query("f22_best_sheet", "WITH s AS (SELECT DISTINCT repo_id, dataset_id, worksheet_name, header_confidence AS c FROM dataset_structures WHERE worksheet_name IS NOT NULL), r AS (SELECT *, lead(c, 1, -1) OVER w AS next, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY repo_id ORDER BY c DESC)) SELECT repo_id, worksheet_name AS sheet, c AS coverage FROM r WHERE r = 1 AND c > next")
def f22(spark, sf):
    s = table(spark, sf, "dataset_structures").filter("worksheet_name is not null").select(F.lit("g").alias("group_id"), F.col("repo_id").alias("file"), "dataset_id", F.col("worksheet_name").alias("sheet"), F.col("header_confidence").alias("coverage")).distinct()
    return L.best_sheet(s).select(F.col("file").alias("repo_id"), "sheet", "coverage")


