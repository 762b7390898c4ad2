"""Issues, events and claims of a run as DataFrames: union, counts, order, search, and how they are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities of issue codes that are no warnings.
SEVERITY = {"INPUT_NOT_FOUND": "fatal", "NO_FILES_FOUND": "fatal", "ZIP_LIMIT_EXCEEDED": "fatal", "EXCEL_CORRUPT": "error", "INTERNAL_ERROR": "error"}
INFO = ("UNSUPPORTED_FILE", "ENCODING_FALLBACK", "README_MULTIPLE", "CONFLICTING_METADATA", "EXCEL_HIDDEN_SHEET", "EXCEL_EMPTY_SHEET", "DOCUMENTED_VARIABLE_INTENTIONALLY_ABSENT", "DOCUMENTED_VARIABLE_IN_OTHER_FILE", "DOCUMENTATION_UNASSIGNED", "DECLARED_ROWS_MISMATCH")


def severity(code: str) -> str:
    return SEVERITY.get(code, "info" if code in INFO else "warning")


def union(found: dict[str, DataFrame]) -> DataFrame:
    """(code, severity, location) of the rows found under each code."""
    parts = [rows.select(F.lit(code).alias("code"), F.lit(severity(code)).alias("severity"), "location") for code, rows in found.items()]
    return reduce(DataFrame.unionByName, parts)


def severities(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def numbered(events: DataFrame, run: str, order: str) -> DataFrame:
    """Adds seq, the number of each event within its run."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(order)).cast("long"))


def progress(events: DataFrame, run: str, order: str, weight: str) -> DataFrame:
    """(run, order, done): the weights of a run's events summed up to each."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.select(run, order, F.sum(weight).over(w).alias("done"))


def stage_totals(events: DataFrame) -> DataFrame:
    """(stage, runs, total) of events (stage, ms)."""
    return events.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("ms"), 4).alias("total"))


def claim(stated: Column, found: Column) -> Column:
    """agree, differ or not stated."""
    return F.when(stated.isNull() | found.isNull(), "not stated").when(stated == found, "agree").otherwise("differ")


def search(rows: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Rows that hold the words in one of the columns, in any case."""
    return rows.filter(reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(words.lower())) for c in columns]))


def as_json(rows: DataFrame) -> DataFrame:
    """(json): each row as one JSON object."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def run_summary(variables: DataFrame, accept: float = 0.85) -> DataFrame:
    """Counts of datasets, variables, matched and undocumented ones of variables (dataset_id, confidence, documented)."""
    return variables.agg(F.count_distinct("dataset_id").alias("datasets"), F.count(F.lit(1)).alias("variables"), F.count_if(F.col("confidence") >= accept).alias("matched"), F.count_if(~F.col("documented")).alias("undocumented"))


def dashboard(variables: DataFrame, by: str, review: float = 0.95) -> DataFrame:
    """Pending and all variables and their median confidence by a column."""
    return variables.groupBy(by).agg(F.count_if(F.col("confidence") < review).alias("pending"), F.count(F.lit(1)).alias("total"), F.round(F.percentile("confidence", 0.5), 6).alias("median_confidence"))
