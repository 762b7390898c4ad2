"""Human review as overlays: a queue of uncertain matches, decisions and edits, and the finished version of the matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The decisions that each kind of item allows.
ALLOWED = {"low_confidence": ("accept", "reject"), "ambiguous": ("accept", "reject"), "undocumented_column": ("acknowledge",), "phantom_variable": ("acknowledge",)}
EDITABLE = ("name", "description", "unit", "type", "role", "documented_name", "missing_values", "format")
TYPES = ("string", "integer", "number", "boolean", "date", "datetime", "time")
ROLES = ("identifier", "categorical", "measure", "temporal", "text")


def review_queue(matches: DataFrame, phantoms: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(item_id, dataset_id, kind, subject): every match that is not sure, and every phantom."""
    sure = (F.col("status") == "matched") & (F.col("confidence") >= threshold)
    kind = F.when(F.col("status") == "ambiguous", "ambiguous").when(F.col("status") == "unmatched", "undocumented_column").otherwise("low_confidence")
    open_items = matches.filter(~F.coalesce(sure, F.lit(False))).select("dataset_id", kind.alias("kind"), F.col("column").alias("subject"))
    missing = phantoms.select("dataset_id", F.lit("phantom_variable").alias("kind"), F.col("name").alias("subject"))
    return open_items.unionByName(missing).withColumn("item_id", F.concat_ws(":", "dataset_id", "kind", "subject"))


def acknowledge_all(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions plus an acknowledgement of every pending item that allows nothing else."""
    notices = [k for k, allowed in ALLOWED.items() if allowed == ("acknowledge",)]
    pending = queue.filter(F.col("kind").isin(notices)).join(decisions, "item_id", "left_anti")
    return decisions.unionByName(pending.select("item_id", F.lit("acknowledge").alias("decision")))


def invalid_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    rules = [F.when(F.col("kind") == k, F.col("decision").isin(*allowed)) for k, allowed in ALLOWED.items()]
    return decisions.join(queue, "item_id", "left").filter(~F.coalesce(*rules, F.lit(False))).select("item_id", "decision")


def clean_edits(edits: DataFrame, current: DataFrame) -> DataFrame:
    """(dataset_id, column, field, value, original): editable fields with valid, changed values."""
    valid = F.col("field").isin(*EDITABLE) & ((F.col("field") != "type") | F.col("value").isin(*TYPES)) & ((F.col("field") != "role") | F.col("value").isin(*ROLES))
    return edits.filter(valid).join(current.withColumnRenamed("value", "original"), ["dataset_id", "column", "field"], "left").filter(~F.col("value").eqNullSafe(F.col("original")))


def sync_decisions(decisions: DataFrame, edited: DataFrame) -> DataFrame:
    """An edited item counts as decided; without its edit an automatic decision falls away."""
    both = decisions.join(edited.select("item_id", F.lit(True).alias("edited")).distinct(), "item_id", "full_outer")
    return both.withColumn("decision", F.when(F.col("edited"), F.coalesce("decision", F.lit("auto"))).otherwise(F.when(F.col("decision") != "auto", F.col("decision")))).filter("decision is not null").select("item_id", "decision")


def apply_decisions(matches: DataFrame, queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """A new version of the matches: rejected links are cut, accepted ones are certain; the input stays as it is."""
    told = queue.join(decisions, "item_id").filter("kind <> 'phantom_variable'").select("dataset_id", F.col("subject").alias("column"), "decision")
    out = matches.join(told, ["dataset_id", "column"], "left")
    reject, accept = F.coalesce(F.col("decision") == "reject", F.lit(False)), F.coalesce(F.col("decision") == "accept", F.lit(False))
    return out.select(
        "dataset_id", "column", F.when(~reject, F.col("name")).alias("name"), F.when(reject, "unmatched").when(accept, "matched").otherwise(F.col("status")).alias("status"),
        F.when(reject, 0.0).when(accept, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(reject | accept, "reviewer").otherwise(F.col("method")).alias("method"),
    )


def apply_edits(matches: DataFrame, phantoms: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links set by the reviewer, and the phantoms that remain."""
    linked = edits.filter("field = 'documented_name'").select("dataset_id", "column", F.col("value").alias("linked"))
    out = matches.join(linked, ["dataset_id", "column"], "left").select(
        "dataset_id", "column", F.coalesce("linked", "name").alias("name"), F.when(F.col("linked").isNotNull(), "matched").otherwise(F.col("status")).alias("status"),
        F.when(F.col("linked").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("linked").isNotNull(), "reviewer").otherwise(F.col("method")).alias("method"),
    )
    return out, phantoms.join(linked.select("dataset_id", F.col("linked").alias("name")), ["dataset_id", "name"], "left_anti")


def claimed_twice(matches: DataFrame) -> DataFrame:
    """Definitions that more than one column of a dataset claims."""
    return matches.filter("name is not null").groupBy("dataset_id", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def pending(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items without a decision; export is only allowed when there are none."""
    return queue.join(decisions, "item_id", "left_anti")


def decision_log(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    return queue.join(decisions, "item_id").select("item_id", "dataset_id", "kind", "subject", "decision")
