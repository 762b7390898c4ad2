"""Queries of the text problems and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import canonical, encoding, leakage, names, packing, reading
from tablewright.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.found(table(spark, sf, "key_values"), table(spark, sf, "variable_definitions"), table(spark, sf, "canonical_terms"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.found(table(spark, sf, "persons"))


def p3_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every person row and affiliation spelling with its class: the links of p3_found as membership."""
    return names.clusters(table(spark, sf, "persons"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.found(table(spark, sf, "decoded_texts"))


def p5_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Every damaged record with its encoding chain and, where it can be regained, the original text."""
    return encoding.judged(table(spark, sf, "decoded_texts")).filter("damaged").select("decode_id", "chain", "restored")


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every text in one container of each capacity (cut only if it exceeds it)."""
    return packing.pack(table(spark, sf, "documents"), table(spark, sf, "pack_limits"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Every container's distance from the target mixture, beside the least that so many whole items allow."""
    limits, sizes = table(spark, sf, "pack_limits"), packing.measured(table(spark, sf, "documents"))
    return packing.mixture(packing.pack_sizes(sizes, limits), packing.target_shares(sizes), limits)


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Of each capacity: texts packed, containers over it, texts cut that fit into one, pieces given twice."""
    limits, sizes = table(spark, sf, "pack_limits"), packing.measured(table(spark, sf, "documents"))
    pieces = packing.pack_sizes(sizes, limits).join(limits.select(F.col("limit_id").cast("long").alias("limit_id"), F.col("capacity_tokens").alias("capacity")).distinct(), "limit_id")
    filled = pieces.groupBy("limit_id", "capacity", "container_id").agg(F.sum("tokens").alias("t")).groupBy("limit_id").agg(F.count_if(F.col("t") > F.col("capacity")).alias("over_capacity"))
    texts = pieces.groupBy("limit_id", "capacity", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"), F.count_distinct("part").alias("parts"), F.max("parts").alias("told"))
    texts = texts.groupBy("limit_id").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if((F.col("k") > 1) & (F.col("t") <= F.col("capacity"))).alias("cut_without_need"), F.count_if((F.col("k") != F.col("parts")) | (F.col("k") != F.col("told"))).alias("pieces_amiss")
    )
    return texts.join(filled, "limit_id").select("limit_id", "texts", "over_capacity", "cut_without_need", "pieces_amiss")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.found(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage rank, sentence complexity and estimated reading level of every document."""
    return reading.reading_levels(table(spark, sf, "documents"), table(spark, sf, "doc_ratings"))


def p9_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """What coverage, sentences and letters each add to the estimate on documents that were not fitted."""
    return reading.ablation(table(spark, sf, "documents"), table(spark, sf, "doc_ratings"))


def p9_word_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """The frequency ranks of all words of the documents that state their language."""
    stated = table(spark, sf, "documents").withColumn("lang", F.regexp_extract(F.lower(F.trim("lang")), r"^([a-z]{2,3})(?:[-_].*)?$", 1)).filter("lang <> ''")
    return reading.word_ranks(reading.word_counts(stated))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_clusters": p3_clusters, "p5_found": p5_found, "p5_restored": p5_restored, "p7_pack": p7_pack, "p7_mixture": p7_mixture, "p7_invariants": p7_invariants, "p8_found": p8_found, "p9_levels": p9_levels, "p9_ablation": p9_ablation, "p9_word_ranks": p9_word_ranks}
ORACLE: dict[str, str] = {
    "p7_invariants": "SELECT DISTINCT CAST(limit_id AS BIGINT) AS limit_id, (SELECT count(DISTINCT doc_id) FROM documents) AS texts, 0::BIGINT AS over_capacity, 0::BIGINT AS cut_without_need, 0::BIGINT AS pieces_amiss FROM pack_limits WHERE capacity_tokens >= 1",
    "p9_word_ranks": r"WITH d AS (SELECT regexp_extract(lower(trim(lang)), '^([a-z]{2,3})(?:[-_].*)?$', 1) AS lang, text FROM documents), w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{No}\p{Nl}]+')) AS word FROM d WHERE lang <> ''), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL) SELECT lang, word, n, count(*) OVER (PARTITION BY lang ORDER BY n DESC) AS rank FROM c",
}
