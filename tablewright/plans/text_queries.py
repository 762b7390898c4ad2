"""Queries on decoding, names, scoping and review (A09, B11, I, F19-F26, K), each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators import linking as L
from tablewright.operators import review as R
from tablewright.plans.table_queries import _NORM
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


@query("a09_decode_ladder")
def a09(spark, sf):
    """The texts written in three encodings, read back through the ladder."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text").filter("text is not null")
    k = F.col("path").cast("long") % 3
    content = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-16LE"))
    content = F.when(k == 2, F.concat(F.unhex(F.lit("FFFE")), content)).otherwise(content)
    return files.decoded(d.select("path", content.alias("content"))).groupBy("encoding", "rung").agg(F.count(F.lit(1)).alias("n"))


@query("b11_header_units", r"SELECT DISTINCT original_name, nullif(regexp_extract(original_name, '[(\[]([^()\[\]]{1,20})[)\]]\s*$', 1), '') AS unit FROM dataset_variables WHERE original_name IS NOT NULL")
def b11(spark, sf):
    return table(spark, sf, "dataset_variables").select("original_name").filter("original_name is not null").distinct().withColumn("unit", F.nullif(T.trailing_unit(F.col("original_name")), F.lit("")))


@query("i01_slugs", "SELECT DISTINCT file_name, CASE WHEN trim(regexp_replace(lower(trim(file_name)), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'dataset' ELSE trim(regexp_replace(lower(trim(file_name)), '[^a-z0-9]+', '_', 'g'), '_') END AS slug FROM dataset_structures")
def i01(spark, sf):
    return table(spark, sf, "dataset_structures").select("file_name", T.slugify(F.col("file_name")).alias("slug")).distinct()


@query("i03_normalize", f"SELECT DISTINCT p_name AS name, {_NORM('p_name')} AS norm FROM part")
def i03(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("name"), T.normalize_name(F.col("p_name")).alias("norm")).distinct()


@query("i34_rounding", "SELECT l_orderkey, l_linenumber, round(l_extendedprice::DOUBLE, 0) AS whole, least(greatest(l_tax::DOUBLE, 0.02), 0.06) AS clipped FROM lineitem")
def i34(spark, sf):
    x = F.col("l_extendedprice").cast("double")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 0).alias("whole"), F.least(F.greatest(F.col("l_tax").cast("double"), F.lit(0.02)), F.lit(0.06)).alias("clipped"))


# Scoping.
def _scoping(spark, sf):
    s = table(spark, sf, "dataset_structures").dropDuplicates(["dataset_id"]).select(F.col("dataset_id").cast("string").alias("dataset_id"), F.col("file_name").alias("file"))
    d = table(spark, sf, "variable_definitions").dropDuplicates(["def_id"])
    defs = d.select(F.concat(F.lit("g"), "dataset_id").alias("group_id"), "name", "description", "unit", F.col("pos").alias("position"), F.col("missing_codes").alias("codes"))
    c = table(spark, sf, "column_contexts").dropDuplicates(["dataset_id", "pos"]).select(F.col("dataset_id").cast("string").alias("dataset_id"), F.col("name").alias("column"))
    return s, defs, c


_STEM = "regexp_replace(list_last(string_split(file_name, '/')), '\\.[^.]*$', '')"


@query("f19_file_hints", f"WITH t AS (SELECT DISTINCT dataset_id, {_STEM} AS s FROM dataset_structures), h AS (SELECT DISTINCT upper({_STEM}) AS hint FROM dataset_structures) SELECT hint, min(CAST(dataset_id AS VARCHAR)) AS dataset_id FROM h JOIN t ON lower(hint) = lower(s) GROUP BY hint")
def f19(spark, sf):
    s, _, _ = _scoping(spark, sf)
    return L.resolve_hints(s.select(F.upper(L.stem(F.col("file"))).alias("hint")).distinct(), s)


@query("f20_documentation_names")
def f20(spark, sf):
    s, _, _ = _scoping(spark, sf)
    return L.resolve_documents(s.select(F.concat(L.stem(F.col("file")), F.lit("_README.txt")).alias("file")).distinct(), s)


@query("f23_in_scope", "WITH d AS (SELECT DISTINCT def_id, dataset_id, name, pos FROM variable_definitions) SELECT CAST(dataset_id AS VARCHAR) AS dataset_id, name, min(pos) AS position FROM d GROUP BY ALL")
def f23(spark, sf):
    s, defs, _ = _scoping(spark, sf)
    bound = s.select(F.concat(F.lit("g"), "dataset_id").alias("group_id"), "dataset_id")
    return L.in_scope(defs.withColumn("codes", F.coalesce("codes", F.array().cast("array<string>"))), bound).select("dataset_id", "name", "position")


@query("f24_codes_in_force", "SELECT DISTINCT CAST(dataset_id AS VARCHAR) AS dataset_id, unnest(missing_codes) AS code FROM variable_definitions")
def f24(spark, sf):
    s, defs, _ = _scoping(spark, sf)
    bound = s.select(F.concat(F.lit("g"), "dataset_id").alias("group_id"), "dataset_id")
    return L.codes_in_force(defs.select("group_id", F.explode("codes").alias("code")), bound)


@query("f26_unassigned", f"SELECT DISTINCT d.def_id FROM variable_definitions d WHERE NOT EXISTS (SELECT 1 FROM column_contexts c WHERE {_NORM('c.name')} = {_NORM("CASE WHEN d.declared_type IS NULL THEN d.name || '_old' ELSE d.name END")})")
def f26(spark, sf):
    d = table(spark, sf, "variable_definitions").dropDuplicates(["def_id"])
    d = d.select("def_id", F.lit("all").alias("group_id"), F.when(F.col("declared_type").isNull(), F.concat("name", F.lit("_old"))).otherwise(F.col("name")).alias("name"))
    c = table(spark, sf, "column_contexts").select(F.col("name").alias("column"))
    everywhere = spark.createDataFrame([("all", None)], "group_id string, dataset_id string")
    return L.unassigned(d, everywhere, c).select("def_id").distinct()


# Review overlays: matches are the variables with their confidence.
_V = "v AS (SELECT DISTINCT CAST(dataset_id AS VARCHAR) AS dataset_id, CAST(variable_id AS VARCHAR) AS col, CASE WHEN def_id IS NOT NULL THEN 'd' || (def_id - def_id % 3) END AS name, coalesce(match_confidence, 0.0) AS confidence, CASE WHEN def_id IS NULL THEN 'unmatched' WHEN variable_id % 13 = 0 THEN 'ambiguous' ELSE 'matched' END AS status FROM dataset_variables), q AS (SELECT dataset_id, CASE status WHEN 'ambiguous' THEN 'ambiguous' WHEN 'unmatched' THEN 'undocumented_column' ELSE 'low_confidence' END AS kind, col AS subject FROM v WHERE NOT (status = 'matched' AND confidence >= 0.95)), qi AS (SELECT *, dataset_id || ':' || kind || ':' || subject AS item_id FROM q), d AS (SELECT item_id, CASE WHEN CAST(subject AS BIGINT) % 2 = 0 THEN 'accept' ELSE 'reject' END AS decision FROM qi WHERE kind <> 'undocumented_column' AND CAST(subject AS BIGINT) % 5 < 3)"


def _review(spark, sf):
    v = table(spark, sf, "dataset_variables").select("dataset_id", "variable_id", "def_id", "match_confidence").distinct()
    status = F.when(F.col("def_id").isNull(), "unmatched").when(F.col("variable_id") % 13 == 0, "ambiguous").otherwise("matched")
    name = F.when(F.col("def_id").isNotNull(), F.concat(F.lit("d"), F.col("def_id") - F.col("def_id") % 3))
    matches = v.select(F.col("dataset_id").cast("string").alias("dataset_id"), F.col("variable_id").cast("string").alias("column"), name.alias("name"), F.coalesce("match_confidence", F.lit(0.0)).alias("confidence"), status.alias("status"), F.lit("exact").alias("method"))
    queue = R.review_queue(matches, spark.createDataFrame([], "dataset_id string, name string"))
    n = F.col("subject").cast("long")
    decisions = queue.filter("kind <> 'undocumented_column'").filter(n % 5 < 3).select("item_id", F.when(n % 2 == 0, "accept").otherwise("reject").alias("decision"))
    return matches, queue, decisions


@query("k01_review_queue", f"WITH {_V} SELECT dataset_id, kind, subject, item_id FROM qi")
def k01(spark, sf):
    return _review(spark, sf)[1]


@query("k02_acknowledge_all", f"WITH {_V} SELECT item_id, decision FROM d UNION ALL SELECT item_id, 'acknowledge' FROM qi WHERE kind = 'undocumented_column'")
def k02(spark, sf):
    _, queue, decisions = _review(spark, sf)
    return R.acknowledge_all(queue, decisions)


@query("k03_invalid_decisions", f"WITH {_V} SELECT item_id, 'reject' AS decision FROM qi WHERE kind = 'undocumented_column'")
def k03(spark, sf):
    _, queue, _ = _review(spark, sf)
    return R.invalid_decisions(queue, queue.select("item_id", F.lit("reject").alias("decision")))


@query("k06_apply_decisions", f"WITH {_V} SELECT v.dataset_id, v.col AS column, CASE WHEN decision = 'reject' THEN NULL ELSE name END AS name, CASE decision WHEN 'reject' THEN 'unmatched' WHEN 'accept' THEN 'matched' ELSE status END AS status, CASE decision WHEN 'reject' THEN 0.0 WHEN 'accept' THEN 1.0 ELSE confidence END AS confidence FROM v LEFT JOIN (SELECT dataset_id, subject, decision FROM qi JOIN d USING (item_id)) x ON x.dataset_id = v.dataset_id AND x.subject = v.col")
def k06(spark, sf):
    return R.apply_decisions(*_review(spark, sf)).drop("method")


@query("k07_apply_edits", f"WITH {_V} SELECT dataset_id, col AS column, CASE WHEN CAST(col AS BIGINT) % 11 = 0 THEN 'linked' ELSE name END AS name FROM v")
def k07(spark, sf):
    matches, _, _ = _review(spark, sf)
    edits = matches.filter(F.col("column").cast("long") % 11 == 0).select("dataset_id", "column", F.lit("documented_name").alias("field"), F.lit("linked").alias("value"))
    return R.apply_edits(matches, spark.createDataFrame([], "dataset_id string, name string"), edits)[0].select("dataset_id", "column", "name")


@query("k04_clean_edits", f"WITH {_V} SELECT dataset_id, col AS column, 'name' AS field, 'x' AS value, name AS original FROM v WHERE name IS DISTINCT FROM 'x'")
def k04(spark, sf):
    matches, _, _ = _review(spark, sf)
    edits = matches.select("dataset_id", "column", F.explode(F.array(F.struct(F.lit("name").alias("field"), F.lit("x").alias("value")), F.struct(F.lit("type").alias("field"), F.lit("complex").alias("value")))).alias("e")).select("dataset_id", "column", "e.*")
    return R.clean_edits(edits, matches.select("dataset_id", "column", F.lit("name").alias("field"), F.col("name").alias("value")))


@query("k05_sync_decisions", f"WITH {_V} SELECT item_id, decision FROM d UNION ALL SELECT item_id, 'auto' FROM qi WHERE CAST(subject AS BIGINT) % 17 = 0 AND item_id NOT IN (SELECT item_id FROM d)")
def k05(spark, sf):
    _, queue, decisions = _review(spark, sf)
    return R.sync_decisions(decisions, queue.filter(F.col("subject").cast("long") % 17 == 0))


@query("k08_export_gate", f"WITH {_V} SELECT count(*) AS pending, count(*) = 0 AS ready FROM qi WHERE item_id NOT IN (SELECT item_id FROM d)")
def k08(spark, sf):
    _, queue, decisions = _review(spark, sf)
    return R.pending(queue, decisions).agg(F.count(F.lit(1)).alias("pending")).withColumn("ready", F.col("pending") == 0)


@query("k09_decision_log", f"WITH {_V} SELECT item_id, dataset_id, kind, subject, decision FROM qi JOIN d USING (item_id)")
def k09(spark, sf):
    _, queue, decisions = _review(spark, sf)
    return R.decision_log(queue, decisions)


@query("f34_claimed_twice", f"WITH {_V} SELECT dataset_id, name, count(*) AS n FROM v WHERE name IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def f34(spark, sf):
    return R.claimed_twice(_review(spark, sf)[0])
