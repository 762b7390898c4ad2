"""Queries on files, dialects, headers and content classes (A, B, C), over the lines of pending tables, documents and names."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tablewright.config import Config
from tablewright.operators import issues as N
from tablewright.plans import inspect
from tablewright.plans.document_queries import python
from tablewright.session import remove, shared_dir, ship
from tablewright.sources import delimited, files
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


def _lines(spark, sf):
    return table(spark, sf, "raw_rows").select("dataset_id", "line_no", "raw_line")


def _layouts(spark, sf):
    """Layouts of all pending tables, told from their first lines."""
    return delimited.layouts(delimited.head_of(_lines(spark, sf)))


# Files.
@query("a04_digest", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, ''))) AS length, 'none' AS kind FROM documents WHERE left(coalesce(text, ''), 2) <> 'PK' AND left(coalesce(text, ''), 4) <> '%PDF'")
def a04(spark, sf):
    """Every document written as a file and scanned as a repository of files: digest, size and kind."""
    return _scanned(spark, sf, lambda found: found.select(F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("long").alias("doc_id"), "sha256", "length", "kind"))


def _scanned(spark, sf, read):
    """read(scan) of the documents as binary content, as scan() has it."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return read(files.described(docs.withColumn("length", F.length("content").cast("long"))))


@query("a06_role_of_text")
def a06(spark, sf):
    """Role by content, of documents and of the heads of pending tables as files of doubtful extension."""
    role = python(spark, lambda t: files.role_of_file("thing.txt", (t or "").encode(), delimited.tabular_evidence(t or "")), "string")
    a = table(spark, sf, "documents").select(F.lit("document").alias("origin"), role("text").alias("role"))
    b = delimited.head_of(_lines(spark, sf)).select(F.lit("table").alias("origin"), role("text").alias("role"))
    return a.unionByName(b).groupBy("origin", "role").agg(F.count(F.lit(1)).alias("n"))


_SCORE = "CASE WHEN n LIKE '%readme%' OR contains(n, 'read_me') THEN 1.0 WHEN n LIKE '%codebook%' OR n LIKE '%dictionary%' THEN 0.9 WHEN n LIKE '%metadata%' OR n LIKE '%methods%' THEN 0.7 WHEN n LIKE '%manifest%' OR n LIKE '%about%' OR n LIKE '%info%' OR n LIKE '%notes%' THEN 0.5 ELSE 0.2 END::DOUBLE"
_FILES = "SELECT file_name FROM key_values UNION SELECT file_name FROM decoded_texts UNION SELECT file_name FROM dataset_structures"


@query("a07_readme_score", f"SELECT file_name, {_SCORE} AS score FROM (SELECT file_name, lower(list_last(string_split(file_name, '/'))) AS n FROM ({_FILES}) WHERE file_name IS NOT NULL)")
def a07(spark, sf):
    return _file_names(spark, sf).select("file_name", files.readme_score(F.col("file_name")).alias("score"))


def _file_names(spark, sf):
    own = lambda t: table(spark, sf, t).select("file_name")
    return own("key_values").union(own("decoded_texts")).union(own("dataset_structures")).filter("file_name is not null").distinct()


@query("h01_sorted_files", f"WITH f AS (SELECT DISTINCT repo_id, file_name, lower(list_last(string_split(file_name, '/'))) AS n FROM dataset_structures WHERE file_name IS NOT NULL UNION SELECT DISTINCT repo_id, file_name, lower(list_last(string_split(file_name, '/'))) FROM key_values WHERE file_name IS NOT NULL) SELECT repo_id, file_name, row_number() OVER (PARTITION BY repo_id ORDER BY {_SCORE} < 0.5, file_name) AS place FROM f")
def h01(spark, sf):
    """The files of each repository in the order they are read: documentation first, then by path."""
    own = lambda t: table(spark, sf, t).select("repo_id", "file_name")
    return files.in_order(own("dataset_structures").union(own("key_values")).filter("file_name is not null").distinct(), "repo_id", "file_name")


@query("a08_text_or_binary", "SELECT doc_id, coalesce(text, '') = '' OR len(list_filter(string_split(coalesce(text, ''), ''), lambda c: ord(c) < 32 AND ord(c) NOT IN (9, 10, 12, 13, 27))) = 0 AS is_text FROM documents WHERE length(coalesce(text, '')) = 0 OR ord(text) <> 0")
def a08(spark, sf):
    is_text = python(spark, lambda t: files.is_text((t or "").encode()), "boolean")
    return table(spark, sf, "documents").select("doc_id", is_text("text").alias("is_text"))


@query("a15_sample", "SELECT doc_id, CASE WHEN length(text) <= 2000 THEN length(text) WHEN contains(substr(text, 1, 2000), chr(10)) THEN length(regexp_replace(substr(text, 1, 2000), '[^\\n]*$', '')) ELSE 2000 END AS kept FROM documents WHERE text IS NOT NULL")
def a15(spark, sf):
    """A sniffing sample: at most so many characters, cut after the last line break."""
    kept = python(spark, lambda t: len(delimited.sample(t, 2000)), "long")
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", kept("text").alias("kept"))


@query("a23_json_out", "SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'r_name': r_name})::VARCHAR AS json FROM nation JOIN region ON n_regionkey = r_regionkey")
def a23(spark, sf):
    rows = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return N.as_json(rows.select("n_nationkey", "n_name", "r_name"))


@query("d04_rows_as_maps", "SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': c_mktsegment})::VARCHAR AS json FROM customer")
def d04(spark, sf):
    return N.as_json(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("a24_event_log", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type AS stage, event_id FROM events")
def a24(spark, sf):
    """A log of events as JSON lines, numbered by run, written and read again."""
    path = f"{shared_dir(spark)}/events_{uuid.uuid4().hex}"
    rows = N.numbered(table(spark, sf, "events").select("user_id", F.col("event_type").alias("stage"), "event_id"), "user_id", "event_id")
    rows.write.json(path)
    kept = spark.read.schema(rows.schema).json(path).checkpoint()
    remove(spark, path)
    return kept


@query("g12_progress", "SELECT user_id, event_id, sum(CAST(round(value::DOUBLE * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS done FROM events")
def g12(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.round(F.col("value").cast("double") * 100).cast("long").alias("weight"))
    return N.progress(e, "user_id", "event_id", "weight")


@query("e13_stage_timings", "SELECT event_type AS stage, count(*) AS runs, round(sum(value::DOUBLE), 4) AS total FROM events GROUP BY event_type")
def e13(spark, sf):
    return N.stage_totals(table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").cast("double").alias("ms")))


@query("a26_schema_drift", "SELECT * FROM (VALUES ('kept', 0), ('one key less', 1)) v(version, differences)")
def a26(spark, sf):
    """The emitted schema against the one kept with the release, and against one that has drifted."""
    import json

    emitted = json.loads(inspect.schema_json())
    less = {k: v for k, v in emitted.items() if k != "events"}
    rows = [("kept", len(inspect.drift(emitted))), ("one key less", len(inspect.drift(less)))]
    return spark.createDataFrame(rows, "version string, differences int")


@query("a27_settings")
def a27(spark, sf):
    """All settings with their defaults."""
    from dataclasses import fields

    c = Config()
    return spark.createDataFrame([(f.name, str(getattr(c, f.name))) for f in fields(c)], "name string, value string")


# Tables.
@query("a11_read_tables")
def a11(spark, sf):
    """Dialect, header, units and kind of every pending table, from its head."""
    return _layouts(spark, sf)


@query("a12_cells")
def a12(spark, sf):
    """The cells of all pending tables, read line by line under the layout found."""
    lines = _lines(spark, sf)
    return delimited.read_lines(lines, delimited.layouts(delimited.head_of(lines)))


_ONCE = "SELECT DISTINCT dataset_id, line_no, raw_line FROM raw_rows"


@query("a13_quote_fallback", f"SELECT dataset_id, line_no, (length(coalesce(raw_line, '')) - length(replace(coalesce(raw_line, ''), '\"', ''))) % 2 = 1 AS unpaired FROM ({_ONCE})")
def a13(spark, sf):
    """Records whose quotes do not pair up: these are read with quoting off."""
    return delimited.unpaired(_lines(spark, sf).distinct()).select("dataset_id", "line_no", "unpaired")


@query("a14_tolerant_rows", f"SELECT dataset_id, line_no, array_to_string(list_resize(string_split(coalesce(raw_line, ''), ',')[1:3], 3, ''), '|') AS cells FROM ({_ONCE})")
def a14(spark, sf):
    """Ragged rows padded or cut to three columns."""
    fit = python(spark, lambda t: "|".join(delimited.fit_width((t or "").split(","), 3)), "string")
    return _lines(spark, sf).distinct().select("dataset_id", "line_no", fit("raw_line").alias("cells"))


_CANDIDATES = f"WITH l AS ({_ONCE}), c(d) AS (VALUES (','), (';'), (chr(9)), ('|')), w AS (SELECT dataset_id, d AS delimiter, len(string_split(raw_line, d)) AS width, count(*) AS n FROM l, c WHERE trim(coalesce(raw_line, ''), ' ') <> '' GROUP BY ALL)"


@query("b01_candidate_widths", f"{_CANDIDATES} SELECT * FROM w")
def b01(spark, sf):
    return delimited.candidate_widths(_lines(spark, sf).distinct())


@query("b02_row_widths", f"{_CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, delimiter ORDER BY n DESC, width DESC) AS r, sum(n) OVER (PARTITION BY dataset_id, delimiter) AS total FROM w) SELECT dataset_id, delimiter, width, CASE WHEN width > 1 THEN round(n / total, 6) ELSE 0.0 END::DOUBLE AS consistency FROM r WHERE r = 1")
def b02(spark, sf):
    return delimited.consistency(delimited.candidate_widths(_lines(spark, sf).distinct()))


@query("c09_width_consistency", f"{_CANDIDATES} SELECT dataset_id, delimiter, round(max(n) / sum(n), 6)::DOUBLE AS share FROM w GROUP BY ALL")
def c09(spark, sf):
    return delimited.width_shares(delimited.candidate_widths(_lines(spark, sf).distinct()))


@query("b03_preamble", f"WITH d AS (SELECT dataset_id, any_value(CASE WHEN lower(delimiter) = 'tab' THEN chr(9) ELSE delimiter END) AS delimiter, any_value(field_count) AS width FROM dataset_structures WHERE delimiter IS NOT NULL GROUP BY dataset_id), w AS (SELECT dataset_id, line_no, len(string_split(coalesce(raw_line, ''), delimiter)) = width AS fits FROM ({_ONCE}) JOIN d USING (dataset_id)), r AS (SELECT dataset_id, line_no, fits AND lead(fits, 1, false) OVER o AND lead(fits, 2, false) OVER o AS run FROM w WINDOW o AS (PARTITION BY dataset_id ORDER BY line_no)) SELECT dataset_id, min(line_no) AS first_line FROM r WHERE run GROUP BY dataset_id")
def b03(spark, sf):
    d = table(spark, sf, "dataset_structures").filter("delimiter is not null").select("dataset_id", F.when(F.lower("delimiter") == "tab", "\t").otherwise(F.col("delimiter")).alias("delimiter"), F.col("field_count").alias("width"))
    return delimited.preambles(_lines(spark, sf).distinct(), d.dropDuplicates(["dataset_id"]))


@query("b04_dialects")
def b04(spark, sf):
    """The dialect sniffed from each pending table beside the recorded one."""
    kept = table(spark, sf, "dataset_structures").select("dataset_id", F.when(F.lower("delimiter") == "tab", "\t").otherwise(F.col("delimiter")).alias("recorded"), "field_count").distinct()
    return _layouts(spark, sf).join(kept, "dataset_id").select("dataset_id", F.col("delimiter").alias("sniffed"), "recorded", "width", "field_count")


@query("b05_header_rows")
def b05(spark, sf):
    """The chosen header row of each pending table with its confidence, beside the recorded one."""
    kept = table(spark, sf, "dataset_structures").select("dataset_id", F.col("header_row").alias("recorded")).distinct()
    return _layouts(spark, sf).join(kept, "dataset_id").select("dataset_id", "header_row", "recorded", "confidence", "ambiguous")


@query("b07_row_features", f"WITH c AS (SELECT dataset_id, line_no, list_filter(list_transform(string_split(coalesce(raw_line, ''), ';'), lambda x: trim(x, ' ')), lambda x: x <> '') AS filled, len(string_split(coalesce(raw_line, ''), ';')) AS width FROM ({_ONCE})) SELECT dataset_id, line_no, round(len(filled) / width, 6)::DOUBLE AS fill, round(CASE WHEN len(filled) = 0 THEN 0 ELSE len(list_distinct(filled)) / len(filled) END, 6)::DOUBLE AS uniqueness, round(CASE WHEN len(filled) = 0 THEN 0 ELSE len(list_filter(filled, lambda x: NOT regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND NOT regexp_full_match(x, '[0-9]{{1,4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,4}}'))) / len(filled) END, 6)::DOUBLE AS textual FROM c")
def b07(spark, sf):
    """What the header score is made of, for every line cut at semicolons."""
    ship(spark)

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([delimited.row_features((t or "").split(";")) for t in texts], columns=["fill", "uniqueness", "textual"]).round(6)

    f = F.pandas_udf(run, "fill double, uniqueness double, textual double")
    return _lines(spark, sf).distinct().select("dataset_id", "line_no", f("raw_line").alias("f")).select("dataset_id", "line_no", "f.*")


@query("b08_literals", "SELECT DISTINCT raw, regexp_full_match(trim(raw, ' '), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AS is_number, regexp_full_match(trim(raw, ' '), '[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}') AS is_date FROM table_cells WHERE raw IS NOT NULL")
def b08(spark, sf):
    ship(spark)

    def run(texts: pd.Series) -> pd.DataFrame:
        cut = [t.strip(" ") for t in texts]
        return pd.DataFrame({"is_number": [delimited.NUMBER.match(t) is not None for t in cut], "is_date": [delimited.DATE.match(t) is not None for t in cut]})

    seen = table(spark, sf, "table_cells").select("raw").filter("raw is not null").distinct()
    return seen.withColumn("f", F.pandas_udf(run, "is_number boolean, is_date boolean")("raw")).select("raw", "f.*")


@query("b09_unique_headers", "WITH c AS (SELECT DISTINCT dataset_id, pos, name FROM column_contexts), o AS (SELECT dataset_id, pos, CASE WHEN trim(coalesce(name, '')) = '' THEN 'column_' || row_number() OVER (PARTITION BY dataset_id ORDER BY pos) ELSE trim(lower(left(name, 2))) END AS base FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, base ORDER BY pos) AS k FROM o) SELECT dataset_id, pos, CASE WHEN k > 1 THEN base || '__' || k ELSE base END AS name FROM r")
def b09(spark, sf):
    """Headers made unique; cut to two letters, so that many repeat."""
    ship(spark)

    def run(names: pd.Series) -> pd.Series:
        return pd.Series([delimited.clean_header([(n or "").lower()[:2] for n in some])[0] for some in names])

    c = table(spark, sf, "column_contexts").select("dataset_id", "pos", "name").distinct()
    headers = c.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", F.lit("")).alias("name")))).alias("h"))  # the columns of one table
    made = headers.withColumn("made", F.pandas_udf(run, "array<string>")(F.transform("h", lambda x: x["name"])))
    return made.select("dataset_id", F.explode(F.arrays_zip(F.transform("h", lambda x: x["pos"]).alias("pos"), F.col("made").alias("name"))).alias("x")).select("dataset_id", "x.pos", "x.name")


@query("b10_unit_cells")
def b10(spark, sf):
    """Header units that read as units."""
    return table(spark, sf, "column_contexts").select("header_unit").distinct().withColumn("is_unit", python(spark, lambda t: delimited.is_unit_cell(t or ""), "boolean")("header_unit"))


@query("b12_fit_width", "SELECT doc_id, list_resize(string_split(coalesce(text, ''), ' ')[1:4], 4, '') AS cells FROM documents")
def b12(spark, sf):
    fit = python(spark, lambda t: delimited.fit_width((t or "").split(" "), 4), "array<string>")
    return table(spark, sf, "documents").select("doc_id", fit("text").alias("cells"))


# Content.
@query("c01_text_evidence")
def c01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", python(spark, lambda t: delimited.tabular_evidence(t or ""), "double")("text").alias("evidence"))


@query("c02_role_sniff")
def c02(spark, sf):
    """Documents and heads of tables told apart by their content."""
    f = python(spark, lambda t: "tabular" if delimited.tabular_evidence(t or "") >= 0.5 else "documentation", "string")
    return delimited.head_of(_lines(spark, sf)).select("dataset_id", f("text").alias("role"))


@query("c03_prose_rows", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, list_transform(string_split(line, ','), lambda c: len(list_filter(string_split_regex(c, '\\s+'), lambda w: w <> ''))) AS n, string_split(line, ',')[1] AS head FROM l WHERE trim(line, ' ') <> ''), s AS (SELECT doc_id, avg((list_max(n) >= 8)::INT) AS share, avg((length(head) <= 64 AND n[1] <= 4)::INT) FILTER (regexp_matches(head, '\\S')) AS ids FROM r GROUP BY doc_id) SELECT doc_id, share > 0.5 AND coalesce(ids, 0) < 0.8 AS prose FROM s")
def c03(spark, sf):
    """Whether a text cut at commas is prose: mostly sentences, and no identifiers before the first comma."""
    rows = lambda t: [line.split(",") for line in t.split("\n") if line.strip(" ")]
    f = python(spark, lambda t: delimited.prose_in_columns(rows(t)) if rows(t) else None, "boolean")
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", f("text").alias("prose")).filter("prose is not null")


@query("c04_identifier_share", "WITH d AS (SELECT DISTINCT def_id, dataset_id, name FROM variable_definitions WHERE regexp_matches(coalesce(name, ''), '\\S')) SELECT dataset_id, round(avg((length(name) <= 64 AND len(list_filter(string_split_regex(name, '\\s+'), lambda w: w <> '')) <= 4)::INT), 6)::DOUBLE AS share FROM d GROUP BY dataset_id")
def c04(spark, sf):
    ship(spark)

    def run(names: pd.Series) -> pd.Series:
        return pd.Series([round(delimited.identifier_share(list(some)), 6) for some in names])

    d = table(spark, sf, "variable_definitions").select("def_id", "dataset_id", "name").distinct().filter(F.col("name").rlike(r"\S"))
    return d.groupBy("dataset_id").agg(F.collect_list("name").alias("names")).select("dataset_id", F.pandas_udf(run, "double")("names").alias("share"))  # the definitions of one table


@query("c05_document_preamble")
def c05(spark, sf):
    """Documents whose first three lines are those of a document."""
    f = python(spark, lambda t: delimited.document_preamble((t or "").split("\n")[:3]), "boolean")
    return table(spark, sf, "documents").select("doc_id", f("text").alias("preamble"))


@query("c07_dictionary_tables")
def c07(spark, sf):
    """Which pending tables are data dictionaries, and which are notes."""
    return _layouts(spark, sf).select("dataset_id", F.when(F.col("dictionary"), "dictionary").when(F.col("notes"), "notes").otherwise("data").alias("kind"))


@query("f33_file_status", "WITH s AS (SELECT DISTINCT file_format, status FROM dataset_structures) SELECT DISTINCT d.dataset_id, CASE WHEN d.status = 'pending' THEN 'skipped' WHEN d.row_count IS NULL THEN 'failed' ELSE 'processed' END AS state FROM dataset_structures d")
def f33(spark, sf):
    """Pending tables were skipped, loaded ones without rows failed."""
    s = table(spark, sf, "dataset_structures").select("dataset_id", F.when(F.col("status") == "pending", "other").otherwise("tabular").alias("role"), (F.col("row_count").isNull() & (F.col("status") != "pending")).alias("failed")).distinct()
    return files.with_status(s).select("dataset_id", "state").distinct()


@query("h03_union_issues", "SELECT 'CSV_PARSE_FAILED' AS code, 'warning' AS severity, CAST(dataset_id AS VARCHAR) AS location FROM (SELECT DISTINCT dataset_id FROM raw_rows) UNION ALL SELECT 'DECLARED_COUNT_MISMATCH', 'warning', CAST(dataset_id AS VARCHAR) FROM (SELECT DISTINCT dataset_id FROM dataset_structures WHERE declared_vars <> column_count) UNION ALL SELECT 'ENCODING_FALLBACK', 'info', CAST(decode_id AS VARCHAR) FROM (SELECT DISTINCT decode_id FROM decoded_texts WHERE rung IN ('cp1252', 'latin-1'))")
def h03(spark, sf):
    return _issues(spark, sf)


def _issues(spark, sf):
    own = lambda t, where, key: table(spark, sf, t).filter(where).select(F.col(key).cast("string").alias("location")).distinct()
    return N.union({"CSV_PARSE_FAILED": own("raw_rows", "true", "dataset_id"), "DECLARED_COUNT_MISMATCH": own("dataset_structures", "declared_vars <> column_count", "dataset_id"), "ENCODING_FALLBACK": own("decoded_texts", "rung in ('cp1252', 'latin-1')", "decode_id")})


@query("e08_severities", f"SELECT severity, count(*) AS n FROM ({ORACLE['h03_union_issues']}) GROUP BY severity")
def e08(spark, sf):
    return N.severities(_issues(spark, sf))


@query("h11_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an') OR contains(lower(p_brand), 'an')")
def h11(spark, sf):
    return N.search(table(spark, sf, "part"), "An", ["p_name", "p_type", "p_brand"]).select("p_partkey", "p_name")


@query("e10_declared_counts", "SELECT DISTINCT dataset_id, CASE WHEN declared_vars IS NULL OR column_count IS NULL THEN 'not stated' WHEN declared_vars = column_count THEN 'agree' ELSE 'differ' END AS variables, CASE WHEN declared_rows IS NULL OR row_count IS NULL THEN 'not stated' WHEN declared_rows = row_count THEN 'agree' ELSE 'differ' END AS rows FROM dataset_structures")
def e10(spark, sf):
    return table(spark, sf, "dataset_structures").select("dataset_id", N.claim(F.col("declared_vars"), F.col("column_count")).alias("variables"), N.claim(F.col("declared_rows"), F.col("row_count")).alias("rows")).distinct()


@query("k10_claims", "SELECT dataset_id, count(DISTINCT def_id) AS described, CASE WHEN any_value(declared_vars) IS NULL THEN 'not stated' WHEN any_value(declared_vars) = count(DISTINCT def_id) THEN 'agree' ELSE 'differ' END AS claim FROM (SELECT DISTINCT dataset_id, declared_vars FROM dataset_structures) LEFT JOIN variable_definitions USING (dataset_id) GROUP BY dataset_id")
def k10(spark, sf):
    """Declared variables against those described."""
    d = table(spark, sf, "variable_definitions").select("dataset_id", "def_id")
    s = table(spark, sf, "dataset_structures").select("dataset_id", "declared_vars").distinct().join(d, "dataset_id", "left")
    counted = s.groupBy("dataset_id").agg(F.count_distinct("def_id").alias("described"), F.max("declared_vars").alias("declared"))
    return counted.select("dataset_id", "described", N.claim(F.col("declared"), F.col("described")).alias("claim"))
