"""Queries on documentation text, over all documents and key-values, with SQL twins built from the same line rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tablewright.functions import lines as L
from tablewright.functions import text as T
from tablewright.operators import documents as D
from tablewright.operators import linking, prose, reader
from tablewright.session import ship
from tablewright.sources import office
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


def python(spark: SparkSession, f, kind: str):
    """A function of one text as an Arrow-batched expression."""
    ship(spark)

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([f(None if v is None or v != v else v) for v in values], dtype=object)

    return F.pandas_udf(run, kind)


def lines(spark, sf):
    """The lines of all documents."""
    return D.lines_of(table(spark, sf, "documents"), "doc_id", "text")


def _long(df, *columns: str):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


@query("a19_lines", f"WITH {L.LINES_SQL} SELECT file, line_no, line FROM l")
def a19(spark, sf):
    return _long(lines(spark, sf), "line_no")


@query("a25_excerpt", f"WITH {L.LINES_SQL} SELECT file, line_no, line FROM l WHERE line_no BETWEEN 3 AND 6")
def a25(spark, sf):
    """The lines 3 to 6 of every document: the excerpt is the feature."""
    return _long(D.excerpt(lines(spark, sf), 3, 6), "line_no")


@query("i11_line_kinds", f"WITH {L.KINDS_SQL} SELECT file, line_no, kind0 AS kind FROM k")
def i11(spark, sf):
    return _long(lines(spark, sf), "line_no").select("file", "line_no", L.kind(F.col("line")).alias("kind"))


@query("g02_look_around", f"WITH {L.CLASSES_SQL} SELECT file, line_no, kind FROM c")
def g02(spark, sf):
    """Line classes after a look at the neighbours."""
    return _long(D.classify(lines(spark, sf)), "line_no").select("file", "line_no", "kind")


@query("i10_headings", f"WITH {L.CLASSES_SQL} SELECT file, line_no FROM c WHERE kind = 'heading'")
def i10(spark, sf):
    return _long(D.classify(lines(spark, sf)), "line_no").filter("kind = 'heading'").select("file", "line_no")


_SECTIONS = f"{L.CLASSES_SQL}, s AS (SELECT *, CAST(sum((kind = 'heading')::INT) OVER w AS BIGINT) AS section_id, last_value(CASE WHEN kind = 'heading' THEN rtrim(trim(regexp_replace(line, '^\\s*#+\\s*|\\s*#+\\s*$', '', 'g')), ':') END IGNORE NULLS) OVER w AS section_title FROM c WINDOW w AS (PARTITION BY file ORDER BY line_no))"


@query("g01_sections", f"WITH {_SECTIONS} SELECT file, line_no, section_id, section_title FROM s")
def g01(spark, sf):
    return _long(D.sections(lines(spark, sf)), "line_no").select("file", "line_no", "section_id", "section_title")


_BLOCKS = (
    f"{_SECTIONS}, b AS (SELECT *, sum((kind <> 'text' OR {L.ALIGNED_SQL})::INT) OVER (PARTITION BY file ORDER BY line_no) AS block, CASE kind WHEN 'key_value' THEN {L.VALUE_SQL} WHEN 'text' THEN trim(line) END AS part FROM s),"
    f" kv AS (SELECT file, section_id, max(CASE WHEN kind = 'key_value' THEN {L.KEY_SQL} END) AS key, coalesce(string_agg(part, ' ' ORDER BY line_no) FILTER (part <> ''), '') AS value, min(line_no) AS line_start, max(line_no) AS line_end FROM b GROUP BY file, section_id, block HAVING max(CASE WHEN kind = 'key_value' THEN {L.KEY_SQL} END) IS NOT NULL)"
)


@query("g03_key_values", f"WITH {_BLOCKS} SELECT file, section_id, key, value, line_start, line_end FROM kv")
def g03(spark, sf):
    return _long(D.key_values(lines(spark, sf)), "line_start", "line_end")


@query("i09_key_value_split", f"WITH {L.CLASSES_SQL} SELECT file, line_no, {L.KEY_SQL} AS key, {L.VALUE_SQL} AS value FROM c WHERE kind = 'key_value'")
def i09(spark, sf):
    keyed = _long(D.classify(lines(spark, sf)), "line_no").filter("kind = 'key_value'")
    return keyed.select("file", "line_no", L.key_of(F.col("line")).alias("key"), L.value_of(F.col("line")).alias("value"))


_LABEL = lambda c: f"trim(regexp_replace(regexp_replace(replace(lower({c}), '(s)', ''), '^\\s*[0-9]+[.)]\\s*', ''), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "g04_carried_context",
    f"WITH {_BLOCKS}, labelled AS (SELECT *, {_LABEL('key')} AS label FROM kv) SELECT file, line_start, key, last_value(CASE WHEN regexp_matches(label, '{D.FILE_LABEL}') THEN value END IGNORE NULLS) OVER w AS in_file, last_value(CASE WHEN regexp_matches(label, '{D.ROWS_LABEL}') THEN regexp_extract(value, '([0-9][0-9,]*)', 1) END IGNORE NULLS) OVER w AS in_rows,"
    f" last_value(CASE WHEN regexp_matches(label, '{D.CODES_LABEL}') THEN value END IGNORE NULLS) OVER w AS in_codes FROM labelled WINDOW w AS (PARTITION BY file ORDER BY line_start ROWS UNBOUNDED PRECEDING)",
)
def g04(spark, sf):
    return _long(D.carried(D.key_values(lines(spark, sf))), "line_start").select("file", "line_start", "key", "in_file", "in_rows", "in_codes")


_COUNTED = "(?i)number of (variables|columns|fields|cases|rows|records|observations)[^0-9]{0,20}:?\\s*([0-9][0-9,]*)"


@query("i22_declared_counts", f"WITH {L.LINES_SQL} SELECT file, line_no, CASE WHEN lower(regexp_extract(line, '{_COUNTED}', 1)) IN ('variables', 'columns', 'fields') THEN 'variables' ELSE 'rows' END AS what, try_cast(replace(regexp_extract(line, '{_COUNTED}', 2), ',', '') AS BIGINT) AS n FROM l WHERE regexp_matches(line, '{_COUNTED}')")
def i22(spark, sf):
    return _long(D.declared_counts(lines(spark, sf)), "line_no")


@query("i29_file_names", f"WITH {L.LINES_SQL}, f AS (SELECT file, line_no, list_sort(list_distinct(list_filter(regexp_extract_all(line, {L._q(T.FILE_NAMES)}, 1), lambda x: NOT contains(lower(x), 'readme')))) AS found FROM l) SELECT * FROM f WHERE len(found) > 0")
def i29(spark, sf):
    return _long(lines(spark, sf), "line_no").select("file", "line_no", F.sort_array(T.file_names(F.col("line"))).alias("found")).filter("size(found) > 0")


_UNDER = f"{L.CLASSES_SQL}, o AS (SELECT *, last_value(CASE WHEN kind <> 'list_item' THEN ends_with(trim(line), ':') AND regexp_matches(line, {L._q(D.LEFT_OUT)}) AND (regexp_matches(line, {L._q(D.VARIABLE_WORD)}) OR {L.words_sql('line')} <= 3) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS under FROM c)"


@query("g07_exclusion_lists", f"WITH {_UNDER} SELECT file, line_no FROM o WHERE kind = 'list_item' AND under")
def g07(spark, sf):
    """List items right below a line that announces variables left out."""
    return _long(D.exclusion_lists(lines(spark, sf)), "line_no")


_Q = L._q(L.QUOTES)


@query("i12_quote_noise", f"WITH {L.LINES_SQL}, q AS (SELECT *, regexp_replace(regexp_replace(line, {L._q(f'^\\s*{L.QUOTES}+')}, ''), {L._q(f'{L.QUOTES}+\\s*$')}, '') AS body FROM l) SELECT file, line_no, CASE WHEN regexp_matches(body, {_Q}) THEN line ELSE body END AS bare FROM q")
def i12(spark, sf):
    return _long(lines(spark, sf), "line_no").select("file", "line_no", L.without_quotes(F.col("line")).alias("bare"))


@query("g05_layouts")
def g05(spark, sf):
    """The layouts that the variable lists of each document follow, and how many definitions they yield."""
    d = D.definitions(table(spark, sf, "documents"), "doc_id", "text", _names(spark, sf))
    return d.groupBy("file", "method").agg(F.count(F.lit(1)).alias("definitions"))


def _names(spark, sf) -> list[str]:
    """The distinct column names: a vocabulary."""
    return [r[0] for r in table(spark, sf, "column_contexts").select("name").filter("name is not null").distinct().collect()]


@query("i13_definitions")
def i13(spark, sf):
    return D.definitions(table(spark, sf, "documents"), "doc_id", "text", _names(spark, sf))


@query("g06_running_groups")
def g06(spark, sf):
    """The file, counts and codes in force for each group of definitions."""
    d = D.definitions(table(spark, sf, "documents"), "doc_id", "text", _names(spark, sf))
    return d.select("file", "group_start", "group_title", "file_hint", "sheet_hint", "declared_variables", "declared_rows", "codes").distinct()


@query("g10_people")
def g10(spark, sf):
    return D.people(table(spark, sf, "documents"), "doc_id", "text")


@query("i25_metadata_of_documents")
def i25_all(spark, sf):
    return D.project_fields(table(spark, sf, "documents"), "doc_id", "text")


@query("i27_text_facts")
def i27(spark, sf):
    """Missing codes in prose, abbreviations, absences and relations of all documents."""
    return D.text_facts(table(spark, sf, "documents"), "doc_id", "text")


@query("i31_relations")
def i31(spark, sf):
    return i27(spark, sf).filter("kind = 'relation'")


@query("f29_stated_relations")
def f29(spark, sf):
    facts = i31(spark, sf).select(F.concat_ws("#", "file", "value").alias("relation_id"), F.split("value", r"\|").alias("files"))
    targets = table(spark, sf, "dataset_structures").dropDuplicates(["dataset_id"]).select(F.col("dataset_id").cast("string").alias("dataset_id"), F.col("file_name").alias("file"))
    hints = linking.resolve_hints(facts.select(F.explode("files").alias("hint")).distinct(), targets)
    return linking.document_relations(facts, hints)


@query("i20_missing_sentences")
def i20(spark, sf):
    return table(spark, sf, "documents").select("doc_id", python(spark, prose.missing_codes_in_prose, "array<string>")("text").alias("codes"))


@query("i28_absences")
def i28(spark, sf):
    return table(spark, sf, "documents").select("doc_id", python(spark, prose.absence_sentence, "string")("text").alias("sentence")).filter("sentence is not null")


@query("i30_scope_hints")
def i30(spark, sf):
    """The data file that each heading names."""
    headings = _long(D.classify(lines(spark, sf)), "line_no").filter("kind = 'heading'")
    return headings.select("file", "line_no", python(spark, lambda t: prose.scope_hint(t).file, "string")("line").alias("names"))


@query("i32_noise")
def i32(spark, sf):
    return _long(lines(spark, sf), "line_no").select("file", "line_no", python(spark, lambda t: reader.is_noise(t or ""), "boolean")("line").alias("noise"))


# Key-values.
def _values(spark, sf):
    return table(spark, sf, "key_values").select(F.col("value_text").alias("t")).filter("t is not null").distinct()


@query("i07_labels")
def i07(spark, sf):
    k = table(spark, sf, "key_values").select("label").filter("label is not null").distinct()
    return k.withColumn("norm", T.normalize_label(F.col("label")))


@query("i08_roles", f"WITH n AS (SELECT DISTINCT {_LABEL('name')} AS label FROM column_contexts WHERE name IS NOT NULL UNION SELECT DISTINCT {_LABEL('unit')} FROM variable_definitions WHERE unit IS NOT NULL UNION SELECT DISTINCT {_LABEL('description')} FROM variable_definitions WHERE description IS NOT NULL), r(word, role) AS (VALUES " + ", ".join(f"('{w}', '{r}')" for w, r in T.ROLE_OF.items()) + "), o(role, place) AS (VALUES " + ", ".join(f"('{r}', {i})" for i, r in enumerate(T.CONTAINED_ORDER)) + "), c AS (SELECT label, arg_min(role, place) AS role FROM n JOIN r ON length(word) > 3 AND contains(' ' || label || ' ', ' ' || word || ' ') JOIN o USING (role) GROUP BY label) SELECT n.label, coalesce(r.role, c.role) AS role FROM n LEFT JOIN r ON r.word = n.label LEFT JOIN c ON c.label = n.label")
def i08(spark, sf):
    """Roles of column names, units and descriptions as if they were headers of a codebook."""
    text = lambda t, c: table(spark, sf, t).select(T.normalize_label(F.col(c)).alias("label")).filter("label is not null")
    every = text("column_contexts", "name").union(text("variable_definitions", "unit")).union(text("variable_definitions", "description")).distinct()
    return every.withColumn("role", T.role_of(F.col("label")))


@query("i18_value_labels", r"SELECT DISTINCT t, list_transform(list_filter(string_split_regex(t, '\s*[;,]\s*'), lambda x: regexp_matches(x, '^\s*\S+\s*[=:]\s*\S')), lambda x: trim(regexp_extract(x, '^\s*(\S+?)\s*[=:]', 1))) AS codes FROM (SELECT value_text AS t FROM key_values UNION SELECT value_range FROM variable_definitions UNION SELECT notes FROM variable_definitions) WHERE t IS NOT NULL")
def i18(spark, sf):
    d = table(spark, sf, "variable_definitions")
    every = _values(spark, sf).union(d.select("value_range")).union(d.select("notes")).filter("t is not null").distinct()
    return every.withColumn("codes", F.transform(T.value_labels(F.col("t")), lambda x: x["code"]))


_STRIPPED = "array_to_string(list_filter(list_transform(string_split_regex(trim(t), '\\s+'), lambda x: lower(trim(x, '\"“”‘’''`()[]{}.,:;!?*_'))), lambda x: x <> ''), ' ')"


@query("i21_missing_labels", f"WITH v AS (SELECT DISTINCT value_text AS t FROM key_values WHERE value_text IS NOT NULL UNION SELECT DISTINCT description FROM variable_definitions WHERE description IS NOT NULL), s AS (SELECT t, regexp_replace({_STRIPPED}, '^(data|value) (not )', '\\2') AS x FROM v) SELECT t, x IN ({', '.join(repr(m) for m in prose.MISSING_LABELS)}) OR starts_with(x, 'missing ') AS means_missing FROM s")
def i21(spark, sf):
    every = _values(spark, sf).union(table(spark, sf, "variable_definitions").select("description")).filter("t is not null").distinct()
    return every.withColumn("means_missing", python(spark, prose.is_missing_label, "boolean")("t"))


@query("i19_missing_codes")
def i19(spark, sf):
    """Codes stated under labels for missing data, in documents and key-values."""
    read = D.key_values(lines(spark, sf)).select(F.lit("document").alias("origin"), F.concat_ws(":", "file", "line_start").alias("place"), "key", "value")
    given = table(spark, sf, "key_values").select(F.lit("key_value").alias("origin"), F.col("kv_id").cast("string").alias("place"), F.col("label").alias("key"), F.col("value_text").alias("value")).distinct()
    every = read.unionByName(given).filter(python(spark, prose.is_missing_key, "boolean")("key"))
    return every.select("origin", "place", python(spark, prose.missing_codes, "array<string>")("value").alias("codes"))


@query("i23_date_ranges", r"SELECT DISTINCT kv_id, CASE WHEN regexp_matches(value_text, '[0-9]{4}-[0-9]{2}-[0-9]{2}\s*(to|–|-|through|until)\s*[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN regexp_extract(value_text, '([0-9]{4}-[0-9]{2}-[0-9]{2})\s*(to|–|-|through|until)\s*([0-9]{4}-[0-9]{2}-[0-9]{2})', 3) ELSE nullif(regexp_extract(value_text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') END AS until, nullif(regexp_extract(value_text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS start FROM key_values WHERE value_text IS NOT NULL")
def i23(spark, sf):
    k = table(spark, sf, "key_values").select("kv_id", "value_text").filter("value_text is not null").distinct()
    return k.select("kv_id", T.date_range(F.col("value_text"))["end"].alias("until"), T.date_range(F.col("value_text"))["start"].alias("start"))


@query("i24_list_items", r"SELECT DISTINCT kv_id, len(list_filter(list_transform(string_split_regex(regexp_replace(value_text, ',\s*(https?://)', ';\1', 'g'), '[;\n]'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '' AND lower(x) NOT IN ('none', 'n/a', 'na', 'tbd', 'not applicable'))) AS n FROM key_values WHERE value_text IS NOT NULL")
def i24(spark, sf):
    items = python(spark, lambda t: len(reader.split_list(t)), "long")
    return table(spark, sf, "key_values").filter("value_text is not null").select("kv_id", items("value_text").alias("n")).distinct()



@query("i25_project_fields")
def i25(spark, sf):
    """The metadata field of each label."""
    return table(spark, sf, "key_values").select("label").filter("label is not null").distinct().withColumn("field", python(spark, reader.field_of, "string")("label"))


_ROLES = ", ".join(f"('{k}', '{r}')" for k, r in reader.ROLE_KEYS.items())


@query("i26_person_roles", f"WITH r(title, role) AS (VALUES {_ROLES}), t AS (SELECT DISTINCT person_role AS title FROM persons WHERE person_role IS NOT NULL UNION SELECT DISTINCT label FROM key_values WHERE label IS NOT NULL) SELECT t.title, r.role FROM t LEFT JOIN r ON rtrim(lower(regexp_replace(regexp_replace(t.title, '^\\s+', ''), '\\s+$', '')), ':') = r.title")
def i26(spark, sf):
    titles = table(spark, sf, "persons").select(F.col("person_role").alias("title")).union(table(spark, sf, "key_values").select("label")).filter("title is not null").distinct()
    return titles.withColumn("role", python(spark, reader.role_of, "string")("title"))


@query("i17_plausible_names")
def i17(spark, sf):
    return table(spark, sf, "key_values").select("label").distinct().withColumn("plausible", python(spark, lambda t: reader.plausible_name((t or "").strip()), "boolean")("label"))


@query("a18_notes_text", "WITH s AS (SELECT dataset_id, slug, file_name FROM dataset_structures) SELECT DISTINCT dataset_id, CASE WHEN trim(coalesce(slug, '')) = '' OR trim(coalesce(file_name, '')) = '' THEN trim(coalesce(slug, '')) || trim(coalesce(file_name, '')) ELSE trim(slug) || ': ' || trim(file_name) END AS notes FROM s")
def a18(spark, sf):
    """Rows of two cells become key: value."""
    ship(spark)

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([office.notes_text([[x or "", y or ""]]) for x, y in zip(a, b)])

    return table(spark, sf, "dataset_structures").select("dataset_id", F.pandas_udf(run, "string")("slug", "file_name").alias("notes")).distinct()


@query("f30_documented_links", "SELECT DISTINCT unnest(regexp_extract_all(value_text, 'https?://[^ ,;]+')) AS link FROM key_values WHERE value_text IS NOT NULL UNION SELECT DISTINCT unnest(regexp_extract_all(text, 'https?://[^ ,;\\s]+')) FROM documents WHERE text IS NOT NULL")
def f30(spark, sf):
    return D.links(table(spark, sf, "key_values").select(F.col("value_text").alias("t")).union(table(spark, sf, "documents").select("text")), "t")


@query("h10_relation_dedup", "SELECT repo_id, line_start, value_text, min(kv_id) AS kv_id FROM key_values GROUP BY ALL")
def h10(spark, sf):
    """The first of statements that stand on one line with one text."""
    return D.first_by(table(spark, sf, "key_values"), ["repo_id", "line_start", "value_text"], "kv_id")


@query("h09_scalar_merge", "WITH k AS (SELECT DISTINCT repo_id, lower(trim(label, ' ')) AS field, kv_id, value_text FROM key_values WHERE trim(coalesce(label, ''), ' ') <> '' AND trim(coalesce(value_text, ''), ' ') <> '') SELECT repo_id, field, arg_min(value_text, kv_id) AS value, count(DISTINCT value_text) > 1 AS conflict FROM k GROUP BY 1, 2")
def h09(spark, sf):
    k = table(spark, sf, "key_values").select("repo_id", F.lower(F.trim("label")).alias("field"), F.col("value_text").alias("value"), "kv_id")
    return D.merge_scalars(k.filter("field <> ''"), ["repo_id", "field"], "value", "kv_id")


@query("h07_ordered_unique", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def h07(spark, sf):
    return D.first_by(table(spark, sf, "documents"), ["source"], "doc_id")


@query("h08_first_wins", "SELECT lower(trim(name, ' ')) AS person, trim(coalesce(orcid, ''), ' ') AS id, min(person_id) AS person_id FROM persons WHERE trim(coalesce(name, ''), ' ') <> '' GROUP BY 1, 2")
def h08(spark, sf):
    p = table(spark, sf, "persons").select(F.lower(F.trim("name")).alias("person"), F.trim(F.coalesce("orcid", F.lit(""))).alias("id"), "person_id")
    return D.first_by(p.filter("person <> ''"), ["person", "id"], "person_id")
