"""Queries over all rows of their tables, held against brute force."""

import re

from tablewright.functions import text as T
from tablewright.plans import registry

NAMES = ["Zoë Novak", "ÉDOUARD Roux", "Ondřej Dvořák", "Czéch", "Ştefan ﬁ Ǻ", "𝒜 m² ½ ℃ ㎏", "Ø ß 한글 😀 ½", "plain", "", None]


def kept(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def plain(name):
    return name if name is None else "".join(c if "가" <= c <= "힣" else T.py_strip_accents(c) for c in name)


def test_accents_of_all_names(spark, tmp_path):
    sf = kept(spark, tmp_path, "persons", [(i, n) for i, n in enumerate(NAMES)], "person_id long, name string")
    got = {r.person_id: r.plain for r in registry.QUERIES["i02_strip_accents_all"](spark, sf).collect()}
    assert got == {i: plain(n) for i, n in enumerate(NAMES)}
    part = {r.person_id: r.plain for r in registry.QUERIES["i02_strip_accents"](spark, sf).collect()}
    assert part == {i: plain(n) for i, n in enumerate(NAMES) if n is not None and all(" " <= c <= "~" for c in plain(n))}


def test_tokens_of_all_names(spark, tmp_path):
    names = [n for n in NAMES if n is not None] + ["siteÉlevé", "flux mg·L⁻¹", "Temp_(℃)"]
    sf = kept(spark, tmp_path, "dataset_variables", [(n,) for n in [*names, None]], "original_name string")
    got = {r.name: r.tokens for r in registry.QUERIES["i04_tokenize"](spark, sf).collect()}
    assert got == {n: T.py_tokenize(n) for n in names}


def test_all_labels(spark, tmp_path):
    labels = ["“Title(s)”", " 2. Número de filas", "1) Author\tname", "Ort", "…", None]
    sf = kept(spark, tmp_path, "key_values", [(x,) for x in labels], "label string")
    got = {r.label: r.norm for r in registry.QUERIES["i07_labels"](spark, sf).collect()}
    norm = lambda x: re.sub(r"[^a-z0-9]+", " ", re.sub(r"^\s*\d+[.)]\s*", "", x.lower().replace("(s)", ""))).strip()
    assert got == {x: norm(x) for x in labels if x is not None}


TEXT = "# Variables of a.csv\nph: acidity of soil\n- depth, how deep (cm)\n\nMissing data codes: NA, -99\n\nsee a.csv and b.csv, joined on plot_id.\nVariables not released:\n- names of farms\n- parcels\n\nExcluded variables: owner"


def test_operators_take_documents(spark, tmp_path):
    sf = kept(spark, tmp_path, "documents", [(7, TEXT), (8, "# Other\nNumber of rows: 12\nName: Ann Lee\nEmail: a@b.example\nTitle: x"), (9, None)], "doc_id long, text string")
    kept(spark, tmp_path, "column_contexts", [(1, 1, "ph"), (2, 1, "PH"), (2, 2, "x")], "dataset_id long, pos int, name string")
    kept(spark, tmp_path, "dataset_structures", [(1, "d/a.csv"), (2, "b.csv")], "dataset_id long, file_name string")
    kept(spark, tmp_path, "key_values", [(3, "Missing value codes", "."), (3, "Missing value codes", "."), (4, "Title", "NA")], "kv_id long, label string, value_text string")
    run = lambda name: registry.QUERIES[name](spark, sf).collect()
    sections = {(r.file, r.line_no): r.section_title for r in run("g01_sections")}
    assert len(sections) == len(TEXT.split("\n")) + 6 and sections["7", 5] == "Variables of a.csv" and sections["8", 2] == "Other"
    assert {(r.file, r.key) for r in run("g03_key_values")} == {("7", "ph"), ("7", "Missing data codes"), ("7", "Excluded variables"), ("8", "Number of rows"), ("8", "Name"), ("8", "Email"), ("8", "Title")}
    found = {(r.file, r.name): r for r in run("i13_definitions")}
    assert {("7", "ph"), ("7", "depth"), ("7", "owner")} <= set(found) and found["7", "ph"].file_hint == "a.csv" and found["7", "depth"].unit == "cm" and found["7", "owner"].absent
    assert sorted((r.origin, r.place, r.codes) for r in run("i19_missing_codes")) == [("document", "7:5", ["NA", "-99"]), ("key_value", "3", ["."])]
    assert [(r.file, r.what, r.n) for r in run("i22_declared_counts")] == [("8", "rows", 12)]
    assert {r.line_no for r in run("g07_exclusion_lists")} == {9, 10}
    assert [(r.file, r.value, r.detail) for r in run("i31_relations")] == [("7", "a.csv|b.csv", "plot_id")]
    assert [r.datasets for r in run("f29_stated_relations")] == [["1", "2"]]
    assert {(r.dataset_id, r.column, r.others) for r in run("f25_same_name_elsewhere")} == {(1, "ph", 1), (2, "PH", 1)}
    assert [(r.name, r.role, r.email) for r in run("g10_people")] == [("Ann Lee", "author", "a@b.example")]
    assert ("8", "title", "x") in {(r.file, r.field, r.value) for r in run("i25_metadata_of_documents")}
