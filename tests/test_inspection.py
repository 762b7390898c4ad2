import zipfile

import pytest
from pyspark.sql import functions as F

from tablewright.config import Config, load_config
from tablewright.functions import text as T
from tablewright.functions import lines as L
from tablewright.operators import documents as D
from tablewright.operators import histogram as H
from tablewright.operators import matching as M
from tablewright.operators import prose as P
from tablewright.operators import reader
from tablewright.plans import inspect as I
from tablewright.sources import delimited, files, office


def column(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return H.histogram(H.cells_of(df, "d"))


@pytest.mark.parametrize(
    "values, kind",
    [
        (["1", "2", "300"], "integer"), (["007", "012", "100"], "string"), (["0", "1", "1", "0"], "integer"), (["yes", "no", "yes"], "boolean"), (["9.16E+06", "1.2E7", "3E5"], "number"), (["2021-01-05", "2021-02-06"], "date"),
        (["01/02/2021", "03/04/2021"], "string"), (["1.5", "N.A.", "#N/A", "—", "#VALUE!"], "number"), (["1d", "2f"], "string"), ([None, "NA"], "string"), (["2021-01-05T10:00:00", "2021-01-06T11:30:00"], "datetime"),
    ],
)
def test_types(spark, values, kind):
    row = H.infer_types(column(spark, values)).first()
    assert row.type == kind
    assert row.ambiguous_date == (values[0] == "01/02/2021")


def test_sentinels_and_missing(spark):
    assert [r.sentinel for r in H.sentinel_report(column(spark, "10.2 11.5 -999 12.1 10.9 11.7 -999".split())).collect()] == [-999.0]
    assert H.sentinel_report(column(spark, "-20 -9 -5 0 4 11 20".split())).collect() == []
    census = H.missing_census(column(spark, ["NA", "1", None, "", "NA"])).first()
    assert (census.missing, census.tokens) == (4, "NA")


def test_histogram_statistics_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(str(i % 7),) for i in range(100)], "x string")
    results = {str(H.numeric_stats(H.histogram(H.cells_of(df.repartition(n), "d"))).collect()) for n in (1, 3, 8)}
    assert len(results) == 1


@pytest.mark.parametrize(
    "a, b, method, least, most",
    [("BWsmth_chg", "BWsmooth_chg", "token_abbreviation", 0.85, 0.98), ("milk_prt", "milk_fat", "fuzzy", 0.0, 0.70), ("Sr", "SR", "case_insensitive", 0.95, 0.98), ("x", "x", "exact", 1.0, 1.0), ("plot size", "size_plot", "token_set", 0.9, 0.9), ("a_b", "ab", "normalized", 0.95, 0.95)],
)
def test_name_scores(spark, a, b, method, least, most):
    row = M.contextual(M.ladder(spark.createDataFrame([(a, b)], "column string, name string"))).first()
    assert row.method == method and least <= row.score <= most


def test_indel_expression_equals_its_twin(spark):
    pairs = [("milkprt", "milkfat"), ("", "a"), ("", ""), ("abc", "abc"), ("kitten", "sitting"), ("nationkey", "nationkeys")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.indel_ratio(F.col("a"), F.col("b")).alias("r"))
    for row in df.collect():
        assert row.r == pytest.approx(T.py_indel_ratio(row.a, row.b))


def test_assignment_is_one_to_one_and_exact_beats_fuzzy(spark):
    c = spark.createDataFrame([("d", x, i) for i, x in enumerate(["milk", "milk2", "fat"])], "dataset_id string, column string, column_pos int")
    d = spark.createDataFrame([("d", x, i) for i, x in enumerate(["milk", "milk_2", "protein"])], "dataset_id string, name string, definition_pos int")
    got = {r.column: (r["name"], r.status) for r in M.match(c, d).collect()}
    assert got["milk"][0] == "milk" and got["milk2"][0] == "milk_2" and got["fat"] == (None, "unmatched")
    names = [n for n, _ in got.values() if n]
    assert len(names) == len(set(names))


def test_dialects_and_headers():
    assert delimited.sniff("a,b\n1,2\n3,4\n").delimiter == ","
    assert delimited.sniff("a;b;c\n1,5;2;3\n4,5;5;6\n7,5;8;9\n").delimiter == ";"
    assert delimited.sniff("a|b\n1|2\n3|4\n").delimiter == "|"
    t = delimited.read("A study of things\n\nid,value,value,,id\n1,2,3,a,4\n2,3,4,b,5\n", ".csv")
    assert t.header == ["id", "value", "value__2", "column_4", "id__2"]
    assert {"HEADER_BLANK", "HEADER_DUPLICATE"} <= set(t.issues)
    t = delimited.read("name,height,mass,temp\n,(cm),(g),°C\na,1,2,3\nb,2,3,4\n", ".csv")
    assert t.units == [None, "cm", "g", "°C"] and len(t.rows) == 2
    assert not delimited.is_units_row(["m", "f"])
    t = delimited.read('a,b,c\n1,"oops,3\n2,x,4\n3,y,5\n', ".csv")
    assert "CSV_QUOTE_FALLBACK" in t.issues and len(t.rows) == 3


def test_decoding_ladder():
    assert files.decode("héé".encode())[1:3] == ("utf-8", "utf-8")
    assert files.decode(b"\xef\xbb\xbfab")[0] == "ab"
    assert files.decode("ab".encode("utf-16"))[0] == "ab"
    assert files.decode("café".encode("cp1252"))[2] == "cp1252"
    assert files.decode(b"\x81\xe9")[2] == "latin-1"
    assert not files.is_text(b"ab\0c") and files.is_text(b"ab\n")


def test_unsafe_members_are_left_out(tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("../escape.txt", "no")
        z.writestr("ok.csv", "a,b\n1,2\n")
    (tmp_path / "out").mkdir()
    assert files.safe_unzip(str(path), str(tmp_path / "out")) == [("../escape.txt", "ZIP_UNSAFE_MEMBER")]
    assert (tmp_path / "out/ok.csv").exists() and not (tmp_path / "escape.txt").exists()
    with pytest.raises(files.InputError):
        files.discover(str(tmp_path / "nothing"))


def test_missing_codes_abbreviations_relations():
    assert P.missing_codes("NA, -99 (not measured) or blank") == ["NA", "-99", ""]
    assert P.missing_codes("none") == []
    assert P.missing_codes_in_prose("Missing values are coded as -999.") == ["-999"]
    assert P.missing_codes_in_prose("Here -9 indicates missing data.") == ["-9"]
    assert reader.abbreviations("We took dissolved organic carbon (DOC) and more.") == [("DOC", "dissolved organic carbon")]
    assert P.relations("See a.csv and b.csv, joined on plot_id.")[0][1:] == (["a.csv", "b.csv"], ["plot_id"])
    assert P.absence_sentence("All good. Names were redacted here.") == "Names were redacted here."
    assert reader.definition_line("- depth (m): how deep it was") == ("depth", "how deep it was", "m")


def test_left_out_and_linked():
    absent = ["x was removed from the public dataset.", "It is not included.", "Not shared with anyone.", "It is available upon reasonable request.", "Coordinates (withheld)", "They were dropped, sadly."]
    present = ["The outliers were excluded from the analysis.", "It was not included in the mean.", "We removed the lid from each jar.", "Nothing is missing here."]
    assert [P.absence_sentence(t) for t in absent] == absent and [P.absence_sentence(t) for t in present] == [None] * 4
    assert P.announces_exclusion("Variables not included") and P.announces_exclusion("Withheld") and not P.announces_exclusion("Additional related data that was not included")
    assert P.excluded_names("Excluded variables", "ssn, home address and phone") == ["ssn", "phone"]
    assert P.relations("Relationship between files: a.csv and b.csv share the site column\nLinkage: none") == [("Relationship between files: a.csv and b.csv share the site column", ["a.csv", "b.csv"], ["site"])]
    assert P.relations("The files a.csv and b.csv can be linked via `plot_id` and visit_no.")[0][2] == ["plot_id"] or P.relations("The files a.csv and b.csv can be linked via `plot_id` and visit_no.")[0][2] == ["plot_id", "visit_no"]
    assert P.relations("a.csv and b.csv were combined using R.")[0][2] == [] and P.relations("a.csv came before b.csv.") == []
    assert [P.scope_hint(t, True).file for t in ("## survey.csv", "Dataset: plots", "Variables in x.tab:", "Note: none")] == ["survey.csv", "plots", "x.tab", None]
    assert P.scope_hint("Sheet: Field data").sheet == "Field data"
    codes = {"Missing value code = -9": ["-9"], "values of 9999 represent no data": ["9999"], "'.' means no data": ["."], "Blank cells indicate missing data.": [""], "missing values are left blank": [""], "The missing data codes are NA and -99.": ["NA", "-99"], "All is there.": []}
    assert {t: P.missing_codes_in_prose(t) for t in codes} == codes
    assert [P.is_missing_label(t) for t in ("missing by design", "Not recorded", "n/a", "unknown", "refused")] == [True, True, True, False, False]


LINES = ["", "---", "-", "| a | b |", "# Title", "DATA FILES", "Name: x", "ORCID:", "Variable List:", "see http://x.example/a", "time 12:30 at noon", "10:30", "a  b  c", "1. First thing", "- item", "doi: 10.1/2", "plain words here", "<provide a name>", "Key <note to you>: v", "A VERY LONG LINE IN CAPITALS THAT GOES ON AND ON", "x\ty: z", "“Quoted: line”", "ENDS HERE.", "1) Title: of it", "ünï: çødé", " 	"]


def test_lines_are_read_alike_by_both_engines_and_in_python(spark):
    import duckdb

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, raw string").withColumn("line", L.cleaned(F.col("raw")))
    got = {r.i: (r.line, r.kind, r.aligned) for r in rows.select("i", "line", L.kind(F.col("line")).alias("kind"), L.is_aligned(F.col("line")).alias("aligned")).collect()}
    assert got == {i: (reader.clean(x), reader.kind(reader.clean(x)), len(reader.aligned_cells(reader.clean(x))) >= 2) for i, x in enumerate(LINES)}
    c = duckdb.connect()
    c.execute("CREATE TABLE t AS SELECT unnest(?) AS raw, unnest(range(?)) AS i", [LINES, len(LINES)])
    sql = {i: (a, b, d) for i, a, b, d in c.sql(f"SELECT i, line, {L.KIND_SQL}, {L.ALIGNED_SQL} FROM (SELECT i, {L.CLEANED_SQL} AS line FROM t)").fetchall()}
    assert sql == got


def test_people_and_metadata():
    text = "This file was generated on 2024-05-01 by X\n\nGENERAL INFORMATION\nTitle of Dataset: Plots\nTitel of dataset: other\nAuthor:\nName: Ann Lee\nORCID: 0000\nInstitution: Uni\nName: Bo Li\nEmail: b@x.example\nContact person:\nName: Cy Ho\n\nFunding sources: NSF; DFG\nDate of data collection: 2020-01-01 to 2020-02-01\nRelated publications: http://x.example/1, http://x.example/2\nHumidity: wet\n\nMETHODS USED\nWe looked.\n\nVARIABLE LIST\nName: depth\nUnit: m"
    p = reader.project(reader.sections(text), text)
    assert [(q.name, q.role, q.orcid, q.affiliation, q.email) for q in p.people] == [("Ann Lee", "author", "0000", "Uni", None), ("Bo Li", "author", None, None, "b@x.example"), ("Cy Ho", "contact", None, None, None)]
    assert {k: v for k, (v, _) in p.values.items()} == {"readme_generated_on": "2024-05-01", "title": "Plots", "collection_period": "2020-01-01 to 2020-02-01"}
    assert p.funding == ["NSF", "DFG"] and p.publications == ["http://x.example/1", "http://x.example/2"] and p.methods == [("METHODS USED", "We looked.")] and ("Humidity", "wet") in [o[:2] for o in p.other]
    assert reader.field_of("Titel of dataset") == "title" and reader.field_of("licence") == "license" and reader.field_of("weather") is None and reader.field_of(None) is None


def test_layouts_of_variable_lists():
    aligned = "VARIABLE   DESCRIPTION      UNIT\ndepth      how deep         cm\nsite                        m\nend of it"
    rows = list(enumerate(aligned.split("\n"), 1))
    assert reader.recognise(rows) == ("aligned_table", [{"name": "depth", "description": "how deep", "unit": "cm", "line_start": 2, "line_end": 2}, {"name": "site", "unit": "m", "line_start": 3, "line_end": 3}])
    pipe = "| Field | Definition | Units |\n|---|---|---|\n| ph | acidity | |\n| t | warmth | °C |"
    assert [d["name"] for d in reader.recognise(list(enumerate(pipe.split("\n"), 1)))[1]] == ["ph", "t"]
    found, everywhere = reader.groups(reader.sections("Missing data codes: -9\n\n# Variables of a.csv\n- x: length (cm)\n- y: width\n\nThe following variables were removed from the public release:\n- name\n- street: where\n\n# Variables of b.csv\nNumber of variables: 2\n- z: depth"))
    assert [(g.file, g.declared_variables, g.codes) for g in found] == [("a.csv", None, ["-9"]), ("b.csv", 2, ["-9"])] and everywhere == ["-9"]
    assert {d["name"]: "absent" in d for d in found[0].variables} == {"x": False, "y": False, "street": True}


@pytest.mark.parametrize("header, kind", [(["Variable", "Description"], True), (["name", "label"], False), (["name", "label", "unit"], True), (["code", "description"], True), (["id", "value"], False)])
def test_dictionary_headers(header, kind):
    assert (delimited.dictionary_columns(header) is not None) == kind


def test_evidence_of_tables():
    assert delimited.tabular_evidence("age,Age of the respondent in full years at the interview\nsex,Sex of the respondent as told to the interviewer\nh,Height of the respondent in cm without any shoes") == 1.0
    assert delimited.tabular_evidence("All of us went out early, and it rained on us for the whole day.\nThen at last it stopped again, but we had already gone home by then.\nAs far as I know, nobody minded that very much in the end.") == 0.0
    assert delimited.tabular_evidence("Variable List:\nid, number\nage, years\nsite, place\nx, y") == 0.25 and delimited.tabular_evidence("a,b\n1,2") == 0.5


def test_large_tables_are_read_by_lines(spark):
    rows = [(1, i, line) for i, line in enumerate(["A title", "id;day;note", "1;2;x", '2;3;"a;b"', "3;4", "", "4;5;6"], 1)] + [(2, i, line) for i, line in enumerate(["a,b", "1,2", "3,4"], 1)]
    lines = spark.createDataFrame([*rows, rows[2]], "dataset_id long, line_no long, raw_line string")
    layout = delimited.layouts(delimited.head_of(lines))
    got = {(r.dataset_id, r.line_no, r["name"]): r.raw for r in delimited.read_lines(lines, layout).collect()}
    assert got[1, 4, "note"] == "a;b" and got[1, 5, "note"] == "" and got[1, 7, "note"] == "6" and got[2, 3, "b"] == "4" and len(got) == 4 * 3 + 2 * 2


def test_rivals_count_unless_a_strictly_better_pair_owns_them(spark):
    scored = spark.createDataFrame(
        [("d", "a", 1, "x", 1, 0.97, 0.95, False, "normalized"), ("d", "a", 1, "y", 2, 0.95, 0.95, False, "normalized"), ("d", "b", 2, "y", 2, 0.95, 0.95, False, "normalized"), ("e", "a", 1, "x", 1, 0.9, 0.9, False, "token_set"), ("e", "a", 1, "y", 2, 0.88, 0.88, False, "fuzzy"), ("e", "b", 2, "y", 2, 1.0, 1.0, False, "exact"), ("f", "a", 1, "x", 1, 0.9, 0.9, True, "token_set")],
        "dataset_id string, column string, column_pos int, name string, definition_pos int, score double, base double, contradicted boolean, method string",
    )
    got = {(r.dataset_id, r.column): (r["name"], r.status, r.confidence) for r in M.assign(scored).collect()}
    assert got["d", "a"] == ("x", "ambiguous", 0.97) and got["e", "a"] == ("x", "matched", 0.95) and got["f", "a"] == ("x", "matched", 0.9)


def test_histograms_of_typed_tables(spark):
    from datetime import date, datetime
    from decimal import Decimal

    rows = [(1, 1.5, "a ", date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5, 600), Decimal("1.25"), True), (1, 1e15, "a", None, datetime(2024, 1, 2, 3, 4, 5, 700), None, None), (None, 1.50001, " ", None, None, None, False), (2, float("nan"), None, None, None, None, False), (2, -0.00001, None, None, None, None, False)]
    df = spark.createDataFrame(rows, "i int, x double, s string, d date, t timestamp, c decimal(10,2), b boolean")
    got = {(r["name"], r.value): r.n for r in H.histogram_of(df, "d").collect()}
    assert got == {
        ("i", "1"): 2, ("i", "2"): 2, ("i", None): 1, ("x", "1.5000"): 2, ("x", "1000000000000000.0000"): 1, ("x", None): 1, ("x", "0.0000"): 1, ("s", "a"): 2, ("s", None): 3, ("d", "2024-01-02"): 1, ("d", None): 4,
        ("t", "2024-01-02 03:04:05"): 2, ("t", None): 3, ("c", "1.2500"): 1, ("c", None): 4, ("b", "true"): 1, ("b", "false"): 3, ("b", None): 1,
    }


@pytest.mark.parametrize("most", [10**6, 2])
def test_quartiles_by_ranges(spark, most):
    values = {"a": [3.0, 1.0, 2.0, 2.0, 9.0, 4.0, 4.0], "b": [5.0], "c": [1.0, 2.0]}
    df = spark.createDataFrame([(k, x) for k, v in values.items() for x in v], "k string, x double").groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    import numpy as np

    got = {r.k: (r.q1, r.median, r.q3) for r in H.quartiles(df.repartition(5), ["k"], most).collect()}
    assert got == {k: pytest.approx(tuple(np.percentile(v, [25, 50, 75]))) for k, v in values.items()}


def test_settings(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("header_scan_rows = 5\n")
    assert load_config(str(f)).header_scan_rows == 5
    f.write_text("nonsense = 5\n")
    with pytest.raises(ValueError):
        load_config(str(f))


def _workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    row = lambda i, cells: f'<row r="{i}">' + "".join(f'<c r="{chr(65 + k)}{i}" t="inlineStr"><is><t>{c}</t></is></c>' for k, c in enumerate(cells)) + "</row>"
    sheet = lambda rows: f"<worksheet {ns}><sheetData>{''.join(row(i, r) for i, r in enumerate(rows, 1))}</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Plots" sheetId="1" r:id="r1"/><sheet name="Off" sheetId="2" state="hidden" r:id="r2"/><sheet name="None" sheetId="3" r:id="r3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/><Relationship Id="r3" Target="worksheets/s3.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", sheet([["plot", "depth"], ["1", "2.5"], ["2", "3.5"], ["3", "1.0"]]))
        z.writestr("xl/worksheets/s2.xml", sheet([["a", "b"], ["1", "2"]]))
        z.writestr("xl/worksheets/s3.xml", sheet([]))


def test_workbooks(tmp_path):
    _workbook(tmp_path / "w.xlsx")
    tables, issues = office.sheets((tmp_path / "w.xlsx").read_bytes(), ".xlsx")
    assert [n for n, _ in tables] == ["Plots", "Off"] and dict(issues) == {"Off": "EXCEL_HIDDEN_SHEET", "None": "EXCEL_EMPTY_SHEET"}
    assert office.sheets(b"junk", ".xlsx")[1] == [("", "EXCEL_CORRUPT")]


def _kept_schema(tmp_path):
    place = tmp_path.parent / f"{tmp_path.name}_schema.json"
    place.write_text(I.schema_json())
    return place


def test_a_repository_end_to_end(spark, tmp_path):
    (tmp_path / "survey.csv").write_text("id,age,score,site\n1,20,1.5,a\n2,-99,2.5,b\n3,40,NA,c\n")
    (tmp_path / "sites.tab").write_text("site\tdepth_m\na\t1.5\nb\t2.5\nc\t3.5\n")
    (tmp_path / "README.txt").write_text("VARIABLES\nFilename: survey.csv\nMissing data codes: -99\n- id: number of the person\n- age: age in years\n- score: result (%)\n- weight: weight of the person\n\nThe tables survey.csv and sites.tab are joined by the key site.\n")
    _workbook(tmp_path / "book.xlsx")
    events = []
    doc = I.run(spark, str(tmp_path), Config(), events.append)
    by = {d["id"]: d for d in doc["datasets"]}
    assert {"survey", "sites", "book_plots", "book_off"} <= set(by)
    columns = {v["name"]: v for v in by["survey"]["variables"]}
    assert columns["age"]["type"] == "integer" and columns["age"]["missing"] == 1 and columns["score"]["missing"] == 1
    assert columns["id"]["match"]["status"] == "matched"
    assert any(r["type"] == "shared_variable" and r["variable"] == "site" for r in doc["relationships"])
    assert any(r["type"] == "documented" and r["variables"] == ["site"] for r in doc["relationships"])
    codes = {(i["code"], i["location"]) for i in doc["issues"]}
    assert any(i["code"] == "DOCUMENTED_VARIABLE_NOT_IN_DATA" and i["detail"] == "weight" for i in doc["issues"]) and by["survey"]["unmatched_documented_variables"] == ["weight"]
    assert I.violations(doc) == [] and I.violations({}) != [] and I.main(["--schema", "--check", str(_kept_schema(tmp_path))]) == 0
    assert [e["seq"] for e in events] == list(range(1, len(events) + 1))
    assert I.run(spark, str(tmp_path / "none"))["issues"][0]["code"] == "INPUT_NOT_FOUND"


def test_the_core_stands_alone():
    from tablewright.plans import registry

    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLE) <= set(registry.QUERIES)
