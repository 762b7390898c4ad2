"""Whole repositories, each with the behaviour it is made for."""

import pytest

from tablewright.plans import inspect as I


@pytest.fixture
def inspect(spark, tmp_path):
    def run(**texts):
        for name, text in texts.items():
            place = tmp_path / name.replace("__", "/").replace("_dot_", ".")
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_text(text)
        document = I.run(spark, str(tmp_path))
        assert I.violations(document) == []
        return document, {d["id"]: d for d in document["datasets"]}

    return run


def columns(dataset):
    return {v["name"]: v for v in dataset["variables"]}


def codes(document):
    return {(i["code"], i["detail"]) for i in document["issues"]} | {i["code"] for i in document["issues"]}


README = """GENERAL INFORMATION
This readme file was generated on 2024-05-01 by the team
Title of Dataset: Two tables
Principal Investigator:
Name: Ann Lee

DATA-SPECIFIC INFORMATION FOR: soil.csv
Number of variables: 4
Number of rows: 3
Missing data codes: -9
Variable List:
- site: where it was
- ph: acidity of the soil
- depth: how deep in the soil (cm)
- ghost: never measured
- owner: withheld for privacy

DATA-SPECIFIC INFORMATION FOR: water.csv
Number of variables: 3
Variable List:
- site: place at the river
- turbidity: how cloudy (NTU)
- grade; quality. Values: 1 = good

The tables soil.csv and water.csv are joined on site_id.
"""


def test_documentation_holds_for_its_own_table(inspect):
    doc, by = inspect(soil_dot_csv="site,ph,depth\na,5.5,10\nb,-9,20\nc,6.5,-9\n", water_dot_csv="site,turbidity,count\na,1.5,1\nb,-9,2\nd,2.5,-9\n", README_dot_txt=README)
    soil, water = columns(by["soil"]), columns(by["water"])
    assert soil["site"]["description"] == "where it was" and water["site"]["description"] == "place at the river"
    assert soil["ph"]["missing"] == 1 and soil["ph"]["statistics"]["min"] == 5.5 and soil["depth"]["unit"] == "cm"
    assert water["turbidity"]["match"]["status"] == "matched" and water["count"]["match"] is None or water["count"]["match"]["status"] == "unmatched"
    assert by["soil"]["unmatched_documented_variables"] == ["ghost"]
    assert {"DOCUMENTED_VARIABLE_NOT_IN_DATA", "DOCUMENTED_VARIABLE_INTENTIONALLY_ABSENT", "DECLARED_COUNT_MISMATCH"} <= codes(doc)
    assert by["soil"]["claims"] == {"variables": "differ", "rows": "agree"} and by["water"]["claims"] == {"variables": "agree", "rows": "not stated"}
    assert by["soil"]["scope"] == ["hint"] and by["soil"]["documented_as"] == "soil.csv" and by["soil"]["last_updated"] == "2024-05-01"
    assert doc["project"]["values"]["title"]["value"] == "Two tables" and [p["name"] for p in doc["project"]["people"]] == ["Ann Lee"] and doc["project"]["people"][0]["role"] == "principal_investigator"
    assert any(r["type"] == "documented" and sorted(r["datasets"]) == ["soil", "water"] and r["variables"] == ["site_id"] for r in doc["relationships"])
    shared = [r for r in doc["relationships"] if r["type"] == "shared_variable"]
    assert [(r["variable"], r["overlap"]) for r in shared] == [("site", 0.667)]
    kinds = {(q["dataset_id"], q["kind"], q["subject"]) for q in doc["review"]}
    assert ("soil", "phantom_variable", "ghost") in kinds and ("water", "undocumented_column", "count") in kinds
    assert [e["stage"] for e in doc["events"]] == ["discovery", "structure", "documentation", "scoping", "columns", "assembly"] and doc["events"][-1]["progress"] == 100


def test_coverage_binds_what_names_no_file_and_other_files_are_referred_to(inspect):
    doc, by = inspect(plots_dot_csv="plot,ph,temp\n1,5,6\n2,6,7\n3,6,8\n", trees_dot_csv="tree,height,girth\n1,5,6\n2,6,7\n", README_dot_md="# Variables\n- plot: number of the plot\n- ph: acidity\n- temp: warmth\n- girth: around the stem\n")
    assert by["plots"]["scope"] == ["coverage"] and by["trees"]["scope"] == []
    assert ("DOCUMENTED_VARIABLE_IN_OTHER_FILE", "girth") in codes(doc)
    girth = columns(by["trees"])["girth"]["match"]
    assert girth["name"] == "girth" and girth["method"] == "cross_file_definition"
    assert any(r["type"] == "cross_file_reference" and r["datasets"] == ["plots", "trees"] for r in doc["relationships"])


def test_messy_header_nested_folders_and_a_codebook(inspect):
    table = "Measured by the river team\n\nstn,val,when\n1,2.5,2021-01-05\n2,3.5,2021-02-06\n3,999,2021-03-01\n"
    book = "# Codebook\n\n| Field | Description | Units | Missing |\n|---|---|---|---|\n| stn | station number | | |\n| val | measured value | mg/L | 999 |\n| when | day | | |\n"
    doc, by = inspect(data__obs_dot_csv=table, docs__codebook_dot_md=book)
    (d,) = doc["datasets"]
    got = columns(d)
    assert d["header_row"] == 3 and got["val"]["unit"] == "mg/L" and got["val"]["missing"] == 1 and got["val"]["statistics"]["max"] == 3.5
    assert got["when"]["type"] == "date" and got["when"]["statistics"] == {"min": "2021-01-05", "max": "2021-03-01"}
    assert all(v["match"]["status"] == "matched" for v in got.values()) and d["scope"] == ["coverage"]


def test_near_names_are_ambiguous_and_tables_without_documentation_complete(inspect):
    doc, by = inspect(a_dot_csv="value1,other\n1,2\n3,4\n", README_dot_txt="VARIABLES\n- value2: one\n- value3: another\n- other: the rest\n")
    assert codes(doc) & {"MATCH_AMBIGUOUS", "MATCH_LOW_CONFIDENCE"}


def test_no_documentation(inspect):
    doc, by = inspect(lonely_dot_csv="a,b\n1,2\n3,4\n")
    assert "README_NOT_FOUND" in codes(doc) and doc["summary"]["datasets"] == 1 and doc["summary"]["undocumented"] == 2


def test_a_dictionary_table_documents_by_file(inspect):
    fields = "Field,Definition,Units,File\nsite,place of the plot,,soil.csv\nph,acidity,,soil.csv\nflow,amount of water,L,water.csv\n"
    doc, by = inspect(soil_dot_csv="site,ph\na,5.5\nb,6\n", water_dot_csv="site,flow\na,1\nb,2\n", fields_dot_csv=fields)
    assert sorted(by) == ["soil", "water"] and columns(by["water"])["flow"]["unit"] == "L" and columns(by["soil"])["site"]["description"] == "place of the plot"
