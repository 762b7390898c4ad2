import tempfile
from collections import Counter
from datetime import datetime
from itertools import product

import pytest
from pyspark.sql import functions as F

from tablewright.operators import quality as Q

CELL = "repo_id long, dataset_id long, load_no int, row_no int, pos int, raw string, loaded_at timestamp, rule string, n long"
VARIABLE = "variable_id long, dataset_id long, load_no int, pos int, var_type string, var_format string, var_role string, missing_values array<string>, stat_missing long, stat_distinct long, stat_min string, stat_max string, value string"


def cells(spark, columns):
    """columns: {(dataset, load, pos): [raw, ...]}; extra columns with clashing names come along."""
    rows = [(1, d, lo, r, p, raw, datetime(2024, 1, 1), "x", 7) for (d, lo, p), values in columns.items() for r, raw in enumerate(values, 1)]
    return spark.createDataFrame(rows, CELL)


def variable(d, load, pos, kind, form="default", role="measure", tokens=("NA",), missing=None, distinct=None, low=None, high=None):
    return (d * 100 + load * 10 + pos, d, load, pos, kind, form, role, list(tokens) if tokens is not None else None, missing, distinct, low, high, "v")


def checks(frame, v, least=Q.HOT_ROWS):
    path = f"{tempfile.mkdtemp()}/counts"
    return [tuple(r) for r in Q.quality_checks(frame, v, path, least).collect()]


def run(spark, columns, variables, least=Q.HOT_ROWS):
    return set(checks(cells(spark, columns), spark.createDataFrame(variables, VARIABLE), least))


@pytest.mark.parametrize("least", [Q.HOT_ROWS, 3])
def test_recorded_statistics_and_patterns(spark, least):
    columns = {(1, 1, 1): ["1", " 2 ", "+3", "x", None, "NA", ""], (1, 1, 2): ["2024-02-29", "2023-02-29", "2024-2-01", "NA"], (1, 1, 3): ["Yes", "f", "maybe"], (1, 1, 4): ["A-1", "A-22", "NA"]}
    variables = [
        variable(1, 1, 1, "integer", missing=3, distinct=4, low="1", high="4"),
        variable(1, 1, 2, "date", "%Y-%m-%d", missing=0, low="2024-02-29", high="2024-02-29"),
        variable(1, 1, 3, "boolean"),
        variable(1, 1, 4, None, "^A-[0-9]$", distinct=3, tokens=None),
    ]
    assert run(spark, columns, variables, least) == {
        (1, 1, 1, "max"), (1, 1, 1, "pattern"), (1, 2, 1, "missing"), (1, 2, 1, "pattern"), (1, 3, 1, "pattern"), (1, 4, 1, "pattern"),
    }


@pytest.mark.parametrize("least", [Q.HOT_ROWS, 3])
def test_shift_of_mean_share_and_missing(spark, least):
    columns = {
        (1, 1, 1): [str(x) for x in range(10)], (1, 2, 1): [str(x + 50) for x in range(10)],
        (1, 1, 2): ["t"] * 9 + ["f"] * 3, (1, 2, 2): ["f"] * 10 + ["t"] * 2,
        (1, 1, 3): ["a"] * 4, (1, 2, 3): ["a"] * 2 + ["NA"] * 2,
        (1, 1, 4): [str(x) for x in range(10)], (1, 2, 4): [str(x + 50) for x in range(10)],
        (1, 1, 5): ["5"] * 10, (1, 2, 5): ["9"] * 10,
        (1, 2, 6): ["only", "new"],
    }
    kinds = {1: ("integer", "measure"), 2: ("boolean", "categorical"), 3: ("string", "text"), 4: ("integer", "identifier"), 5: ("integer", "measure"), 6: ("string", "text")}
    variables = [variable(1, load, pos, kind, role=role) for (pos, (kind, role)), load in product(kinds.items(), (1, 2))]
    assert run(spark, columns, variables, least) == {(1, 1, 2, "shift"), (1, 2, 2, "shift"), (1, 3, 2, "shift")}


def test_repeated_deliveries_empty_tables_and_columns_without_rules(spark):
    columns = {(1, 1, 1): ["1", "2"], (2, 1, 1): ["x"]}
    v = [variable(1, 1, 1, "integer", missing=0, distinct=2, low="1", high="2")]
    twice = cells(spark, columns).unionByName(cells(spark, columns))
    assert checks(twice, spark.createDataFrame(v, VARIABLE)) == []
    assert checks(cells(spark, {}), spark.createDataFrame(v, VARIABLE)) == []
    assert checks(twice, spark.createDataFrame([], VARIABLE)) == []


@pytest.mark.parametrize("least", [Q.HOT_ROWS, 3])
def test_the_maintained_table_holds_states_and_profiles(spark, tmp_path, least):
    columns = {(1, 1, 1): ["a", "a", "b", None], (1, 2, 1): ["b", "c", "NA"], (1, 3, 1): ["c", "c"]}
    path = str(tmp_path / "counts")
    v = spark.createDataFrame([variable(1, load, 1, "string") for load in (1, 2, 3)], VARIABLE)
    got = {r.load_no: r for r in Q.full_profile(cells(spark, columns), v, path, least).collect()}
    assert {k: (r.n_cells, r.n_missing, r.n_distinct) for k, r in got.items()} == {1: (4, 1, 2), 2: (3, 1, 2), 3: (2, 0, 1)}
    assert got[1].entropy_bits == 0.9183 and got[3].entropy_bits == 0.0
    table = spark.read.parquet(path)
    for load in (1, 2, 3):
        state = table.filter(F.col("load_no") <= load).groupBy("value").agg(F.sum(F.col("arrived") - F.col("left")).alias("n")).filter("n <> 0")
        want = Counter((x or "").strip() for x in columns[1, load, 1])
        assert {r.value: r.n for r in state.collect()} == want


def test_state_of_the_persistent_table_equals_counts(spark, tmp_path):
    one, two = {(1, 1, 1): ["a", "a", "b"]}, {(1, 2, 1): ["b", "c"]}
    path = str(tmp_path / "counts")
    Q.append_deltas(Q.signed_deltas(Q.value_counts(Q.trimmed_cells(cells(spark, {**one, **two})))), path)
    assert {(r.value, r.n) for r in Q.state_after(spark, path, 1).collect()} == {("a", 2), ("b", 1)}
    assert {(r.value, r.n) for r in Q.state_after(spark, path, 2).collect()} == {("b", 1), ("c", 1)}
    assert Q.state_after(spark, path, 3).collect() == []
