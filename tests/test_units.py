import pytest

from tablewright.operators import units as U


@pytest.mark.parametrize(
    "text, code",
    [
        ("kg", "kg"), (" (Grams) ", "g"), ("[m s-1]", "m_per_s"), ("mg·L−1", "mg_per_l"), ("'000 ind.", "kilo_each"), ("℉", "degf"), ("KPa", "kpa"), ("mm Hg", "mmhg"), ("sq. cm", "cm2"), ("kilogarm", None), ("kilogam", "kg"),
        ("%", None), ("see notes", None), ("", None), (None, None), ("unitless", None), ("MJ", "mj"), ("″", "inch"), ("gallons (US)", "gal"),
    ],
)
def test_stated_units(text, code):
    assert U.stated_unit(text) == code


@pytest.mark.parametrize(
    "text, name, code",
    [
        ("Score given after 10 min of watching", False, None), ("Visits seen along a 50 m line", False, None), ("Energy taken in", False, None), ("Energy taken in, in kilojoule", False, "kj"), ("Soil depth; unit: cm", False, "cm"),
        ("Size (given in sq m)", False, "m2"), ("Wind at the mast. Values are km/h", False, "km_per_h"), ("Wing Span2, micrometre", True, "um"), ("heat_out_kj", True, "kj"), ("air_temp_a", True, None), ("n_leaves_1", True, None),
        ("WATER_USED_1, l", True, "l"), ("Canopy [ha]", True, "ha"), (None, True, None), ("Depth in m below surface", False, "m"), ("Time in min of the second test", False, "min"), ("Taken in 5 min of watching", False, None), ("Heat in kWh", False, "kwh"), ("Weight of 12 kg animals", False, None), ("Plants in m2 plots", False, None),
    ],
)
def test_units_in_texts(text, name, code):
    assert U.unit_in_text(text, name) == code


def test_priority_factors_and_edges(spark):
    v = spark.createDataFrame(
        [
            (1, 1, 1, "cm", None, "x", None, 5.0, 1.0, "1", "9", "number", 10), (2, 1, 2, "-", None, "x", None, 5.0, 1.0, "1", "9", "number", None), (3, 1, 3, None, None, "x", None, 5.0, 1.0, None, None, "number", 10),
            (4, 1, 4, None, "x in mm", "x", None, 5.0, 1.0, "1", "9", "number", None), (5, 1, 5, "m", None, "x", None, 5.0, 1.0, "1", "9", "number", None), (6, 1, 6, "cm", None, "x", None, None, None, None, None, "string", None),
            (7, 1, 7, "degf", None, "x", None, 212.0, 9.0, "32", "212", "number", None), (1, 1, 1, "cm", None, "x", None, 5.0, 1.0, "1", "9", "number", 10),
        ],
        "variable_id long, dataset_id long, pos int, unit string, original_name string, name string, description string, stat_mean double, stat_std double, stat_min string, stat_max string, var_type string, def_id long",
    )
    c = spark.createDataFrame([(1, 1, 2, "(kg)", "clash")], "context_id long, dataset_id long, pos int, header_unit string, unit string")
    d = spark.createDataFrame([(10, "km", "2024", "clash")], "def_id long, unit string, parsed_at string, name string")
    u = spark.createDataFrame([("cm", "length", 0.01, 0.0), ("m", "length", 1.0, 0.0), ("km", "length", 1000.0, 0.0), ("mm", "length", 0.001, 0.0), ("kg", "mass", 1000.0, 0.0), ("degf", "temperature", 5 / 9, -160 / 9)], "unit_code string, quantity string, to_common_factor double, to_common_shift double")
    assert {tuple(r) for r in U.other_units(v, c, d, u).collect()} == {(1, "cm"), (2, "kg"), (3, "km"), (4, "mm"), (7, "degf")}
    by = {r.variable_id: r for r in U.common_statistics(v, c, d, u).collect()}
    assert by[7].common_mean == pytest.approx(100.0) and by[7].common_min == pytest.approx(0.0) and by[7].common_std == pytest.approx(5.0)
    assert by[1].common_mean == pytest.approx(0.05) and by[6].common_mean is None
    assert U.other_units(v.limit(0), c, d, u).collect() == []
