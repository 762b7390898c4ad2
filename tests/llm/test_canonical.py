import pytest

from tablewright.llm import canonical as C

TERMS = [(1, "field_label", "Title", ["Dataset name", "Titre"]), (2, "field_label", "Collection period", ["Sampling dates"]), (3, "field_label", "Number of variables", None), (4, "column_type", "number", ["decimal", "float"]), (5, "column_type", "string", ["text", "character"]), (6, "column_type", "time", []), (7, "column_type", "datetime", ["timestamp"])]
VALUES = {
    ("field_label", "titel"): 1, ("field_label", " 12. TITLE (required) "): 1, ("field_label", "NameDataset"): 1, ("field_label", "Title page colour"): -1, ("field_label", "period, collection"): 2, ("field_label", "Collection permit"): -1,
    ("field_label", "collecrion preiod"): 2, ("field_label", "no of vars"): 3, ("field_label", "???"): -1, ("field_label", "“Sampling-Dates:”"): 2, ("field_label", "x " * 5000): -1, ("column_type", "nbr."): 4, ("column_type", "Text(40)"): 5,
    ("column_type", "chr. text"): 5, ("column_type", "TIMES"): 6, ("column_type", "formula"): -1, ("other", "title"): -1,
}


def _terms(spark):
    return spark.createDataFrame([(*t, "clash") for t in TERMS], "term_id long, term_domain string, term string, also_written array<string>, value string")


def test_values_are_mapped(spark):
    values = spark.createDataFrame([*VALUES, *VALUES, ("field_label", None)], "domain string, value string")
    got = {(r.domain, r.value): r.term_id for r in C.match_values(values, _terms(spark)).collect()}
    assert got == VALUES


def test_the_join_finds_all_pairs_of_the_threshold(spark):
    """Prefix, length and position filters lose nothing against brute force."""
    labels = ["titel", "tilte of", "name data", "decmal", "samplng date", "period of collection", "nmber of variable", "colection"]
    values = spark.createDataFrame([("field_label", v) for v in labels], "domain string, value string")
    got = {r.value: r.term_id for r in C.match_values(values, _terms(spark)).collect()}
    for v in labels:
        best = []
        for rank, reading in enumerate(C.readings(v)):
            for i, d, t, a in TERMS:
                for entry, short in C._entry_forms(t, a) if d == "field_label" else []:
                    p, q = set(C.pairs(reading)), set(C.pairs(entry))
                    j = len(p & q) / len(p | q)
                    w = (0.05 if reading == entry else None) if short else C.word_distance(reading, entry)
                    if j >= C.THRESHOLD and w is not None:
                        best.append((-j, rank, w, i))
        assert got[v] == (min(best)[3] if best else -1)


def test_cases_and_empty_tables(spark):
    k = spark.createDataFrame([(1, "Title", "x"), (2, "title", "x"), (2, "title", "x"), (3, "  ", "x"), (4, None, "x")], "kv_id long, label string, term_id string")
    d = spark.createDataFrame([(1, "float", 9)], "def_id long, declared_type string, record_id int")
    assert {tuple(r) for r in C.found(k, d, _terms(spark)).collect()} == {("label", 2, 1), ("declared_type", 1, 4)}
    assert {tuple(r) for r in C.found(k, d, _terms(spark).limit(0)).collect()} == {("label", 1, -1), ("label", 2, -1), ("declared_type", 1, -1)}
    assert C.found(k.limit(0), d.limit(0), _terms(spark)).collect() == []


@pytest.mark.parametrize("a, b, n", [("abc", "acb", 1), ("abc", "abcd", 1), ("abc", "xbc", 1), ("", "ab", 2)])
def test_slips(a, b, n):
    assert C.slips(a, b) == n
