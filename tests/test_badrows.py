import csv
import io
import random

import pytest

from tablewright.operators import badrows as B


@pytest.mark.parametrize(
    "record, width, fields, cost",
    [
        ("a,b", 2, ["a", "b"], 0), ("a,b", 3, ["a", "b"], 1), ('"a,b",c', 2, ["a,b", "c"], 0), ('"a""b",c', 2, ['a"b', "c"], 0), ('5" pipe,b', 2, ['5" pipe', "b"], 0),
        ('"a,b', 2, None, 1), ('"a"x,b', 2, None, 1), ("", 1, [""], 0), ('""', 1, [""], 0), ('a,"two\nlines"', 2, ["a", "two\nlines"], 0), ("a,b,c", 2, ["a", "b", "c"], 1),
    ],
)
def test_reading_and_least_edits(record, width, fields, cost):
    assert B.read_fields(record, ",", '"') == fields
    assert B.least_edits(record, ",", '"', width if fields is not None else None)[0] == cost


def test_round_trip_with_a_writer():
    draw = random.Random(5)
    for _ in range(300):
        row = ["".join(draw.choice('ab,"\n ;') for _ in range(draw.randrange(6))) for _ in range(draw.randrange(1, 5))]
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(row)
        assert B.read_fields(out.getvalue(), ",", '"') == row
        assert B.least_edits(out.getvalue(), ",", '"', len(row))[0] == 0


def test_edits_lead_to_a_sound_record():
    draw = random.Random(6)
    for _ in range(150):
        record = "".join(draw.choice('ab,"') for _ in range(draw.randrange(1, 9)))
        cost, edits = B.least_edits(record, ",", '"', 3)
        text = list(record)
        for kind, place in reversed(edits):
            if kind.startswith("delete"):
                text.pop(place)
            else:
                text.insert(place, '"' if kind.endswith("quote") else ",")
        fields = B.read_fields("".join(text), ",", '"')
        assert fields is not None and len(fields) == 3 and len(edits) == cost, (record, edits)


def brute_force(record, delimiter, quote, width):
    """The least cost by trying all edits, cheapest first."""
    from itertools import count

    level, seen = {record}, {record}
    for cost in count():
        for text in level:
            fields = B.read_fields(text, delimiter, quote)
            if fields is not None and width in (None, len(fields)):
                return cost
        near = {text[:i] + text[i + 1 :] for text in level for i, c in enumerate(text) if c in (delimiter, quote)}
        near |= {text[:i] + c + text[i:] for text in level for i in range(len(text) + 1) for c in (delimiter, quote) if c}
        level = near - seen
        seen |= near


@pytest.mark.parametrize("quote", ['"', None])
def test_least_cost_equals_brute_force(quote):
    draw = random.Random(7)
    for _ in range(120):
        record = "".join(draw.choice('ab,,""') for _ in range(draw.randrange(1, 8)))
        fields = B.read_fields(record, ",", quote)
        width = draw.choice([None, 1, 2, 3])
        best = brute_force(record, ",", quote, width)
        if best <= 3:
            assert B.least_edits(record, ",", quote, width)[0] == best, (record, width, fields)


def test_long_records_get_their_edits():
    field = "word " * 20_000
    assert B.least_edits(f'1;"{field};{field}', ";", '"', None)[0] == 1
    assert B.least_edits(f'1;"{field}";{field};x', ";", '"', 3)[0] == 1
    many = ",".join(f'"a{i}"' for i in range(20_000))
    assert B.least_edits(many + ',"b', ",", '"', None)[0] == 1
    assert B.least_edits(many, ",", '"', 20_002)[0] == 2 and B.least_edits("x," * 50_000, ",", '"', 3)[0] == 49_998
    spec = B.Spec('{"delimiter": ",", "quote_char": "\\"", "field_count": 20000}')
    assert spec.judge(many)[0] is None and spec.judge(many + ',"b')[0] == "quoting" and spec.judge(many + ",b")[0] == "field_count"


RAW = "dataset_id long, line_no long, raw_line string, ingested_at string, spec string"
STRUCTURE = "dataset_id long, delimiter string, quote_char string, header_row int, field_count int, raw_line string"
VARIABLE = "dataset_id long, load_no int, pos int, var_type string, var_format string, missing_values array<string>"


def test_tables_with_every_edge(spark):
    raw = [
        (1, 1, "id;day;note", "", ""), (1, 2, "1;2024-01-02;x", "", ""), (1, 3, "NA;;", "", ""), (1, 4, "a;2024-01-02;x", "", ""), (1, 5, "1;2024-13-02;x", "", ""), (1, 6, '1;"2024-01-02;x', "", ""),
        (1, 7, "1;2024-01-02", "", ""), (1, 8, "   ", "", ""), (1, 9, None, "", ""), (1, 2, "1;2024-01-02;x", "late", ""), (2, 1, 'a\t"b', "", ""), (3, 1, "whole; line", "", ""), (4, 1, "lost", "", ""),
        (1, 10, "1;2024-01-02;" + "long " * 30_000, "", ""), (1, 11, '1;"2024-01-02;' + "long " * 30_000, "", ""),
    ]
    s = [(1, ";", '"', 1, 3, "clash"), (1, ";", '"', 1, 3, "clash"), (2, "tab", None, 0, 2, ""), (3, None, '"', None, None, "")]
    v = [(1, 1, 1, "integer", "default", ["NA"]), (1, 1, 2, "date", "%Y-%m-%d", None), (1, 1, 3, "string", "default", [])]
    frames = spark.createDataFrame(raw, RAW), spark.createDataFrame(s, STRUCTURE), spark.createDataFrame(v, VARIABLE)
    found = {(r.dataset_id, r.line_no, r.reason) for r in B.failed_rows(*frames).collect()}
    assert found == {(1, 4, "value"), (1, 5, "value"), (1, 6, "quoting"), (1, 7, "field_count"), (1, 11, "quoting")}
    loaded = {(r.dataset_id, r.line_no) for r in B.loaded_rows(*frames).collect()}
    assert loaded == {(1, 2), (1, 3), (1, 10), (2, 1), (3, 1)}
    empty = spark.createDataFrame([], RAW)
    assert B.failed_rows(empty, frames[1], frames[2]).collect() == []
