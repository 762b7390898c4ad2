"""Rows that fail to parse, apart from those that load (problem 4).

A record is parsed by minimum-cost error parsing: the states of a delimited-text reader (start of a field, inside an
unquoted field, inside quotes, after a quote that closes) are walked through the record, and a quote or a delimiter may
be inserted or deleted at cost 1 each. A path of cost 0 is an ordinary parse; records that have one with the expected
number of fields are well formed, and their fields are held against their types. For all others the edits of the
cheapest path state the reason:

* ``quoting``      the cheapest path to any number of fields holds edits: a quote or delimiter is amiss;
* ``field_count``  that path is free, but the cheapest one to field_count fields inserts or deletes delimiters;
* ``value``        the record parses, but a field does not fit its type.

The search goes by cost: from all places reached at one cost the free steps are followed, then single edits lead to the
next cost. It visits as many states as the record is long, times the cost, whatever its length, so there is no bound on
records. Runs of ordinary characters are one step. Without any quote in the record the edits are known at once.

Layout. The lines of a dataset are exchanged once in chunks of CHUNK line numbers, without their dialect; the dialect and
column rules of a dataset travel as one text per chunk and meet the lines there. A dataset with a third of all lines is
many chunks.

Edge cases (tested): a null or blank record is no record; lines up to header_row are not records; a null delimiter
makes the whole record one field; the word ``tab`` is the tabulator; a null quote_char makes quotes ordinary; a null
field_count is not checked; a column without a rule accepts anything; repeated lines count once; a dataset without
structure row is left out; records of any length are parsed whole and get their edits.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.quality import BOOLEAN_WORDS
from tablewright.session import ship

#: States of the reader.
START, PLAIN, QUOTED, CLOSED = range(4)
#: Line numbers in a chunk.
CHUNK = 500

_INTEGER = re.compile(r"[+-]?[0-9]+")
_NUMBER = re.compile(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?")


@lru_cache(maxsize=4096)
def _reader(delimiter: str | None, quote: str | None):
    """The cost-0 transitions of the dynamic program as one expression: a field and what follows it."""
    end = f"(?:{re.escape(delimiter)}|\\Z)" if delimiter else r"\Z"
    if quote is None:
        plain = f"[^{re.escape(delimiter)}]*" if delimiter else r"(?:.|\n)*"
        return re.compile(f"({plain})({end})", re.S)
    q = re.escape(quote)
    plain = f"(?!{q})[^{re.escape(delimiter)}]*" if delimiter else f"(?!{q}).*"
    return re.compile(f"(?:{q}((?:[^{q}]|{q}{q})*){q}|({plain}))({end})", re.S)


def read_fields(record: str, delimiter: str | None, quote: str | None) -> list[str] | None:
    """The fields of a record if it parses at cost 0, else None."""
    if quote is None or quote not in record:
        return record.split(delimiter) if delimiter else [record]
    step, at, fields = _reader(delimiter, quote).match, 0, []
    while True:
        m = step(record, at)
        if m is None:
            return None
        fields.append(m[1].replace(quote * 2, quote) if m[1] is not None else m[2])
        at = m.end()
        if not m[3]:
            return fields


def _marks(record: str, delimiter: str | None, quote: str | None) -> list[tuple[str, int]]:
    """The record as (kind, place): ``d`` a delimiter, ``q`` a quote, ``x`` a run of anything else."""
    out: list[tuple[str, int]] = []
    for place, char in enumerate(record):
        kind = "d" if char == delimiter else "q" if quote is not None and char == quote else "x"
        if kind != "x" or not out or out[-1][0] != "x":
            out.append((kind, place))
    return out


#: The reader: what each mark makes of each state; None where no free step exists.
_STEP = {"d": (START, START, QUOTED, START), "q": (QUOTED, PLAIN, CLOSED, QUOTED), "x": (PLAIN, PLAIN, QUOTED, None)}


def least_edits(record: str, delimiter: str | None, quote: str | None, width: int | None) -> tuple[int, list[tuple[str, int]]]:
    """The least number of quotes and delimiters to insert or delete so that the record has ``width`` fields.

    Returns the cost and the edits as (kind, place in the record); width None accepts any number of fields.
    """
    if width is not None and (quote is None or quote not in record):
        places = [i for i, c in enumerate(record) if c == delimiter] if delimiter else []
        surplus = len(places) + 1 - width
        if surplus >= 0:
            return surplus, [("delete delimiter", p) for p in places[len(places) - surplus :]]
        if delimiter:
            return -surplus, [("insert delimiter", len(record))] * -surplus
    marks = _marks(record, delimiter, quote)
    size = len(marks)
    here = [place for _, place in marks] + [len(record)]
    # A node is (mark, state, fields); fields stay 0 where any number will do.
    count = 0 if width is None else 1
    seen: dict[tuple[int, int, int], tuple | None] = {}
    front: list[tuple[tuple[int, int, int], tuple | None]] = [((0, START, count), None)]
    cost = 0
    while front:
        edge: list[tuple[tuple[int, int, int], tuple | None]] = []
        for node, path in front:
            while node not in seen:
                seen[node] = path
                at, state, fields = node
                more = fields + 1 if width is not None else 0
                if at == size and state != QUOTED and (width is None or fields == width):
                    edits = []
                    while path is not None:
                        path, edit = path
                        edits.append(edit)
                    return cost, edits[::-1]
                if delimiter and state != QUOTED and (width is None or more <= width):
                    edge.append(((at, START, more), (path, ("insert delimiter", here[at]))))
                if quote is not None and state != PLAIN:
                    edge.append(((at, CLOSED if state == QUOTED else QUOTED, fields), (path, ("insert quote", here[at]))))
                if at == size:
                    break
                kind = marks[at][0]
                if kind != "x":
                    edge.append(((at + 1, state, fields), (path, ("delete delimiter" if kind == "d" else "delete quote", here[at]))))
                after = _STEP[kind][state]
                if after is None or (kind == "d" and state != QUOTED and width is not None and more > width):
                    break
                node = (at + 1, after, more if kind == "d" and state != QUOTED else fields)
        front, cost = edge, cost + 1
    return -1, []  # no delimiter to reach the width with


@lru_cache(maxsize=1024)
def _date_reader(form: str):
    parts = re.split(r"(%[Ymd])", form)
    pattern = "".join({"%Y": "(?P<Y>[0-9]{4})", "%m": "(?P<m>[0-9]{2})", "%d": "(?P<d>[0-9]{2})"}.get(p, re.escape(p)) for p in parts)
    return re.compile(pattern)


@lru_cache(maxsize=1024)
def _pattern(form: str):
    try:
        return re.compile(form)
    except re.error:
        return None


def fits(value: str, kind: str | None, form: str | None) -> bool:
    """Whether a trimmed, non-missing value reads as its type (the same rule as in the quality profile)."""
    if kind == "integer":
        return _INTEGER.fullmatch(value) is not None
    if kind == "number":
        return _NUMBER.fullmatch(value) is not None
    if kind == "boolean":
        return value.lower() in BOOLEAN_WORDS
    if kind == "date":
        m = _date_reader(form or "%Y-%m-%d").fullmatch(value)
        if m is None:
            return False
        try:
            date(int(m["Y"]), int(m["m"]), int(m["d"]))
        except (ValueError, IndexError):
            return False
        return True
    if form in (None, "default"):
        return True
    pattern = _pattern(form)
    return pattern is None or pattern.fullmatch(value) is not None


class Spec:
    """Dialect and column rules of one dataset."""

    def __init__(self, text: str) -> None:
        d = json.loads(text)
        mark = d.get("delimiter")
        self.delimiter = "\t" if mark and mark.strip(" ").lower() in ("tab", "\\t") else mark or None
        self.quote = d.get("quote_char") or None
        self.width = d.get("field_count")
        self.header_row = d.get("header_row") or 0
        self.rules = {c["pos"]: (c.get("var_type"), c.get("var_format"), frozenset(c.get("missing_values") or ())) for c in d.get("columns") or ()}

    def judge(self, record: str) -> tuple[str | None, int, str | None, list[str] | None]:
        """(reason, cost, edits or offending field, fields)."""
        fields = read_fields(record, self.delimiter, self.quote)  # the path of cost 0, if there is one
        if fields is None or (self.width is not None and len(fields) != self.width):
            reason = "quoting"
            cost, edits = least_edits(record, self.delimiter, self.quote, None) if self.quote is not None else (0, [])
            if not edits:
                reason = "field_count"
                cost, edits = least_edits(record, self.delimiter, self.quote, self.width)
            return reason, cost, "; ".join(f"{kind} at {place}" for kind, place in edits), None
        for pos, field in enumerate(fields, 1):
            value = field.strip(" ")
            if value and pos in self.rules:
                kind, form, tokens = self.rules[pos]
                if value not in tokens and not fits(value, kind, form):
                    return "value", 0, f"field {pos} is not {kind}", fields
        return None, 0, None, fields


def dataset_specs(structures: DataFrame, variables: DataFrame) -> DataFrame:
    """(dataset_id, spec): dialect and the column rules of the latest load as one JSON text per dataset."""
    latest = variables.groupBy("dataset_id", "pos").agg(
        F.max_by(F.struct(F.col("pos").cast("int").alias("pos"), F.lower("var_type").alias("var_type"), "var_format", "missing_values"), "load_no").alias("column")
    )
    columns = latest.groupBy("dataset_id").agg(F.collect_list("column").alias("columns"))
    dialects = structures.select("dataset_id", "delimiter", "quote_char", "header_row", "field_count").dropDuplicates(["dataset_id"])
    spec = F.to_json(F.struct("delimiter", "quote_char", "header_row", "field_count", "columns"))
    return dialects.join(columns, "dataset_id", "left").select("dataset_id", spec.alias("spec"))


_SCHEMA = "dataset_id long, line_no long, reason string, cost int, detail string, fields array<string>"


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())]
    for batch in batches:
        out: list[list] = [[] for _ in types]
        for dataset_id, numbers, records, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            spec = Spec(text)
            for line_no, record in zip(numbers, records):
                if line_no > spec.header_row:
                    for column, value in zip(out, (dataset_id, line_no, *spec.judge(record))):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["dataset_id", "line_no", "reason", "cost", "detail", "fields"])


def judged_rows(raw_rows: DataFrame, structures: DataFrame, variables: DataFrame) -> DataFrame:
    """Every record with its reason (null if it loads), edit cost, edits and fields."""
    ship(raw_rows.sparkSession)
    blank = F.coalesce(F.regexp_replace("raw_line", r"[\s ]+", ""), F.lit("")) == ""
    numbered = raw_rows.select(F.col("dataset_id").cast("long").alias("dataset_id"), F.col("line_no").cast("long").alias("line_no"), "raw_line").filter("line_no is not null")
    chunk = F.floor(F.col("line_no") / CHUNK).alias("chunk")
    # A chunk has at most CHUNK different lines; repeated deliveries fall together.
    chunks = numbered.filter(~blank).groupBy("dataset_id", chunk).agg(F.collect_set(F.struct("line_no", "raw_line")).alias("lines"))
    parts = numbered.select("dataset_id", chunk).distinct()
    specs = parts.join(dataset_specs(structures, variables), "dataset_id")
    lines = chunks.join(specs.hint("merge"), ["dataset_id", "chunk"])
    return lines.select("dataset_id", "lines.line_no", "lines.raw_line", "spec").mapInArrow(_judge_batches, _SCHEMA)


def failed_rows(raw_rows: DataFrame, structures: DataFrame, variables: DataFrame) -> DataFrame:
    return judged_rows(raw_rows, structures, variables).filter("reason is not null")


def loaded_rows(raw_rows: DataFrame, structures: DataFrame, variables: DataFrame) -> DataFrame:
    """The valid records as cells: (dataset_id, line_no, pos, raw)."""
    good = judged_rows(raw_rows, structures, variables).filter("reason is null")
    return good.select("dataset_id", "line_no", F.posexplode("fields").alias("at", "raw")).select(
        "dataset_id", "line_no", (F.col("at") + 1).cast("long").alias("pos"), "raw"
    )
