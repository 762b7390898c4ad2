"""From a folder, zip or file to one document: tables, columns, documentation, matches, relations, people, issues."""

from __future__ import annotations

import hashlib
import json
import sys
import time
import unicodedata
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright import __version__
from tablewright.config import DOCUMENT_EXTENSIONS, WORKBOOK_EXTENSIONS, Config, load_config
from tablewright.functions import text as T
from tablewright.operators import histogram as H
from tablewright.operators import linking as L
from tablewright.operators import matching as M
from tablewright.operators import prose, reader
from tablewright.operators import review as R
from tablewright.operators.issues import severity
from tablewright.sources import delimited, files, office

#: Weights of the stages in the progress of a run, in per cent.
STAGES = {"discovery": 5, "structure": 30, "documentation": 20, "scoping": 5, "columns": 30, "assembly": 10}


def issue(code: str, place: str, detail: str = "") -> dict:
    return {"code": code, "severity": severity(code), "location": place, "detail": detail}


@dataclass
class Group:
    """Definitions with the document they stand in and what was in force there."""

    group_id: str
    file: str
    hint: str | None
    sheet: str | None
    title: str | None
    variables: list[dict]
    declared_variables: int | None
    declared_rows: int | None
    codes: list[str]


class Inspection:
    """State of one run; every file is read inside an exception boundary."""

    def __init__(self, spark: SparkSession, config: Config, sink=None) -> None:
        self.spark, self.config, self.sink = spark, config, sink
        self.issues: list[dict] = []
        self.events: list[dict] = []
        self.progress, self.began = 0, time.perf_counter()
        self.raw: list[tuple[str, str | None, str, str, str]] = []  # (file, sheet, text, extension, encoding)
        self.tables: list[tuple[str, str | None, delimited.RawTable, str]] = []
        self.texts: list[tuple[str, str]] = []
        self.dictionaries: list[tuple[str, str | None, delimited.RawTable]] = []
        self.records: list[dict] = []

    def event(self, stage: str, status: str, **more) -> None:
        now = time.perf_counter()
        self.progress += STAGES.get(stage, 0)
        e = {"seq": len(self.events) + 1, "stage": stage, "status": status, "progress": self.progress, "ms": round(1000 * (now - self.began), 1), **more}
        self.began = now
        self.events.append(e)
        if self.sink:
            self.sink(e)

    def load(self, root: str, names: list[str]) -> None:
        for name in names:
            content = Path(root, name).read_bytes()
            try:
                role = self._load(name, content)
            except Exception as error:  # one bad file must not end the run
                role = "failed"
                self.issues.append(issue("INTERNAL_ERROR", name, f"{type(error).__name__}: {error}"))
            status = "failed" if role == "failed" else "skipped" if role == "other" else "processed"
            self.records.append({"file": name, "role": role, "status": status, "size_bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()})

    def _load(self, name: str, content: bytes) -> str:
        extension = Path(name).suffix.lower()
        if extension in WORKBOOK_EXTENSIONS:
            found, issues = office.sheets(content, extension, self.config.process_hidden_sheets)
            self.issues += [issue(code, f"{name}:{sheet}") for sheet, code in issues]
            for sheet, rows in found:
                if delimited.is_notes(rows):
                    self.texts.append((f"{name}:{sheet}", office.notes_text(rows)))
                else:
                    self.raw.append((name, sheet, "\n".join("\t".join(c.replace("\t", " ").replace("\n", " ") for c in r) for r in rows), ".tab", "utf-8"))
            return "tabular" if found else "failed"
        if extension == ".docx":
            lines = office.docx_lines(content)
            if lines is None:
                self.issues.append(issue("README_UNREADABLE", name))
                return "failed"
            self.texts.append((name, "\n".join(lines)))
            return "documentation"
        if not files.is_text(content):
            self.issues.append(issue("README_UNREADABLE" if extension == ".pdf" else "UNSUPPORTED_FILE", name))
            return "documentation" if extension == ".pdf" else "other"
        text, encoding, rung, _ = files.decode(content)
        if rung in ("cp1252", "latin-1"):
            self.issues.append(issue("ENCODING_FALLBACK", name, encoding))
        text = unicodedata.normalize("NFKC", text) if extension in DOCUMENT_EXTENSIONS else text
        role = files.role_of_file(name, content, delimited.tabular_evidence(text))
        if role == "tabular":
            self.raw.append((name, None, text, extension, encoding))
        elif role == "documentation":
            self.texts.append((name, text))
        else:
            self.issues.append(issue("UNSUPPORTED_FILE", name))
        return role

    def structure(self) -> None:
        """Reads the tables; names that prose documents help to find the header."""
        listed = frozenset(delimited.documented_form(d["name"]) for _, t in self.texts for g in reader.groups(reader.sections(t))[0] for d in g.variables)
        for name, sheet, text, extension, encoding in self.raw:
            table = delimited.read(text, extension, self.config, listed)
            self.issues += [issue(code, name) for code in table.issues]
            if delimited.is_dictionary(table.original, table.rows):
                self.dictionaries.append((name, sheet, table))
            elif table.header:
                self.tables.append((name, sheet, table, encoding))

    def dataset_id(self, name: str, sheet: str | None) -> str:
        base = name.rsplit(".", 1)[0] + (f" {sheet}" if sheet else "")
        return "_".join(p for p in "".join(c.lower() if c.isalnum() and c.isascii() else " " for c in base).split()) or "dataset"

    def groups(self, known: frozenset[str]) -> tuple[list[Group], list[tuple[str, str]]]:
        """Variable groups of all documents, and (file, code) of codes stated for no file."""
        out: list[Group] = []
        loose: list[tuple[str, str]] = []
        for name, text in self.texts:
            found, codes = reader.groups(reader.sections(text), known)
            loose += [(name, c) for c in codes]
            for g in found:
                out.append(Group(f"{name}#{g.start}", name, g.file, g.sheet, g.title, [{**d, "method": d.get("method", g.method)} for d in g.variables], g.declared_variables, g.declared_rows, g.codes))
        for name, sheet, table in self.dictionaries:
            rows: dict[tuple[str | None, str | None], list[dict]] = {}
            roles = [T.py_role_of(h) for h in table.original]
            a, b = delimited.dictionary_columns(table.original)
            roles[a], roles[b] = "name", "description"
            for number, cells in enumerate(table.rows, 2):
                d = {r: c.strip() for r, c in zip(roles, cells) if r and c.strip()}
                if reader.plausible_name(d.get("name", "")):
                    rows.setdefault((d.get("file"), d.get("sheet")), []).append({**d, "line_start": number, "line_end": number, "method": "dictionary"})
            for k, ((file, tab), variables) in enumerate(rows.items()):
                out.append(Group(f"{name}:{sheet or ''}#{k}", name, file, tab, "data dictionary", variables, None, None, []))
        return out, loose

    def cells(self) -> DataFrame:
        """The cells of all tables as one row per record, unfolded by the executors."""
        rows = [(self.dataset_id(n, s), t.header, r) for n, s, t, _ in self.tables for r in t.rows]
        frame = self.spark.createDataFrame(rows or [("", [], [])], "dataset_id string, header array<string>, cells array<string>")
        each = frame.select("dataset_id", "header", F.posexplode("cells").alias("i", "raw"))
        return each.select("dataset_id", (F.col("i") + 1).alias("pos"), F.col("header")[F.col("i")].alias("name"), F.nullif(F.trim("raw"), F.lit("")).alias("value"))


def scope(i: Inspection, found: list[Group]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bindings, definitions, columns): which groups hold for which dataset, by hint, document name, coverage or being alone."""
    spark = i.spark
    targets = spark.createDataFrame([(i.dataset_id(n, s), n, s) for n, s, _, _ in i.tables], "dataset_id string, file string, sheet string")
    columns = spark.createDataFrame([(i.dataset_id(n, s), h, p) for n, s, t, _ in i.tables for p, h in enumerate(t.header, 1)], "dataset_id string, column string, column_pos int")
    rows, place = [], 0
    for g in found:
        for d in g.variables:
            place += 1
            labels = prose_labels(d.get("values"))
            codes = sorted({*prose.missing_codes(d.get("missing")), *(c for c, label in labels if prose.is_missing_label(label))})
            rows.append((g.group_id, d["name"], d.get("description"), d.get("unit"), d.get("type"), d.get("notes"), [c for c, label in labels if not prose.is_missing_label(label)], codes, d.get("absent"), place, g.file, d["line_start"], d["line_end"], d["method"]))
    definitions = spark.createDataFrame(rows, "group_id string, name string, description string, unit string, declared_type string, notes string, label_codes array<string>, codes array<string>, absent string, position int, file string, line_start int, line_end int, method string")
    groups = spark.createDataFrame([(g.group_id, g.file, g.hint, g.sheet) for g in found], "group_id string, file string, hint string, sheet string")
    hints = L.resolve_hints(groups.filter("hint is not null").select("hint").distinct(), targets)
    named = L.resolve_documents(groups.select("file").distinct(), targets)
    covered = L.coverage(definitions, columns)
    return L.bind_groups(groups, L.pick_sheets(groups, hints, targets, covered), L.pick_named(groups, named, targets, covered), covered, targets), definitions, columns


def prose_labels(text: str | None) -> list[tuple[str, str]]:
    """(code, label) of ``1 = Male; 2 = Female``."""
    out = []
    for part in (text or "").replace(",", ";").split(";"):
        code, mark, label = part.partition("=" if "=" in part else ":")
        if mark and code.strip() and label.strip() and " " not in code.strip():
            out.append((code.strip(), label.strip()))
    return out


def project_of(texts: list[tuple[str, str]]) -> tuple[dict, list[dict]]:
    """The project's metadata merged from all documents: the first value wins, others that differ are reported."""
    merged: dict = {"values": {}, "people": [], "funding": [], "publications": [], "related": [], "methods": [], "other": []}
    issues: list[dict] = []
    for name, text in texts:
        p = reader.project(reader.sections(text), text)
        for key, (value, line) in p.values.items():
            have = merged["values"].setdefault(key, {"value": value, "file": name, "line": line})
            if have["value"].strip() != value.strip() and key not in ("collection_period", "readme_generated_on"):
                issues.append(issue("CONFLICTING_METADATA", name, f"{key}: {have['value']!r} and {value!r}"))
        for person in p.people:
            if person.name.strip() and not any((q["name"].lower(), q["orcid"] or "") == (person.name.strip().lower(), (person.orcid or "").strip()) for q in merged["people"]):
                merged["people"].append(asdict(person))
        for key in ("funding", "publications", "related"):
            merged[key] += [v for v in getattr(p, key) if v not in merged[key]]
        merged["methods"] += [{"heading": a, "text": b} for a, b in p.methods]
        merged["other"] += [{"label": k, "value": v, "file": name, "line": n} for k, v, n in p.other]
    if period := merged["values"].get("collection_period"):
        days = files.date_range(period["value"])
        period |= {"start": days[0], "end": days[1]}
    return merged, issues


def run(spark: SparkSession, path: str, config: Config = Config(), sink=None) -> dict:
    """The document of a repository; a fatal input gives a document with that issue only."""
    i = Inspection(spark, config, sink)
    began = time.time()
    try:
        root, names, found = files.discover(path, config)
    except files.InputError as error:
        return {"schema_version": "1.0.0", "generator": f"tablewright {__version__}", "datasets": [], "issues": [issue(error.code, path, str(error))], "summary": {"datasets": 0}}
    try:
        i.issues += [issue(code, name) for name, code in found]
        i.event("discovery", "done", files=len(names))
        i.load(root, names)
    finally:
        files.cleanup(root)
    i.structure()
    i.event("structure", "done", tables=len(i.tables))
    if not i.texts and not i.dictionaries:
        i.issues.append(issue("README_NOT_FOUND", path))
    if len(i.texts) > 1:
        i.issues.append(issue("README_MULTIPLE", path, str(len(i.texts))))
    known = frozenset(T.py_normalize_name(h) for _, _, t, _ in i.tables for h in t.original if h)
    groups, loose = i.groups(known)
    aliases = [a for _, t in i.texts for a in reader.abbreviations(t)]
    merged, conflicts = project_of(i.texts)
    i.issues += conflicts
    i.event("documentation", "done", definitions=sum(len(g.variables) for g in groups))
    datasets, relationships, queue = [], [], []
    if i.tables:
        datasets, relationships, queue = _datasets(i, groups, loose, aliases, merged)
    stated = []
    by_file: dict[str, list[str]] = {}
    for d in datasets:
        by_file.setdefault(Path(d["file"]).stem.lower(), []).append(d["id"])
    for name, text in i.texts:
        for sentence, mentioned, variables in prose.relations(text):
            ids = [x for f in mentioned for x in by_file.get(Path(f).stem.lower(), [])]
            missing = [f for f in mentioned if Path(f).stem.lower() not in by_file]
            stated.append({"type": "documented", "document": name, "files": mentioned, "datasets": ids, "unresolved": missing, "variables": variables, "evidence": sentence})
    links = [{"type": "documented_link", "from": "project", "target": url} for url in merged["related"]]
    i.event("assembly", "done")
    count = lambda severity: sum(x["severity"] == severity for x in i.issues)
    variables = [v for d in datasets for v in d["variables"]]
    status = lambda s: sum((v["match"] or {}).get("status", "unmatched") == s for v in variables)
    return {
        "schema_version": "1.0.0", "generator": f"tablewright {__version__}", "project": merged, "files": sorted(i.records, key=lambda r: r["file"]),
        "documents": [{"file": n, "describes": [d["id"] for d in datasets if n in d["documents"]], "sections": [{"title": s.title, "lines": [s.start, s.end]} for s in reader.sections(t) if s.title]} for n, t in i.texts],
        "datasets": datasets, "relationships": relationships + stated + links, "review": queue, "issues": i.issues, "events": i.events, "elapsed_seconds": round(time.time() - began, 3),
        "summary": {"datasets": len(datasets), "variables": len(variables), "matched": status("matched"), "undocumented": status("unmatched"), "warnings": count("warning"), "errors": count("error") + count("fatal")},
    }


def _datasets(i: Inspection, groups: list[Group], loose: list[tuple[str, str]], aliases: list[tuple[str, str]], merged: dict) -> tuple[list[dict], list[dict], list[dict]]:
    spark, config = i.spark, i.config
    ids = [i.dataset_id(n, s) for n, s, _, _ in i.tables]
    by_id = {g.group_id: g for g in groups}
    bound: dict[str, list[tuple[Group, str]]] = {ds: [] for ds in ids}
    everywhere: list[Group] = []
    bindings = definitions = None
    if groups:
        bindings, definitions, columns = scope(i, groups)
        bindings = H.kept(bindings)
        for r in sorted(bindings.collect(), key=lambda r: list(by_id).index(r.group_id)):  # groups of one repository
            everywhere += [by_id[r.group_id]] if r.dataset_id is None else []
            if r.dataset_id is not None:
                bound[r.dataset_id].append((by_id[r.group_id], r.method))
    i.event("scoping", "done", groups=len(groups))
    # Codes hold where their group is bound; those stated for no file hold for the datasets of their document, or all.
    described = {ds: {g.file for g, _ in gs} for ds, gs in bound.items()}
    free = {f for f, _ in loose} - {f for fs in described.values() for f in fs}
    codes = [(ds, c) for ds, gs in bound.items() for g, _ in gs for c in g.codes] + [(ds, c) for ds in ids for f, c in loose if f in described[ds] or f in free] + [(ds, c) for ds in ids for g in everywhere for c in g.codes]
    hist = i.cells()
    hist = H.histogram(hist)
    if codes:
        hist = H.without_codes(hist, spark.createDataFrame([(d, c) for d, c in set(codes) if c] or [("", "")], "dataset_id string, code string"))
    hist = H.kept(hist)
    types = H.infer_types(hist, config)
    matches: list[dict] = []
    scoped = None
    if groups:
        scoped = H.kept(L.in_scope(definitions, bindings))
        units = spark.createDataFrame([(ds, p, u or None) for ds, (_, _, t, _) in zip(ids, i.tables) for p, u in enumerate(t.units, 1)], "dataset_id string, column_pos int, header_unit string")
        seen = H.distinct_values(hist, config).select("dataset_id", F.col("pos").alias("column_pos"), F.col("seen").alias("observed"))
        kinds = types.select("dataset_id", F.col("pos").alias("column_pos"), "type", "distinct")
        left = columns.join(units, ["dataset_id", "column_pos"], "left").join(kinds, ["dataset_id", "column_pos"], "left").join(seen, ["dataset_id", "column_pos"], "left")
        right = scoped.select("dataset_id", "name", F.col("place").alias("definition_pos"), "description", "unit", "label_codes")
        short = spark.createDataFrame(aliases, "short string, long string") if aliases else None
        matches = [r.asDict() for r in M.match(left, right, short, config).collect()]
    told = {(r.dataset_id, r.name): r.asDict() for r in scoped.collect()} if scoped is not None else {}
    found = {(m["dataset_id"], m["column"]): m for m in matches}
    if scoped is not None:
        # Columns without a match of their own take the best same-name definition from elsewhere.
        open_columns = [(ds, h) for ds, (_, _, t, _) in zip(ids, i.tables) for h in t.header if found.get((ds, h), {}).get("name") is None]
        if open_columns:
            elsewhere = definitions.join(bindings.select("group_id", F.coalesce("dataset_id", F.lit("")).alias("dataset_id")), "group_id")
            for r in M.out_of_scope(spark.createDataFrame(open_columns, "dataset_id string, column string"), elsewhere.select("dataset_id", "name")).collect():
                place = next(p for ds, (_, _, t, _) in zip(ids, i.tables) if ds == r.dataset_id for p, h in enumerate(t.header, 1) if h == r.column)
                found[r.dataset_id, r.column] = {"dataset_id": r.dataset_id, "column": r.column, "column_pos": place, "name": r["name"], "score": r.score, "confidence": r.score, "method": "cross_file_definition" if r.bound_to else "repository_definition", "status": "matched" if r.score >= config.match_accept_threshold else "low_confidence", "alternatives": []}
                source = next((d for g in groups for d in g.variables if d["name"] == r["name"]), {})
                told.setdefault((r.dataset_id, r["name"]), {"description": source.get("description"), "unit": source.get("unit"), "codes": prose.missing_codes(source.get("missing")), "label_codes": [], "elsewhere": True})
    # Codes of matched definitions change the column: it is typed and profiled again from the same histogram.
    pos_of = {(ds, h): p for ds, (_, _, t, _) in zip(ids, i.tables) for p, h in enumerate(t.header, 1)}
    extra = [(ds, pos_of[ds, c], code) for (ds, c), m in found.items() if m.get("name") for code in (told.get((ds, m["name"])) or {}).get("codes") or [] if code]
    if extra:
        hist = H.kept(H.without_codes(hist, spark.createDataFrame(extra, "dataset_id string, pos int, code string")))
        types = H.infer_types(hist, config)
    keyed = lambda rows: {(r.dataset_id, r.pos): r.asDict() for r in rows.collect()}  # noqa: E731 – one row per column of a repository
    types, stats, missing, spans, seen = keyed(types), keyed(H.numeric_stats(hist, config)), keyed(H.missing_census(hist, config)), keyed(H.temporal_bounds(hist, config)), keyed(H.distinct_values(hist, config))
    tops: dict = {}
    for r in H.top_values(hist, config).orderBy("dataset_id", "pos", "rank").collect():
        tops.setdefault((r.dataset_id, r.pos), []).append(r.value)
    for r in H.sentinel_report(hist, config).collect():
        i.issues.append(issue("POSSIBLE_UNDECLARED_MISSING_CODE", f"{r.dataset_id}.{r['name']}", str(r.sentinel)))
    i.event("columns", "done", columns=len(types))
    datasets = []
    every_column = {T.py_normalize_name(h): ds for ds, (_, _, t, _) in zip(ids, i.tables) for h in t.header}
    phantoms: list[tuple[str, str]] = []
    relationships: list[dict] = []
    for ds, (name, sheet, t, encoding) in zip(ids, i.tables):
        variables = []
        for p, h in enumerate(t.header, 1):
            ty, m = types.get((ds, p), {}), found.get((ds, h))
            if m is None or m["status"] == "unmatched":
                i.issues.append(issue("VARIABLE_UNDOCUMENTED", f"{ds}.{h}"))
            elif m["status"] != "matched":
                i.issues.append(issue("MATCH_AMBIGUOUS" if m["status"] == "ambiguous" else "MATCH_LOW_CONFIDENCE", f"{ds}.{h}"))
            if ty.get("ambiguous_date"):
                i.issues.append(issue("AMBIGUOUS_DATE_FORMAT", f"{ds}.{h}"))
            own = told.get((ds, m["name"])) if m and m.get("name") else None
            s, span = stats.get((ds, p)) if ty.get("type") in ("integer", "number") else None, spans.get((ds, p))
            figures = {k: s[k] for k in ("min", "max", "mean", "std")} if s else {"min": span["first"], "max": span["last"]} if span else None
            variables.append({
                "name": h, "original_name": t.original[p - 1], "position": p, "description": (own or {}).get("description"), "unit": (own or {}).get("unit") or t.units[p - 1], "type": ty.get("type", "string"), "format": ty.get("format"), "role": ty.get("role", "text"),
                "distinct": ty.get("distinct", 0), "count": ty.get("total", 0), "missing": missing.get((ds, p), {}).get("missing", 0), "missing_tokens": [x for x in (missing.get((ds, p), {}).get("tokens") or "").split("|") if x], "missing_codes": sorted({c for d, c in codes if d == ds} | set((own or {}).get("codes") or [])),
                "statistics": figures, "values": (seen.get((ds, p)) or {}).get("seen"), "top_values": tops.get((ds, p), []) if not s else [], "match": m,
            })
        gs = [g for g, _ in bound[ds]]
        declared = {"variables": next((g.declared_variables for g in gs if g.declared_variables is not None), None), "rows": next((g.declared_rows for g in gs if g.declared_rows is not None), None)}
        if declared["variables"] not in (None, len(t.header)):
            i.issues.append(issue("DECLARED_COUNT_MISMATCH", ds, f"{declared['variables']} variables declared, {len(t.header)} found"))
        if declared["rows"] not in (None, len(t.rows)):
            i.issues.append(issue("DECLARED_ROWS_MISMATCH", ds, f"{declared['rows']} rows declared, {len(t.rows)} found"))
        taken = {(found.get((ds, h)) or {}).get("name") for h in t.header}
        left = []
        for g in gs:
            for d in g.variables:
                if d["name"] in taken or d["name"] in left:
                    continue
                other = every_column.get(T.py_normalize_name(d["name"]))
                place = f"{g.file}:{d['line_start']}"
                if d.get("absent"):
                    i.issues.append(issue("DOCUMENTED_VARIABLE_INTENTIONALLY_ABSENT", place, f"{d['name']}: {d['absent']}"))
                elif other and other != ds:
                    i.issues.append(issue("DOCUMENTED_VARIABLE_IN_OTHER_FILE", place, d["name"]))
                    relationships.append({"type": "cross_file_reference", "datasets": [ds, other], "variables": [d["name"]], "document": g.file})
                else:
                    left.append(d["name"])
                    phantoms.append((ds, d["name"]))
                    i.issues.append(issue("DOCUMENTED_VARIABLE_NOT_IN_DATA", place, d["name"]))
        rows = [dict(zip(t.header, r)) for r in t.rows[: config.max_records_per_dataset]]
        generated = merged["values"].get("readme_generated_on")
        documents = list(dict.fromkeys(g.file for g in gs))
        datasets.append({
            "id": ds, "file": name, "sheet": sheet, "encoding": encoding, "title": next((g.title for g in gs if g.title), None), "documented_as": next((g.hint for g, how in bound[ds] if how == "hint"), None), "documents": documents, "scope": sorted({how for _, how in bound[ds]}),
            "dialect": asdict(t.dialect), "header_row": t.header_row, "header_confidence": t.header_confidence, "row_count": len(t.rows), "column_count": len(t.header), "declared": declared, "last_updated": generated["value"] if generated and generated["file"] in documents else None,
            "claims": {k: "not stated" if declared[k] is None else "agree" if declared[k] == n else "differ" for k, n in (("variables", len(t.header)), ("rows", len(t.rows)))},
            "variables": variables, "unmatched_documented_variables": left, "records": rows, "records_truncated": len(t.rows) > len(rows),
        })
    for g in everywhere:
        for d in g.variables:
            if T.py_normalize_name(d["name"]) not in every_column:
                i.issues.append(issue("DOCUMENTATION_UNASSIGNED", f"{g.file}:{d['line_start']}", d["name"]))
    shared = H.kept(H.shared_variables(hist, config))
    means = {(r.a, r.b): r.confidence for r in H.shared_pairs(shared).collect()}
    for r in shared.collect():
        relationships.append({"type": "shared_variable", "datasets": [r.a, r.b], "variable": r.norm, "overlap": r.overlap, "confidence": means[r.a, r.b]})
    listed = [(m["dataset_id"], m["column"], m["status"], m["confidence"]) for m in found.values()] + [(ds, h, "unmatched", 0.0) for ds, (_, _, t, _) in zip(ids, i.tables) for h in t.header if (ds, h) not in found]
    open_items = R.review_queue(spark.createDataFrame(listed, "dataset_id string, column string, status string, confidence double"), spark.createDataFrame(phantoms, "dataset_id string, name string"), config.review_threshold)
    return datasets, relationships, [r.asDict() for r in open_items.orderBy("item_id").collect()]


SCHEMA = {
    "schema_version": "string", "generator": "string", "project": "object", "files": ["file", "role", "status", "size_bytes", "sha256"], "documents": ["file", "describes", "sections"],
    "datasets": ["id", "file", "sheet", "dialect", "header_row", "row_count", "column_count", "declared", "claims", "variables", "unmatched_documented_variables", "records"], "relationships": ["type"], "review": ["item_id", "kind", "subject"],
    "issues": ["code", "severity", "location", "detail"], "events": ["seq", "stage", "status", "progress", "ms"], "summary": "object",
}


def schema_json() -> str:
    """The shape of the document, as kept beside a release to detect drift."""
    return json.dumps(SCHEMA, indent=2, sort_keys=True)


def drift(kept: dict) -> list[str]:
    """Where a kept schema differs from the present one."""
    now = json.loads(schema_json())
    return [k for k in sorted({*kept, *now}) if kept.get(k) != now.get(k)]


def violations(document: dict) -> list[str]:
    """What a document lacks of the schema."""
    out = []
    for key, want in SCHEMA.items():
        if key not in document:
            out.append(f"no {key}")
        elif isinstance(want, list):
            out += [f"{key}[{n}] has no {k}" for n, item in enumerate(document[key]) for k in want if k not in item]
        elif not isinstance(document[key], {"string": str, "object": dict}[want]):
            out.append(f"{key} is no {want}")
    return out


def main(arguments: list[str] | None = None) -> int:
    """Command line: path, --config FILE, --output FILE, --events FILE, --schema [--check FILE]; exit code 2 fatal, 1 error, 0."""
    import argparse

    from tablewright.session import local_session

    p = argparse.ArgumentParser(prog="tablewright")
    p.add_argument("path", nargs="?")
    p.add_argument("--config")
    p.add_argument("--output")
    p.add_argument("--events")
    p.add_argument("--schema", action="store_true")
    p.add_argument("--check")
    a = p.parse_args(arguments)
    if a.schema:
        if a.check:
            return int(bool(drift(json.loads(Path(a.check).read_text()))))
        print(schema_json())
        return 0
    if not a.path:
        p.error("a path is needed")
    try:
        config = load_config(a.config)
    except (ValueError, OSError) as error:
        print(error, file=sys.stderr)
        return 2
    log = open(a.events, "w") if a.events else None
    document = run(local_session(), a.path, config, (lambda e: print(json.dumps(e), file=log, flush=True)) if log else None)
    text = json.dumps(document, indent=2, ensure_ascii=False, default=str)
    Path(a.output).write_text(text) if a.output else print(text)
    severities = {x["severity"] for x in document["issues"]}
    return 2 if "fatal" in severities else 1 if "error" in severities else 0


if __name__ == "__main__":
    sys.exit(main())
