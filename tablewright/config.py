"""All thresholds and word lists of the inspection, with their defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace

#: Tokens that mean missing, and error values of spreadsheets.
COMMON_MISSING = ("", "NA", "N/A", "n/a", "N.A.", "n.a.", "NaN", "nan", "NAN", "null", "NULL", "None", "missing", "Missing", ".", "-", "—")
SPREADSHEET_ERRORS = ("#N/A", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#NULL!")
#: Numbers that often stand for missing; only warned about.
SENTINELS = (-9.0, -99.0, -999.0, -9999.0, 999.0, 9999.0)
#: Formats tried for dates (strptime names and their Spark patterns).
DATE_FORMATS = {"%Y-%m-%d": "yyyy-M-d", "%Y/%m/%d": "yyyy/M/d", "%d-%m-%Y": "d-M-yyyy", "%m-%d-%Y": "M-d-yyyy", "%d/%m/%Y": "d/M/yyyy", "%m/%d/%Y": "M/d/yyyy"}
DATETIME_FORMATS = {"%Y-%m-%dT%H:%M:%S": "yyyy-M-d'T'H:m:s", "%Y-%m-%d %H:%M:%S": "yyyy-M-d H:m:s", "%Y-%m-%dT%H:%M:%S%.f": "yyyy-M-d'T'H:m:s.SSSSSSSSS"}
DELIMITERS = (",", "\t", ";", "|")
QUOTES = ('"', "'", None)
DELIMITED_EXTENSIONS = frozenset({".csv", ".tsv", ".tab", ".txt", ".dat"})
WORKBOOK_EXTENSIONS = frozenset({".xlsx", ".xlsm", ".xlsb", ".xls", ".ods"})
DOCUMENT_EXTENSIONS = frozenset({".md", ".txt", ".pdf", ".docx", ".rst"})


@dataclass(frozen=True)
class Config:
    match_accept_threshold: float = 0.85
    match_review_threshold: float = 0.70
    ambiguity_margin: float = 0.05
    header_scan_rows: int = 30
    header_min_score: float = 0.35
    categorical_max_distinct: int = 20
    sentinel_outlier_iqr_factor: float = 10.0
    sentinel_min_other_values: int = 4
    max_records_per_dataset: int = 50_000
    max_file_bytes: int = 1 << 30
    max_files: int = 10_000
    sample_bytes: int = 65_536
    max_zip_members: int = 10_000
    max_zip_total_bytes: int = 2 << 30
    max_zip_ratio: float = 100.0
    process_hidden_sheets: bool = True
    missing_value_tokens: tuple[str, ...] = COMMON_MISSING + SPREADSHEET_ERRORS
    min_value_overlap: float = 0.2
    review_threshold: float = 0.95


def load_config(path: str | None = None, **overrides) -> Config:
    """Defaults, then a TOML file, then overrides; an unknown key is an error."""
    values: dict = {}
    if path:
        with open(path, "rb") as f:
            values.update(tomllib.load(f))
    values.update({k: v for k, v in overrides.items() if v is not None})
    unknown = set(values) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if "missing_value_tokens" in values:
        values["missing_value_tokens"] = tuple(values["missing_value_tokens"])
    return replace(Config(), **values)
