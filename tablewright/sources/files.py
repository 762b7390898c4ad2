"""Repositories of files: scan, safe unzip, digests, roles, decoding."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import unicodedata
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.config import DELIMITED_EXTENSIONS, DOCUMENT_EXTENSIONS, WORKBOOK_EXTENSIONS, Config
from tablewright.session import ship

SKIPPED = {".git", "__MACOSX", ".DS_Store", "__pycache__", "node_modules"}


class InputError(Exception):
    """A fatal problem of the input: code and message."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def readme_score(name: Column) -> Column:
    """How much a file name promises documentation."""
    low = F.lower(F.element_at(F.split(name, "/"), -1))
    has = lambda *words: low.rlike("|".join(words))
    return F.when(has("readme", "read_me"), 1.0).when(has("codebook", "dictionary"), 0.9).when(has("metadata", "methods"), 0.7).when(has("manifest", "about", "info", "notes"), 0.5).otherwise(0.2)


def py_readme_score(name: str) -> float:
    low = Path(name).name.lower()
    for words, score in ((("readme", "read_me"), 1.0), (("codebook", "dictionary"), 0.9), (("metadata", "methods"), 0.7), (("manifest", "about", "info", "notes"), 0.5)):
        if any(w in low for w in words):
            return score
    return 0.2


def is_text(content: bytes) -> bool:
    """Byte order mark, or no NUL and at most one control byte in twenty."""
    if content[:3] == b"\xef\xbb\xbf" or content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return True
    head = content[:8192]
    return b"\0" not in head and sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in head) <= 0.05 * len(head)


def decode(content: bytes, detector=None) -> tuple[str, str, str, float]:
    """(text, encoding, rung, confidence): byte order mark, UTF-8, a detector if given, cp1252, latin-1."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            try:
                return content.decode(encoding), encoding, "bom", 1.0
            except UnicodeDecodeError:
                break
    try:
        return content.decode("utf-8"), "utf-8", "utf-8", 1.0
    except UnicodeDecodeError:
        pass
    if detector is not None:
        encoding, confidence = detector(content)
        if encoding and confidence >= 0.80:
            try:
                return content.decode(encoding), encoding, "detected", confidence
            except (UnicodeDecodeError, LookupError):
                pass
    try:
        return content.decode("cp1252"), "cp1252", "cp1252", 0.6
    except UnicodeDecodeError:
        return content.decode("latin-1"), "latin-1", "latin-1", 0.3


def role_by_magic(content: bytes, extension: str) -> str | None:
    """Role of a binary file by its first bytes, then its extension; None for text."""
    if content.startswith(b"%PDF"):
        return "documentation"
    if content.startswith((b"PK\x03\x04", b"\xd0\xcf\x11\xe0")):
        return "tabular" if extension in WORKBOOK_EXTENSIONS else "documentation" if extension == ".docx" else "other"
    return None if is_text(content) else "other"


def magic_kind(content: Column) -> Column:
    """The kind that the first four bytes announce."""
    start = F.hex(F.substring(content, 1, 4))
    return F.when(start == "504B0304", "zip").when(start == "D0CF11E0", "ole").when(start.startswith("25504446"), "pdf").otherwise("none")


def date_range(text: str | None) -> tuple[str | None, str | None]:
    """(start, end) of ``A to B``, or of the only ISO date twice."""
    days = re.findall(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text or "")
    between = re.search(r"[0-9]{4}-[0-9]{2}-[0-9]{2}\s*(?:to|–|-|through|until)\s*[0-9]{4}-[0-9]{2}-[0-9]{2}", text or "")
    if between:
        return tuple(re.findall(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", between[0]))
    return (days[0], days[0]) if len(days) == 1 else (None, None)


def safe_unzip(path: str, target: str, config: Config = Config()) -> list[tuple[str, str]]:
    """Extracts members with safe paths within the limits; returns (member, issue code) of those left out."""
    issues: list[tuple[str, str]] = []
    root = Path(target).resolve()
    with zipfile.ZipFile(path) as z:
        members = [m for m in z.infolist() if not m.is_dir()]
        packed = max(1, sum(m.compress_size for m in members))
        total = sum(m.file_size for m in members)
        if len(members) > config.max_zip_members or total > config.max_zip_total_bytes or total / packed > config.max_zip_ratio:
            raise InputError("ZIP_LIMIT_EXCEEDED", f"{path}: {len(members)} members of {total} bytes")
        for m in members:
            name = m.filename.replace("\\", "/")
            place = (root / name).resolve()
            if name.startswith("/") or re.match(r"^[A-Za-z]:", name) or ".." in name.split("/") or root not in place.parents:
                issues.append((m.filename, "ZIP_UNSAFE_MEMBER"))
                continue
            place.parent.mkdir(parents=True, exist_ok=True)
            left = m.file_size
            with z.open(m) as source, place.open("wb") as out:
                while chunk := source.read(1 << 20):
                    left -= len(chunk)
                    if left < 0:
                        raise InputError("ZIP_LIMIT_EXCEEDED", f"{m.filename} is larger than announced")
                    out.write(chunk)
    return issues


def discover(path: str, config: Config = Config()) -> tuple[str, list[str], list[tuple[str, str]]]:
    """(root, relative paths, issues) of a folder, a zip file or one file; documentation first, then by path."""
    if not os.path.exists(path):
        raise InputError("INPUT_NOT_FOUND", path)
    issues: list[tuple[str, str]] = []
    root = path
    if os.path.isfile(path) and zipfile.is_zipfile(path) and Path(path).suffix.lower() == ".zip":
        root = tempfile.mkdtemp(prefix="tablewright_zip_")
        issues += safe_unzip(path, root, config)
    if os.path.isfile(root):
        return str(Path(root).parent), [Path(root).name], issues
    found: list[str] = []
    for folder, folders, files in os.walk(root, followlinks=False):
        folders[:] = sorted(d for d in folders if not d.startswith(".") and d not in SKIPPED)
        for name in sorted(files):
            full = Path(folder, name)
            if name.startswith(".") or name in SKIPPED or full.is_symlink():
                continue
            if full.stat().st_size > config.max_file_bytes:
                issues.append((str(full.relative_to(root)), "FILE_TOO_LARGE"))
            elif len(found) >= config.max_files:
                issues.append((str(full.relative_to(root)), "TOO_MANY_FILES"))
            else:
                found.append(str(full.relative_to(root)))
    if not found:
        raise InputError("NO_FILES_FOUND", path)
    return root, sorted(found, key=lambda f: (py_readme_score(f) < 0.5, f)), issues


def cleanup(root: str) -> None:
    if Path(root).name.startswith("tablewright_zip_"):
        shutil.rmtree(root, ignore_errors=True)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content, sha256, kind) of all files under a root, spread over the cluster."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return described(files.filter(~F.col("path").rlike(r"/(?:\.|__MACOSX)")))


def described(files: DataFrame) -> DataFrame:
    """(path, length, content, sha256, kind) of files (path, length, content)."""
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), magic_kind(F.col("content")).alias("kind"))


def in_order(names: DataFrame, by: str, name: str) -> DataFrame:
    """(by, name, place): files in the order they are read, documentation first, then by path."""
    order = Window.partitionBy(by).orderBy(readme_score(F.col(name)) < 0.5, name)
    return names.select(by, name, F.row_number().over(order).cast("long").alias("place"))


def with_status(records: DataFrame) -> DataFrame:
    """Adds state to files (role, failed): failed, skipped (no table and no documentation) or processed."""
    return records.withColumn("state", F.when(F.col("failed"), "failed").when(F.col("role") == "other", "skipped").otherwise("processed"))


def decoded(files: DataFrame) -> DataFrame:
    """(path, text, encoding, rung, confidence) of the text files among scanned ones, NFKC."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *decode(bytes(c))) for p, c in zip(b.path, b.content) if is_text(bytes(c))]
            yield pd.DataFrame([(p, unicodedata.normalize("NFKC", t), e, r, c) for p, t, e, r, c in rows], columns=["path", "text", "encoding", "rung", "confidence"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, encoding string, rung string, confidence double")


def role_of_file(name: str, content: bytes, evidence: float) -> str:
    extension = Path(name).suffix.lower()
    if not content:
        return "tabular" if extension in DELIMITED_EXTENSIONS - {".txt"} | WORKBOOK_EXTENSIONS else "documentation" if extension in DOCUMENT_EXTENSIONS else "other"
    binary = role_by_magic(content, extension)
    if binary is not None:
        return binary
    if evidence >= 0.5 and py_readme_score(name) < 0.9:
        return "tabular"
    if evidence >= 1.0:
        return "tabular"
    return "documentation" if extension in DOCUMENT_EXTENSIONS or py_readme_score(name) >= 0.5 else "tabular" if extension in DELIMITED_EXTENSIONS - {".txt"} else "documentation"
