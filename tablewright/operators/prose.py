"""Facts that prose states: missing codes, what is left out, how files are linked, which file a passage is about.

Sentences are read word by word against small sets of words; no sentence pattern stands for a whole statement.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from tablewright.functions.text import FILE_NAMES

_TOKEN = re.compile(r"[\"“‘'`][^\"”’'`]*[\"”’'`]|[^\s,;]+|[,;]")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"“'`])|\n\s*\n")

#: Texts that state that there are no missing codes, and codes that are lower-case words.
NO_CODES = {"none", "no", "nil", "not applicable", "no missing data", "no missing values", "there are no missing values", "there is no missing data"}
KNOWN_CODES = {"na", "n/a", "n.a.", "nan", "null", "nd", "-", "--", "."}
#: Wordings of a label that mean a missing value; unknown and refused are categories.
MISSING_LABELS = ("missing", "not recorded", "not available", "not measured", "not collected", "not applicable", "no data", "n/a", "na")

#: The words that statements on missing values are made of.
_MARKING = {"coded", "represented", "indicated", "denoted", "recorded", "marked", "given", "shown", "entered", "reported", "written", "filled", "identified", "flagged"}
_LINKER = {"as", "by", "with", "using"}
_MEANING = {"indicate", "indicates", "denote", "denotes", "represent", "represents", "mean", "means", "mark", "marks", "signify", "signifies"}
_HOLE = {"blank", "blanks", "empty"}
#: The words that say that something is not in the data, and what it can be absent from.
_HIDDEN = {"withheld", "redacted"}
_LEFT_OUT = {"removed", "excluded", "omitted", "dropped"}
_NOT_THERE = {"included", "provided"}
_NOT_GIVEN = {"released", "shared"}
_DATA = {"data", "dataset", "datasets", "file", "files", "release", "package", "repository", "deposit", "spreadsheet", "table", "csv", "version", "archive", "download", "public"}
_VARIABLE = {"variable", "variables", "column", "columns", "field", "fields", "attribute", "attributes", "measure", "measures"}
#: Beginnings and words that link files, words that make their neighbour a name, and words that never are one.
_RELATING = ("join", "link", "merg", "relat", "combin", "match", "correspond")
_SHARING = {"key", "keys", "common", "shared"}
_ROLES = {"key", "keys", "column", "columns", "field", "fields", "variable", "variables"}
_PLAIN = {
    "the", "a", "an", "this", "that", "these", "those", "each", "both", "all", "and", "or", "of", "to", "in",
    "with", "its", "their", "file", "files", "dataset", "datasets", "data", "table", "tables", "common",
    "shared", "same", "unique", "primary", "foreign", "key", "keys", "column", "columns", "field", "fields",
    "variable", "variables", "can", "be", "is", "are", "was", "were", "which", "using", "via", "by", "on",
    "row", "rows", "record", "records", "value", "values", "name", "names", "it", "them", "one", "other",
    "another", "between", "per", "linking", "link", "join", "joining", "joined", "matching", "match",
    "merge", "merged", "merging", "identifying", "following", "as", "for", "has", "have", "share",
}


def sentences(text: str | None) -> list[str]:
    return [s.strip() for s in _SENTENCE_END.split(text or "") if s and s.strip()]


def _word(token: str) -> str:
    return token.strip("\"“”‘’'`()[]{}.,:;!?*_").lower()


# Missing codes.


def _is_code(text: str) -> bool:
    """A number, a short word in capitals, a sign, or an error value of a spreadsheet."""
    if not text or len(text) > 10 or " " in text:
        return False
    if text.lower() in KNOWN_CODES or set(text) <= set(".?*#x-"):
        return len(text) <= 3 or text.lower() in KNOWN_CODES
    number = text.lstrip("+-")
    if number.replace(".", "", 1).isdigit():
        return True
    return text[0].isupper() and text.upper() == text and all(c.isalnum() or c in "./_-" for c in text) or text.startswith("#") and text[1:].strip("!?").replace("/", "").isalnum()


def missing_codes(text: str | None) -> list[str]:
    """The codes of a list such as ``NA, -99 (not measured) or blank``; a blank cell is ''."""
    if text is None or text.strip().lower().strip(" .") in NO_CODES:
        return []
    body = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text)
    out: list[str] = []
    for part in re.split(r"[;,]|\s(?:or|and)\s", f" {body} "):
        code = re.split(r"[=:]", part, maxsplit=1)[0].strip()
        if {_word(w) for w in part.split()} & _HOLE:
            code = ""
        elif len(code) >= 2 and code[0] in "\"'“‘" and code[-1] in "\"'”’":
            code = code[1:-1]
        else:
            code = code.rstrip(".") if len(code) > 1 and code.lower() not in KNOWN_CODES else code
            if not _is_code(code):
                continue
        if code not in out:
            out.append(code)
    return out


def is_missing_key(key: str | None) -> bool:
    """Whether a label introduces missing codes."""
    words = [_word(w) for w in (key or "").split()]
    if len(words) > 6 or not words:
        return False
    if words[0] == "missing":
        return len(words) == 1 or words[1] in {"data", "value", "values", "code", "codes"} and all(w in {"data", "value", "values", "code", "codes", ""} for w in words[1:])
    return words in (["na", "values"], ["na", "codes"]) or words[:2] in (["codes", "for"], ["code", "for"]) and "missing" in words


def is_missing_label(label: str | None) -> bool:
    """Whether a value label means that the value is missing."""
    text = " ".join(w for w in (_word(t) for t in (label or "").split()) if w)
    text = re.sub(r"^(?:data|value) (?=not )", "", text)
    return text in MISSING_LABELS or text.startswith("missing ")


def _says_missing(words: list[str], at: int) -> bool:
    rest = [w for w in words[at : at + 4] if w not in ("a", "an", "that", "the", "is")]
    return rest[:1] == ["missing"] or rest[:2] in (["no", "data"], ["not", "available"])


def missing_codes_in_prose(text: str | None) -> list[str]:
    out: list[str] = []

    def add(found: list[str]) -> None:
        out.extend(c for c in found if c not in out)

    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text or ""):
        tokens = _TOKEN.findall(sentence)
        words = [_word(t) for t in tokens]
        for i, word in enumerate(words):
            if word == "missing":
                ahead = words[i + 1 : i + 8]
                marked = next((k for k, w in enumerate(ahead) if w in _MARKING and ahead[k + 1 : k + 2] and ahead[k + 1] in _LINKER), None)
                coded = next((k for k, w in enumerate(ahead) if w in ("code", "codes") and k <= 2), None)
                if marked is not None:
                    add(missing_codes(_clause(tokens[i + 3 + marked :])))
                elif coded is not None and i + 2 + coded < len(words) and (words[i + 2 + coded] in ("are", "is") or tokens[i + 1 + coded].endswith((":", "=")) or tokens[i + 2 + coded] in (":", "=")):
                    skip = 3 if words[i + 2 + coded] in ("are", "is") or tokens[i + 2 + coded] in (":", "=") else 2
                    add(missing_codes(_clause(tokens[i + skip + coded :])))
                elif set(ahead[:6]) & _HOLE and not set(ahead[:6]) & _MEANING:
                    add([""])
            elif word in _MEANING and i and _says_missing(words, i + 1):
                before = words[:i]
                if set(before[-3:]) & _HOLE:
                    add([""])
                elif "of" in before and before[before.index("of") - 1 :][:1] in (["value"], ["values"]):
                    add(missing_codes(" ".join(tokens[before.index("of") + 1 : i])))
                else:
                    add(missing_codes(tokens[i - 1]))
            elif word == "used" and words[i - 1 : i] == ["is"] and i >= 2 and words[i + 1 : i + 2] in (["for"], ["to"]) and any(_says_missing(words, k) for k in (i + 2, i + 3)):
                add([""] if set(words[max(0, i - 3) : i]) & _HOLE else missing_codes(tokens[i - 2]))
    return out


def _clause(tokens: list[str]) -> str:
    """The tokens up to a semicolon, as text without the full stop that ends the sentence."""
    upto = tokens[: tokens.index(";")] if ";" in tokens else tokens
    text = " ".join(upto)
    return text[:-1] if text.endswith(".") and not text.endswith(" .") and text != "." else text


# What is left out.


def _absent(sentence: str) -> bool:
    tokens = _TOKEN.findall(sentence)
    words = [_word(t) for t in tokens]
    for i, word in enumerate(words):
        if word in _HIDDEN:
            return True
        if word == "not":
            ahead = [w for w in words[i + 1 : i + 3] if w != "publicly"]
            if ahead[:1] and (ahead[0] in _NOT_GIVEN or ahead[0] == "available" and words[i + 1] == "publicly"):
                return True
        if word in ("available", "provided") and "request" in words[i + 1 : i + 5] and words[i + 1] in ("on", "upon"):
            return True
        negated = i > 0 and words[i - 1] == "not"
        if word in _LEFT_OUT or (negated and word in _NOT_THERE) or (word == "available" and negated and words[i + 1 : i + 3] == ["in", "this"]):
            ends = i + 1 == len(words) or tokens[i][-1:] in ".;:,)" or tokens[i + 1] in (";", ",") or tokens[i + 1].startswith("(")
            if ends or words[i + 1] in ("in", "from", "with") and set([w for w in words[i + 2 : i + 7] if w not in ("the", "this", "these")][:3]) & _DATA:
                return True
    return False


def absence_sentence(text: str | None) -> str | None:
    """The first sentence that says something is not in the data; leaving it out of an analysis does not count."""
    return next((s for s in sentences(text) if _absent(s)), None)


def announces_exclusion(title: str | None) -> bool:
    """Whether a heading, label or lead-in line announces variables that are not in the data."""
    words = [_word(w) for w in (title or "").split()]
    hidden = set(words) & (_HIDDEN | _LEFT_OUT | {"unreleased", "restricted"}) or any(a == "not" and b in _NOT_THERE | _NOT_GIVEN for a, b in zip(words, words[1:]))
    return bool(hidden) and (bool(set(words) & _VARIABLE) or len(words) <= 3)


def excluded_names(key: str | None, value: str | None) -> list[str]:
    """The names of ``Excluded variables: ssn, address``."""
    if not announces_exclusion(key) or not {_word(w) for w in (key or "").split()} & _VARIABLE:
        return []
    parts = (p.strip(" .*_`\"'") for p in re.split(r"[,;]|\sand\s", value or ""))
    return [p for p in parts if re.fullmatch(r"[A-Za-z_][\w.\-]{0,59}", p)]


# Links between files.

_FILE = re.compile(FILE_NAMES, re.I)


def data_files(text: str | None) -> list[str]:
    """Data files named in a text, each once, without READMEs."""
    return list(dict.fromkeys(f for f in _FILE.findall(text or "") if "readme" not in f.lower().replace("_", "").replace("-", "")))


def is_relation_key(key: str | None) -> bool:
    words = [_word(w) for w in (key or "").split()]
    if "linkage" in words or any(a == "join" and b in ("key", "keys") for a, b in zip(words, words[1:])):
        return True
    return bool(set(words) & {"relationship", "relationships"}) and bool(set(words) & {"file", "files", "table", "tables", "dataset", "datasets", "sheet", "sheets"})


def says_nothing(value: str | None) -> bool:
    return (value or "").strip().lower().strip(" .") in {"", "no", "none", "n/a", "na", "not applicable", "nil", "-", "tbd", "no relationship"}


def _names_something(word: str) -> bool:
    return bool(re.search(r"_|\d|[a-z][A-Z]", word)) or word.isupper() and len(word) >= 2


def linking_variables(text: str) -> list[str]:
    """The variables that a statement says files share or join on: quoted names, names beside key or column, and lists

    after on, by, via or using of which one looks like an identifier.
    """
    bare = _FILE.sub(" ", text)
    out = [m for m in re.findall(r"[\"“‘'`]([A-Za-z_][\w.\-]{0,59})[\"”’'`]", bare)]
    tokens = re.findall(r"[A-Za-z_][\w\-]*|[,&.;:]", bare)
    low = [t.lower() for t in tokens]

    def listed(at: int) -> list[str]:
        """The names from a place on, joined by commas or and."""
        names = []
        while at < len(tokens) and re.match(r"[A-Za-z_]", tokens[at]):
            names.append(tokens[at])
            at += 1
            if at < len(tokens) and low[at] in (",", "and", "&"):
                at += 1
                if at < len(tokens) and low[at] == "and":
                    at += 1
            else:
                break
        return [n for n in names if n.lower() not in _PLAIN]

    for i, word in enumerate(low):
        if word in ("on", "by", "via", "using"):
            at = i + 1
            while at < len(low) and low[at] in ("the", "a", "an", "common", "shared"):
                at += 1
            names = listed(at)
            if any(map(_names_something, names)):
                out += names
        if word in _ROLES:
            out += listed(i + 1)
            if i and re.match(r"[A-Za-z_]", tokens[i - 1]) and low[i - 1] not in _PLAIN:
                out.append(tokens[i - 1])
    return list(dict.fromkeys(out))


def _relates(sentence: str) -> bool:
    words = [_word(w) for w in _FILE.sub(" ", sentence).split()]
    return any(w in _SHARING or w.startswith(_RELATING) for w in words)


def relations(text: str | None) -> list[tuple[str, list[str], list[str]]]:
    """(statement, files, variables): sentences that link two data files or more, and keys about their relationship."""
    out = []
    for line in (text or "").split("\n"):
        key, colon, value = line.partition(":")
        if colon and len(key.split()) <= 10 and is_relation_key(key):
            if not says_nothing(value):
                out.append((line.strip(), data_files(value), linking_variables(value)))
            continue
        for sentence in re.split(r"(?<=[.!?])\s+(?=[A-Z`\"'])", line):
            files = data_files(sentence)
            if len(files) >= 2 and _relates(sentence):
                out.append((sentence.strip(), files, linking_variables(sentence)))
    return list({(s, tuple(f)): (s, f, v) for s, f, v in out}.values())


# Which file or sheet a passage is about.


@dataclass(frozen=True)
class Hint:
    file: str | None = None
    sheet: str | None = None

    def __bool__(self) -> bool:
        return bool(self.file or self.sheet)


def _sheet(text: str) -> str | None:
    m = re.search(r"\b(?:work)?sheet\b[\s:]*[\"“'‘`]([^\"”'’`]{1,31})[\"”'’`]|[\"“'‘`]([^\"”'’`]{1,31})[\"”'’`]\s+(?:work)?sheet\b|\b(?:work)?sheet\s*:?\s+([A-Z0-9][\w\-]{0,30})\b", text, re.I)
    found = next((g for g in m.groups() if g), None) if m else None
    return None if found is None or found.lower() in _PLAIN | {"of", "named", "called"} else found.strip()


def scope_hint(text: str | None, lead: bool = False) -> Hint:
    """The file and sheet that a heading, a key line or (lead) a short line before a list names."""
    text = (text or "").strip().strip("#").strip()
    key, colon, value = text.partition(":")
    label = " ".join(_word(w) for w in key.split())
    if colon and label in ("sheet", "worksheet", "sheet name", "tab"):
        value = value.strip(" .*_`\"'“”‘’")
        return Hint(sheet=value if value and len(value) <= 31 and len(value.split()) <= 4 else None)
    files = data_files(text)
    if colon and label in ("file", "filename", "file name", "dataset", "data file", "table", "data set"):
        bare = value.strip(" .*_`\"'“”‘’")
        file = files[0] if files else bare if re.fullmatch(r"[A-Za-z][\w\-]{0,59}", bare) and not says_nothing(bare) else None
        return Hint(file, _sheet(value))
    if lead and len(text.split()) > 12:
        return Hint()
    return Hint(files[0] if files else None, _sheet(text))


def facts(text: str | None) -> Iterator[tuple[str, str, str | None]]:
    """(kind, value, detail) of everything above in one text, without abbreviations."""
    yield from (("missing_code", c, None) for c in missing_codes_in_prose(text))
    if (absent := absence_sentence(text)) is not None:
        yield "absence", absent, None
    yield from (("relation", "|".join(f), "|".join(v)) for _, f, v in relations(text))
