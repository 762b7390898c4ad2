"""Mapping freely entered values to a canonical list (problem 1).

A prefix-filter set-similarity join. A value is stripped of decoration (numbering, quotes, remarks, generic lead
words), folded, and becomes the set of letter pairs of its words, so that the order of words does not matter. Tokens
are ordered by how rare they are over all values and entries; for a similarity of at least ``threshold`` two sets must
share one of their ``size - ceil(threshold * size) + 1`` rarest tokens, so only these prefixes are joined; length and
position then bound the overlap and the remaining candidates get their exact Jaccard similarity, by which they are
ranked. An exact check on words follows: every word of one side must be a word of the other up to slips of the keyboard
or as a plain abbreviation. Of the entries that pass, the one of the highest Jaccard similarity is kept; slips per
letter and then the smaller term_id only break ties. A value of two words may also be two wordings of one term.

Values enter once per distinct text (pre-aggregated), however often they occur; results are joined back by text. The
index (the prefix tokens of terms, other wordings and abbreviations made by rule, with their token sets) is written
before the join and broadcast only if its counted tokens are at most MOST_INDEX_TOKENS; otherwise it is joined by token.

Edge cases (tested): null and blank values are not cases; a value without letters or digits matches nothing (-1); an
empty list maps everything to -1; a value equal to a term as stored is no case; repeated rows give one result; a term
domain that no entry has gives -1; very long values simply have many tokens and fail the length filter.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.strings import slips
from tablewright.session import shared_dir, ship

THRESHOLD = 0.3
#: Tokens of an index that may be broadcast, about 60 bytes each.
MOST_INDEX_TOKENS = 500_000

#: Words that only introduce a label; any short remark in brackets and punctuation that close one.
_LEAD = re.compile(r"^(?:the|a|an|data|dataset|project)\b[\s:.\-]+(?=\S)")
_TAIL = re.compile(r"(?:\s*(?:[(\[][^()\[\]]{1,20}[)\]]|\*+\d*|:|\.|,|;))+\s*$")
_NUMBERING = re.compile(r"^\s*(?:section\s+\d+\s*[-:.]?|[(\[]?\d{1,3}[)\].:]|\d{1,3}\s+(?=\D)|[a-z]\d{1,2}[.):]?\s)\s*")


def fold(text: str | None) -> str:
    text = unicodedata.normalize("NFKD", text or "").casefold()
    return re.sub(r"\s+", " ", "".join(c for c in text if not unicodedata.combining(c))).strip()


def _words(text: str) -> str:
    return " ".join(re.findall(r"[a-z0-9]+|[^\W_]+", text))


@lru_cache(maxsize=100_000)
def readings(text: str) -> tuple[str, ...]:
    """The plain forms a value may stand for, from the fullest to the barest."""
    joined = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text.strip()) if " " not in text.strip() else text
    body = fold(joined).strip("\"'“”‘’„«»*_` ")
    out = [_words(body)]
    for _ in range(4):
        before = body
        body = _NUMBERING.sub("", body).strip("\"'“”‘’„«»*_` ")
        body = _TAIL.sub("", body).strip("\"'“”‘’„«»*_` ")
        if body == before:
            break
    if _words(body):
        out.append(_words(body))
    bare = body
    while (shorter := _LEAD.sub("", bare)) != bare:
        bare = shorter
        out.append(_words(bare))
    head = re.split(r"\s*[:;(\[]", bare)[0]
    if head and head != bare and len(_words(head)) >= 3:
        out.append(_words(head))
    return tuple(dict.fromkeys(w for w in out if w))


def pairs(text: str) -> list[str]:
    """The set of letter pairs of the words, with marked word ends."""
    out = set()
    for word in text.split():
        marked = f"^{word}$"
        out.update(marked[i : i + 2] for i in range(len(marked) - 1))
    return sorted(out)


def allowed_slips(size: int) -> int:
    return 0 if size <= 2 else 1 if size <= 6 else 2 if size <= 10 else 3


#: Fixed value: the usual short form of number.
_USUAL = {("no", "number"), ("nr", "number")}


def abbreviates(short: str, long: str) -> bool:
    """A beginning of at least three letters, or the consonants in order from the first letter on."""
    if (short, long) in _USUAL:
        return True
    if len(short) < 2 or len(short) > len(long) - 2:
        return False
    if len(short) >= 3 and long.startswith(short) or len(short) >= 4 and short[-1] == "s" and long.startswith(short[:-1]):
        return True
    if short[0] != long[0] or any(c in "aeiou" for c in short[1:]):
        return False
    rest = iter(long)
    return all(c in rest for c in short)


_SMALL = {"of", "the", "to", "in", "and", "or", "how", "are"}


def word_distance(value: str, entry: str) -> float | None:
    """Slips per letter if each word of one side is a word of the other, else None."""
    squeezed, wanted = value.replace(" ", ""), entry.replace(" ", "")
    gap = slips(squeezed, wanted)
    limit = allowed_slips(min(len(squeezed), len(wanted))) + (len(wanted) > 15)
    best = gap / len(wanted) if gap <= limit else None
    if best is not None and value.count(" ") == entry.count(" ") and any(slips(v, e) > max(2, 0.4 * len(e)) for v, e in zip(value.split(), entry.split())):
        best = None
    free, total = value.split(), 0.0
    for word in sorted(entry.split(), key=len, reverse=True):
        options = []
        for have in free:
            d = 0 if have == word else slips(have, word)
            if d <= allowed_slips(min(len(have), len(word))):
                options.append((d, have))
            elif abbreviates(have, word):
                options.append((0.5, have))
        if not options:
            if word in _SMALL:
                total += 0.5
                continue
            return best
        d, have = min(options)
        total += d
        free.remove(have)
    if any(w not in _SMALL for w in free):
        return best
    share = (total + 0.25 * len(free)) / len(wanted)
    return share if best is None else min(best, share)


def abbreviations(words: str) -> list[str]:
    """Short forms of one-word wordings: beginnings of three letters or more and the bare consonants."""
    if " " in words or len(words) < 6:
        return []
    bare = words[0] + "".join(c for c in words[1:] if c not in "aeiou")
    out = {words[:n] for n in range(3, min(7, len(words) - 2))}
    if len(bare) >= 3:
        out |= {bare, bare[:3]}
        doubled = re.sub(r"(.)\1", r"\1", bare)
        out |= {doubled, doubled[0] + doubled[2:]} if len(doubled) > 3 else {doubled}
    if len(bare) >= 4:
        out.add(bare[0] + bare[2] + bare[-1] if len(bare) >= 4 else bare)
        out.add(bare[0] + bare[-2] + bare[-1])
    return sorted(w for w in out if len(w) >= 3)


def _parts(text: str | None) -> list[dict]:
    whole = readings(text or "")
    out = [{"reading": w, "rank": i, "parts": 1, "tokens": pairs(w)} for i, w in enumerate(whole)]
    for i, w in enumerate(whole):
        if w.count(" ") == 1 and len(set(w.split())) == 2:
            out += [{"reading": part, "rank": len(whole) + i, "parts": 2, "tokens": pairs(part)} for part in w.split()]
    return out


def _read_values(text: pd.Series) -> pd.Series:
    return pd.Series([_parts(t) for t in text])


_READING = "array<struct<reading:string,rank:int,parts:int,tokens:array<string>>>"


def _entry_forms(term: str | None, also: list[str] | None) -> list[tuple[str, bool]]:
    full = [_words(fold(t)) for t in [term, *(list(also) if also is not None else [])] if t]
    forms = {w: False for w in full if w}
    for w in full:
        if w.endswith("s") and len(w) > 4:
            forms.setdefault(w[:-1], False)
        else:
            forms.setdefault(w + "s", False)
        for short in abbreviations(w):
            forms.setdefault(short, True)
    return sorted(forms.items())


def _read_entries(term: pd.Series, also: pd.Series) -> pd.Series:
    return pd.Series([[{"entry": w, "short": s, "tokens": pairs(w)} for w, s in _entry_forms(t, a)] for t, a in zip(term, also)])


_ENTRY = "array<struct<entry:string,short:boolean,tokens:array<string>>>"


def _verify(value: pd.Series, entry: pd.Series, short: pd.Series) -> pd.Series:
    return pd.Series([(0.05 if v == e else None) if s else word_distance(v, e) for v, e, s in zip(value, entry, short)], dtype=object)


def _ordered(sets: DataFrame, order: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """Each set with its tokens from the rarest on and its prefix of (token, place)."""
    ranked = sets.select(*key, F.explode("tokens").alias("token")).join(order, "token")
    ranked = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("sorted"))
    size = F.size("sorted")
    return ranked.select(
        *key,
        F.transform("sorted", lambda s: s["token"]).alias("tokens"),
        (size - F.ceil(size * threshold - 1e-9).cast("int") + 1).alias("prefix"),
    )


def match_values(values: DataFrame, terms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(domain, value, term_id): the entry each distinct value means, -1 if none.

    values: (domain, value), repeated as may be; terms: term_id, term_domain, term, also_written.
    """
    spark = values.sparkSession
    ship(spark)
    shared_dir(spark)
    distinct = values.filter("value is not null").select("domain", "value").distinct()
    read = distinct.withColumn("r", F.explode(F.pandas_udf(_read_values, _READING)("value"))).select("domain", "value", "r.*").checkpoint()
    forms = read.select("domain", "reading", "tokens").dropDuplicates(["domain", "reading"])
    listed = terms.filter("term_id is not null").select(F.col("term_id").cast("long"), F.col("term_domain").alias("domain"), "term", "also_written")
    listed = listed.dropDuplicates(["term_id"])
    entries = listed.withColumn("e", F.explode(F.pandas_udf(_read_entries, _ENTRY)("term", "also_written"))).select("term_id", "domain", "e.*").checkpoint()
    order = forms.select(F.explode("tokens").alias("token")).unionByName(entries.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    # Few forms meet many entries: they are spread over all tasks, whatever their size, and stay where they are up to the check.
    left = _ordered(forms, order, ["domain", "reading"], threshold).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "domain", "reading").checkpoint()
    right = _ordered(entries, order, ["term_id", "domain", "entry", "short"], threshold)
    probe = left.select("domain", "reading", "tokens", F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("i", "token"))
    index = right.select(
        "term_id", "domain", "entry", "short", F.col("tokens").alias("entry_tokens"), F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("j", "token")
    ).checkpoint()
    held = index.agg(F.coalesce(F.sum(F.size("entry_tokens")), F.lit(0))).first()[0]
    index = F.broadcast(index) if held <= MOST_INDEX_TOKENS else index.hint("merge")
    a, b = F.size("tokens"), F.size("entry_tokens")
    need = F.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9)
    met = probe.join(index, ["domain", "token"]).filter((a >= threshold * b) & (b >= threshold * a))
    met = met.filter(F.least(a - F.col("i"), b - F.col("j")) >= need)  # the first shared token stands at places i and j
    both = F.size(F.array_intersect("tokens", "entry_tokens"))
    scored = met.withColumn("jaccard", both / (a + b - both)).filter(F.col("jaccard") >= threshold)
    scored = scored.groupBy("domain", "reading", "term_id", "entry").agg(F.max("jaccard").alias("jaccard"), F.min("short").alias("short"))
    distance = F.pandas_udf(_verify, "double").asNondeterministic()("reading", "entry", "short")  # else it runs again for the filter
    accepted = scored.withColumn("distance", distance).filter("distance is not null")
    per_reading = accepted.groupBy("domain", "reading").agg(F.min(F.struct((-F.col("jaccard")).alias("less"), "distance", "term_id")).alias("best"))
    best = read.select("domain", "value", "reading", "rank", "parts").join(per_reading, ["domain", "reading"])
    # The parts of a value must mean one term.
    best = best.groupBy("domain", "value", "rank", "best.term_id").agg(F.count(F.lit(1)).alias("met"), F.first("parts").alias("parts"), F.avg("best.less").alias("less"), F.sum("best.distance").alias("distance")).filter("met = parts")
    best = best.groupBy("domain", "value").agg(F.min(F.struct("less", "rank", "distance", "term_id"))["term_id"].alias("term_id"))
    return distinct.join(best, ["domain", "value"], "left").select("domain", "value", F.coalesce("term_id", F.lit(-1)).alias("term_id"))


def labelled_values(key_values: DataFrame, definitions: DataFrame) -> DataFrame:
    """(field, domain, record_id, value) of the values to map."""
    blank = lambda c: F.regexp_replace(c, r"[\s ]+", "") == ""
    labels = key_values.select(F.lit("label").alias("field"), F.lit("field_label").alias("domain"), F.col("kv_id").alias("record_id"), F.col("label").alias("value"))
    types = definitions.select(F.lit("declared_type").alias("field"), F.lit("column_type").alias("domain"), F.col("def_id").alias("record_id"), F.col("declared_type").alias("value"))
    return labels.unionByName(types).filter(F.col("value").isNotNull() & ~blank(F.col("value")))


def found(key_values: DataFrame, definitions: DataFrame, terms: DataFrame) -> DataFrame:
    rows = labelled_values(key_values, definitions).distinct()
    stored = terms.select(F.col("term_domain").alias("domain"), F.col("term").alias("value")).distinct()
    rows = rows.join(stored, ["domain", "value"], "left_anti")
    mapped = match_values(rows.select("domain", "value"), terms)
    return rows.join(mapped, ["domain", "value"]).select("field", "record_id", "term_id").distinct()
