"""Spellings of one organisation (a part of problem 3).

A spelling becomes a list of words: departments (a segment or an opening phrase with a word such as faculty, if the
text goes on to name an institution), a closing country code and articles are left off, and words that many
institutions bear (university, institute, marine, ...) take one form whatever their language or abbreviation: known
forms, beginnings with a full stop, contractions, compounds of known forms and forms with one slip. All other words are
proper names and stay as they are.

Blocks hold the phonetic codes of the sorted words, all of them or all but one; the one left out only gives its
beginning, its end or, if it is short, what remains without one of its letters. So one slip in one word never hides a
pair, and a block holds only spellings that share all other words: a crowded city or a frequent word alone is no block.
A run of known words also gives its initials, which meet acronyms beside the same proper names.

Two spellings are one organisation if their words pair off completely: equal, close by Jaro-Winkler with a single slip
(none below five letters; in words of five or six letters no exchange, which makes Mary of Mark; numbers must be
equal), or an abbreviation of a known word. An acronym stands for words with its initials in this order, else in any
order; of several candidates only the set of words that most spellings share counts, and none at a tie. Accepted pairs
are clustered by connected components.

Edge cases (tested): null and blank affiliations are in no organisation; texts without letters or digits are one only
if equal when folded; repeated rows count once; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice, product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.components import connected_components
from tablewright.llm.strings import fold, in_order, jaro_winkler, lessened, phonetic, slips
from tablewright.session import ship

LIKE = 0.80
#: Readings that ambiguous abbreviations of one spelling may give for blocking.
MOST_READINGS = 16

#: Words of institution names, each with other forms of it (translations, plurals, irregular short forms).
KNOWN_WORDS = {
    "university": ("universite", "universitat", "universidad", "universidade", "universita", "universiteit", "universitet", "universities", "uni"),
    "institute": ("institut", "instituto", "istituto", "institutes", "institution"),
    "college": ("colegio", "collegio", "colleges"),
    "school": ("schule", "escuela", "ecole", "scuola"),
    "academy": ("academie", "akademie", "academia", "accademia"),
    "centre": ("center", "centro", "zentrum", "centrum", "centres", "centers"),
    "laboratory": ("laboratories", "laboratoire", "laboratorio", "laboratorium", "lab", "labs"),
    "museum": ("musee", "museo", "museu", "muzeum", "museums"),
    "hospital": ("hopital", "ospedale", "krankenhaus", "hospitals"),
    "society": ("societe", "sociedad", "gesellschaft"),
    "foundation": ("fondation", "fundacion", "stiftung"),
    "observatory": ("observatoire", "observatorio", "observatorium"),
    "library": ("bibliotheque", "biblioteca", "bibliothek"),
    "station": (),
    "survey": (),
    "council": (),
    "agency": (),
    "research": ("recherche", "recherches", "forschung", "investigacion", "ricerca"),
    "science": ("sciences", "scientific", "wissenschaft", "wissenschaften", "ciencia", "ciencias"),
    "technology": ("technological", "technologie", "tecnologia", "technologies"),
    "technical": ("technische", "technique", "tecnica"),
    "engineering": (),
    "medicine": ("medical", "medecine", "medicina", "medizin"),
    "health": ("sante", "salud", "gesundheit"),
    "agriculture": ("agricultural", "agricole", "agricola", "landwirtschaft"),
    "forestry": (),
    "environment": ("environmental", "environnement", "umwelt"),
    "marine": (),
    "ocean": ("oceanography", "oceanographic"),
    "soil": ("soils",),
    "water": (),
    "history": ("histoire", "historia", "historisches", "historisch"),
    "natural": ("natur", "naturelle", "naturale"),
    "national": ("nationale", "nacional", "nazionale", "natl"),
    "international": ("internationale", "internacional", "intl"),
    "federal": (),
    "royal": (),
    "state": (),
    "polytechnic": ("polytechnique", "politecnico", "politecnica"),
    "arts": (),
    "studies": (),
}
#: The known words that name an institution by themselves.
HEADS = {"university", "institute", "college", "academy", "centre", "laboratory", "museum", "hospital", "society", "foundation", "observatory", "polytechnic"}
#: Words that name a part of an institution.
PARTS = ("department", "dept", "departement", "departamento", "depart", "faculty", "faculte", "facultad", "fakultat", "division", "section", "chair", "unit", "group", "school")
#: Articles and prepositions between the words.
SMALL_WORDS = ("of", "for", "the", "de", "di", "la", "le", "el", "der", "die", "das", "fur", "des", "del", "du", "da", "do", "and", "at", "in", "et", "und", "y", "e")

_FORM = {form: word for word, forms in KNOWN_WORDS.items() for form in (word, *forms)}
_SMALL = frozenset(SMALL_WORDS)
_PART = re.compile(rf"\b(?:{'|'.join(PARTS)})\b")
_OPENING_PART = re.compile(r"^(?:department|dept|depart)\b\.?\s+(?:of\s+|for\s+)?[^\W\d_]+\s+(?=\S)")
_WORD = re.compile(r"([^\W\d_]+|\d+)(\.?)")


@lru_cache(maxsize=1)
def _nearly() -> dict[str, set[str]]:
    """Known forms of five letters or more by what remains of them without a letter."""
    out: dict[str, set[str]] = {}
    for form in _FORM:
        if len(form) >= 5:
            for part in lessened(form):
                out.setdefault(part, set()).add(form)
    return out


def _near_forms(token: str) -> set[str]:
    """The token itself if it is a known form, else the known forms one slip away, from five letters on."""
    if token in _FORM:
        return {token}
    return {form for part in lessened(token) for form in _nearly().get(part, ()) if slips(token, form) == 1} if len(token) >= 5 else set()


@lru_cache(maxsize=100_000)
def known_words(token: str, dotted: bool) -> tuple[tuple[str, ...], ...]:
    """What a token may stand for: lists of known words, usually none or one."""
    if token in _FORM:
        return ((_FORM[token],),)
    if token == "u" and dotted:
        return (("university",),)
    for i in range(4, len(token) - 3):
        if (token[:i] in _FORM or token[i:] in _FORM) and len(halves := [next(iter(_near_forms(part)), None) for part in (token[:i], token[i:])]) == 2 and all(halves):
            return ((_FORM[halves[0]], _FORM[halves[1]]),)
    if len(token) >= (2 if dotted else 4):
        begun = {word for form, word in _FORM.items() if len(form) > len(token) and form.startswith(token)}
        if begun:
            return tuple((w,) for w in sorted(begun))
    if len(token) >= 3:
        drawn = {word for word in KNOWN_WORDS if len(word) > len(token) + 1 and token[-1] == word[-1] and in_order(token, word)}
        drawn |= {word for form, word in _FORM.items() if len(form) > len(token) + 1 and not set(token[1:]) & set("aeiou") and token[-1] == form[-1] and in_order(token, form)}
        if len(drawn) == 1:
            return ((drawn.pop(),),)
    near = {_FORM[form] for form in _near_forms(token)}
    return ((near.pop(),),) if len(near) == 1 else ()


def read(text: str) -> tuple[list[str], list[bool], list[list[tuple[str, ...]]]]:
    """(words in order, which of them are known, for each word what it may stand for)."""
    segments = [s for s in (fold(p).replace("'", "").replace("’", "") for p in re.split(r"[,;]", text)) if re.search(r"\w", s)]
    if len(segments) > 1 and re.fullmatch(r"[a-z]{2,3}\.?", segments[-1]) and not known_words(segments[-1].rstrip("."), segments[-1].endswith(".")):
        segments.pop()
    names_one = lambda s: any(w in HEADS for t, dot in _WORD.findall(s) for ws in known_words(t, bool(dot))[:1] for w in ws)
    kept = [s for s in segments if not _PART.search(s) or names_one(s)] or segments
    kept = [cut if (cut := _OPENING_PART.sub("", s)) != s and names_one(cut) else s for s in kept]
    words: list[str] = []
    known: list[bool] = []
    options: list[list[tuple[str, ...]]] = []
    for segment in kept:
        for token, dot in _WORD.findall(segment):
            if token in _SMALL:
                continue
            found = known_words(token, bool(dot))
            if len(found) == 1:
                for word in found[0]:
                    words.append(word)
                    known.append(True)
                    options.append([(word,)])
            else:
                words.append(token)
                known.append(False)
                options.append([(token,), *found] if found else [(token,)])
    return words, known, options


def _code(word: str) -> str:
    return word if word in KNOWN_WORDS else phonetic(word)


def blocks(words: list[str], options: list[list[tuple[str, ...]]]) -> list[str]:
    out: set[str] = set()
    for chosen in islice(product(*options), MOST_READINGS):
        reading = [w for part in chosen for w in part]
        codes = [_code(w) for w in reading]
        out.add("f|" + " ".join(sorted(codes)))
        for i, word in enumerate(reading):
            rest = " ".join(sorted(codes[:i] + codes[i + 1 :]))
            if word in KNOWN_WORDS or len(word) <= 6:
                out.add(f"w|{rest}|{word[0]}")
            if word not in KNOWN_WORDS:
                if 4 <= len(word) <= 7:
                    out.update(f"d|{rest}|{part}" for part in lessened(word))
                if not 4 <= len(word) <= 6:
                    out |= {f"b|{rest}|{word[:3]}", f"e|{rest}|{word[-3:]}"}
                if small_slip(word, i, len(reading)):
                    out.add(f"f|{rest}")
            if word not in KNOWN_WORDS and 2 <= len(word) <= 6 and word.isalpha() and rest:
                out.add(f"a|{rest}|{''.join(sorted(word))}")
        for begin, end in known_runs(reading):
            rest = codes[:begin] + codes[end:]
            if rest:
                out.add(f"a|{' '.join(sorted(rest))}|{''.join(sorted(w[0] for w in reading[begin:end]))}")
    return sorted(out)


def known_runs(words: list[str]) -> list[tuple[int, int]]:
    """The longest runs of two or more known words, as (begin, end)."""
    out, begin = [], None
    for i, word in enumerate([*words, ""]):
        if word in KNOWN_WORDS:
            begin = i if begin is None else begin
        else:
            if begin is not None and i - begin >= 2:
                out.append((begin, i))
            begin = None
    return out


def small_slip(word: str, place: int, size: int) -> bool:
    """Whether a word inside a spelling is a small word with a slip."""
    return 0 < place < size - 1 and len(word) <= 3 and word not in KNOWN_WORDS and any(len(s) >= 2 and slips(word, s) == 1 for s in SMALL_WORDS)


@lru_cache(maxsize=200_000)
def one_word(a: str, b: str) -> bool:
    """Whether two words are one: equal, one slip apart, or an abbreviation of a known word, itself with a slip at most."""
    if a == b:
        return True
    if a.isdigit() or b.isdigit() or a in KNOWN_WORDS and b in KNOWN_WORDS:
        return False
    if a in KNOWN_WORDS or b in KNOWN_WORDS:
        a, b = (b, a) if a in KNOWN_WORDS else (a, b)
        if 2 <= len(a) <= len(b) - 2 and in_order(a, b):
            return True
        return len(a) >= 4 and a[0] == b[0] and any(slips(a, b[:k]) == 1 for k in [len(b), *range(3, min(7, len(b) - 1))])
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 5 or jaro_winkler(a, b) < LIKE - 0.08 * (a[0] != b[0]) or slips(a, b) > 1:
        return False
    return len(a) > 6 or len(a) != len(b) or sorted(a) == sorted(b)


def _pair_off(a: list[str], b: list[str]) -> bool:
    """Whether all words of both lists pair off; a slip of a small word may be left over."""
    free = list(b)
    left = []
    loose = {w for words in (a, b) for i, w in enumerate(words) if small_slip(w, i, len(words))}
    for word in sorted(a, key=len, reverse=True):
        if word in free:
            free.remove(word)
        else:
            left.append(word)
    for word in list(left):
        near = next((f for f in free if one_word(word, f)), None)
        if near is not None:
            left.remove(word)
            free.remove(near)
    return loose.issuperset(left + free)


SAME = 1


def compare(a: list[str], b: list[str]) -> int:
    """SAME if the words pair off; if one holds the initials of the other's known words 2 to 5, the better the less: in

    this order beside equal names, beside alike names, in any order beside equal names, beside alike names; else 0.
    """
    if _pair_off(a, b):
        return SAME
    best = 0
    for short, long in ((a, b), (b, a)):
        for begin, end in known_runs(long):
            initials = "".join(w[0] for w in long[begin:end])
            for i, word in enumerate(short):
                if word not in KNOWN_WORDS and len(word) == len(initials) and sorted(word) == sorted(initials):
                    rest, other = short[:i] + short[i + 1 :], long[:begin] + long[end:]
                    if _pair_off(rest, other):
                        how = 2 + 2 * (word != initials) + (sorted(rest) != sorted(other))
                        best = min(best or how, how)
    return best


_READ = "form:string,words:array<string>,proper:string,sorted:string,blocks:array<bigint>"


def _hashed(keys: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(k) - (1 << 63) for k in keys]


def _read_rows(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        words, known, options = read(text)
        words = words or [fold(text)]
        proper = " ".join(sorted(w for w, k in zip(words, known) if not k))
        rows.append((" ".join(words), words, proper, " ".join(sorted(words)), _hashed(blocks(words, options)) if options else []))
    return pd.DataFrame(rows, columns=["form", "words", "proper", "sorted", "blocks"])


def _compared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([compare(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def organisations(persons: DataFrame) -> DataFrame:
    """(affiliation, first_id, org, spot): each distinct affiliation text with its organisation and the proper name in it.

    first_id is the smallest person_id that carries the text; spot is the proper name most spellings of the
    organisation agree on.
    """
    ship(persons.sparkSession)
    texts = persons.filter("affiliation is not null and trim(affiliation) <> ''").groupBy("affiliation").agg(F.min("person_id").alias("first_id"))
    texts = texts.withColumn("o", F.pandas_udf(_read_rows, f"struct<{_READ}>")("affiliation")).select("affiliation", "first_id", "o.*").checkpoint()
    forms = texts.groupBy("form").agg(F.first("words").alias("words"), F.first("sorted").alias("sorted"), F.first("proper").alias("proper"), F.first("blocks").alias("blocks"), F.count(F.lit(1)).alias("spellings"))
    keyed = forms.select(F.struct("form", "words", "sorted", "spellings").alias("a"), F.explode("blocks").alias("block"))
    met = keyed.join(keyed.select(F.col("a").alias("b"), "block").hint("merge"), "block").filter("a.form < b.form")
    met = met.groupBy("a.form", F.col("b.form").alias("other")).agg(F.first("a").alias("a"), F.first("b").alias("b"))
    judged = met.withColumn("how", F.pandas_udf(_compared, "int")("a.words", "b.words")).filter("how > 0").select("a", "b", "how").checkpoint()

    same = judged.filter(F.col("how") == SAME).select(F.col("a.form").alias("u"), F.col("b.form").alias("v"))
    # The acronym is the side with fewer words. Ordered initials go before loose ones, then the words most spellings share.
    shorter = F.size("a.words") < F.size("b.words")
    named = judged.filter(F.col("how") > SAME).select("how", F.when(shorter, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(shorter, F.col("b")).otherwise(F.col("a")).alias("l"))
    votes = named.groupBy(F.col("s.form").alias("u"), F.col("how"), F.col("l.sorted").alias("sorted")).agg(F.sum("l.spellings").alias("n"), F.collect_set("l.form").alias("forms"))
    w = Window.partitionBy("u").orderBy("how", F.desc("n"))
    first = votes.withColumn("r", F.row_number().over(w)).withColumn("next_how", F.lead("how").over(w)).withColumn("next_n", F.lead("n").over(w)).filter("r = 1 and not (next_how <=> how and next_n <=> n)")
    edges = same.unionByName(first.select("u", F.explode("forms").alias("v"))).unionByName(forms.select(F.col("form").alias("u"), F.col("form").alias("v")))
    labels = connected_components(edges).select(F.col("node").alias("form"), F.col("label").alias("org"))
    out = texts.select("affiliation", "first_id", "form", "proper").join(labels.hint("merge"), "form")
    named = out.filter("proper <> ''").groupBy("org", "proper").agg(F.count(F.lit(1)).alias("n"))
    spots = named.groupBy("org").agg(F.min_by("proper", F.struct(F.size(F.split("proper", " ")), -F.col("n"), F.col("proper"))).alias("spot"))
    return out.join(spots.hint("merge"), "org", "left").select("affiliation", "first_id", "org", "spot")

