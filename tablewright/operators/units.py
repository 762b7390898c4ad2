"""Quantities recorded in different units, brought to the common unit of each quantity (problem 2).

An automaton over all unit aliases finds every alias in a text in one pass; of overlapping finds the longest wins. It
reads all six fields; what stands around a find decides whether it is the unit of the values:

* a field that is meant for a unit (unit, header_unit, the definition's unit) must hold nothing else than the alias,
  brackets, stops and cue words (in, unit), or go on with ``per`` and a noun or with a preposition (kg per animal);
* in names and descriptions the alias must follow a cue (a bracket, comma, colon, the words in/are/as/unit, or the joint
  of a name) and close the text, or follow a cue word and go on with a preposition (depth in m below surface);
* a number right before the alias makes it an amount (a 50 m line, visits of 10 min), not the unit of the values, in
  every field; only the number one is nothing (1 kg);
* a single letter or a unit of another quantity than the word before it names, without a cue, is part of the name.

The fields are asked in order: unit, header_unit, the definition's unit, original_name, name, description; the first that
states a unit decides. Conversion factors are joined from unit_list (broadcast: the list is checked to hold at most
MOST_UNITS rows, beyond that it is joined by key).

The alias table is built by rule from unit names, SI prefixes and spellings, with every quotient of base units; units
that unit_list lacks (W/m2, kWh, mol/L) are recognised under a made code, so that they state something, but are not
converted. A unit field of five letters or more may be one insertion, deletion or exchange of a letter away from a
single alias; a swap of neighbours is two exchanges and states nothing, nor does a slip in names or descriptions.

Edge cases (tested): nulls, blanks, placeholders, percentages and words for no unit state nothing and the next field is
asked; repeated rows count once; a null def_id joins nothing and does not gather in one partition; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import ship

MOST_UNITS = 10_000

#: SI prefixes.
_PREFIXES = {"": "", "k": "kilo", "m": "milli", "c": "centi", "u": "micro", "h": "hecto", "n": "nano", "M": "mega"}


def _si(prefix: str, symbol: str, words: list[str]) -> list[str]:
    return [prefix.lower() + symbol, *(_PREFIXES[prefix] + w + end for w in words for end in ("", "s"))]


def alias_table() -> dict[str, str]:
    """Alias (folded as by fold()) to unit_code."""
    metre, litre, gram = ["metre", "meter"], ["litre", "liter"], ["gram", "gramme"]
    length = {"m": _si("", "m", metre), "cm": [*_si("c", "m", metre), "cms"], "mm": [*_si("m", "m", metre), "mms"], "km": [*_si("k", "m", metre), "kms"], "um": [*_si("u", "m", metre), "micron", "microns"]}
    mass = {"g": [*_si("", "g", gram), "gr", "gms", "gm"], "kg": [*_si("k", "g", gram), "kgs", "kilo", "kilos"], "mg": [*_si("m", "g", gram), "mgs"], "ug": [*_si("u", "g", gram), "mcg"], "ng": _si("n", "g", gram)}
    volume = {"l": [*_si("", "l", litre), "ltr", "dm3"], "ml": [*_si("m", "l", litre), "cc", "cm3"], "ul": _si("u", "l", litre)}
    hour, minute, second = ["h", "hr", "hrs", "hour", "hours"], ["min", "mins", "minute", "minutes"], ["s", "sec", "secs", "second", "seconds"]
    table = {**length, **{k: v for k, v in mass.items() if k != "ng"}, **volume, "h": hour, "min": minute, "s": second, "day": ["d", "day", "days"]}
    table |= {"lb": ["lb", "lbs", "pound", "pounds"], "oz": ["oz", "ozs", "ounce", "ounces"], "inch": ["in", "ins", "inch", "inches", "″", '"'], "ft": ["ft", "foot", "feet"]}
    for code, letter, word in (("degc", "c", "celsius"), ("degf", "f", "fahrenheit")):
        table[code] = [word, letter, *(f"{d}{gap}{x}" for d in ("deg", "degs", "degree", "degrees", "°") for gap in ("", " ") for x in (letter, word)), f"°{letter}"]
    table["kelvin"] = ["k", "kelvin", "kelvins", "deg k", "degk", "°k", "degrees kelvin"]
    squares = lambda symbol, words: [f"{symbol}2", f"{symbol}^2", f"sq {symbol}", f"{symbol} 2", *(f"{q} {w}{end}" for q in ("square", "sq", "sq.") for w in words for end in ("", "s")), f"sq. {symbol}"]
    table["m2"], table["cm2"] = squares("m", metre), squares("cm", ["centi" + w for w in metre])
    table["m3"] = ["m3", "m^3", "m 3", "cu m", "cu. m", *(f"cubic {w}{end}" for w in metre for end in ("", "s"))]
    table["gal"] = ["gal", "gals", "gallon", "gallons", "us gal", "us gallon", "us gallons", "gallons (us)", "gallon (us)", "gal (us)"]
    per = lambda tops, bottoms: [f"{t}{join}{b}" for t in tops for b in bottoms for join in ("/", " / ", " per ", "/ ")] + [f"{t}{gap}{b}-1" for t in tops for b in bottoms for gap in (" ", ".")]
    table |= {"mg_per_l": per(mass["mg"], volume["l"]), "ug_per_l": per(mass["ug"], volume["l"]), "g_per_l": per(mass["g"], volume["l"]), "ng_per_ml": per(mass["ng"], volume["ml"])}
    table |= {"m_per_s": [*per(length["m"], second), "mps"], "km_per_h": [*per(length["km"], hour), "kph", "kmh", "kmph"], "knot": ["kn", "kt", "kts", "knot", "knots"]}
    table |= {"ha": ["ha", "hectare", "hectares"], "acre": ["ac", "acre", "acres"]}
    table |= {"kpa": _si("k", "pa", ["pascal"]), "pa": _si("", "pa", ["pascal"]), "hpa": [*_si("h", "pa", ["pascal"]), "mbar", "mb", "millibar", "millibars"], "bar": ["bar", "bars"]}
    table["mmhg"] = ["mmhg", "mm hg", "torr", *(f"millim{e}{end} of mercury" for e in ("etre", "eter") for end in ("", "s"))]
    table |= {"kj": _si("k", "j", ["joule"]), "mj": _si("M", "j", ["joule"]), "joule": _si("", "j", ["joule"]), "kcal": ["kcal", "kcals", "kilocalorie", "kilocalories"]}
    heads = ["ind", "inds", "individual", "individuals"]
    table["each"] = [*heads, *(f"{n} {h}" for n in ("n", "no of", "number of") for h in heads), "each", "head", "count"]
    table["kilo_each"] = ["kilo each", "thousand", "thousands", "x1000", "'000", "10^3", *(f"{n} {h}" for n in ("thousand", "thousands", "thousands of", "x1000", "x 1000", "'000", "10^3", "1000") for h in heads)]
    own = {alias: code for code, aliases in table.items() for alias in aliases}
    return {alias: code for code, aliases in _quotients(table).items() for alias in aliases} | own


def _quotients(table: dict[str, list[str]]) -> dict[str, list[str]]:
    """Units beyond the list: watts, watt hours, moles and the quotients of base units, under codes such as w_per_m2."""
    more = {
        "w": _si("", "w", ["watt"]), "kw": _si("k", "w", ["watt"]), "wh": ["wh", "watt hour", "watt hours"], "kwh": ["kwh", "kw h", "kilowatt hour", "kilowatt hours"],
        "mol": ["mol", "mols", "mole", "moles"], "mmol": ["mmol", "millimole", "millimoles"], "umol": ["umol", "micromole", "micromoles"], "v": ["volt", "volts"], "hz": ["hz", "hertz"], "ppm": ["ppm"], "ppb": ["ppb"],
    }
    symbols = {**{c: a for c, a in table.items() if c in _BASE}, **more}
    out = {c: a for c, a in more.items()}
    for top, tops in symbols.items():
        for bottom in _BELOW:
            if top != bottom:
                symbol, words = tops[0], [w for w in table[bottom] if len(w) > 3 and w.isalpha()][:4]
                low = table[bottom][0].rstrip("23")
                power = table[bottom][0][len(low) :]
                out[f"{top}_per_{bottom}"] = [f"{symbol}{join}{table[bottom][0]}" for join in ("/", " / ", " per ")] + [f"{symbol}{gap}{low}-{power or 1}" for gap in (" ", ".", "")] + [f"{t} per {w}" for t in tops if t.isalpha() for w in words]
    return out


_BASE = ("g", "kg", "mg", "ug", "m", "cm", "mm", "km", "l", "ml", "kj", "joule", "mj", "each")
_BELOW = ("m2", "m3", "cm2", "ha", "l", "ml", "g", "kg", "s", "min", "h", "day", "m", "km", "kelvin")

#: The quantity that words in a name or description point to.
_HINTS = {
    "mass": "mass weight wt weighs", "length": "length len height depth dist distance span width diameter thickness", "temperature": "temp temperature", "volume": "vol volume", "concentration": "conc concentration dissolved",
    "duration": "time duration long", "area": "area surface extent", "pressure": "press pressure", "energy": "energy heat", "speed": "speed velocity wind flow", "headcount": "number count animals",
}
_HINT_OF = {word: quantity for quantity, words in _HINTS.items() for word in words.split()}
_QUANTITY_OF_CODE = {
    **dict.fromkeys(["g", "kg", "mg", "ug", "lb", "oz"], "mass"), **dict.fromkeys(["m", "cm", "mm", "km", "inch", "ft", "um"], "length"), **dict.fromkeys(["degc", "degf", "kelvin"], "temperature"),
    **dict.fromkeys(["l", "ml", "ul", "m3", "gal"], "volume"), **dict.fromkeys(["h", "min", "s", "day"], "duration"),
}

_SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻−–µμ·", "0123456789---uu ")
_SURE = re.compile(r"(?:[(\[,;:_]|\b(?:in|are|unit|units|as))\s*$")
_CUE_WORD = re.compile(r"\b(?:in|are|as|units?)[\s:]*$")
_NUMBER_BEFORE = re.compile(r"[0-9]\s*$")
_ONE_BEFORE = re.compile(r"(?:^|[^0-9.,])1\s*$")
_GOES_ON = re.compile(r"[\s)\]]*(?:per\s+[^\W\d_]{3,}|(?:above|below|from|of|at|on|under|over|for|since|after|before|between)\b)")
_FILLING = re.compile(r"(?:[\s()\[\]{}.,:;*]|\b(?:in|units?)\b)*")


def fold(text: str) -> str:
    """Lower case, plain digits and signs, single spaces."""
    text = text.replace("℃", "°C").replace("℉", "°F").translate(_SUPERSCRIPTS)
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).strip().lower()


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for alias, code in alias_table().items():
        found.add_word(alias, (len(alias), code))
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def _slips() -> dict[str, set[str]]:
    """Aliases of five letters or more by their texts with one letter left out."""
    out: dict[str, set[str]] = {}
    for alias in alias_table_cached():
        if len(alias) >= 5 and alias.isalpha():
            for part in _lessened(alias):
                out.setdefault(part, set()).add(alias)
    return out


def _lessened(word: str) -> list[str]:
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


def one_off(a: str, b: str) -> bool:
    """Whether one letter inserted, left out or exchanged turns one word into the other."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def find_aliases(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, unit_code) of aliases in a folded text that stand as words, leftmost and longest first."""
    edge = lambda c: not c.isalnum()
    hits = []
    for last, (size, code) in _automaton().iter(text):
        begin, end = last - size + 1, last + 1
        if (begin == 0 or edge(text[begin - 1]) or edge(text[begin])) and (end == len(text) or edge(text[end]) or edge(text[end - 1])):
            hits.append((begin, end, code))
    hits.sort(key=lambda h: (h[0], -h[1]))
    out: list[tuple[int, int, str]] = []
    for hit in hits:
        if not out or hit[0] >= out[-1][1]:
            out.append(hit)
    return out


@lru_cache(maxsize=100_000)
def stated_unit(text: str | None) -> str | None:
    """The unit that a field meant for units states."""
    if text is None:
        return None
    folded = fold(text)
    for begin, end, code in find_aliases(folded):
        before, after = folded[:begin], folded[end:]
        if _ONE_BEFORE.search(before):
            before = before.rstrip()[:-1]
        if _FILLING.fullmatch(before) and (_FILLING.fullmatch(after) or _GOES_ON.match(after)):
            return code
    body = folded.strip("()[]{} .,:;*")
    if len(body) >= 5 and body.isalpha():
        near = {alias_table_cached()[alias] for part in _lessened(body) for alias in _slips().get(part, ()) if one_off(body, alias)}
        if len(near) == 1:
            return near.pop()
    return None


@lru_cache(maxsize=1)
def alias_table_cached() -> dict[str, str]:
    return alias_table()


@lru_cache(maxsize=200_000)
def unit_in_text(text: str | None, name: bool) -> str | None:
    """The unit of the values that a name or a description gives."""
    if not text:
        return None
    folded = fold(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text) if name and not re.search(r"[\s_(\[,]", text) else text)
    body = folded.rstrip(" .)]}") if not folded.endswith("(us)") else folded
    if body.endswith("(us") or re.search(r"\(us\)[)\]]$", folded):
        body = body if body.endswith("(us)") else body + ")"
    spaced = re.sub(r"_+", lambda m: "_" * len(m[0]), body)
    for begin, end, code in find_aliases(spaced.replace("_", " ")):
        before = spaced[:begin]
        if end < len(spaced) and not (_CUE_WORD.search(before) and _GOES_ON.match(spaced[end:])):
            continue
        if _NUMBER_BEFORE.search(before) and not before.rstrip().endswith(("_",)):
            continue
        joint = name and before.endswith(("_", " ")) and before.strip(" _")
        if not (_SURE.search(before) or joint):
            continue
        if not _SURE.search(before.rstrip("_")) and code in _QUANTITY_OF_CODE:
            hints = {_HINT_OF[w] for w in re.findall(r"[a-z]+", before) if w in _HINT_OF}
            if (hints and _QUANTITY_OF_CODE[code] not in hints) or (not hints and len(spaced) - begin == 1):
                continue
        return code
    return None


def resolve(unit, header_unit, definition_unit, original_name, name, description) -> tuple[str | None, str | None]:
    for source, text in (("unit", unit), ("header_unit", header_unit), ("definition", definition_unit)):
        if code := stated_unit(text):
            return code, source
    for source, text, is_name in (("original_name", original_name, True), ("name", name, True), ("description", description, False)):
        if code := unit_in_text(text, is_name):
            return code, source
    return None, None


def _resolve_rows(unit: pd.Series, header: pd.Series, definition: pd.Series, original: pd.Series, name: pd.Series, description: pd.Series) -> pd.DataFrame:
    plain = [[None if x is None or x != x else x for x in s.tolist()] for s in (unit, header, definition, original, name, description)]
    return pd.DataFrame([resolve(*row) for row in zip(*plain)], columns=["unit_code", "stated_by"], dtype=object)


def _bounded(units: DataFrame) -> DataFrame:
    return F.broadcast(units) if units.limit(MOST_UNITS + 1).count() <= MOST_UNITS else units


def variable_units(variables: DataFrame, contexts: DataFrame, definitions: DataFrame) -> DataFrame:
    """Every variable row once, with unit_code and the field that states it."""
    ship(variables.sparkSession)
    columns = ["variable_id", "dataset_id", "pos", "unit", "original_name", "name", "description", "stat_min", "stat_max", "stat_mean", "stat_std", "var_type"]
    rows = variables.select(*columns, "def_id").dropDuplicates(["variable_id"])
    headers = contexts.filter("header_unit is not null").groupBy("dataset_id", "pos").agg(F.min_by("header_unit", "context_id").alias("header_unit"))
    stated = definitions.filter("unit is not null").groupBy("def_id").agg(F.max_by("unit", "parsed_at").alias("definition_unit")).withColumnRenamed("def_id", "link")
    own = F.coalesce(F.col("def_id"), -F.abs(F.xxhash64("variable_id")) - 1)
    rows = rows.join(headers, ["dataset_id", "pos"], "left").withColumn("link", own).join(stated, "link", "left")
    found = F.pandas_udf(_resolve_rows, "unit_code string, stated_by string")("unit", "header_unit", "definition_unit", "original_name", "name", "description")
    return rows.withColumn("found", found).select(*columns, "found.unit_code", "found.stated_by")


def _is_common() -> Column:
    return (F.col("to_common_factor") == 1.0) & (F.col("to_common_shift") == 0.0)


def other_units(variables: DataFrame, contexts: DataFrame, definitions: DataFrame, units: DataFrame) -> DataFrame:
    """(variable_id, unit_code) of the variables with a mean whose values are not in the common unit."""
    measured = variables.filter("stat_mean is not null")
    factors = units.select("unit_code", "to_common_factor", "to_common_shift").dropDuplicates(["unit_code"])
    return variable_units(measured, contexts, definitions).filter("unit_code is not null").join(_bounded(factors), "unit_code").filter(~_is_common()).select("variable_id", "unit_code")


def common_statistics(variables: DataFrame, contexts: DataFrame, definitions: DataFrame, units: DataFrame) -> DataFrame:
    """The recorded statistics of every variable in the common unit of its quantity; unit_code null where none is stated."""
    factors = units.select("unit_code", "quantity", "to_common_factor", "to_common_shift").dropDuplicates(["unit_code"])
    factor, shift = F.coalesce("to_common_factor", F.lit(1.0)), F.coalesce("to_common_shift", F.lit(0.0))
    number = lambda c: F.when(F.col("var_type").isin("integer", "number"), F.col(c).try_cast("double")) * factor + shift
    return variable_units(variables, contexts, definitions).join(_bounded(factors), "unit_code", "left").select(
        "variable_id", "unit_code", "stated_by", "quantity", number("stat_min").alias("common_min"), number("stat_max").alias("common_max"),
        (F.col("stat_mean") * factor + shift).alias("common_mean"), (F.col("stat_std") * factor).alias("common_std"),
    )
