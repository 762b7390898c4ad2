"""Linking table columns to documented variables: scored pairs, context, one-to-one assignment, leftovers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.config import Config
from tablewright.functions import text as T
from tablewright.session import ship

#: Scores of the name tests and the sizes of the context nudges.
EXACT, CASE, NORMALIZED, ALIAS, FUZZY_WEIGHT = 1.00, 0.98, 0.95, 0.90, 0.90
NUDGES = {"position": 0.03, "description_full": 0.04, "description_part": 0.02, "unit_agrees": 0.03, "unit_conflicts": -0.04, "unit_numeric": 0.02, "unit_text": -0.03, "labels_subset": 0.03, "labels_disjoint": -0.05, "labels_continuous": -0.05}
MOST_CONTEXT = 0.10
CONTEXT_FROM, SAME_NAME_FLOOR, INFERRED_CEILING = 0.50, 0.95, 0.98
UNIQUE_MARGIN, UNIQUE_BOOST = 0.15, 0.05


def py_abbreviated(a: str, b: str) -> bool:
    """Token by token equal or an abbreviation in either direction."""
    x, y = T.py_tokenize(a), T.py_tokenize(b)
    return len(x) == len(y) > 0 and all(p == q or T.py_is_abbreviation(p, q) or T.py_is_abbreviation(q, p) for p, q in zip(x, y))


def _compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The tests that need letters: token abbreviation, else the Indel ratio of the normalized names."""
    rows = []
    for x, y in zip(a, b):
        if x is None or y is None:
            rows.append((None, None))
        elif py_abbreviated(x, y):
            rows.append(("token_abbreviation", ALIAS))
        else:
            rows.append(("fuzzy", FUZZY_WEIGHT * T.py_indel_ratio(T.py_normalize_name(x), T.py_normalize_name(y)) / 100))
    return pd.DataFrame(rows, columns=["method", "base"])


def keyed(names: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds what the name tests compare, once per name instead of once per pair."""
    c = F.col(column)
    return names.withColumns({f"{prefix}low": F.lower(c), f"{prefix}norm": T.normalize_name(c), f"{prefix}set": T.token_set(c)})


def ladder(pairs: DataFrame, column: str = "column", name: str = "name", aliases: DataFrame | None = None) -> DataFrame:
    """Adds base score and method: the first name test that holds; only the rest is compared letter by letter."""
    ship(pairs.sparkSession)
    if "_a_norm" not in pairs.columns:
        pairs = keyed(keyed(pairs, column, "_a_"), name, "_b_")
    if aliases is not None:
        known = aliases.select(T.normalize_name(F.col("short")).alias("s"), T.normalize_name(F.col("long")).alias("l")).distinct()
        both = known.unionByName(known.select(F.col("l").alias("s"), F.col("s").alias("l"))).distinct().withColumn("aliased", F.lit(True))
        pairs = pairs.join(both, (F.col("_a_norm") == F.col("s")) & (F.col("_b_norm") == F.col("l")), "left").drop("s", "l")
    else:
        pairs = pairs.withColumn("aliased", F.lit(None).cast("boolean"))
    rung = (
        F.when(F.col(column) == F.col(name), "exact")
        .when(F.col("_a_low") == F.col("_b_low"), "case_insensitive")
        .when((F.col("_a_norm") == F.col("_b_norm")) & (F.col("_a_norm") != ""), "normalized")
        .when(F.coalesce("aliased", F.lit(False)), "abbreviation")
        .when((F.col("_a_set") == F.col("_b_set")) & (F.col("_a_set") != ""), "token_set")
    )
    left = lambda c: F.when(F.col("rung").isNull(), F.coalesce(F.col(c), F.lit("")))
    ranked = pairs.withColumn("rung", rung).withColumn("letters", F.pandas_udf(_compared, "method string, base double")(left(column), left(name)))
    fixed = F.create_map(*[F.lit(x) for k, v in (("exact", EXACT), ("case_insensitive", CASE), ("normalized", NORMALIZED), ("abbreviation", ALIAS), ("token_set", ALIAS)) for x in (k, v)])
    out = ranked.withColumn("method", F.coalesce("rung", "letters.method")).withColumn("base", F.coalesce(fixed[F.col("rung")], "letters.base"))
    return out.drop("aliased", "rung", "letters", *(f"_{x}_{k}" for x in "ab" for k in ("low", "norm", "set")))


#: Units as parts of names, with the form they are compared in.
UNIT_ALIASES = {"percent": "%", "pct": "%", "percentage": "%", "meter": "m", "metre": "m", "meters": "m", "metres": "m", "gram": "g", "grams": "g", "kilogram": "kg", "kilograms": "kg", "second": "s", "seconds": "s", "sec": "s", "hour": "h", "hours": "h", "hr": "h", "hrs": "h", "minute": "min", "minutes": "min", "celsius": "c", "degc": "c", "liter": "l", "litre": "l", "liters": "l", "litres": "l"}
UNIT_WORDS = {"%", "m", "cm", "mm", "km", "um", "g", "kg", "mg", "ug", "ng", "s", "ms", "h", "min", "c", "f", "k", "l", "ml", "ul", "ha", "m2", "m3", "pa", "kpa", "hpa", "bar", "j", "kj", "mj", "w", "kw", "v", "hz", "ppm", "ppb", "mol", "mmol", "umol"}


def unit_parts(text: str) -> list[str]:
    folded = T.py_strip_accents(text.lower())
    return [UNIT_ALIASES.get(p, p) for p in re.split(r"[\s/·*()\[\]^.,_-]+|(?<=[a-z])(?=per\b)", folded) if p]


def compare_units(a: str | None, b: str | None) -> str:
    """agree, conflict or unknown: a shared part or beginning agrees, known parts without one conflict."""
    x, y = unit_parts(a or ""), unit_parts(b or "")
    if not x or not y:
        return "unknown"
    if any(p.startswith(q) or q.startswith(p) for p in x for q in y):
        return "agree"
    return "conflict" if set(x) & UNIT_WORDS and set(y) & UNIT_WORDS else "unknown"


def name_unit(column: str) -> str | None:
    """A unit written into a column name: in closing brackets, as % at the end, or as the last of several words."""
    if m := re.search(r"[(\[]([^()\[\]]{1,20})[)\]]\s*$", column):
        return m[1].strip()
    if column.strip().endswith("%"):
        return "%"
    words = T.py_tokenize(column)
    return words[-1] if len(words) >= 2 and UNIT_ALIASES.get(words[-1], words[-1]) in UNIT_WORDS else None


def nudges(column: str, column_pos, definition_pos, description, unit, header_unit, kind, distinct, codes, observed) -> list[float]:
    """What the context says for (positive) or against a pair."""
    out: list[float] = []
    if column_pos is not None and definition_pos and abs(column_pos - definition_pos) <= 1:
        out.append(NUDGES["position"])
    if description:
        own = [t for t in T.py_tokenize(column) if len(t) >= 2 and not t.isdigit() and UNIT_ALIASES.get(t, t) not in UNIT_WORDS]
        words = re.findall(r"[a-z0-9]+", T.py_strip_accents(description.lower()))
        initials = "".join(w[0] for w in words)
        told = [t for t in own if t in words or any(T.py_is_abbreviation(t, w) for w in words) or t.isalpha() and t in initials]
        if own and len(told) == len(own):
            out.append(NUDGES["description_full"])
        elif told and 2 * len(told) >= len(own):
            out.append(NUDGES["description_part"])
    if unit and unit.strip():
        for cue in (name_unit(column), header_unit):
            verdict = compare_units(cue, unit) if cue and cue.strip() else "unknown"
            out += [NUDGES["unit_agrees"]] if verdict == "agree" else [NUDGES["unit_conflicts"]] if verdict == "conflict" else []
        if kind in ("integer", "number"):
            out.append(NUDGES["unit_numeric"])
        elif kind == "string" and (distinct is None or distinct > 0):
            out.append(NUDGES["unit_text"])
    if codes is not None and len(codes):
        labels, seen = {T.py_normalize_name(c) for c in codes if c}, {T.py_normalize_name(v) for v in (observed if observed is not None else ()) if v}
        if labels and seen and labels <= seen:
            out.append(NUDGES["labels_subset"])
        elif kind in ("integer", "number") and (distinct or 0) > Config().categorical_max_distinct:
            out.append(NUDGES["labels_continuous"])
        elif labels and seen and not labels & seen:
            out.append(NUDGES["labels_disjoint"])
    return out


_CONTEXT = {"column_pos": "int", "definition_pos": "int", "description": "string", "unit": "string", "header_unit": "string", "type": "string", "distinct": "long", "label_codes": "array<string>", "observed": "array<string>"}


def _nudged(column: pd.Series, *context: pd.Series) -> pd.DataFrame:
    plain = lambda x: None if x is None or isinstance(x, float) and x != x else x
    rows = []
    for name, *rest in zip(column, *context):
        found = nudges(name, *map(plain, rest)) if name is not None else []
        rows.append((min(MOST_CONTEXT, sum(n for n in found if n > 0)) + max(-MOST_CONTEXT, sum(n for n in found if n < 0)), any(n < 0 for n in found)))
    return pd.DataFrame(rows, columns=["nudge", "contradicted"])


def contextual(scored: DataFrame) -> DataFrame:
    """Adds nudge, contradicted and score. Optional columns: column_pos, definition_pos, description, unit, header_unit,
    type, distinct, label_codes and observed (arrays). Pairs below CONTEXT_FROM get no nudges."""
    have = set(scored.columns)
    close = F.col("base") >= CONTEXT_FROM
    inputs = [F.when(close, F.col("column"))] + [F.when(close, F.col(c).cast(k)) if c in have else F.lit(None).cast(k) for c, k in _CONTEXT.items()]
    out = scored.withColumn("n", F.pandas_udf(_nudged, "nudge double, contradicted boolean")(*inputs)).withColumn("nudge", F.col("n.nudge")).withColumn("contradicted", F.col("n.contradicted")).drop("n")
    ceiling = F.when(F.col("method") == "exact", 1.0).otherwise(INFERRED_CEILING)
    floor = F.when(F.col("method").isin("exact", "case_insensitive"), SAME_NAME_FLOOR).otherwise(0.0)
    return out.withColumn("score", F.round(F.greatest(F.least(F.col("base") + F.col("nudge"), ceiling), floor), 4))


_MATCH = "dataset_id string, column string, column_pos int, name string, definition_pos int, score double, confidence double, method string, status string, alternatives array<string>"
#: Pairs that a column brings to the assignment beside all that reach CONTEXT_FROM, for its alternatives.
CANDIDATES = 12


def _assign(pairs: pd.DataFrame, config: Config) -> pd.DataFrame:
    """Greedy one-to-one assignment of one dataset's columns and definitions, with rivals and alternatives.

    A candidate is free, and so a rival, unless a strictly better pair owns its other side.
    """
    pairs = pairs.sort_values(["score", "column_pos", "definition_pos"], ascending=[False, True, True])
    rows = list(pairs[["column", "column_pos", "name", "definition_pos", "score", "base", "contradicted", "method"]].itertuples(index=False))
    owner: dict[int, float] = {}
    chosen: dict[int, tuple] = {}
    for r in rows:
        if r.score >= config.match_review_threshold and r.column_pos not in chosen and r.definition_pos not in owner:
            chosen[r.column_pos], owner[r.definition_pos] = r, r.score
    by_column: dict[int, list] = {}
    by_definition: dict[int, list] = {}
    for r in rows:
        by_column.setdefault(r.column_pos, []).append(r)
        by_definition.setdefault(r.definition_pos, []).append(r)
    free = lambda r, held: held is None or held <= r.score
    out = []
    dataset = pairs.dataset_id.iloc[0]
    for pos, own in sorted(by_column.items()):
        best = chosen.get(pos)
        if best is None:
            out.append((dataset, own[0].column, pos, None, None, None, 0.0, None, "unmatched", [r.name for r in own if r.score > 0][:3]))
            continue
        others = [r for r in own if r is not best and r.score > 0 and free(r, owner.get(r.definition_pos))]
        claims = [r for r in by_definition[best.definition_pos] if r is not best and free(r, chosen[r.column_pos].score if r.column_pos in chosen else None)]
        rival = max((r.score for r in [*others, *claims]), default=0.0)
        confidence, margin = best.score, best.score - rival
        ambiguous = rival > 0 and round(margin, 9) < config.ambiguity_margin
        if not ambiguous and round(margin, 9) >= UNIQUE_MARGIN and not best.contradicted and best.base >= config.match_accept_threshold and confidence < INFERRED_CEILING:
            confidence = min(INFERRED_CEILING, confidence + UNIQUE_BOOST)
        status = "ambiguous" if ambiguous else "matched" if confidence >= config.match_accept_threshold else "low_confidence"
        out.append((dataset, best.column, pos, best.name, best.definition_pos, best.score, round(confidence, 4), best.method, status, [r.name for r in others[:2]]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _MATCH.split(", ")]).astype({"definition_pos": "Int32"})


def assign(scored: DataFrame, config: Config = Config()) -> DataFrame:
    """One-to-one matches by dataset. Pairs that can matter go to one task: those near enough to match or rival, and each

    column's CANDIDATES best for its alternatives, so a task holds a few pairs for each column.
    """
    ship(scored.sparkSession)

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        return _assign(pairs, config)

    place = F.row_number().over(Window.partitionBy("dataset_id", "column_pos").orderBy(F.desc("score"), "definition_pos"))
    near = scored.withColumn("place", place).filter((F.col("place") <= CANDIDATES) | (F.col("score") >= CONTEXT_FROM)).drop("place")
    return near.groupBy("dataset_id").applyInPandas(run, _MATCH)


def match(columns: DataFrame, definitions: DataFrame, aliases: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """columns (dataset_id, column, column_pos, ...) to definitions (dataset_id, name, definition_pos, ...): an equi-join on the dataset."""
    pairs = keyed(columns, "column", "_a_").join(keyed(definitions, "name", "_b_"), "dataset_id")
    return assign(contextual(ladder(pairs, aliases=aliases)), config)


def unmatched_definitions(definitions: DataFrame, matches: DataFrame) -> DataFrame:
    return definitions.join(matches.filter("name is not null").select("dataset_id", "name"), ["dataset_id", "name"], "left_anti")


def triage(leftovers: DataFrame, columns: DataFrame) -> DataFrame:
    """What an unmatched definition is: intentionally absent, a column of another dataset, or a phantom."""
    elsewhere = columns.select(F.col("dataset_id").alias("other"), T.normalize_name(F.col("column")).alias("norm")).distinct()
    found = leftovers.withColumn("norm", T.normalize_name(F.col("name"))).join(elsewhere, "norm", "left").withColumn("hit", F.col("other").isNotNull() & (F.col("other") != F.col("dataset_id")))
    grouped = found.groupBy("dataset_id", "name").agg(F.max("hit").alias("hit"), F.max("absent").alias("absent"))
    code = F.when(F.col("absent"), "DOCUMENTED_VARIABLE_INTENTIONALLY_ABSENT").when(F.col("hit"), "DOCUMENTED_VARIABLE_IN_OTHER_FILE").otherwise("DOCUMENTED_VARIABLE_NOT_IN_DATA")
    return grouped.select("dataset_id", "name", code.alias("code"))


def out_of_scope(unmatched: DataFrame, definitions: DataFrame) -> DataFrame:
    """For a column without a match the best same-name definition of another dataset, 0.05 less if only the normalized names agree."""
    named = definitions.select(F.col("dataset_id").alias("bound_to"), "name", F.col("name").alias("form"), T.normalize_name(F.col("name")).alias("norm")).filter("bound_to is not null and norm <> ''")

    def first_two(rows, *key):
        """The first two datasets of each key with their first name: one of them is not the column's own."""
        each = rows.groupBy(*key, "bound_to").agg(F.min("name").alias("name"))
        return each.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("bound_to"))).filter("r <= 2").drop("r")

    # The two of a wider key are among the twos of its narrower ones.
    exact = first_two(named, "norm", "form")
    lower = first_two(exact.withColumn("form", F.lower("form")), "norm", "form")
    loose = first_two(lower, "norm")
    forms = unmatched.select("column").distinct().withColumn("norm", T.normalize_name(F.col("column")))
    asked = forms.withColumn("form", F.col("column"))
    met = asked.join(exact, ["norm", "form"]).unionByName(asked.withColumn("form", F.lower("form")).join(lower, ["norm", "form"])).drop("form").unionByName(forms.join(loose, "norm"))
    score = F.when(F.col("column") == F.col("name"), EXACT).when(F.lower("column") == F.lower("name"), CASE).otherwise(NORMALIZED - 0.05)
    best = met.withColumn("score", F.round(score, 4)).groupBy("column").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("below"), "bound_to", "name", "score"))).alias("best"))
    own = unmatched.select("dataset_id", "column").distinct().join(best, "column")
    taken = own.withColumn("b", F.get(F.filter("best", lambda x: x["bound_to"] != F.col("dataset_id")), F.lit(0))).filter("b is not null")
    return taken.select("dataset_id", "column", "b.name", "b.bound_to", "b.score")


def same_name_elsewhere(columns: DataFrame) -> DataFrame:
    """(dataset_id, column, norm, others): each column with the number of other datasets that have its name.

    Which datasets share a name is one class row per name (name_owners), never a row per pair.
    """
    named = columns.select("dataset_id", "column", T.normalize_name(F.col("column")).alias("norm")).distinct()
    owners = named.groupBy("norm").agg(F.count_distinct("dataset_id").alias("n")).filter("n > 1")
    return named.join(owners, "norm").select("dataset_id", "column", "norm", (F.col("n") - 1).alias("others"))


def name_owners(columns: DataFrame) -> DataFrame:
    """(norm, dataset_id): the datasets of every name that more than one has."""
    named = columns.select(T.normalize_name(F.col("column")).alias("norm"), "dataset_id").distinct()
    return named.join(named.groupBy("norm").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("norm"), "norm")


def decision(score: Column, config: Config = Config()) -> Column:
    return F.when(score >= config.match_accept_threshold, "accept").when(score >= config.match_review_threshold, "review").otherwise("unmatched")


def claimed(matches: DataFrame) -> DataFrame:
    """(dataset_id, name, n): how many columns claim each definition."""
    return matches.filter("name is not null").groupBy("dataset_id", "name").agg(F.count(F.lit(1)).alias("n"))


def set_relation(codes: Column, seen: Column) -> tuple[Column, Column]:
    """Whether all codes are among the values seen, and whether none is."""
    return (F.size(F.array_except(codes, seen)) == 0).alias("subset"), (~F.arrays_overlap(codes, seen)).alias("disjoint")
