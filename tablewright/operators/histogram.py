"""The value histogram of tables and everything that is derived from it: types, profiles, sentinels, shared values.

``hist(dataset_id, pos, value, n)`` holds each distinct trimmed value of each column with its number of cells; it takes
one shuffle, pre-aggregated, and all column analysis then runs over distinct values with weights instead of cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.config import DATE_FORMATS, DATETIME_FORMATS, SENTINELS, Config
from tablewright.operators.quality import BOOLEAN_WORDS
from tablewright.session import shared_dir

KEY = ["dataset_id", "pos"]
NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"
LEADING_ZERO = r"^0[0-9]+$"


def as_text(column: Column, kind: str) -> Column:
    """Values as text with one spelling in all engines: decimals and doubles with four places."""
    if kind.startswith(("double", "float", "decimal")):
        return column.cast("decimal(24,4)").cast("string")
    if kind.startswith("timestamp"):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    return column.cast("string")


def cells_of(df: DataFrame, dataset_id: str, columns: list[str] | None = None) -> DataFrame:
    """(dataset_id, pos, name, value) of every cell, null or blank cells with a null value."""
    names = columns or df.columns
    kinds = dict(df.dtypes)
    pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name"), as_text(F.col(f"`{c}`"), kinds[c]).alias("raw")) for i, c in enumerate(names, 1)])
    rows = df.select(F.inline(pairs))
    trimmed = F.trim("raw")
    return rows.select(F.lit(dataset_id).alias("dataset_id"), "pos", "name", F.when(trimmed != "", trimmed).alias("value"))


def histogram(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEY, "name", "value").agg(F.count(F.lit(1)).alias("n"))


#: Columns that one pass over a table counts.
COLUMNS_AT_ONCE = 2


def histogram_of(df: DataFrame, dataset_id: str, columns: list[str] | None = None, at_once: int = COLUMNS_AT_ONCE) -> DataFrame:
    """The histogram of a columnar table.

    Columns are counted in groups of ``at_once`` of one class (whole numbers, days and times as 64-bit numbers, floating
    numbers, anything else as text), so a wide table is a few passes that read different columns each; only distinct values
    are turned into text.
    """
    kinds = dict(df.dtypes)
    classes: dict[str, list[tuple[int, str]]] = {"bigint": [], "double": [], "string": []}
    for pos, name in enumerate(columns or df.columns, 1):
        kind = kinds[name]
        whole = kind in ("tinyint", "smallint", "int", "bigint", "date") or kind.startswith("timestamp")
        classes["bigint" if whole else "double" if kind in ("double", "float") else "string"].append((pos, name))
    parts = []
    for kind, members in classes.items():
        for k in range(0, len(members), at_once):
            some = members[k : k + at_once]
            keys = F.array(*[F.struct(F.lit(pos).alias("pos"), _counted_as(F.col(f"`{name}`"), kinds[name]).cast(kind).alias("key")) for pos, name in some])
            counted = df.select(F.inline(keys)).groupBy("pos", "key").agg(F.count(F.lit(1)).alias("n"))
            key, text = F.col("key"), F.col("key").cast("string")
            times, days = ([pos for pos, name in some if kinds[name].startswith(t)] for t in ("timestamp", "date"))
            if kind == "double":
                text = key.try_cast("decimal(24,4)").cast("string")
            if times:
                text = F.when(F.col("pos").isin(times), F.date_format(F.timestamp_micros(key), "yyyy-MM-dd HH:mm:ss")).otherwise(text)
            if days:
                text = F.when(F.col("pos").isin(days), F.date_from_unix_date(key.cast("int")).cast("string")).otherwise(text)
            spelled = counted.select("pos", text.alias("value"), "n")
            # Numbers that differ beyond four places and times that differ below a second have one text.
            parts.append(spelled.groupBy("pos", "value").agg(F.sum("n").alias("n")) if kind == "double" or times else spelled)
    names = F.create_map(*[x for pos, name in enumerate(columns or df.columns, 1) for x in (F.lit(pos), F.lit(name))])
    return reduce(DataFrame.unionByName, parts).select(F.lit(dataset_id).alias("dataset_id"), "pos", names[F.col("pos")].alias("name"), "value", "n")


def _counted_as(own: Column, kind: str) -> Column:
    if kind.startswith("timestamp"):
        return F.unix_micros(own.cast("timestamp"))
    if kind == "date":
        return F.unix_date(own)
    return own.cast("decimal(24,4)").cast("string") if kind.startswith("decimal") else F.nullif(F.trim(own), F.lit("")) if kind == "string" else own


def present(hist: DataFrame, config: Config = Config()) -> DataFrame:
    """The values that are not missing."""
    return hist.filter(F.col("value").isNotNull() & ~F.col("value").isin(*[t for t in config.missing_value_tokens if t]))


def missing_census(hist: DataFrame, config: Config = Config()) -> DataFrame:
    """Missing cells and the missing tokens that occur, in order."""
    is_token = F.col("value").isin(*[t for t in config.missing_value_tokens if t])
    return hist.groupBy(*KEY, "name").agg(
        F.sum(F.when(F.col("value").isNull() | is_token, F.col("n")).otherwise(0)).alias("missing"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_token, F.col("value")))), "|").alias("tokens"),
    )


def is_number(value: Column) -> Column:
    return value.rlike(NUMERIC) & value.try_cast("double").isNotNull()


def is_integer(value: Column) -> Column:
    return value.rlike(INTEGER) & value.try_cast("bigint").isNotNull()


def census(hist: DataFrame, config: Config = Config()) -> DataFrame:
    """Cells, missing cells and distinct present values of every column, in one pass."""
    there = F.col("value").isNotNull() & ~F.coalesce(F.col("value").isin(*[t for t in config.missing_value_tokens if t]), F.lit(False))
    return hist.groupBy(*KEY, "name").agg(
        F.sum("n").alias("cells"), F.sum(F.when(there, 0).otherwise(F.col("n"))).alias("missing"), F.count_if(there).alias("distinct_values"),
    )


def infer_types(hist: DataFrame, config: Config = Config()) -> DataFrame:
    """(dataset_id, pos, name, type, format, role, total, distinct): one type per column, by tests all values pass.

    One pass over the distinct values; missing ones take part in no test. The costly date tests only see values of the
    shape of a date.
    """
    v = F.when(~F.col("value").isin(*[t for t in config.missing_value_tokens if t]), F.col("value"))
    every = lambda test: F.coalesce(F.every(F.when(F.col("v").isNotNull(), F.coalesce(test, F.lit(False)))), F.lit(False))
    v_ = F.col("v")
    day, moment = v_.rlike(r"^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}$"), v_.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9]{1,2}:[0-9]")
    dates = {f: every(F.when(day, F.try_to_timestamp(v_, F.lit(p)).isNotNull())) for f, p in DATE_FORMATS.items()}
    times = {f: every(F.when(moment, F.try_to_timestamp(v_, F.lit(p)).isNotNull())) for f, p in DATETIME_FORMATS.items()}
    tests = {"boolean": every(F.lower(v_).isin(BOOLEAN_WORDS)), "integer": every(is_integer(v_)), "number": every(is_number(v_)), "zero": F.coalesce(F.bool_or(v_.rlike(LEADING_ZERO)), F.lit(False))}
    named = [t.alias(k) for k, t in tests.items()] + [t.alias(f"d{i}") for i, t in enumerate(dates.values())] + [t.alias(f"t{i}") for i, t in enumerate(times.values())]
    a = hist.withColumn("v", v).groupBy(*KEY, "name").agg(F.sum(F.when(v_.isNotNull(), F.col("n")).otherwise(0)).alias("total"), F.count("v").alias("distinct"), *named)
    fitting = sum((F.col(f"d{i}").cast("int") for i in range(len(dates))), F.lit(0))
    first_time = F.coalesce(*[F.when(F.col(f"t{i}"), F.lit(f)) for i, f in enumerate(times)])
    first_date = F.coalesce(*[F.when(F.col(f"d{i}"), F.lit(f)) for i, f in enumerate(dates)])
    kind = (
        F.when(F.col("boolean"), "boolean")
        .when(F.col("integer") & ~F.col("zero"), "integer")
        .when(F.col("number") & ~F.col("zero"), "number")
        .when(first_time.isNotNull(), "datetime")
        .when(fitting == 1, "date")
        .otherwise("string")
    )
    a = a.withColumn("type", kind).withColumn("format", F.when(F.col("type") == "datetime", first_time).when(F.col("type") == "date", first_date))
    a = a.withColumn("ambiguous_date", (F.col("type") == "string") & (fitting > 1))
    distinct, total = F.col("distinct"), F.col("total")
    text_role = F.when((distinct <= config.categorical_max_distinct) & (distinct < total), "categorical").when(distinct == total, "identifier").otherwise("text")
    role = (
        F.when(F.col("type") == "boolean", "categorical")
        .when(F.col("type") == "integer", F.when(distinct == total, "identifier").otherwise("measure"))
        .when(F.col("type") == "number", "measure")
        .when(F.col("type").isin("date", "datetime"), "temporal")
        .otherwise(text_role)
    )
    return a.select(*KEY, "name", "type", "format", F.when(total == 0, "text").otherwise(role).alias("role"), "total", "distinct", "ambiguous_date")


DATE_SHAPE = r"\A[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}\z"


def date_fits(values: DataFrame, keys: list[str], formats: dict[str, str]) -> DataFrame:
    """For each format (strptime name: output column) whether all values (value) of a key fit it."""
    fits = [F.every(F.try_to_timestamp("value", F.lit(DATE_FORMATS[f])).isNotNull()).alias(name) for f, name in formats.items()]
    return values.groupBy(*keys).agg(*fits)


def blocking_examples(hist: DataFrame, config: Config = Config(), most: int = 5) -> DataFrame:
    """Up to five values per column that keep it from being numeric."""
    stubborn = present(hist, config).filter(~is_number(F.col("value")))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("value"))
    return stubborn.withColumn("r", rank).filter(F.col("r") <= most).groupBy(*KEY, "name").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("examples"))


#: Columns whose means may be sent to every task.
MOST_COLUMNS = 100_000


def kept(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder, for more than one pass over them."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()


def numeric_stats(hist: DataFrame, config: Config = Config()) -> DataFrame:
    """Count, min, max, mean and sample deviation (rounded to 6) of the numeric values, weighted by their counts.

    The values are kept once; deviations are summed from the means, which no cancellation spoils.
    """
    numbers = kept(present(hist, config).filter(is_number(F.col("value"))).select(*KEY, "name", F.col("value").cast("double").alias("x"), "n"))
    means = numbers.groupBy(*KEY, "name").agg(F.sum("n").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m"))
    means = kept(means)
    centre = means.select(*KEY, "m")
    centre = F.broadcast(centre) if means.count() <= MOST_COLUMNS else centre
    spread = numbers.join(centre, KEY).groupBy(*KEY).agg(F.sum(F.col("n") * (F.col("x") - F.col("m")) ** 2).alias("squares"))
    sd = F.when(F.col("count") > 1, F.sqrt(F.col("squares") / (F.col("count") - 1)))
    return means.join(spread, KEY).select(*KEY, "name", "count", "min", "max", F.round("m", 6).alias("mean"), F.round(sd, 6).alias("std"))


def top_values(hist: DataFrame, config: Config = Config(), k: int = 10) -> DataFrame:
    """The k most frequent values, ties in the order of the values."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("n"), "value")).cast("long")
    return present(hist, config).withColumn("rank", rank).filter(F.col("rank") <= k)


#: Distinct values of a column beyond which its quartiles are found by ranges instead of in one task.
MOST_VALUES = 2_000_000


def quartiles(numbers: DataFrame, keys: list[str], most: int = MOST_VALUES) -> DataFrame:
    """Exact linear quartiles of weighted values (x, n).

    A column of few distinct values is one aggregate. For others the values are put in order over ranges, each range is
    summed, and only the few ranges that hold a quartile are searched, from the sum of those before them.
    """
    numbers = kept(numbers.select(*keys, "x", "n"))
    sizes = numbers.groupBy(*keys).agg(F.count(F.lit(1)).alias("values"))
    large = kept(sizes.filter(F.col("values") > most).select(*keys))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    named = lambda rows: rows.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    few = large.count()
    small = numbers if not few else numbers.join(large.hint("merge"), keys, "left_anti")
    out = named(small.groupBy(*keys).agg(q.alias("q")))
    return out if not few else out.unionByName(_ranged_quartiles(numbers.join(large.hint("merge"), keys, "left_semi"), keys))


def _ranged_quartiles(numbers: DataFrame, keys: list[str]) -> DataFrame:
    # Ranges are cut by key and value; kept() fixes them, so that their numbers mean the same in both passes.
    ranged = kept(numbers.repartitionByRange(*keys, "x").withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "range").agg(F.sum("n").alias("own"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offset = sums.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0))).withColumn("total", F.sum("own").over(Window.partitionBy(*keys)))
    # Rank p * (total - 1), from 0, and its neighbour above.
    spots = offset.select("*", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p")).withColumn("at", F.col("p") * (F.col("total") - 1))
    spots = spots.select("*", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    spots = spots.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("own"))).select(*keys, "range", "before", "p", "at", "rank")
    upto = F.sum("n").over(Window.partitionBy(*keys, "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    near = ranged.join(F.broadcast(spots.select(*keys, "range").distinct()), [*keys, "range"], "left_semi")  # at most six ranges a column
    placed = near.withColumn("upto", upto).join(F.broadcast(spots), [*keys, "range"]).filter((F.col("rank") >= F.col("before") + F.col("upto") - F.col("n")) & (F.col("rank") < F.col("before") + F.col("upto")))
    part = F.when(F.floor("at") == F.ceil("at"), 1.0).when(F.col("rank") == F.floor("at"), F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    met = placed.groupBy(*keys, "p").agg(F.sum(F.col("x") * part).alias("v"))
    pick = lambda p, name: F.max(F.when(F.col("p") == p, F.col("v"))).alias(name)
    return met.groupBy(*keys).agg(pick(0.25, "q1"), pick(0.5, "median"), pick(0.75, "q3"))


def sentinel_report(hist: DataFrame, config: Config = Config()) -> DataFrame:
    """Numbers that often mean missing and lie far from all others of their column."""
    numbers = present(hist, config).filter(is_number(F.col("value"))).withColumn("x", F.col("value").cast("double"))
    sentinel = F.col("x").isin(*SENTINELS)
    others = numbers.filter(~sentinel)
    base = quartiles(others, KEY).join(others.groupBy(*KEY).agg(F.sum("n").alias("others")), KEY)
    found = numbers.filter(sentinel).groupBy(*KEY, "name", "x").agg(F.sum("n").alias("n")).join(base, KEY)
    far = F.abs(F.col("x") - F.col("median")) > config.sentinel_outlier_iqr_factor * F.greatest(F.col("q3") - F.col("q1"), F.lit(1e-9))
    return found.filter((F.col("others") >= config.sentinel_min_other_values) & far).select(*KEY, "name", F.col("x").alias("sentinel"), "n")


def canonical_value(value: Column) -> Column:
    """Numbers by value, everything else by its trimmed text."""
    return F.when(is_number(value), value.cast("double").cast("string")).otherwise(F.trim(value))


def shared_variables(hist: DataFrame, config: Config = Config()) -> DataFrame:
    """Columns of equal name and compatible type in two datasets whose values overlap.

    Values that only one dataset has meet nothing and are left out before the join; each value goes to a pair of columns
    once, in the order of the datasets. A value of many datasets still meets all of them: the overlap of each pair is
    what is asked for.
    """
    norm = F.lower(F.regexp_replace("name", r"[\s_\-.]+", ""))
    hist = kept(hist)
    types = infer_types(hist, config).select(*KEY, F.when(F.col("type").isin("integer", "number"), "numeric").otherwise(F.col("type")).alias("family"))
    own = present(hist, config).join(types, KEY).select("dataset_id", "pos", norm.alias("norm"), "family", canonical_value(F.col("value")).alias("v")).distinct()
    named = types.join(hist.select(*KEY, norm.alias("norm")).distinct(), KEY).groupBy("norm", "family").agg(F.count_distinct("dataset_id").alias("d")).filter("d > 1").select("norm", "family")
    values = kept(own.join(named, ["norm", "family"], "left_semi"))
    sizes = values.groupBy("dataset_id", "pos", "norm", "family").agg(F.count(F.lit(1)).alias("size"))
    owners = values.groupBy("norm", "family", "v").agg(F.count_distinct("dataset_id").alias("d")).filter("d > 1").drop("d")
    met = values.join(owners, ["norm", "family", "v"])
    a = met.select(F.col("dataset_id").alias("a"), F.col("pos").alias("pos_a"), "norm", "family", "v")
    b = met.select(F.col("dataset_id").alias("b"), F.col("pos").alias("pos_b"), "norm", "family", "v")
    common = a.join(b, ["norm", "family", "v"]).filter("a < b").groupBy("a", "b", "pos_a", "pos_b", "norm").agg(F.count(F.lit(1)).alias("common"))
    common = common.join(sizes.select(F.col("dataset_id").alias("a"), F.col("pos").alias("pos_a"), F.col("size").alias("size_a")), ["a", "pos_a"])
    common = common.join(sizes.select(F.col("dataset_id").alias("b"), F.col("pos").alias("pos_b"), F.col("size").alias("size_b")), ["b", "pos_b"])
    ratio = F.col("common") / F.least("size_a", "size_b")
    return common.withColumn("overlap", F.round(ratio, 3)).filter(ratio >= config.min_value_overlap).select("a", "b", "norm", "common", "overlap")


def shared_pairs(shared: DataFrame) -> DataFrame:
    """(a, b, confidence): the mean overlap of the variables that two datasets share."""
    return shared.groupBy("a", "b").agg(F.round(F.avg("overlap"), 3).alias("confidence"))


def distinct_values(hist: DataFrame, config: Config = Config(), most: int = 200) -> DataFrame:
    """(dataset_id, pos, name, seen): the sorted values of columns with at most so many."""
    there = present(hist, config)
    few = there.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") <= most)
    return there.join(few, KEY, "left_semi").groupBy(*KEY, "name").agg(F.array_sort(F.collect_set("value")).alias("seen"))


def without_codes(hist: DataFrame, codes: DataFrame) -> DataFrame:
    """The histogram with each dataset's (or, with pos, column's) stated missing codes as missing: types and profiles follow from it without another scan."""
    on = [c for c in ("dataset_id", "pos") if c in codes.columns]
    stated = codes.select(*on, F.col("code").alias("value"), F.lit(True).alias("coded")).distinct()
    return hist.join(stated, [*on, "value"], "left").withColumn("value", F.when(F.col("coded").isNull(), F.col("value"))).groupBy(*KEY, "name", "value").agg(F.sum("n").alias("n"))


def temporal_bounds(hist: DataFrame, config: Config = Config()) -> DataFrame:
    """(dataset_id, pos, name, first, last): least and greatest day or time of temporal columns, read by their format, as ISO text."""
    hist = kept(hist)
    kinds = infer_types(hist, config).filter("role = 'temporal'").select(*KEY, "type", "format")
    rows = present(hist, config).join(kinds, KEY)
    read = F.coalesce(*[F.when(F.col("format") == f, F.try_to_timestamp("value", F.lit(p))) for f, p in {**DATE_FORMATS, **DATETIME_FORMATS}.items()])
    out = rows.groupBy(*KEY, "name", "type").agg(F.min(read).alias("a"), F.max(read).alias("b"))
    iso = lambda c: F.when(F.col("type") == "date", F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
    return out.select(*KEY, "name", iso("a").alias("first"), iso("b").alias("last"))


def limited(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows for a document, with a flag whether there are more."""
    more = df.limit(most + 1).count() > most
    return df.orderBy(*order).limit(most).withColumn("truncated", F.lit(more))


def typed(df: DataFrame, types: dict[str, str], missing: dict[str, list[str]] | None = None, config: Config = Config()) -> DataFrame:
    """Text columns as typed columns, missing tokens as null; one projection, no shuffle."""
    out = []
    for name in df.columns:
        v = F.trim(F.col(f"`{name}`"))
        tokens = [*config.missing_value_tokens, *(missing or {}).get(name, [])]
        kind = types.get(name, "string")
        if kind == "integer":
            cast = F.when(is_integer(v), v.try_cast("bigint"))
        elif kind == "number":
            cast = F.when(is_number(v), v.try_cast("double"))
        elif kind == "boolean":
            cast = F.when(F.lower(v).isin("true", "t", "yes", "y"), True).when(F.lower(v).isin("false", "f", "no", "n"), False)
        else:
            cast = F.col(f"`{name}`")
        out.append(F.when(~v.isin(*tokens), cast).alias(name))
    return df.select(*out)
