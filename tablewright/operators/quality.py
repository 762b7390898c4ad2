"""Column-level data quality profile from maintained value-count tables (problem 6).

The state of a column is a value-count table: one row per distinct trimmed value with the number of cells that
hold it. A load replaces the content of its table, so it enters the state as signed deltas: what it brings of a value
(``arrived``) less what the load before it held (``left``). The deltas are kept in a persistent table, with what each
value is under the rules of its load; maintain() adds to it, and every profile, check and entropy is derived from this
table, never from cells, and is exact: the state after a load is the sum of all deltas up to it, which is what arrived
with it.

Plan. Cells are exchanged once by (dataset_id, pos); dropping repeated deliveries, counting values, judging them and
forming the deltas then run inside that partitioning, and the table is written from there. Columns with more than HOT_ROWS
cells, the HOT_GROUPS largest at most (any further one holds less than a HOT_GROUPS-th of all cells), would make one task
too long: they take the same steps with natural exchanges on the full keys, pre-aggregated before each. Profiles are
one pass over the table with partial sums.

Edge cases (all tested): a null or blank cell is missing; a null ``missing_values`` is an empty list; a null or
unknown ``var_type`` is a string without pattern; a row delivered twice counts once; a column without a variable row
is not profiled; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
HOT_GROUPS = 10_000
KNOWN_PATTERNS = 16
COLUMN = ["dataset_id", "pos"]

#: The words that read as a boolean, in any case.
BOOLEAN_WORDS = ["true", "t", "yes", "y", "false", "f", "no", "n"]
INTEGER = r"\A[+-]?[0-9]+\z"
NUMBER = r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def trimmed_cells(cells: DataFrame) -> DataFrame:
    """The key of each cell and its value without surrounding spaces; null reads as empty."""
    return cells.select(
        F.col("dataset_id").cast("long").alias("dataset_id"),
        F.col("pos").cast("int").alias("pos"),
        F.col("load_no").cast("int").alias("load_no"),
        F.col("row_no").cast("long").alias("row_no"),
        F.coalesce(F.trim("raw"), F.lit("")).alias("value"),
    )


def value_counts(cells: DataFrame) -> DataFrame:
    """(dataset_id, pos, load_no, value, n): each delivered cell once."""
    keys = ["dataset_id", "pos", "load_no"]
    return cells.dropDuplicates([*keys, "row_no", "value"]).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def signed_deltas(counts: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(dataset_id, pos, load_no, value, arrived, left): what a load adds to and takes from the maintained table.

    ``arrived - left`` is the signed delta; as a load replaces its predecessor, ``left`` is the count that the
    state held before the load and ``arrived`` the count it holds after it. Numeric columns in ``carried`` come along
    for both sides, those of the load before with the suffix 0.
    """
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("load_no").alias("at"), F.col("n").alias("arrived"), none.alias("left"), *[x for c in carried for x in (F.col(c).alias(c), _null_like(counts, c).alias(f"{c}0"))]),
        F.struct((F.col("load_no") + 1).alias("at"), none.alias("arrived"), F.col("n").alias("left"), *[x for c in carried for x in (_null_like(counts, c).alias(c), F.col(c).alias(f"{c}0"))]),
    )
    kept = [F.max(x).alias(x) for c in carried for x in (c, f"{c}0")]
    return (
        counts.select(*COLUMN, "value", F.inline(sides))
        .groupBy(*COLUMN, "at", "value")
        .agg(F.sum("arrived").alias("arrived"), F.sum("left").alias("left"), *kept)
        .withColumnRenamed("at", "load_no")
    )


def _null_like(rows: DataFrame, column: str) -> Column:
    return F.lit(None).cast(rows.schema[column].dataType)


def append_deltas(deltas: DataFrame, path: str) -> None:
    """Append a load's signed deltas to the persistent table at path (partitioned by load)."""
    changed = deltas.withColumn("delta", F.col("arrived") - F.col("left")).filter("delta <> 0")
    changed.select(*COLUMN, "value", "delta", "load_no").write.mode("append").partitionBy("load_no").parquet(path)


def state_after(spark: SparkSession, path: str, load_no: int) -> DataFrame:
    """The maintained value counts after a load: the sum of all deltas up to it."""
    return (
        spark.read.parquet(path)
        .filter(F.col("load_no") <= load_no)
        .groupBy(*COLUMN, "value")
        .agg(F.sum("delta").alias("n"))
        .filter("n <> 0")
    )


def variable_rules(variables: DataFrame) -> DataFrame:
    """One row per column: a map from load to the rules and recorded statistics in force."""
    kind = F.coalesce(F.lower("var_type"), F.lit("string"))
    form = F.coalesce("var_format", F.lit("default"))
    spread = F.replace(F.replace(F.replace(form, F.lit("%Y"), F.lit("YYYY")), F.lit("%m"), F.lit("MM")), F.lit("%d"), F.lit("DD"))
    shape = F.replace(F.replace(F.replace(spread, F.lit("YYYY"), F.lit("0000")), F.lit("MM"), F.lit("00")), F.lit("DD"), F.lit("00"))
    rule = F.struct(
        F.when(kind.isin("integer", "number", "boolean", "date"), kind).otherwise("string").alias("kind"),
        F.when(kind == "date", shape)
        .when(kind.isin("integer", "number", "boolean") | (form == "default"), F.lit(None))
        .otherwise(F.concat(F.lit(r"\A(?:"), form, F.lit(r")\z")))
        .alias("pattern"),
        F.instr(spread, "YYYY").alias("iy"),
        F.instr(spread, "MM").alias("im"),
        F.instr(spread, "DD").alias("id"),
        F.coalesce("missing_values", F.array().cast("array<string>")).alias("tokens"),
        (F.coalesce("var_role", F.lit("")) == "identifier").alias("identifier"),
        F.col("stat_missing").cast("long").alias("stat_missing"),
        F.col("stat_distinct").cast("long").alias("stat_distinct"),
        F.trim("stat_min").alias("stat_min"),
        F.trim("stat_max").alias("stat_max"),
    )
    once = variables.select(F.col("dataset_id").cast("long"), F.col("pos").cast("int"), F.col("load_no").cast("int"), "variable_id", rule.alias("rule"))
    once = once.filter("load_no is not null").dropDuplicates([*COLUMN, "load_no"])
    return once.groupBy(*COLUMN).agg(F.map_from_entries(F.collect_list(F.struct("load_no", "rule"))).alias("rules"))


def _ordinal(value: Column, rule: Column) -> Column:
    """The value as a number if it fits: numbers as they are, real dates as yyyymmdd; else null."""
    year, month, day = (F.substring(value, rule[at], F.lit(size)) for at, size in (("iy", 4), ("im", 2), ("id", 2)))
    real = (F.translate(value, "123456789", "000000000") == rule["pattern"]) & F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date").isNotNull()
    number = F.when(rule["kind"] == "date", F.when(real, F.concat(year, month, day))).otherwise(
        F.when(F.when(rule["kind"] == "integer", value.rlike(INTEGER)).when(rule["kind"] == "number", value.rlike(NUMBER)), value)
    )
    return number.try_cast("double")


def frequent_patterns(variables: DataFrame) -> list[str]:
    """The most used patterns, at most KNOWN_PATTERNS: they are compiled once instead of whenever the column changes.

    Others take the general path with the same result.
    """
    used = variables.filter("var_format is not null and var_format <> 'default' and coalesce(lower(var_type), 'string') not in ('integer', 'number', 'boolean', 'date')")
    top = used.groupBy("var_format").count().orderBy(F.desc("count"), "var_format").limit(KNOWN_PATTERNS).collect()
    return [rf"\A(?:{r[0]})\z" for r in top]


def _matches(value: Column, pattern: Column, known: list[str]) -> Column:
    out = F.rlike(value, pattern)
    for text in reversed(known):
        out = F.when(pattern == F.lit(text), value.rlike(text)).otherwise(out)
    return out


def _fits(value: Column, rule: Column, ordinal: Column, known: list[str]) -> Column:
    return (
        F.when(rule["kind"].isin("integer", "number", "date"), ordinal.isNotNull())
        .when(rule["kind"] == "boolean", F.lower(value).isin(BOOLEAN_WORDS))
        .when(rule["pattern"].isNull(), F.lit(True))
        .otherwise(_matches(value, rule["pattern"], known))
    )


def _lacks(value: Column, rule: Column) -> Column:
    return (value == "") | F.array_contains(rule["tokens"], value)


#: What a value is under the rules of its load.
MISSING, MISFIT, FITS = 0, 1, 2
JUDGED = ("state", "shares", "x")


def judged_counts(counts: DataFrame, rules: DataFrame, known: list[str], hint: str = "shuffle_hash") -> DataFrame:
    """The value counts of loads that have a rule, with what each value is and its ordinal; one test per value and load."""
    now = F.col("now")
    rows = counts.join(rules.hint(hint), COLUMN).select(*COLUMN, "load_no", "value", "n", F.col("rules")[F.col("load_no")].alias("now"))
    rows = rows.filter(now.isNotNull()).withColumn("x", _ordinal(F.col("value"), now))
    fit = _fits(F.col("value"), now, F.col("x"), known)
    state = F.when(_lacks(F.col("value"), now), MISSING).when(fit, FITS).otherwise(MISFIT)
    shares = (now["kind"] == "boolean") | ((now["kind"] == "string") & now["pattern"].isNull())
    rows = rows.select(*COLUMN, "load_no", "value", "n", state.alias("state"), shares.cast("int").alias("shares"), "x")
    return rows.withColumn("x", F.when(F.col("state") == FITS, F.col("x")))


def profile(deltas: DataFrame) -> DataFrame:
    """The exact profile of every (column, load), next to that of the load before, from judged signed deltas."""
    n, left = F.col("arrived"), F.col("left")
    rows = deltas.withColumn("g", F.when(F.col("state") == FITS, n).otherwise(0)).withColumn("g0", F.when(F.col("state0") == FITS, left).otherwise(0))
    wide = "decimal(18,0)"
    pair = lambda a, b: F.max(F.when((F.col("shares") == 1) | (F.col("shares0") == 1), F.col(a).cast(wide) * F.lit(10**18).cast("decimal(19,0)") + F.col(b).cast(wide)))
    return rows.groupBy(*COLUMN, "load_no").agg(
        F.sum("arrived").alias("cells"),
        F.sum(F.when(F.col("state") == MISSING, n).otherwise(0)).alias("missing"),
        F.sum(F.when((F.col("state") > MISSING) & (n > 0), 1).otherwise(0)).alias("distinct"),
        F.sum(F.when(F.col("state") == MISFIT, n).otherwise(0)).alias("misfits"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.sum("g").alias("fitting"),
        F.sum(F.col("g") * F.col("x")).alias("total"),
        F.sum("left").alias("cells0"),
        F.sum(F.when(F.col("state0") == MISSING, left).otherwise(0)).alias("missing0"),
        F.sum("g0").alias("fitting0"),
        F.sum(F.col("g0") * F.col("x0")).alias("total0"),
        F.sum(F.col("g0") * F.col("x0") * F.col("x0")).alias("squares0"),
        pair("g", "g0").alias("mode"),
        pair("g0", "g").alias("mode0"),
        F.sum(F.when((n > 0) & (F.col("state") > MISSING), n * F.log2(n)).otherwise(0.0)).alias("nlogn"),
    )


def hot_columns(cells: DataFrame, least: int = HOT_ROWS, groups: int = HOT_GROUPS) -> list[tuple[int, int]]:
    """The largest columns of more than ``least`` cells, ``groups`` at most; one pass over two columns."""
    sizes = cells.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    return [(r[0], r[1]) for r in sizes.orderBy(F.desc("n"), *COLUMN).limit(groups).collect()]


def maintain(table_cells: DataFrame, variables: DataFrame, path: str, least: int = HOT_ROWS) -> None:
    """Appends the signed deltas of the loads in the cells to the persistent table at path, hot columns apart."""
    cells, rules, known = trimmed_cells(table_cells), variable_rules(variables), frequent_patterns(variables)
    hot = hot_columns(table_cells.select(F.col("dataset_id").cast("long"), F.col("pos").cast("int")), least)

    def add(part: DataFrame, own: DataFrame, hint: str) -> None:
        deltas = signed_deltas(judged_counts(value_counts(part), own, known, hint), JUDGED)
        deltas.write.mode("append").option("compression", "zstd").parquet(path)

    if not hot:
        add(cells.repartition(*COLUMN), rules, "shuffle_hash")
        return
    few = F.broadcast(table_cells.sparkSession.createDataFrame(hot, "dataset_id long, pos int"))
    add(cells.join(few, COLUMN, "left_anti").repartition(*COLUMN), rules, "shuffle_hash")
    add(cells.join(few, COLUMN, "left_semi"), rules.join(few, COLUMN, "left_semi"), "broadcast")


def maintained_profile(table_cells: DataFrame, variables: DataFrame, path: str, least: int = HOT_ROWS) -> DataFrame:
    """profile() of all loads, from the persistent table."""
    maintain(table_cells, variables, path, least)
    return profile(table_cells.sparkSession.read.parquet(path))


def check(profiled: DataFrame, rules: DataFrame) -> DataFrame:
    """(dataset_id, pos, load_no, check_name): the recorded statistics that are wrong and the changes that are large."""
    rule = F.col("rule")
    p = profiled.join(rules.hint("shuffle_hash"), COLUMN).withColumn("rule", F.col("rules")[F.col("load_no")]).drop("rules")
    bound = lambda c: _ordinal(rule[c], rule)
    ordered = rule["kind"].isin("integer", "number", "date")
    off = lambda c, x: ordered & rule[c].isNotNull() & ~F.coalesce(bound(c) == F.col(x), F.lit(False))
    mean, mean0 = F.col("total") / F.col("fitting"), F.col("total0") / F.col("fitting0")
    variance0 = (F.col("squares0") - F.col("total0") * mean0) / (F.col("fitting0") - 1)
    many = (F.col("fitting") >= 10) & (F.col("fitting0") >= 10)
    sd0 = F.sqrt(F.greatest(variance0, F.lit(0.0)))
    far = rule["kind"].isin("integer", "number") & many & (sd0 > 0) & (F.abs(mean - mean0) > 2 * sd0)
    first = lambda c: F.floor(F.col(c) / F.lit(10**18).cast("decimal(19,0)")).cast("double")
    second = lambda c: (F.col(c) % F.lit(10**18).cast("decimal(19,0)")).cast("double")
    moved = lambda a, b: F.abs(a / F.col("fitting") - b / F.col("fitting0")) > 0.5
    swung = F.col("mode").isNotNull() & many & (moved(first("mode"), second("mode")) | moved(second("mode0"), first("mode0")))
    had = F.col("cells0") > 0
    gap = had & (F.abs(F.col("missing") / F.col("cells") - F.col("missing0") / F.col("cells0")) > 0.25)
    tests = {
        "missing": rule["stat_missing"].isNotNull() & (rule["stat_missing"] != F.col("missing")),
        "distinct": rule["stat_distinct"].isNotNull() & (rule["stat_distinct"] != F.col("distinct")),
        "min": off("stat_min", "low"),
        "max": off("stat_max", "high"),
        "pattern": F.col("misfits") > 0,
        "shift": ~rule["identifier"] & had & (gap | F.coalesce(far, F.lit(False)) | F.coalesce(swung, F.lit(False))),
    }
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return p.filter(F.col("cells") > 0).select(*COLUMN, "load_no", F.explode(names).alias("check_name"))


def quality_checks(table_cells: DataFrame, variables: DataFrame, path: str, least: int = HOT_ROWS) -> DataFrame:
    return check(maintained_profile(table_cells, variables, path, least), variable_rules(variables))


def full_profile(table_cells: DataFrame, variables: DataFrame, path: str, least: int = HOT_ROWS) -> DataFrame:
    """The metrics of every column after every load, from the persistent table; entropy in bits over the values that are not missing."""
    p = maintained_profile(table_cells, variables, path, least).filter("cells > 0")
    present = F.col("cells") - F.col("missing")
    return p.select(
        *COLUMN,
        F.col("load_no").cast("int").alias("load_no"),
        F.col("cells").alias("n_cells"),
        F.col("missing").alias("n_missing"),
        F.col("distinct").alias("n_distinct"),
        F.col("misfits").alias("n_misfits"),
        F.round(F.when(present > 0, F.log2(present) - F.col("nlogn") / present), 4).alias("entropy_bits"),
    )
