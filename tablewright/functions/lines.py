"""What a line of documentation is: one set of rules, as Spark expressions and as SQL.

A rule is a regular expression that both engines read alike; where a rule needs more, both forms stand side by side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULE = r"^\s*([-=_*]{3,}|-)\s*$"
PIPE_ROW = r"^\s*\|.*\|\s*$"
MARKED_HEADING = r"^\s*#{1,6}\s+\S"
LIST_ITEM = r"^\s*([-*•·]|[0-9]+[.)])\s+\S"
PROMPT = r"<[A-Za-z][^<>]{2,}>"
GAP = r"\t+|\s{2,}"
NUMBERED = r"^[0-9]+[.)]\s*"
LEADING_NUMBER = r"^[0-9]+[.)]?(\t+|\s{2,})"
SCHEME = r"(^|\s)(https?|ftps?|doi)$"
QUOTES = r"[\"“”„«»]"


def cleaned(raw: Column) -> Column:
    """A line without carriage returns, template prompts in angle brackets and trailing blanks."""
    return F.rtrim(F.regexp_replace(F.replace(raw, F.lit("\r"), F.lit("")), PROMPT, ""))


def without_quotes(line: Column) -> Column:
    """A line without a pair of outer quotes, or a quote at one end that has no partner inside."""
    body = F.regexp_replace(F.regexp_replace(line, rf"^\s*{QUOTES}+", ""), rf"{QUOTES}+\s*$", "")
    return F.when(body.rlike(QUOTES), line).otherwise(body)


def words(text: Column) -> Column:
    """Number of words; none in a blank text."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def key_of(line: Column) -> Column:
    """What stands before the first colon, without a list number."""
    return F.regexp_replace(F.trim(F.substring_index(line, ":", 1)), NUMBERED, "")


def value_of(line: Column) -> Column:
    return F.trim(F.substr(line, F.instr(line, ":") + 1))


def is_aligned(line: Column) -> Column:
    """Two or more columns, with tabs or runs of blanks between; a list number is no column."""
    body = F.regexp_replace(F.trim(line), LEADING_NUMBER, "")
    return F.size(F.filter(F.split(body, GAP), lambda x: x != "")) >= 2


def is_key_value(line: Column) -> Column:
    """A label of at most ten words and sixty letters before the first colon; no address, time or table row."""
    key, value = key_of(line), value_of(line)
    return (
        (F.instr(line, ":") > 0) & F.length(key).between(1, 60) & ~F.contains(key, F.lit("//")) & ~F.startswith(value, F.lit("//")) & ~F.lower(key).rlike(SCHEME)
        & ~key.rlike(GAP) & (words(key) <= 10) & ~(key.rlike("[0-9]$") & F.substr(line, F.instr(line, ":") + 1).rlike("^[0-9]"))
    )


def kind(line: Column) -> Column:
    """blank, rule, pipe_row, heading, key_value, list_item or text, by the line alone.

    A heading is marked, in capitals (at most eight words) or ends in a colon (two to six words); with a value after
    its colon, or as a single word before it, it is a key.
    """
    text = F.trim(line)
    colon = F.instr(line, ":") > 0
    open_label = ~colon | ((value_of(line) == "") & (words(key_of(line)) > 1))
    capitals = text.rlike("[A-Z]") & (F.upper(text) == text) & (words(text) <= 8) & ~F.endswith(text, F.lit("."))
    title = F.endswith(text, F.lit(":")) & (words(text) <= 6)
    return (
        F.when(text == "", "blank")
        .when(line.rlike(RULE), "rule")
        .when(line.rlike(PIPE_ROW), "pipe_row")
        .when(line.rlike(MARKED_HEADING), "heading")
        .when(~is_aligned(line) & open_label & (capitals | title), "heading")
        .when(is_key_value(line), "key_value")
        .when(line.rlike(LIST_ITEM), "list_item")
        .otherwise("text")
    )


# The same in SQL, for the queries' twins.


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def words_sql(text: str) -> str:
    return f"(CASE WHEN trim({text}) = '' THEN 0 ELSE len(string_split_regex(trim({text}), '\\s+')) END)"


KEY_SQL = f"regexp_replace(trim(split_part(line, ':', 1)), {_q(NUMBERED)}, '')"
VALUE_SQL = "trim(substr(line, instr(line, ':') + 1))"
ALIGNED_SQL = f"(len(list_filter(string_split_regex(regexp_replace(trim(line), {_q(LEADING_NUMBER)}, ''), {_q(GAP)}), lambda x: x <> '')) >= 2)"
IS_KEY_SQL = (
    f"(instr(line, ':') > 0 AND length({KEY_SQL}) BETWEEN 1 AND 60 AND NOT contains({KEY_SQL}, '//') AND NOT starts_with({VALUE_SQL}, '//') AND NOT regexp_matches(lower({KEY_SQL}), {_q(SCHEME)})"
    f" AND NOT regexp_matches({KEY_SQL}, {_q(GAP)}) AND {words_sql(KEY_SQL)} <= 10 AND NOT (regexp_matches({KEY_SQL}, '[0-9]$') AND regexp_matches(substr(line, instr(line, ':') + 1), '^[0-9]')))"
)
KIND_SQL = (
    f"CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, {_q(RULE)}) THEN 'rule' WHEN regexp_matches(line, {_q(PIPE_ROW)}) THEN 'pipe_row' WHEN regexp_matches(line, {_q(MARKED_HEADING)}) THEN 'heading'"
    f" WHEN NOT {ALIGNED_SQL} AND (instr(line, ':') = 0 OR ({VALUE_SQL} = '' AND {words_sql(KEY_SQL)} > 1)) AND ((regexp_matches(trim(line), '[A-Z]') AND upper(trim(line)) = trim(line) AND {words_sql('line')} <= 8 AND NOT ends_with(trim(line), '.'))"
    f" OR (ends_with(trim(line), ':') AND {words_sql('line')} <= 6)) THEN 'heading' WHEN {IS_KEY_SQL} THEN 'key_value' WHEN regexp_matches(line, {_q(LIST_ITEM)}) THEN 'list_item' ELSE 'text' END"
)
CLEANED_SQL = f"rtrim(regexp_replace(replace(raw, chr(13), ''), {_q(PROMPT)}, '', 'g'))"
#: CTEs: l (file, line_no, line) over all documents; k adds kind by the line, c by its neighbours.
LINES_SQL = f"r AS (SELECT CAST(doc_id AS VARCHAR) AS file, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents), l AS (SELECT file, line_no, {CLEANED_SQL} AS line FROM r)"
KINDS_SQL = f"{LINES_SQL}, k AS (SELECT *, {KIND_SQL} AS kind0 FROM l)"
CLASSES_SQL = (
    f"{KINDS_SQL}, n AS (SELECT *, lag(kind0) OVER w AS before, lead(kind0) OVER w AS after FROM k WINDOW w AS (PARTITION BY file ORDER BY line_no)),"
    f" c AS (SELECT *, CASE WHEN kind0 = 'text' AND {words_sql('line')} <= 8 AND NOT ends_with(trim(line), '.') AND NOT {ALIGNED_SQL} AND (coalesce(before, '') = 'rule' OR coalesce(after, '') = 'rule') THEN 'heading' ELSE kind0 END AS kind FROM n)"
)
