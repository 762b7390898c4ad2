"""Reading level of each document (problem 9).

Words are ranked by frequency within their language over all documents; words of one frequency share a rank, the number
of words at least as frequent. The coverage rank of a document at a share is the smallest rank up to which the vocabulary
covers this share of its words: a document that gets by with common words is easy. The ranks at several SHARES show how
the whole vocabulary of a document is spread. With the complexity of its sentences (words per sentence, letters per
word) they are calibrated against the readers' ratings: the normal equations of a linear model are summed in SQL over
the rated documents and solved for the coefficients, which then estimate every document. ablation() states what each
group of features adds on documents that were not fitted.

Two passes over the texts, each one task per split without shuffling text: the first sends partial word counts, the
second looks ranks up in the SENT_WORDS most frequent words of all languages, which are broadcast. Only documents whose
coverage reaches beyond these send on their rarer words, whose ranks come by a join with the full table; so the bound
only chooses the way, not the result. No task sorts a vocabulary: ranks come from the counts of counts.

Edge cases (tested): null or empty text, or text without letters, has no coverage rank and no estimate; a null or
unknown lang is told by its function words, else ``und``; several ratings of a document are averaged, repeated ones
count once; without enough ratings (fewer than LEAST_RATED) the estimate is null; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tablewright.session import shared_dir, ship

SHARES = (0.3, 0.5, 0.75, 0.9)
SENT_WORDS = 200_000
LEAST_RATED = 20
MOST_COUNTED = 400_000
#: Rows of a table of counts of counts that may be broadcast.
MOST_COUNTS = 500_000

_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")
#: Frequent function words by language.
_FUNCTION_WORDS = {
    "en": "the of and to in is was were with for that from each", "fr": "le la les des et est une dans pour que par sur du", "de": "der die das und ist nicht von mit den ein auf wurde im",
    "es": "el los las una que del con por para se en como fue", "pt": "o os as uma que do da com por para em não foi",
}
_FUNCTION_SETS = {lang: frozenset(words.split()) for lang, words in _FUNCTION_WORDS.items()}


def language(lang: str | None, words: list[str]) -> str:
    code = re.split(r"[-_]", lang.strip().lower())[0] if lang else ""
    if 2 <= len(code) <= 3:
        return code
    counts = Counter(words)
    votes = {name: sum(counts[w] for w in known) for name, known in _FUNCTION_SETS.items()}
    best = max(votes, key=lambda k: (votes[k], k))
    return best if votes[best] else "und"


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def coverage_place(words: int, share: float) -> int:
    """The place (from 0) among a document's words by rank whose rank covers the share."""
    return max(0, ceil(share * words - 1e-9) - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = words_of(text.as_py())
            if words:
                counts.setdefault(language(lang, words), Counter()).update(words)
        if sum(map(len, counts.values())) > MOST_COUNTED:
            yield out()
    yield out()


def word_counts(documents: DataFrame) -> DataFrame:
    """(lang, word, n) over all documents."""
    ship(documents.sparkSession)
    return documents.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_ranks(counts: DataFrame) -> DataFrame:
    """(lang, word, n, rank): rank is the number of words of the language that are at least as frequent."""
    sizes = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("words"))
    upto = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)  # one row per count that occurs
    table = sizes.select("lang", "n", F.sum("words").over(upto).alias("rank"))
    table = F.broadcast(table) if sizes.count() <= MOST_COUNTS else table
    return counts.join(table, ["lang", "n"]).select("lang", "word", "n", "rank")


_RANKS = [f"rank_{round(100 * s)}" for s in SHARES]
_FEATURES = "doc_id long, lang string, words long, " + ", ".join(f"{r} long" for r in _RANKS) + ", words_per_sentence double, letters_per_word double"
_ROWS = _FEATURES + ", rarer array<string>, places array<int>"


def _measured(ranks: dict[str, dict[str, int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.int64(), *[pa.int64()] * len(SHARES), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32()))
    names = [f.split()[0] for f in _ROWS.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            words = words_of(text)
            if not words:
                rows.append((doc_id, language(lang, words), 0, *[None] * (len(SHARES) + 4)))
                continue
            code = language(lang, words)
            table = ranks.get(code, {})
            known = sorted(table[w] for w in words if w in table)
            # Words that were not sent are no more frequent than those that were, so they come last.
            places = [coverage_place(len(words), s) - len(known) for s in SHARES]
            found = [known[p] if p < 0 else None for p in places]
            rarer = [w for w in words if w not in table] if max(places) >= 0 else None
            sentences = sum(1 for part in _SENTENCE.split(text) if part and _LETTERS.search(part))
            rows.append((doc_id, code, len(words), *found, len(words) / max(1, sentences), sum(map(len, words)) / len(words), rarer, places if rarer else None))
        columns = list(zip(*rows)) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def features(documents: DataFrame, sent: int = SENT_WORDS) -> DataFrame:
    """(doc_id, lang, words, rank_30 ..., words_per_sentence, letters_per_word) of every document once."""
    spark = documents.sparkSession
    shared_dir(spark)
    counts = word_counts(documents).checkpoint()
    ranked = word_ranks(counts)
    top = ranked.orderBy(F.desc("n"), "lang", "word").limit(sent)
    table: dict[str, dict[str, int]] = {}
    for lang, word, rank in top.select("lang", "word", "rank").collect():  # at most ``sent``
        table.setdefault(lang, {})[word] = rank
    shared = spark.sparkContext.broadcast(table)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _measured(shared.value, batches)

    seen = Observation()
    rows = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(measure, _ROWS).dropDuplicates(["doc_id"])
    rows = rows.observe(seen, F.count("rarer").alias("beyond")).checkpoint()
    plain = rows.drop("rarer", "places")
    if not seen.get.get("beyond"):
        return plain
    rare = rows.filter("rarer is not null").select("doc_id", "lang", F.explode("rarer").alias("word")).join(ranked.select("lang", "word", "rank").hint("merge"), ["lang", "word"])
    rare = rare.groupBy("doc_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))  # no more than a document has words
    both = rows.join(rare.hint("merge"), "doc_id", "left")
    filled = [F.coalesce(r, F.when(F.col("places")[i] >= 0, F.get("ranks", F.col("places")[i]))).alias(r) for i, r in enumerate(_RANKS)]
    return both.select(*[f for f in plain.columns if f not in _RANKS and f not in ("words_per_sentence", "letters_per_word")], *filled, "words_per_sentence", "letters_per_word")


#: What the level is linear in, by group.
_X = {"coverage": {r: f"ln({r})" for r in _RANKS}, "sentence": {"sentence": "ln(words_per_sentence)"}, "letters": {"letters": "letters_per_word"}}


def _terms(groups: tuple[str, ...]) -> dict[str, str]:
    return {name: e for g in groups for name, e in _X[g].items()}


def mean_ratings(ratings: DataFrame) -> DataFrame:
    """(doc_id, y): each rater's rating once, averaged."""
    return ratings.filter("reading_level is not null").select("doc_id", "rater", "reading_level").distinct().groupBy("doc_id").agg(F.avg("reading_level").alias("y"))


def calibrate(rated: DataFrame, groups: tuple[str, ...] = tuple(_X)) -> dict[str, float] | None:
    """Coefficients of the linear model, from sums over the rated documents (features and y)."""
    x = {**_terms(groups), "one": "1.0D"}
    joined = rated.filter("words > 0").select("y", *[F.expr(e).alias(n) for n, e in x.items()])
    names = list(x)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]] + [F.sum(F.col(a) * F.col("y")).alias(f"{a}_y") for a in names]
    row = joined.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    if row["n"] < LEAST_RATED:
        return None
    at = lambda a, b: row[f"{a}_{b}"] if names.index(a) <= names.index(b) else row[f"{b}_{a}"]
    matrix = np.array([[at(a, b) for b in names] for a in names]) + np.eye(len(names)) * 1e-6
    return dict(zip(names, np.linalg.solve(matrix, np.array([row[f"{a}_y"] for a in names])).tolist()))


def estimate(model: dict[str, float] | None, groups: tuple[str, ...] = tuple(_X)) -> Column:
    """The level of a document, from 1 to 5."""
    if model is None:
        return F.lit(None).cast("double")
    line = sum((F.expr(e) * model[n] for n, e in _terms(groups).items()), F.lit(model["one"]))
    return F.when(F.col("words") > 0, F.least(F.greatest(line, F.lit(1.0)), F.lit(5.0)))


def reading_levels(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """Each document's features with level (1 easiest to 5 hardest) and its nearest whole band."""
    measured = features(documents)
    model = calibrate(measured.join(mean_ratings(ratings), "doc_id"))
    return measured.withColumn("level", estimate(model)).withColumn("band", F.round("level").cast("int"))


def ablation(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """(features, documents, correlation, mean_error) of models fitted on one half of the rated documents, on the other half."""
    rated = features(documents).filter("words > 0").join(mean_ratings(ratings), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2))).checkpoint()
    out = None
    for groups in (("coverage",), ("sentence",), ("coverage", "sentence"), ("sentence", "letters"), ("coverage", "sentence", "letters")):
        level = F.when(F.col("half") == 0, estimate(calibrate(rated.filter("half = 1"), groups), groups)).otherwise(estimate(calibrate(rated.filter("half = 0"), groups), groups))
        row = rated.withColumn("level", level).agg(F.lit("+".join(groups)).alias("features"), F.count("level").alias("documents"), F.round(F.corr("level", "y"), 4).alias("correlation"), F.round(F.avg(F.abs(F.col("level") - F.col("y"))), 4).alias("mean_error"))
        out = row if out is None else out.unionByName(row)
    return out
