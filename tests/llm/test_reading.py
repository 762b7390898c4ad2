import random

import pytest

from tablewright.llm import reading as R


def test_coverage_place():
    at = lambda ranks, share: sorted(ranks)[R.coverage_place(len(ranks), share)]
    assert at([1, 1, 1, 1, 9], 0.8) == 1
    assert at([1, 1, 1, 1, 9], 0.9) == 9
    assert at([4], 0.5) == 4


def test_ranks_count_all_documents(spark):
    docs = spark.createDataFrame([(i, "en-US", "the the plot") for i in range(5)] + [(9, None, "le le la les des parcelles"), (10, "en", None), (11, "EN", "rare odd")], "doc_id long, lang string, text string")
    got = {(r.lang, r.word): r["rank"] for r in R.word_ranks(R.word_counts(docs)).collect()}
    assert got[("en", "the")] == 1 and got[("en", "plot")] == 2 and got[("en", "rare")] == got[("en", "odd")] == 4 and got[("fr", "le")] == 1


@pytest.mark.parametrize("sent", [0, 1, 5, 40, 10**6])
def test_the_number_of_words_sent_changes_nothing(spark, sent):
    """Any rank, in any of many languages, against brute force."""
    draw = random.Random(4)
    rows = [(i, f"x{chr(97 + i % 26)}", " ".join(f"w{'abcdefgh'[min(7, int(draw.expovariate(0.5)))]}{'abcdefghij'[draw.randrange(1 + i % 10)]}" for _ in range(draw.randrange(1, 80)))) for i in range(150)]
    counts: dict = {}
    for _, lang, text in rows:
        for w in text.split():
            counts[lang, w] = counts.get((lang, w), 0) + 1
    rank = {(lang, w): sum(1 for (o, _), m in counts.items() if o == lang and m >= n) for (lang, w), n in counts.items()}
    got = {r.doc_id: r for r in R.features(spark.createDataFrame(rows, "doc_id long, lang string, text string"), sent).collect()}
    for i, lang, text in rows:
        ranks = sorted(rank[lang, w] for w in text.split())
        assert [got[i][f"rank_{round(100 * s)}"] for s in R.SHARES] == [ranks[R.coverage_place(len(ranks), s)] for s in R.SHARES]


def test_levels_follow_ratings(spark):
    draw = random.Random(1)
    rows, ratings = [], []
    for i in range(120):
        hard = i % 2
        words = [("considerable methodological heterogeneity" if hard else "the dog ran").split()[draw.randrange(3)] for _ in range(40)]
        step = 20 if hard else 4
        rows.append((i, "en", ". ".join(" ".join(words[k : k + step]) for k in range(0, 40, step)) + ".", 3))
        if i < 60:
            ratings += [(i, "a", 5 if hard else 1, 0.5)] * 2
    docs = spark.createDataFrame([*rows, (900, "en", "", 1), (901, None, None, 1), (902, "xx-odd", "123 456", 1)], "doc_id long, lang string, text string, level int")
    rated = spark.createDataFrame(ratings, "doc_id long, rater string, reading_level int, words double")
    got = {r.doc_id: r.level for r in R.reading_levels(docs, rated).collect()}
    assert len(got) == 123 and got[900] is None and got[901] is None and got[902] is None
    assert all(got[i] == pytest.approx(5 if i % 2 else 1, abs=0.8) for i in range(60, 120))
    assert {r.level for r in R.reading_levels(docs, rated.limit(0)).collect()} == {None}
    assert R.reading_levels(docs.limit(0), rated).collect() == []
    parts = {r.features: r for r in R.ablation(docs, rated).collect()}
    assert parts["coverage+sentence+letters"].documents == 60 and parts["coverage"].correlation > 0.9
