import random
from collections import defaultdict

import pytest

from tablewright.llm import packing as P


def test_windows_hold_everything_once():
    draw = random.Random(1)
    items = [(draw.randrange(1, 100), draw.choice("abc"), i, 0, 1, 0) for i in range(500)]
    windows = P.fill(list(items), 100, {"a": 0.3, "b": 0.3, "c": 0.4}, {})
    assert sorted(i for w in windows for i in w) == sorted(items)
    assert all(sum(i[0] for i in w) <= 100 for w in windows)
    assert len(windows) <= 1.03 * sum(i[0] for i in items) / 100 + 1


def test_mixture_follows_the_shares():
    items = [(5, s, i, 0, 1, 0) for s in "ab" for i in range(300)]
    windows = P.fill(items, 100, {"a": 0.75, "b": 0.25}, {})
    half = windows[: len(windows) // 2]
    share = sum(i[0] for w in half for i in w if i[1] == "a") / sum(i[0] for w in half for i in w)
    assert share == pytest.approx(0.75, abs=0.05)


def test_deficits_carry_over():
    items = [(5, s, i, 0, 1, 0) for s in "ab" for i in range(300)]
    deficits = {"a": 0.0, "b": 200.0}
    windows = P.fill(items, 100, {"a": 0.5, "b": 0.5}, deficits)
    early = [i[1] for w in windows[:4] for i in w]
    assert early.count("b") - early.count("a") == pytest.approx(40, abs=8)  # what b was owed comes first
    assert sum(deficits.values()) == pytest.approx(200 + sum(100 - sum(i[0] for i in w) for w in windows), abs=1e-6)


@pytest.mark.parametrize("per_shard", [1000, 40])
def test_given_targets_and_the_mixture_of_windows(spark, per_shard):
    rows = [(i, "plot " * 10, "abc"[i % 3]) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    limits = spark.createDataFrame([(1, 100)], "limit_id long, capacity_tokens int")
    targets = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("z", 9.0)], "source string, share double")
    sizes = P.measured(docs)
    packed = P.pack_sizes(sizes, limits, per_shard, targets)
    assert packed.count() == 240 and packed.select("doc_id").distinct().count() == 240
    got = P.mixture(packed, P.target_shares(sizes, targets), limits).collect()
    n = sizes.first().tokens
    assert all(r.tokens + r.unused == 100 and r["least"] <= r.deviation + 1e-9 for r in got) and n * 240 == sum(r.tokens for r in got)
    assert sum(r.deviation < 0.15 for r in got) >= 0.4 * len(got)  # two of three sources in equal parts, the third last
    shares = {r.source: r.share for r in P.target_shares(sizes).collect()}
    assert shares == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3})


@pytest.mark.parametrize("per_shard", [1000, 20])
def test_documents_of_all_sizes(spark, per_shard):
    draw = random.Random(2)
    text = lambda n: " ".join(draw.choice(["plot", "depth", "water", "été"]) for _ in range(n))
    rows = [(i, text(draw.randrange(1, 60)), draw.choice(["x", "y", None]), "k") for i in range(150)] + [(1000, text(700), "x", "k"), (1001, None, "x", "k"), (1002, "", None, "k")]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string, capacity string")
    limits = spark.createDataFrame([(1, 64), (2, 256), (2, 256), (3, 0)], "limit_id long, capacity_tokens int")
    out = P.pack(docs, limits, per_shard=per_shard).collect()
    sizes = {r.doc_id: r.tokens for r in P.token_counts(docs).collect()}
    for limit, capacity in ((1, 64), (2, 256)):
        filled, got, parts = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in out:
            if r.limit_id == limit:
                filled[r.container_id] += r.tokens
                got[r.doc_id] += r.tokens
                parts[r.doc_id] += 1
        assert max(filled.values()) <= capacity and dict(got) == sizes
        assert all(n == max(1, -(-sizes[d] // capacity)) for d, n in parts.items())
    assert not [r for r in out if r.limit_id == 3]
    assert P.pack(docs.limit(0), limits).collect() == []
