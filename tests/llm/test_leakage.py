import random

import numpy as np

from tablewright.llm import leakage as L

ITEM = "Inspector Lodokitis found that annex F stored 691 ochre vials per gannets, yet ledger VD516 claimed 373. Sheet N21 pairs newts with indigo flags; Rudriduzi struck out 290 entries after Drufesado flooded in 1995."


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*r, "a") for r in items], "item_id long, text string, doc_id string")
    return {tuple(r) for r in L.found(d, i).collect()}


def test_whole_partial_altered_and_short_quotations(spark):
    w = ITEM.split()
    altered = [x if i % 10 else "other" for i, x in enumerate(w)]
    docs = [
        (1, "Before. " + ITEM.upper() + " After."), (2, "x " * 500 + " ".join(w[:16]) + " y" * 500), (3, " ".join(w[:12])), (4, " ".join(altered)), (5, "\n".join(w)), (6, " ".join(w[:9]) + " and now something else of eleven words or more, then " + " ".join(w[9:30])),
        (7, None), (8, ""), (9, " ".join(reversed(w))), (10, "Inspector Q found that silo B stored 12 teal vials per stoats, yet ledger AA1 claimed 9. Sheet P5 pairs otters with ochre flags; Bo struck out 2 entries after Ka flooded in 2001."), (1, "Before. " + ITEM.upper() + " After."),
    ]
    items = [(100, ITEM), (101, "too short"), (102, None), (100, ITEM)]
    assert run(spark, docs, items) == {(1, 100), (2, 100), (4, 100), (5, 100), (6, 100)}
    assert run(spark, docs, []) == set() and run(spark, [], items) == set()


def test_pieces_far_apart_count_in_their_order(spark):
    w = ITEM.split()
    gap = lambda n: " ".join(f"filler{k % 97}" for k in range(n))
    docs = [
        (1, f"{' '.join(w[:8])} {gap(300)} {' '.join(w[8:16])}"), (2, f"{' '.join(w[:8])} {gap(3000)} {' '.join(w[8:16])}"), (3, f"{' '.join(w[:8])} {gap(300)} {' '.join(w[8:15])}"), (4, f"{' '.join(w[-9:])} {gap(3000)} {' '.join(w[:6])}"),
        (5, f"{' '.join(w[8:16])} {gap(300)} {' '.join(w[:8])}"), (6, f"{' '.join(w[:8])} {gap(3000)} {' '.join(w[8:11])} {gap(300)} {' '.join(w[11:15])}"), (7, f"{gap(9000)} {' '.join(w[3:19])} {gap(9000)}"),
    ]
    assert run(spark, docs, [(100, ITEM)]) == {(1, 100), (2, 100), (3, 100), (7, 100)}


def test_chains_weigh_as_much_as_brute_force():
    draw = random.Random(2)
    index = L.Index([(0, [f"w{draw.randrange(40)}" for _ in range(60)]), (1, [f"w{k}" for k in range(40)])])
    own = index.numbers[0]
    weights = [index.weights[w] for w in index.items[0][1]]
    for _ in range(60):
        cuts = [(draw.randrange(50), draw.randrange(3, 20)) for _ in range(6)]
        text = np.concatenate([p for a, n in cuts for p in (own[a : a + n], np.array([draw.randrange(40) for _ in range(draw.randrange(4))], np.int64))])
        runs = index.runs(text, 0)
        assert all(n >= L.SHINGLE and (text[i : i + n] == own[j : j + n]).all() for i, j, n in runs)
        held = index.chain(runs, 0)
        assert all(a + n <= b for (a, n), (b, _) in zip(held, held[1:]))
        whole: dict = {}
        for i, j, n in sorted(runs):  # whole runs only: the chain may also cut their beginnings
            whole[i, j, n] = sum(weights[j : j + n]) + max([v for (p, q, m), v in whole.items() if p + m <= i and q + m <= j], default=0)
        assert sum(sum(weights[a : a + n]) for a, n in held) >= max(whole.values())


def test_index_finds_all_fingerprints_within_the_radius():
    draw = random.Random(1)
    index = L.Index([(i, [f"w{draw.randrange(300)}" for _ in range(40)]) for i in range(50)])
    probe = np.array([int(p) ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(0, 6))) for p in index.prints[:400]], np.uint64)
    a, b = index.near(probe)
    got = set(zip(a.tolist(), b.tolist()))
    want = {(i, j) for i, p in enumerate(probe) for j in np.flatnonzero(np.bitwise_count(index.prints ^ p) <= L.RADIUS).tolist()}
    assert got == want
