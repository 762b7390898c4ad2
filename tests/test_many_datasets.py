"""Links between many datasets: held against brute force, and without a row per pair of datasets."""

import random

from tablewright.functions import text as T
from tablewright.plans import registry


def kept(spark, tmp_path, columns, definitions):
    spark.createDataFrame([(d, i, n) for i, (d, n) in enumerate(columns)], "dataset_id long, pos int, name string").write.parquet(str(tmp_path / "column_contexts.parquet"))
    spark.createDataFrame([(i, d, n, None, None, i, []) for i, (d, n) in enumerate(definitions)], "def_id long, dataset_id long, name string, description string, unit string, pos int, missing_codes array<string>").write.parquet(str(tmp_path / "variable_definitions.parquet"))
    spark.createDataFrame([(d, f"{d}.csv") for d in sorted({d for d, _ in columns if d is not None})], "dataset_id long, file_name string").write.parquet(str(tmp_path / "dataset_structures.parquet"))
    return str(tmp_path)


def nodes(plan):
    """The operators of a plan that ran, with those of its stages."""
    within = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan"}.get(plan.nodeName().split(" ")[0])
    below = plan.children() if not within else None
    found = [getattr(plan, within)()] if within else [below.apply(i) for i in range(below.size())]
    return [plan, *(x for p in found for x in nodes(p))]


def most_rows(df):
    """The rows, and how many the operator of most rows gave."""
    rows = df.collect()
    metrics = [n.metrics().get("numOutputRows") for n in nodes(df._jdf.queryExecution().executedPlan())]
    return rows, max(m.get().value() for m in metrics if m.isDefined())


def sets(rows):
    out = {}
    for key, name in rows:
        out.setdefault(key, set()).add(name if name is None else T.py_normalize_name(name))
    return out


def some_sets(seed, names, datasets, widest):
    r = random.Random(seed)
    spelled = lambda n: r.choice([n, n.upper(), f"{n} (cm)", f"_{n}"])
    return [(d if d else None, spelled(f"v{n}")) for d in range(datasets) for n in r.sample(range(names), min(names, r.randint(1, widest)))]


def bound(columns, definitions):
    groups, datasets, out = sets(definitions), sets((d, n) for d, n in columns if n is not None), {}
    for g, names in groups.items():
        names = names - {None}
        best = sorted(((len(names & own) / len(names), d) for d, own in datasets.items() if names), key=lambda x: -x[0]) if g is not None else []
        next_ = best[1][0] if len(best) > 1 else 0
        hit = best and best[0][0] >= 0.5 and round(best[0][0] - next_, 9) >= 0.2 and best[0][1] is not None
        out[g] = (str(best[0][1]), "coverage") if hit else (None, "repository")
    return out


def test_group_binding_as_by_brute_force(spark, tmp_path):
    for seed, (names, widest) in enumerate([(9, 4), (26, 16)]):
        odd = [(1, "v1\x01"), (2, "v11:"), (3, "v1"), (3, "1:v"), (4, None), (4, "é ü"), (5, "")]
        columns, definitions = some_sets(seed, names, 60, widest) + odd, some_sets(seed + 100, names, 60, widest) + [(d + 60 if d else d, n) for d, n in odd] + [(71, None)]
        definitions += [(d + 100, n) for d, n in columns if d and d % 3]
        (folder := tmp_path / str(seed)).mkdir()
        got = {r.group_id: (r.dataset_id, r.method) for r in registry.QUERIES["f21_group_binding"](spark, kept(spark, folder, columns, definitions)).collect()}
        want = bound(columns, definitions)
        assert got == {None if g is None else f"g{g}": x for g, x in want.items()}
        assert {m for _, m in got.values()} == {"coverage", "repository"}


def test_group_binding_of_one_dataset(spark, tmp_path):
    sf = kept(spark, tmp_path, [(1, "a"), (1, "b")], [(1, "a"), (2, "x"), (2, "y")])
    assert {tuple(r) for r in registry.QUERIES["f21_group_binding"](spark, sf).collect()} == {("g1", "1", "coverage"), ("g2", None, "repository")}


def test_group_binding_without_pairs(spark, tmp_path):
    n = 1000
    rows = [(d, x) for d in range(1, n + 1) for x in ("remarks", "tag", f"own{d}")]
    got, most = most_rows(registry.QUERIES["f21_group_binding"](spark, kept(spark, tmp_path, rows, rows)))
    assert {(r.group_id, r.dataset_id, r.method) for r in got} == {(f"g{d}", str(d), "coverage") for d in range(1, n + 1)}
    assert most < 20 * n  # pairs: n * n and more


def elsewhere(columns, definitions):
    norm, out = T.py_normalize_name, {}
    defined = {(d, n) for d, n in definitions if d is not None and n is not None}
    known = {(d, norm(n)) for d, n in defined}
    for d, c in {(d, c) for d, c in columns if d is not None and c is not None and norm(c) and (d, norm(c)) not in known}:
        met = [(-(1.0 if c == n else 0.98 if c.lower() == n.lower() else 0.9), str(b), n) for b, n in defined if b != d and norm(n) == norm(c)]
        if met:
            below, b, n = min(met)
            out[str(d), c] = (n, b, -below)
    return out


def test_definitions_elsewhere_as_by_brute_force(spark, tmp_path):
    odd = [(1, "É"), (2, "e"), (3, "E"), (4, "()"), (5, None), (None, "e"), (6, "a-b"), (6, "A_b"), (7, "AB"), (10, "AB"), (7, "ab")]
    columns, definitions = some_sets(1, 30, 40, 5) + odd, some_sets(2, 30, 40, 5) + [(d + 3 if d else d, n) for d, n in odd]
    got = {(r.dataset_id, r.column): (r.name, r.bound_to, r.score) for r in registry.QUERIES["f18_out_of_scope"](spark, kept(spark, tmp_path, columns, definitions)).collect()}
    assert got == elsewhere(columns, definitions) and {score for _, _, score in got.values()} == {1.0, 0.98, 0.9}


def test_definitions_elsewhere_without_pairs(spark, tmp_path):
    n = 1000
    sf = kept(spark, tmp_path, [(d, "remarks") for d in range(1, n + 1)], [(d + n, "Remarks") for d in range(1, n + 1)])
    got, most = most_rows(registry.QUERIES["f18_out_of_scope"](spark, sf))
    assert {tuple(r) for r in got} == {(str(d), "remarks", "Remarks", "1001", 0.98) for d in range(1, n + 1)}
    assert most < 20 * n  # pairs: n * n


def covered(columns, definitions):
    groups, datasets = sets(definitions), sets(columns)
    shares = {(f"g{g}", d if d is None else str(d)): len((names & own) - {None}) / len(names) for g, names in groups.items() if g is not None for d, own in datasets.items()}
    return {pair: round(share, 6) for pair, share in shares.items() if share}


def test_coverage_as_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tablewright.operators.linking.CELL", 7)
    wide = [(d, f"v{n}") for d in (901, 902) for n in range(d % 5, 90)]
    columns = some_sets(1, 100, 50, 9) + wide + [(3, None), (4, ""), (5, "é"), (6, "v1")]
    definitions = some_sets(2, 100, 50, 9) + wide + [(3, None), (4, ""), (5, "E"), (6, "v1"), (7, None)]
    got = [tuple(r) for r in registry.QUERIES["e11_coverage"](spark, kept(spark, tmp_path, columns, definitions)).collect()]
    assert len(got) == len({r[:2] for r in got}) and {(g, d): c for g, d, c in got} == covered(columns, definitions)


def test_coverage_moves_no_pairs(spark, tmp_path):
    n = 300
    rows = [(d, x) for d in range(1, n + 1) for x in ("remarks", "tag", f"own{d}")]
    df = registry.QUERIES["e11_coverage"](spark, kept(spark, tmp_path, rows, rows))
    got = df.collect()
    assert len(got) == n * n and {(r.group_id[1:] == r.dataset_id, r.coverage) for r in got} == {(True, 1.0), (False, 0.666667)}
    written = [x.metrics().get("shuffleRecordsWritten") for x in nodes(df._jdf.queryExecution().executedPlan())]
    assert 0 < max(m.get().value() for m in written if m.isDefined()) < 20 * n  # pairs: n * n
