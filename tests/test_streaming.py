from datetime import datetime

from tablewright.operators import quality
from tablewright.streaming.loads import maintain_counts

CELL = "dataset_id long, load_no int, row_no int, pos int, raw string, loaded_at timestamp"


def test_counts_follow_the_files(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("in", "counts", "mark")]
    first = [(1, 1, r, 1, v, datetime(2024, 1, 1)) for r, v in enumerate(["a", "a", "b"], 1)]
    second = [(1, 2, r, 1, v, datetime(2024, 1, 2)) for r, v in enumerate(["b", "c"], 1)] + first[:1]  # one cell again
    for rows in (first, second):
        spark.createDataFrame(rows, CELL).write.mode("append").parquet(paths[0])
        maintain_counts(spark, paths[0], spark.createDataFrame([], CELL).schema, paths[1], paths[2]).awaitTermination()
    assert {(r.value, r.n) for r in quality.state_after(spark, paths[1], 1).collect()} == {("a", 2), ("b", 1)}
    assert {(r.value, r.n) for r in quality.state_after(spark, paths[1], 2).collect()} == {("b", 1), ("c", 1)}


def test_late_older_loads_count_once(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("in", "counts", "mark")]
    newer = [(1, 1, r, 1, v, datetime(2025, 11, 1)) for r, v in enumerate(["a", "a", "b"], 1)]
    older = [(2, 1, r, 1, v, datetime(2023, 1, 1)) for r, v in enumerate(["c", "d"], 1)]
    again = [(1, 1, 1, 1, "a", datetime(2025, 12, 24)), *older, (2, 1, 3, 1, "d", datetime(2023, 1, 2))]  # three cells long known
    for rows in (newer, older, again):
        spark.createDataFrame(rows, CELL).write.mode("append").parquet(paths[0])
        maintain_counts(spark, paths[0], spark.createDataFrame([], CELL).schema, paths[1], paths[2]).awaitTermination()
    state = quality.state_after(spark, paths[1], 1)
    assert {(r.dataset_id, r.value, r.n) for r in state.collect()} == {(1, "a", 2), (1, "b", 1), (2, "c", 1), (2, "d", 2)}
