"""Connected components by contraction, on DataFrames.

Every partition first joins its own edges by union-find and passes on one row per node with the least node it reaches
there. Nodes that meet several such roots link these roots, and the same is done with the links, which only run between
roots and are far fewer, until no node has two roots. A hub's edges are never gathered: they are joined where they are,
so a node has at most one root from each partition (or each MOST_NODES nodes of it). Levels are cut by checkpoint() into
the shared folder; the number of clashes is observed while a level is written, so a level is one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.session import shared_dir, ship

#: Nodes joined in memory at a time.
MOST_NODES = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    kind = None

    def out() -> pa.RecordBatch:
        nodes = list(parent)
        rows = pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "root"])
        parent.clear()
        return rows

    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
        if len(parent) > MOST_NODES:
            yield out()
    if parent:
        yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any one type, either direction, repeats and loops allowed -> (node, label), label the least node.

    A node that only has loops is its own component.
    """
    shared_dir(edges.sparkSession)
    ship(edges.sparkSession)
    kind = edges.schema["u"].dataType.simpleString()
    stars = edges.select("u", "v").filter("u is not null and v is not null").mapInArrow(_contract, f"node {kind}, root {kind}")
    seen = Observation()
    met = stars.groupBy("node").agg(F.collect_set("root").alias("roots"))
    met = met.select("node", "roots", F.array_min("roots").alias("label")).observe(seen, F.sum(F.size("roots") - 1).alias("clashes")).checkpoint()
    found = met.select("node", "label")
    if not seen.get.get("clashes"):
        return found
    links = met.filter("size(roots) > 1").select(F.explode("roots").alias("u"), F.col("label").alias("v"))
    above = connected_components(links).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return found.join(above.hint("merge"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
