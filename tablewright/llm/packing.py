"""Filling fixed-capacity containers with items, in a controlled mixture (problem 7).

Every text is measured in tokens of a public tokenizer and assigned whole to one container of each capacity; only a
text that alone exceeds the capacity is cut, into full containers and a rest. Containers are windows filled by deficit
round-robin over one queue per source: with each window every source earns its target share of the capacity, and what
it is owed beyond what it gave is its deficit, which carries over from window to window. A heap holds the sources by
the window in which their next turn is due (tokens given beyond the carried deficit, over the share). Of the LOOK
sources whose turn is next, the first goes: with an item near what it is owed while the room takes several more, else
with its largest that fits. An item that would close the window with waste has to beat the later sources' items, and at
last any item that fits better; WASTE says how many turns a wasted window is worth.

The items are dealt by hash into shards of about ITEMS_PER_SHARD, each packed by one task, so neither a source nor the
whole corpus is ever one group. Shards are packed in WAVES; the deficits at the end of one wave go on to shards of the
next, so they carry through all shards. A shard gives back its emptiest windows (one in MERGE at most); these leftovers
are merged, MERGE shards at a time, and packed again with the deficits of the last wave, until one shard is left.

Target shares are given as a table or are those of all tokens of the corpus. They reach the shards by a join on the
source, so their number has no bound. As every text has to be packed, the windows follow given targets as long as the
queues last. With few items in a window no window can have the mixture of many sources; mixture() gives the distance
of each window beside the least that so many whole items allow.

Edge cases (tested): null or empty texts have no tokens and go into the first container of their shard; a null source
is a queue of its own; ties are broken by doc_id; repeated rows count once; capacities below one are ignored; an empty
corpus gives no rows; sources without a target earn nothing and come last.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache, reduce
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import shared_dir, ship

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
ITEMS_PER_SHARD = 20_000
MERGE = 16
NEARLY_FULL = 0.995
WAVES = 4
LOOK = 16
WASTE = 2_000
#: A window is closing when the room left is below this share; an item is chosen by what is owed above so many mean items.
CLOSING = 0.15
ROOMY = 3

#: Fixed value: the pattern that cuts text into pieces before byte pairs are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens). The vocabulary is sent to the executors; it need only be where the driver runs."""
    ship(documents.sparkSession)
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], names=["doc_id", "source", "tokens"])

    rows = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return rows.mapInArrow(count, "doc_id long, source string, tokens long")


class Queue:
    """Items of one source by size; the largest size that fits is one operation on a bit set."""

    def __init__(self) -> None:
        self.sizes = 0
        self.items: dict[int, list] = {}

    def add(self, size: int, item: tuple) -> None:
        self.items.setdefault(size, []).append(item)
        self.sizes |= 1 << size

    def largest(self, room: int) -> int:
        """The largest size up to room, or -1."""
        return (self.sizes & ((1 << (room + 1)) - 1)).bit_length() - 1

    def smallest(self) -> int:
        return (self.sizes & -self.sizes).bit_length() - 1

    def take(self, size: int) -> tuple:
        stack = self.items[size]
        item = stack.pop()
        if not stack:
            del self.items[size]
            self.sizes &= ~(1 << size)
        return item


def fill(items: list[tuple], capacity: int, shares: dict[str, float], deficits: dict[str, float]) -> list[list[tuple]]:
    """Windows of (size, source, item...) tuples with sizes from 1 to capacity; deficits are changed in place."""
    queues: dict[str, Queue] = {}
    holders: dict[int, set[str]] = {}
    for item in sorted(items, key=lambda i: i[2:], reverse=True):
        queues.setdefault(item[1], Queue()).add(item[0], item)
        holders.setdefault(item[0], set()).add(item[1])
    present = sum(1 << size for size in holders)
    mean = sum(i[0] for i in items) / len(items) if items else 0
    given = {s: -deficits.get(s, 0.0) for s in {*queues, *deficits}}
    turn = lambda s: given[s] / max(shares.get(s, 0.0), 1e-12)
    due = [(turn(s), s) for s in queues]
    heapify(due)
    windows: list[list[tuple]] = []
    while queues:
        room, window = capacity, []
        while room > 0 and queues:
            least = (present & -present).bit_length() - 1
            if least > room:
                break
            looked = [heappop(due) for _ in range(min(LOOK, len(due)))]
            best: tuple[float, str, int] | None = None
            for place, (_, source) in enumerate(looked):
                if best is not None and place >= best[0]:
                    break
                queue = queues[source]
                size = queue.largest(room)
                if size <= 0:
                    continue
                if room >= ROOMY * mean:
                    owed = shares.get(source, 0.0) * (len(windows) + 1) * capacity - given[source]
                    size = max(queue.largest(min(room, int(max(owed, 1)))), queue.smallest())
                left = room - size
                cost = place + (WASTE * left / capacity if left < CLOSING * capacity else 0)
                if best is None or cost < best[0]:
                    best = cost, source, size
            largest = (present & ((1 << (room + 1)) - 1)).bit_length() - 1
            if best is None or (room - best[2] < max(least, CLOSING * capacity) and WASTE * (largest - best[2]) / capacity > LOOK):
                best = 0, min(holders[largest]), largest
            _, source, size = best
            window.append(queues[source].take(size))
            room -= size
            given[source] += size
            if not queues[source].sizes >> size & 1:
                holders[size].discard(source)
                if not holders[size]:
                    del holders[size]
                    present &= ~(1 << size)
            if all(s != source for _, s in looked):
                due = [d for d in due if d[1] != source]
                heapify(due)
            for d in looked:
                if d[1] != source:
                    heappush(due, d)
            if queues[source].sizes:
                heappush(due, (turn(source), source))
            else:
                del queues[source]
        windows.append(window)
    for source, tokens in given.items():
        deficits[source] = shares.get(source, 0.0) * len(windows) * capacity - tokens
    return windows


_PIECE = "limit_id long, capacity long, shard long, doc_id long, source string, part long, parts long, token_start long, tokens long, share double, container_id string, done boolean, deficit double"


def _pack_shard(rows: pd.DataFrame, level: int, last: bool) -> pd.DataFrame:
    """Packs a shard's pieces; rows without a document carry deficits of earlier shards."""
    first = rows.iloc[0]
    limit_id, capacity, shard = int(first.limit_id), int(first.capacity), int(first.shard)
    deficits: dict[str, float] = {}
    shares: dict[str, float] = {}
    items, empty, out = [], [], []
    columns = ["doc_id", "source", "part", "parts", "token_start", "tokens", "share", "deficit"]
    for doc_id, source, part, parts, start, tokens, share, deficit in rows[columns].itertuples(index=False):
        shares[source] = share
        if pd.isna(doc_id):
            deficits[source] = deficits.get(source, 0.0) + deficit
            continue
        piece = (int(tokens), source, int(doc_id), int(part), int(parts), int(start))
        (items if tokens > 0 else empty).append(piece)
    windows = fill(items, capacity, shares, deficits)
    if empty:
        if not windows:
            windows = [[]]
        windows[0] = [*windows[0], *empty]
    # The emptiest windows go on to the next level, at most one in MERGE, so a merged shard is no larger than a first one.
    filled = sorted((sum(i[0] for i in window), number) for number, window in enumerate(windows))
    loose = set() if last else {n for size, n in filled[: max(1, len(windows) // MERGE)] if size < NEARLY_FULL * capacity}
    for number, window in enumerate(windows):
        done = number not in loose
        for tokens, source, doc_id, part, parts, start in window:
            out.append((limit_id, capacity, shard, doc_id, source, part, parts, start, tokens, shares[source], f"{limit_id}-{level}-{shard}-{number}", done, 0.0))
            if not done:
                deficits[source] = deficits.get(source, 0.0) + tokens  # what goes on was not given
    for source in deficits:
        deficits[source] -= shares[source] * capacity * len(loose)
    if not last:
        out += [(limit_id, capacity, shard, None, s, None, None, None, None, shares[s], None, False, d) for s, d in sorted(deficits.items())]
    names = [c.split()[0] for c in _PIECE.split(", ")]
    return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("doc_id", "part", "parts", "token_start", "tokens")})


def _packer(level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _pack_shard(rows, level, last)

    return run


def measured(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of every document once, null sources as ''."""
    shared_dir(documents.sparkSession)
    return token_counts(documents, path).dropDuplicates(["doc_id"]).withColumn("source", F.coalesce("source", F.lit(""))).checkpoint()


def target_shares(sizes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(source, share): the given targets scaled to a sum of 1, or each source's share of all tokens."""
    weights = sizes.groupBy("source").agg(F.sum("tokens").cast("double").alias("w"))
    if targets is not None:
        given = targets.filter("share > 0").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("share").cast("double").alias("given"))
        weights = weights.join(given, "source", "left").select("source", F.coalesce("given", F.lit(0.0)).alias("w"))
    whole = weights.agg(F.sum("w")).first()[0] or 1.0
    return weights.select("source", (F.col("w") / whole).alias("share"))


def pack(documents: DataFrame, limits: DataFrame, path: str = TOKENIZER, per_shard: int = ITEMS_PER_SHARD, targets: DataFrame | None = None) -> DataFrame:
    """(limit_id, container_id, doc_id, part, parts, token_start, tokens, source): every text in a container of every capacity."""
    return pack_sizes(measured(documents, path), limits, per_shard, targets)


def pack_sizes(sizes: DataFrame, limits: DataFrame, per_shard: int = ITEMS_PER_SHARD, targets: DataFrame | None = None) -> DataFrame:
    """pack() of texts already measured."""
    shards = max(1, -(-sizes.count() // per_shard))
    caps = [(r[0], r[1]) for r in limits.select("limit_id", "capacity_tokens").distinct().collect() if r[1] is not None and r[1] >= 1]
    if not caps:
        return sizes.limit(0).select(F.lit(0).cast("long").alias("limit_id"), F.lit("").alias("container_id"), "doc_id", *[F.lit(0).cast("long").alias(c) for c in ("part", "parts", "token_start", "tokens")], "source")
    cap = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("limit_id"), F.lit(c).cast("long").alias("capacity")) for i, c in caps]))
    shared = sizes.join(target_shares(sizes, targets), "source")
    pieces = shared.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).select("*", cap.alias("cap")).select("doc_id", "source", "tokens", "share", "shard", "cap.*")
    parts = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)).cast("long")
    pieces = pieces.withColumn("parts", parts).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    start = F.col("part") * F.col("capacity")
    pieces = pieces.select(
        "limit_id", "capacity", "shard", "doc_id", "source", "part", "parts", start.alias("token_start"), F.least(F.col("tokens") - start, F.col("capacity")).alias("tokens"), "share",
        F.lit(None).cast("string").alias("container_id"), F.lit(False).alias("done"), F.lit(0.0).alias("deficit"),
    )
    level, packed, carried = 0, [], None
    while True:
        last = shards == 1
        waves = min(WAVES, shards) if level == 0 else 1
        loose = []
        for wave in range(waves):
            rows = pieces.filter(F.col("shard") % waves == wave) if waves > 1 else pieces
            if carried is not None:
                # What a source is owed goes to one shard of the next wave, another for each source.
                number = -(-(shards - wave) // waves)
                rows = rows.unionByName(carried.withColumn("shard", F.pmod(F.xxhash64("source"), F.lit(number)) * waves + wave))
            filled = rows.groupBy("limit_id", "shard").applyInPandas(_packer(level, last), _PIECE)
            if last:
                packed.append(filled)
                break
            filled = filled.checkpoint()
            packed.append(filled.filter("done"))
            loose.append(filled.filter("not done and doc_id is not null"))
            owed = filled.filter("doc_id is null").groupBy("limit_id", "capacity", "source").agg(F.sum("deficit").alias("deficit"), F.max("share").alias("share"))
            carried = owed.select(*[c if c in ("limit_id", "capacity", "source", "deficit", "share") else F.lit(None if c != "done" else False).cast(k).alias(c) for c, k in (x.split() for x in _PIECE.split(", "))])
        if last:
            break
        pieces = reduce(DataFrame.unionByName, loose).withColumn("shard", F.floor(F.col("shard") / MERGE))
        shards, level = -(-shards // MERGE), level + 1
    out = reduce(DataFrame.unionByName, packed)
    return out.filter("doc_id is not null").select("limit_id", "container_id", "doc_id", "part", "parts", "token_start", "tokens", "source")


def mixture(packed: DataFrame, shares: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, container_id, items, tokens, unused, deviation, least): how far each window is from the target shares.

    deviation is half the sum of differences (total variation); least is what so many whole items allow at best, one from
    each of the sources with the largest shares.
    """
    each = packed.groupBy("limit_id", "container_id", "source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    window = each.join(shares, "source").groupBy("limit_id", "container_id").agg(
        F.sum("k").alias("items"), F.sum("t").alias("tokens"), F.collect_list(F.struct("t", "share")).alias("held"),  # at most one entry per token
    )
    n = F.col("tokens").cast("double")
    apart = F.aggregate("held", F.lit(0.0), lambda x, h: x + F.abs(h["t"] / n - h["share"]) - h["share"])
    most = limits.agg(F.max("capacity_tokens")).first()[0] or 0
    top = shares.orderBy(F.desc("share"), "source").limit(int(most))
    order = Window.orderBy(F.desc("share"), "source")  # no more rows than a window can have items
    reach = top.select(F.row_number().over(order).cast("long").alias("items"), F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("reach"))
    caps = limits.select(F.col("limit_id").cast("long").alias("limit_id"), F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    out = window.join(reach, "items", "left").join(caps, "limit_id").withColumn("deviation", F.when(n > 0, (F.lit(1.0) + apart) / 2))
    return out.select("limit_id", "container_id", "items", "tokens", (F.col("capacity") - F.col("tokens")).alias("unused"), F.round("deviation", 6).alias("deviation"), F.round(F.greatest(1 - F.coalesce("reach", F.lit(1.0)), F.lit(0.0)), 6).alias("least"))
