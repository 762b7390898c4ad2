"""Evaluation texts that leak into training text (problem 8).

Every window of WINDOW words of a document and of the test items gets a 64-bit SimHash of its words, weighted by how
rare they are among the items. A case holds at least MIN_WORDS words of an item in order with at least WINDOW of them
in a row, however it is laid out, interrupted or altered elsewhere; so windows are as long as the shortest run that
must be found, not as the whole item, which would miss passages quoted in part. Four blocks of 16 bits index the
fingerprints of the items: two fingerprints within Hamming distance RADIUS agree in one block at least, so the index
finds all of them. Windows with more than FOREIGN words that no item has are not hashed: none of them is part of a case.

Every document and item that meet within the radius are then verified exactly, over the whole text: the document's
shingles of SHINGLE words that the item has are joined to runs, and of these the chain that goes forward in both texts
and weighs most is taken; runs of fewer than FAR words only count within reach of a run of WINDOW. What decides is the
weight of the item's words in the chain, as a share of the item (``held``): it must reach the share of the item's
lightest MIN_WORDS words, and the chain must have MIN_WORDS words with WINDOW in a row. It does not matter what lies
between the runs.

The items are the stated query set. Their index is built once, sent as arrays and kept by each worker; the documents are
read once for every ITEMS_PER_BLOCK items and never shuffled, so a source or a group of copies with a third of all rows
is just rows.

Edge cases (tested): null or empty documents and items hold nothing; items shorter than MIN_WORDS cannot be held; texts
of any length are read whole; a document with several items gives one row each; repeated rows give one row; an empty
item or document table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import ship

WINDOW = 8
MIN_WORDS = 15
SHINGLE = 3
FAR = 5
REACH = 40
RADIUS = 3
FOREIGN = 2
ITEMS_PER_BLOCK = 100_000
CHUNK = 150_000
MOST_FORMS_KEPT = 1_000_000
FOREIGN_ROWS = 4096
_WORD = re.compile(r"[^\W_]+")
_BREAKS = str.maketrans(dict.fromkeys("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’„«»–—…·•¡¿°±×", " "))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Vocabulary:
    """Word numbers; each word has 64 signed weights, the bits of its hash.

    The items' words have numbers below ``fixed``; all others share FOREIGN_ROWS rows by hash, which only enter windows
    that are verified afterwards.
    """

    def __init__(self, weights: dict[str, int]) -> None:
        self.number = {w: i for i, w in enumerate(weights)}
        self.fixed = len(self.number)
        self.rows = np.stack([*(self._bits(w, k) for w, k in weights.items()), *(self._bits(f"\0{i}", 8) for i in range(FOREIGN_ROWS))])
        self.forms: dict[str, int] = {}
        self.multiple: list[list[int]] = []

    @staticmethod
    def _bits(word: str, weight: int) -> np.ndarray:
        h = np.array([xxhash.xxh64_intdigest(word)], np.uint64)
        return np.where(np.unpackbits(h.view(np.uint8)) == 1, weight, -weight).astype(np.int8)

    def word(self, word: str) -> int:
        n = self.number.get(word)
        return self.fixed + xxhash.xxh32_intdigest(word) % FOREIGN_ROWS if n is None else n

    def form(self, raw: str) -> int:
        """A blank-delimited form: the number of its word, or -2 - k for the k-th list of several words or none."""
        found = [self.word(w) for w in words(raw)]
        if len(found) == 1:
            n = found[0]
        else:
            n = -2 - len(self.multiple)
            self.multiple.append(found)
        self.forms[raw] = n
        return n

    def numbers(self, text: str) -> np.ndarray:
        forms, form = self.forms, self.form
        raw = text.translate(_BREAKS).split()
        out = np.array([forms[r] if r in forms else form(r) for r in raw], np.int64)
        if len(out) and out.min() < 0:
            flat: list[int] = []
            for n in out.tolist():
                flat.extend(self.multiple[-2 - n]) if n < 0 else flat.append(n)
            out = np.array(flat, np.int64)
        return out

    def forget(self) -> None:
        """Empties the cache of forms when it is large."""
        if len(self.forms) > MOST_FORMS_KEPT:
            self.forms, self.multiple = {}, []


def fingerprints(numbers: np.ndarray, rows: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """SimHash of the windows of WINDOW (8) words that begin at the given places, or of all."""
    if len(numbers) < WINDOW:
        return np.zeros(0, np.uint64)
    if at is None:
        at = np.arange(len(numbers) - WINDOW + 1)
    x = rows[numbers[at]]
    for k in range(1, WINDOW):
        x += rows[numbers[at + k]]
    return np.packbits(x > 0, axis=1).view(np.uint64).ravel()


def familiar(numbers: np.ndarray, fixed: int) -> np.ndarray:
    """Places of the windows in which at most FOREIGN words are none of the items'; no other holds WINDOW of them in a row."""
    if len(numbers) < WINDOW:
        return np.zeros(0, np.int64)
    known = np.concatenate([[0], np.cumsum(numbers < fixed)])
    return np.flatnonzero(known[WINDOW:] - known[:-WINDOW] >= WINDOW - FOREIGN)


class Index:
    """The items' windows by each 16-bit block of their fingerprints."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        spread = Counter(w for _, ws in items for w in set(ws))
        self.weights = {w: max(1, min(15, round(1 + 2 * log2(len(items) / n)))) if len(items) > n else 1 for w, n in spread.items()}
        self.items = items
        self.vocabulary = Vocabulary(self.weights)
        self.numbers = [np.array([self.vocabulary.number[w] for w in ws], np.int64) for _, ws in items]
        prints = [fingerprints(n, self.vocabulary.rows) for n in self.numbers]
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self.owner = np.concatenate([np.full(len(p), i) for i, p in enumerate(prints)]) if prints else np.zeros(0, int)
        self.blocks = []
        for b in range(RADIUS + 1):
            key = self._block(self.prints, b)
            order = np.argsort(key, kind="stable")
            start = np.searchsorted(key[order], np.arange((1 << 16) + 1))
            self.blocks.append((order, start.astype(np.int32)))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (i, j) with prints[i] within RADIUS of the items' fingerprint j."""
        left, right = [], []
        for b, (order, start) in enumerate(self.blocks):
            key = self._block(prints, b)
            first, size = start[key], start[key + 1] - start[key]
            total = int(size.sum())
            if not total:
                continue
            at = np.repeat(np.arange(len(prints)), size)
            inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            other = order[np.repeat(first, size) + inside]
            close = np.bitwise_count(prints[at] ^ self.prints[other]) <= RADIUS
            left.append(at[close])
            right.append(other[close])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(left), np.concatenate(right)

    def runs(self, text: np.ndarray, item: int) -> list[tuple[int, int, int]]:
        """(place in the text, place in the item, words) of the longest common runs of SHINGLE words or more."""
        own = self.numbers[item].tolist()
        at: dict[tuple, list[int]] = {}
        for j in range(len(own) - SHINGLE + 1):
            at.setdefault(tuple(own[j : j + SHINGLE]), []).append(j)
        known = np.isin(text, self.numbers[item])
        spots = np.flatnonzero(np.convolve(known, np.ones(SHINGLE, int), "valid") == SHINGLE) if len(text) >= SHINGLE else np.zeros(0, int)
        words = text.tolist()
        open_runs: dict[int, tuple[int, int]] = {}  # by diagonal: (first, last) place of its shingles
        out = []
        for i in spots.tolist():
            for j in at.get(tuple(words[i : i + SHINGLE]), ()):
                first, last = open_runs.get(i - j, (i, i - 1))
                if last != i - 1:
                    out.append((first, first - (i - j), last - first + SHINGLE))
                    first = i
                open_runs[i - j] = (first, i)
        out += [(first, first - d, last - first + SHINGLE) for d, (first, last) in open_runs.items()]
        return sorted(out)

    def chain(self, runs: list[tuple[int, int, int]], item: int) -> list[tuple[int, int]]:
        """The item's stretches (place, words) of the chain of runs that weighs most, forward in both texts."""
        weights = [self.weights[w] for w in self.items[item][1]]
        upto = np.concatenate([[0], np.cumsum(weights)]).tolist()
        # best[j]: the heaviest chain whose last word is the item's word j - 1 or before, as (weight, last link).
        ends: list[tuple[int, int, int, tuple]] = []  # (end in the text, end in the item, number, link)
        best: list[tuple[int, tuple | None]] = [(0, None)] * (len(weights) + 1)
        pushed = 0
        for place, at, size in runs:
            while ends and ends[0][0] <= place:  # runs that ended before this one begins may precede it
                _, stop, _, link = heappop(ends)
                for j in range(stop, len(best)):
                    if best[j][0] >= link[0]:
                        break
                    best[j] = (link[0], link)
            for cut in range(0, max(1, size - SHINGLE + 1)):  # a run may give up its beginning where it overlaps the chain
                before = best[at + cut]
                if cut == 0 or before[0] > best[at + cut - 1][0]:
                    pushed += 1
                    heappush(ends, (place + size, at + size, pushed, (before[0] + upto[at + size] - upto[at + cut], before[1], at + cut, size - cut)))
        top = max((link for *_, link in ends), key=lambda k: k[0], default=None)
        top = max((x for x in (top, best[-1][1]) if x is not None), key=lambda k: k[0], default=None)
        out = []
        while top is not None:
            out.append((top[2], top[3]))
            top = top[1]
        return out[::-1]

    def verify(self, text: np.ndarray, item: int) -> float | None:
        """The weighted share of the item that the text holds, or None if it is no case."""
        runs = self.runs(text, item)
        size = len(self.numbers[item])
        hits = [(place - 2 * at - REACH, place + 2 * (size - at) + REACH) for place, at, n in runs if n >= WINDOW]
        if not hits:
            return None
        near = [r for r in runs if r[2] >= FAR or any(low <= r[0] and r[0] + r[2] <= high for low, high in hits)]
        held = self.chain(near, item)
        weights = np.array([self.weights[w] for w in self.items[item][1]])
        share = sum(int(weights[at : at + n].sum()) for at, n in held) / int(weights.sum())
        least = int(np.sort(weights)[:MIN_WORDS].sum()) / int(weights.sum())
        return share if share >= least and sum(n for _, n in held) >= MIN_WORDS and max(n for _, n in held) >= WINDOW else None


def _scan(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = index.vocabulary
    for batch in batches:
        out: list[tuple[int, int, float]] = []
        pending: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            if not pending:
                return
            joined = np.concatenate([n for _, n in pending])
            starts = np.cumsum([0, *(len(n) for _, n in pending)])
            document = np.repeat(np.arange(len(pending)), np.diff(starts))
            places = familiar(joined, vocabulary.fixed)
            if len(places):
                at, other = index.near(fingerprints(joined, vocabulary.rows, places))
                at = places[at]
                whole = document[at] == document[at + WINDOW - 1]
                met = np.unique(np.stack([document[at[whole]], index.owner[other[whole]]], 1), axis=0)
                for d, i in met.tolist():
                    share = index.verify(pending[d][1], i)
                    if share is not None:
                        out.append((pending[d][0], index.items[i][0], share))
            pending.clear()

        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            numbers = vocabulary.numbers(text.as_py() or "")
            if len(numbers) >= MIN_WORDS:
                pending.append((doc_id, numbers))
                size += len(numbers)
            if size >= CHUNK:
                flush()
                size = 0
                vocabulary.forget()
        flush()
        vocabulary.forget()
        columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "held"])


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, held): each document with each item it holds; held is the weighted share of the item."""
    spark = documents.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, held double"
    listed = items.filter("text is not null and item_id is not null").select("item_id", "text").dropDuplicates(["item_id"])
    blocks = max(1, -(-listed.count() // ITEMS_PER_BLOCK))
    rows = documents.filter("text is not null and doc_id is not null").select("doc_id", "text")
    out = None
    for k in range(blocks):
        part = listed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else listed
        own = [(r[0], ws) for r in part.collect() if len(ws := words(r[1])) >= MIN_WORDS]  # at most ITEMS_PER_BLOCK on average
        shared = spark.sparkContext.broadcast(Index(sorted(own)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return _scan(shared.value, batches)

        found = rows.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("held").alias("held"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id")
