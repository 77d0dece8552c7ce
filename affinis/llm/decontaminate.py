"""Benchmark decontamination (operator 2): SimHash of item-sized windows.

For every benchmark item of n words, every window of n words of every document is a
candidate copy; a document with fewer words than the item is one window of all its words,
if its shingles are at least 3/4 as many as the item's. Windows and items carry a 64-bit SimHash of their weighted five-word
shingles (weight: occurrences). Pairs of such lengths within Hamming distance
``RADIUS`` are found by a multi-index join: the fingerprint is cut into 8 blocks of 8
bits, and by the pigeonhole principle two fingerprints at most 8 * (t + 1) - 1 = 23
bits apart have a block at most t = 2 bits apart, so an item is listed under all block
values within two bits and a window looks up its own eight. Then the exact weighted
Jaccard similarity of the shingles decides: 0.75 or more is a leak.

Before fingerprints are built, windows are ruled out that cannot be similar to any
item of their length: two multisets of m shingles with similarity 3/4 share at least
6m/7 of them (of m and m', 3/7 of the sum), so a window must have that many shingles that
occur in the benchmark at all. That bound is exact; it only spares fingerprints of windows without a match. A
random 64-bit SimHash puts texts of similarity 3/4 about 10 bits apart with a deviation
of 3; a radius of 23 is four deviations, and a verbatim passage is at distance 0.

The benchmark goes to every executor in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_SHINGLES`` shingles, with one pass over the documents per block, so what is sent
stays bounded whatever the benchmark's size.

Defined cases: null and empty texts, on either side, match nothing; an item with fewer
than five words is one shingle of all its words and matches that run of words. Null
ids are ids like any other: a null item_id or doc_id comes out as null. Repeated
rows each give their own results. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.text import SHINGLE_WORDS, batches, documents, materialise, pairs_of, runs, word_hashes, words_of

SIMILARITY = 0.75
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BLOCK_ITEMS = 50_000
BLOCK_SHINGLES = 4_000_000
# Windows fingerprinted at a time in a task.
GROUP = 4096
# Listed items up to which plain numbers are faster than arrays.
FEW = 64
# Shingles of a text whose running sums are kept whole (256 bytes each).
SUMMED = 1 << 16

_LEAK = pa.schema([
    ("doc_id", pa.int64()), ("item", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])


@functools.cache
def needed(m: int, other: int | None = None) -> int:
    """Fewest shared shingles of multisets of ``m`` and ``other`` (``m``) with similarity 3/4."""
    return math.ceil(SIMILARITY / (1 + SIMILARITY) * (m + (m if other is None else other)) - 1e-9)


class Fingerprints:
    """64-bit SimHashes of windows of a sequence of shingle hashes; repeats weigh as often
    as they occur. Running sums of the bits make a window one difference."""

    def __init__(self, s: np.ndarray):
        self.s, self.low, self.sums = s, 0, np.zeros((1, 64), np.int32)

    def of(self, starts: np.ndarray, m: int) -> np.ndarray:
        """Fingerprints of the windows of ``m`` shingles from ``starts`` on, in ascending order."""
        first, last = int(starts[0]), int(starts[-1]) + m
        if first < self.low or last >= self.low + len(self.sums):
            # The whole sequence at once where it is short, else what these windows span.
            first, last = (0, len(self.s)) if len(self.s) <= SUMMED else (first, last)
            bits = np.unpackbits(np.ascontiguousarray(self.s[first:last]).view(np.uint8).reshape(-1, 8), axis=1)
            self.low, self.sums = first, np.zeros((last - first + 1, 64), np.int32)
            np.cumsum(bits, axis=0, out=self.sums[1:])
        at = starts - self.low
        ones = self.sums[at + m] - self.sums[at]
        return np.packbits(2 * ones > m, axis=1).view(np.uint64).reshape(-1)


def _near_values() -> np.ndarray:
    """near[v]: the block values within ``BLOCK_RADIUS`` bits of v."""
    values = np.arange(1 << BLOCK_BITS)
    flips = np.array([x for x in values if bin(x).count("1") <= BLOCK_RADIUS])
    return values[:, None] ^ flips[None, :]


class Items:
    """A block of benchmark items: shingles, fingerprints and the multi-index."""

    def __init__(self, rows: list[tuple[int, bytes | None]]):
        hashes = word_hashes()
        self.numbers, self.by_length = [], {}
        self.counts: list[Counter] = []
        prints, lengths, every = [], [], []
        for number, text in rows:
            words = words_of(text)
            if not words:
                continue
            s = runs(hashes.of(words), min(SHINGLE_WORDS, len(words)))
            self.numbers.append(number)
            self.counts.append(Counter(s.tolist()))
            prints.append(Fingerprints(s).of(np.zeros(1, np.int64), len(s))[0])
            lengths.append(len(words))
            every.append((min(SHINGLE_WORDS, len(words)), s))
        self.prints = np.array(prints, np.uint64)
        self.numbers_of = self.prints.tolist()
        self.known = {
            w: np.unique(np.concatenate([s for width, s in every if width == w])) for w in {width for width, _ in every}}
        near = _near_values()
        # (length, block, value within two bits) -> items: the multi-index.
        index: dict[int, dict[tuple[int, int], list[int]]] = {}
        for i, (n, p) in enumerate(zip(lengths, prints, strict=True)):
            table = index.setdefault(n, {})
            for block, value in enumerate(np.array([p], np.uint64).view(np.uint8)):
                for v in near[value]:
                    table.setdefault((block, int(v)), []).append(i)
        self.by_length = {n: {k: np.array(v) for k, v in t.items()} for n, t in index.items()}

    def leaks(self, h: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """``item, start, words, similarity`` of every similar window of a document."""
        shingled: dict[int, tuple[Fingerprints, np.ndarray]] = {}
        for width, known in self.known.items():
            s = runs(h, width)
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            shingled[width] = Fingerprints(s), np.r_[0, np.cumsum(known[at] == s)]
        for n, table in self.by_length.items():
            width = min(SHINGLE_WORDS, n)
            prints, hits = shingled[width]
            m, have = n - width + 1, len(prints.s)
            if have < m:
                # All of a shorter document is one window.
                if have >= SIMILARITY * m and hits[-1] >= needed(have, m):
                    yield from self._verified(prints, np.zeros(1, np.int64), len(h), have, table, m)
                continue
            if hits[-1] < needed(m):
                continue
            starts = np.flatnonzero(hits[m:] - hits[:-m] >= needed(m))
            for part in np.array_split(starts, len(starts) // GROUP + 1):
                if len(part):
                    yield from self._verified(prints, part, n, m, table, m)

    def _verified(self, windows, starts, n, m, table, of_item):
        """Windows of ``n`` words and ``m`` shingles against items of ``of_item`` shingles."""
        s, prints, held, window = windows.s, windows.of(starts, m), None, Counter()
        for start, fingerprint, blocks in zip(starts.tolist(), prints.tolist(), prints.view(np.uint8).reshape(-1, BLOCKS).tolist(), strict=True):
            listed = [table[k] for k in enumerate(blocks) if k in table]
            if not listed:
                continue
            if sum(map(len, listed)) <= FEW:
                items = [i for i in sorted({i for part in listed for i in part.tolist()}) if (self.numbers_of[i] ^ fingerprint).bit_count() <= RADIUS]
            else:
                items = np.unique(np.concatenate(listed))
                items = items[np.bitwise_count(self.prints[items] ^ np.uint64(fingerprint)) <= RADIUS].tolist()
            if items:
                if held is not None and start - held < m:  # the window before, moved on
                    window.subtract(s[held:start].tolist())
                    window.update(s[held + m : start + m].tolist())
                else:
                    window = Counter(s[start : start + m].tolist())
                held = start
                for i in items:
                    both = sum(min(count, window[h]) for h, count in self.counts[i].items())
                    if both >= SIMILARITY * (m + of_item - both):
                        yield self.numbers[i], start, n, both / (m + of_item - both)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, n_words, similarity``: every item's best window in a document.

    ``start`` counts words from 0; of equally similar windows the first is given.
    """
    spark = docs.sparkSession
    # Items are numbered, so that null and repeated item_ids stay apart; the number is
    # dense enough to cut the table into blocks.
    items = materialise(benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("item")), "items")
    sizes = items.select(F.spark_partition_id().alias("part"), "item", F.octet_length("text").alias("bytes"))
    parts = []
    for row in sizes.groupBy("part").agg(F.min("item").alias("lo"), F.max("item").alias("hi"), F.count("item").alias("n"), F.sum("bytes").alias("bytes")).orderBy("lo").collect():
        # At most one shingle per two bytes; a file that is too large is cut by its numbers.
        pieces = max(1, -(-row["n"] // BLOCK_ITEMS), -(-(row["bytes"] or 0) // (2 * BLOCK_SHINGLES)))
        step = -(-(row["hi"] - row["lo"] + 1) // pieces)
        parts += [(lo, min(lo + step - 1, row["hi"])) for lo in range(row["lo"], row["hi"] + 1, step)]
    found = None
    for lo, hi in parts:
        block = spark.sparkContext.broadcast(
            [(r["item"], r["text"].encode() if r["text"] is not None else None) for r in items.where(F.col("item").between(lo, hi)).collect()])

        def rows(batches_in, block=block) -> Iterator[tuple]:
            known, hashes = Items(block.value), word_hashes()
            for batch in batches_in:
                for doc_id, text in pairs_of(batch, "doc_id", "text"):
                    best: dict[int, tuple] = {}
                    for item, start, n, similarity in known.leaks(hashes.of(words_of(text))):
                        if item not in best or similarity > best[item][-1]:
                            best[item] = doc_id, item, start, n, similarity
                    yield from best.values()

        one = documents(docs).mapInArrow(
            lambda b, rows=rows: batches(rows(b), _LEAK), "doc_id long, item long, start long, n_words long, similarity double")
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, item long, start long, n_words long, similarity double")
    # Leaks are few beside the documents; the items join them by number.
    return found.join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "start", "n_words", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a similar copy of an item; all columns kept.

    A row without doc_id can't be named as a leak's place and stays.
    """
    leaking = materialise(leaks(docs, benchmark).where("doc_id is not null").select("doc_id").distinct(), "leaks")
    return docs.join(leaking, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
