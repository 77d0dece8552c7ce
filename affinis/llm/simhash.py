"""SimHash near-duplicates (operator 13): tiled exact comparison of 64-bit fingerprints.

A document's fingerprint has a bit set where more than half of the XXH64 values (seed 42)
of its three-word shingles, repeats included, have it set. Two documents link when their
fingerprints differ in at most ``RADIUS`` bits. Every such pair is found; nothing is
approximated after the fingerprint.

1. Equal fingerprints are one node from the start, so copies cost one row.
2. Tiles. The population counts of a fingerprint's ``PARTS`` parts are its tile. A bit that
   differs moves one count by one, so fingerprints within the radius lie in tiles whose
   counts differ by at most ``RADIUS`` = 2 in sum, and all other pairs of tiles are skipped.
   Two tiles that are that near have a tile in common that is at most one step from each
   (their midpoint). Every fingerprint is therefore sent to its own tile and to the tiles
   one step away, ``2 * PARTS + 1`` rows at most, and pairs meet there.
3. Inside a cell (what was sent to one tile) fingerprints are compared by exclusive-or and
   bit counts in numpy: small cells all at once, large ones in tiles of ``TILE`` rows in the
   order of their whole population counts, where tile pairs further apart than the radius
   are skipped again. Cells above ``CELL`` members, counted beforehand, are dealt to slots,
   and a task sees two slots at a time.
4. Only the links that join something leave a task (a forest, not all pairs); components
   are joined by :func:`affinis.llm.components.components`. Nodes carry the smallest doc_id
   of their fingerprint in front, so that a component's label is its smallest doc_id.

Defined cases: null and empty texts and texts without words have fingerprint zero, which
links like any other; one or two words are one shingle. Rows without doc_id take part in
links; a component that has no doc_id at all has a null component_id. Repeated rows stay.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.components import components
from affinis.llm.text import batches, documents, materialise, pairs_of, signed, tasks_for, words_of

SEED, WORDS, RADIUS = 42, 3, 2
# Parts whose population counts name a tile; three bits hold a count of 0 to 4.
PARTS, COUNT_BITS = 16, 3
# Members of a cell before it is dealt to slots, and rows of a tile inside a large group.
CELL, TILE = 4096, 512
# Groups up to this size are compared all at once with their neighbours in the batch.
SMALL = 64
# Shingles whose bits are added up in one go.
CHUNK = 1 << 16
# Rows of one comparison, at least; a group is never cut.
GATHERED = 1 << 17
# Stands for "no doc_id": larger than every id.
NO_ID = (1 << 63) - 1

_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LINKS = pa.schema([("ia", pa.int64()), ("fa", pa.int64()), ("ib", pa.int64()), ("fb", pa.int64())])


def fingerprint(text: bytes | None) -> int:
    """The fingerprint as an unsigned number."""
    words = words_of(text)
    if not words:
        return 0
    n = max(len(words) - WORDS + 1, 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[min(WORDS, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for low in range(0, n, CHUNK):
        spans = zip(starts[low : low + CHUNK], ends[low : low + CHUNK], strict=True)
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", min(CHUNK, n - low))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` for every row; ``fp`` is the fingerprint as a signed number."""

    def rows(parts) -> Iterator[tuple]:
        for batch in parts:
            for doc_id, text in pairs_of(batch, "doc_id", "text"):
                fp = fingerprint(text)
                yield doc_id, fp - (fp >> 63 << 64)

    return documents(docs).mapInArrow(lambda parts: batches(rows(parts), _FINGERPRINTS), "doc_id long, fp long")


def part_counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of the parts, one row per fingerprint."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(-1, PARTS, 64 // PARTS).sum(axis=2, dtype=np.int64)


def tile_names(fp: np.ndarray) -> np.ndarray:
    """A fingerprint's own tile as one number."""
    return part_counts(fp) @ (1 << COUNT_BITS * np.arange(PARTS, dtype=np.int64))


def neighbour_tiles(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``row, tile``: each row of population counts with its own tile and those one step away."""
    step = 1 << COUNT_BITS * np.arange(PARTS, dtype=np.int64)
    own = counts @ step
    up_row, up = np.nonzero(counts < 64 // PARTS)
    down_row, down = np.nonzero(counts > 0)
    return (np.concatenate([np.arange(len(own)), up_row, down_row]),
            np.concatenate([own, own[up_row] + step[up], own[down_row] - step[down]]))


def _cells(nodes: DataFrame) -> DataFrame:
    """``cell, id, fp``: every node in its own tile and the tiles one step away."""

    def rows(parts) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            fp = batch.column("fp").to_numpy()
            at, tile = neighbour_tiles(part_counts(fp.view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile), pa.array(batch.column("id").to_numpy()[at]), pa.array(fp[at])], names=["cell", "id", "fp"])

    return nodes.mapInArrow(rows, "cell long, id long, fp long")


def _large_cells(nodes: DataFrame) -> DataFrame:
    """``cell, slots`` of the cells above ``CELL`` members, from the sizes of the tiles around them."""

    def own(parts) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            names, n = np.unique(tile_names(fp), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], names=["tile", "n"])

    def around(parts) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            tile = batch.column("tile").to_numpy()
            counts = tile[:, None] >> COUNT_BITS * np.arange(PARTS, dtype=np.int64) & ((1 << COUNT_BITS) - 1)
            at, cell = neighbour_tiles(counts)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(batch.column("n").to_numpy()[at])], names=["cell", "n"])

    tiles = nodes.select("fp").mapInArrow(own, "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n"))
    cells = tiles.mapInArrow(around, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return cells.where(F.col("n") > CELL).select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("slots"))


class _Forest:
    """Union-find over positions; ``join`` says whether two were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up = self.up
        while (b := up.get(a, a)) != a:
            up[a] = up.get(b, b)
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def small_links(group: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Positions that link inside runs of equal ``group``, as a forest: each row is compared
    with the next one of its group, then the one after that, all groups at once."""
    at, lag, forest = np.arange(len(fp)), 0, _Forest()
    while True:
        lag += 1
        at = at[at < len(fp) - lag]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            return
        hits = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= RADIUS].tolist()
        yield from ((a, a + lag) for a in hits if forest.join(a, a + lag))


def large_links(fp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Positions that link, as a forest, tile by tile in the order of population counts."""
    ones = np.bitwise_count(fp).astype(np.int64)
    order = np.argsort(ones, kind="stable")
    x, ones = fp[order], ones[order]
    label = np.arange(len(x))
    for i in range(0, len(x), TILE):
        for j in range(i, len(x), TILE):
            if ones[j] - ones[min(i + TILE, len(x)) - 1] > RADIUS:
                break
            near = np.bitwise_count(x[i : i + TILE, None] ^ x[None, j : j + TILE]) <= RADIUS
            for r in np.flatnonzero(near.any(axis=1)).tolist():
                others, first = np.unique(label[j + np.flatnonzero(near[r])], return_index=True)
                own = label[i + r]
                for other, k in zip(others.tolist(), first.tolist(), strict=True):
                    if other != own:
                        yield int(order[i + r]), int(order[j + np.flatnonzero(near[r])[k]])
                        label[label == other] = own


def _compared(rows: DataFrame) -> DataFrame:
    """Links of the groups ``cell, i, j``, whose rows lie one behind the other."""
    names = ["cell", "i", "j", "id", "fp"]

    def of(group: np.ndarray, ids: np.ndarray, fp: np.ndarray) -> Iterator[tuple]:
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        sizes = np.diff(cuts)
        u = fp.view(np.uint64)
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        back = np.flatnonzero(small)
        found = [(back[a], back[b]) for a, b in small_links(group[small], u[small])]
        for k in np.flatnonzero(sizes > SMALL).tolist():
            found += [(cuts[k] + a, cuts[k] + b) for a, b in large_links(u[cuts[k] : cuts[k + 1]])]
        for a, b in found:
            yield int(ids[a]), int(fp[a]), int(ids[b]), int(fp[b])

    def links(parts) -> Iterator[tuple]:
        held, n = [], 0
        for batch in parts:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            n += batch.num_rows
            if n >= GATHERED:
                cell, i, j, ids, fp = (np.concatenate(c) for c in zip(*held, strict=True))
                same = (cell[1:] == cell[:-1]) & (i[1:] == i[:-1]) & (j[1:] == j[:-1])
                group = np.r_[0, np.cumsum(~same)]
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
                yield from of(group[:cut], ids[:cut], fp[:cut])
                held, n = [[c[cut:] for c in (cell, i, j, ids, fp)]], len(fp) - cut
        if n:
            cell, i, j, ids, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            same = (cell[1:] == cell[:-1]) & (i[1:] == i[:-1]) & (j[1:] == j[:-1])
            yield from of(np.r_[0, np.cumsum(~same)], ids, fp)

    return rows.mapInArrow(lambda parts: batches(links(parts), _LINKS), "ia long, fa long, ib long, fb long")


def links(nodes: DataFrame, tasks: int) -> DataFrame:
    """``a, b``: structs ``(id, fp)`` of fingerprints within the radius, enough to join every component."""
    slots = F.coalesce("slots", F.lit(1))
    slot = F.pmod(F.xxhash64("fp"), slots).cast("int")
    dealt = (
        _cells(nodes).join(_large_cells(nodes), "cell", "left").withColumn("slot", slot)
        .withColumn("other", F.explode(F.sequence(F.lit(0), slots - 1)))
        .select("cell", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "id", "fp"))
    found = _compared(dealt.repartition(tasks, "cell", "i", "j").sortWithinPartitions("cell", "i", "j"))
    node = lambda i, f: F.struct(F.col(i).alias("id"), F.col(f).alias("fp"))
    return found.select(node("ia", "fa").alias("a"), node("ib", "fb").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    tasks = tasks_for(docs)
    stored = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(stored.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("id")), "nodes")
    joined = components(links(nodes, tasks)).select(F.col("node.fp").alias("fp"), F.col("label.id").alias("label"))
    of = nodes.join(joined, "fp", "left").select("fp", F.nullif(F.coalesce("label", "id"), F.lit(NO_ID)).alias("component_id"))
    return stored.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
