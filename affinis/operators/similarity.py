"""Exact nearest neighbours over sparse rating rows, in tiles.

Comparing users through a self join on the item would shuffle one row per pair
of raters: the square of the popularity of every item. Here users are hashed
into blocks and each task compares two blocks. The ratings of both blocks
stream past in item order and are multiplied into one block x block
accumulator, so memory is bounded by the block size whatever the popularity of
an item or the length of a user's history, and only each user's k best
candidates per block leave the task.

A rating enters as many tiles as there are blocks, and every tile names k candidates. Above
``SENT_BLOCKS`` blocks rows are therefore not sent to tiles: blocks are written once to the
shared folder, and a task takes one block, reads the others one by one and keeps only the
best k so far. What is written and sent then grows with the ratings alone. Blocks with few
common items are compared through the pairs that share one.

Where most users share no item, every pair of blocks costs reading them and little else, so
blocks are wide: only pairs with a common item are formed, a run of rows at a time, and users
without one are filled in at the end, by id, where a row has too few. Where most users share
items, raters are found from the other end: what a user's weakest request would still take is
compared with all similarities at once, and only the few that pass are looked up.

Similarities are rounded to nine decimals before they are compared, so that
ties are decided by id and not by the order of floating-point additions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.operators.layout import PACKED_ROWS, PIECEWISE, arrow_rows, cores, distinct, is_mounted, local_path, scratch_path
from affinis.operators.normal import matrix

# A tile of this many users squared takes 32 MB; bigger blocks mean fewer copies
# of each rating (one per block), smaller ones less memory per task.
BLOCK = 2048
TILES_PER_TASK = 16
# Up to so many blocks, rows are sent to every tile of their block.
SENT_BLOCKS = 8
# Users and ratings of a block where most users share no item, and from how many common items
# of two users on, in the mean over all pairs, blocks are compared densely.
WIDE_USERS, WIDE_RATINGS = 65_536, 1_500_000
DENSE_ITEMS = 1 / 16
# Bytes of a stored row group: about what a reader holds beside a block.
STORED_BYTES = 8 << 20
DECIMALS = 9
_PAIRS_AT_ONCE = 2_000_000
# Pairs formed at once between wide blocks, candidates that wait before the best are sorted, what is
# sorted at once, and numbers of a dense array.
_MET, _HELD, _SORTED, _CELLS = 500_000, 500_000, 500_000, 4_000_000

LEFT, RIGHT = 0, 1
USERS, RATINGS, TARGETS = 0, 1, 2
NEIGHBOURS = "user bigint, neighbor bigint, sim double"
RATERS = "user bigint, item bigint, rater bigint, sim double, rating double"


def _expand(li: np.ndarray, n_right: np.ndarray, start_right: np.ndarray, item_of_left: np.ndarray):
    """Index pairs (left entry, right entry) that share an item, in bounded chunks."""
    reps = n_right[item_of_left]
    ends = np.cumsum(reps)
    lo, done = 0, 0
    while lo < len(li):
        hi = max(lo + 1, int(np.searchsorted(ends, done + _PAIRS_AT_ONCE, side="right")))
        rep = reps[lo:hi]
        total = int(rep.sum())
        if total:
            left = np.repeat(np.arange(lo, hi), rep)
            within = np.arange(total) - np.repeat(np.cumsum(rep) - rep, rep)
            yield left, start_right[item_of_left[left]] + within
        lo, done = hi, int(ends[hi - 1])


def _by_item(item: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[True, item[1:] != item[:-1]]) - 1


class _Tile:
    """State of one pair of blocks while its rows stream past."""

    def __init__(self, a: int, b: int, mirror: bool, k: int | None, skip_self: bool, finish):
        self.a, self.b, self.k, self.skip_self, self.finish_with = a, b, k, skip_self, finish
        self.diagonal = mirror and a == b
        self.mirror = mirror and a != b
        self.ids = ([], [])
        self.dot = None
        self.sim = None
        self.held: list[tuple] = []

    def add(self, phase, side, user, item, rating) -> Iterator[pa.RecordBatch]:
        for p in (USERS, RATINGS, TARGETS):
            m = phase == p
            if not m.any():
                continue
            if p == USERS:
                for s in (LEFT, RIGHT):
                    self.ids[s].append(user[m & (side == s)])
                continue
            if p == RATINGS:
                self._start()
                yield from self._buffer(item[m], side[m], user[m], rating[m], self._accumulate)
            else:
                if self.sim is None:
                    yield from self._flush(self._accumulate)
                    self._similarity()
                yield from self._buffer(item[m], side[m], user[m], rating[m], self._rank_raters)

    def _start(self) -> None:
        if self.dot is None:
            self.left = np.sort(np.concatenate(self.ids[LEFT]))
            self.right = self.left if self.diagonal else np.sort(np.concatenate(self.ids[RIGHT]))
            self.dot = np.zeros((len(self.left), len(self.right)))
            self.sq = [np.zeros(len(self.left)), np.zeros(len(self.right))]

    def _buffer(self, item, side, user, rating, consume):
        """Hand over whole items only: the last item of a batch may continue."""
        new = (item, side, user, rating)
        cols = [np.concatenate(c) for c in zip(*self.held, new)] if self.held else list(new)
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if cut:
            yield from consume(*[c[:cut] for c in cols])
        self.held = [tuple(c[cut:] for c in cols)]

    def _flush(self, consume):
        if self.held:
            held, self.held = self.held, []
            yield from consume(*[np.concatenate(c) for c in zip(*held)])

    def _accumulate(self, item, side, user, rating):
        it = _by_item(item)
        n_items = it[-1] + 1
        lm = side == LEFT
        rm = lm if self.diagonal else side == RIGHT
        il, ir, vl, vr = it[lm], it[rm], rating[lm], rating[rm]
        li, ri = np.searchsorted(self.left, user[lm]), np.searchsorted(self.right, user[rm])
        np.add.at(self.sq[LEFT], li, vl * vl)
        np.add.at(self.sq[RIGHT], ri, vr * vr)
        n_left, n_right = np.bincount(il, minlength=n_items), np.bincount(ir, minlength=n_items)
        pairs = int((n_left * n_right).sum())
        # A multiply-add in a dense product costs about a fortieth of a scattered one.
        if pairs and self.dot.size * n_items <= 40 * pairs:
            step = max(1, 4_000_000 // max(self.dot.shape))
            for lo in range(0, n_items, step):
                ml, mr = (il >= lo) & (il < lo + step), (ir >= lo) & (ir < lo + step)
                x = np.zeros((len(self.left), min(step, n_items - lo)))
                y = np.zeros((len(self.right), x.shape[1]))
                x[li[ml], il[ml] - lo] = vl[ml]
                y[ri[mr], ir[mr] - lo] = vr[mr]
                self.dot += x @ y.T
        elif pairs:
            flat = self.dot.reshape(-1)
            for i, j in _expand(li, n_right, np.cumsum(n_right) - n_right, il):
                np.add.at(flat, li[i] * len(self.right) + ri[j], vl[i] * vr[j])
        return iter(())

    def _similarity(self) -> None:
        if self.sim is None:
            self._start()
            norms = [np.sqrt(s) for s in self.sq]
            for n in norms:
                n[n == 0] = 1.0
            self.sim = np.round(self.dot / np.outer(*norms), DECIMALS) + 0.0
            if self.skip_self:
                both, i, j = np.intersect1d(self.left, self.right, return_indices=True)
                self.sim[i, j] = -np.inf

    def _rank_raters(self, item, side, user, rating):
        """Best k raters in this tile for each requested (user, item)."""
        it = _by_item(item)
        lm, rm = side == LEFT, side == RIGHT
        ir, rater, rr = it[rm], user[rm], rating[rm]
        asked, who, what = it[lm], user[lm], item[lm]
        li, ri = np.searchsorted(self.left, who), np.searchsorted(self.right, rater)
        n_left, n_right = np.bincount(asked, minlength=it[-1] + 1), np.bincount(ir, minlength=it[-1] + 1)
        start_left, start_right = np.cumsum(n_left) - n_left, np.cumsum(n_right) - n_right

        def out(i, j, sim):
            return pa.RecordBatch.from_arrays(
                [pa.array(who[i]), pa.array(what[i]), pa.array(rater[j]), pa.array(sim), pa.array(rr[j])],
                names=["user", "item", "rater", "sim", "rating"])

        # Popular items: one block of similarities each, cut down to the k-th
        # best value before anything is sorted.
        wide = (n_left * n_right >= 4096) & (n_right > self.k)
        for t in np.flatnonzero(wide):
            i = np.arange(start_left[t], start_left[t] + n_left[t])
            j = np.arange(start_right[t], start_right[t] + n_right[t])
            sim = self.sim[np.ix_(li[i], ri[j])]
            least = -np.partition(-sim, self.k - 1, axis=1)[:, self.k - 1]
            row, col = np.nonzero(sim >= least[:, None])
            yield from self._ranked(i[row], j[col], sim[row, col], rater, out)
        for i, j in _expand(li, np.where(wide, 0, n_right), start_right, asked):
            yield from self._ranked(i, j, self.sim[li[i], ri[j]], rater, out)

    def _ranked(self, i, j, sim, rater, out):
        order = np.lexsort((rater[j], -sim, i))
        i, j, sim = i[order], j[order], sim[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        keep = rank < self.k
        yield out(i[keep], j[keep], sim[keep])

    def _best(self, sim, rows, cols):
        step = max(1, 1_000_000 // len(cols))
        for lo in range(0, len(rows), step):
            yield self._best_slice(sim[lo:lo + step], rows[lo:lo + step], cols)

    def _best_slice(self, sim, rows, cols):
        if self.k is not None and self.k < len(cols):
            order = np.argsort(-sim, axis=1, kind="stable")[:, : self.k]
        else:
            order = np.broadcast_to(np.arange(len(cols)), sim.shape)
        value = np.take_along_axis(sim, order, axis=1).ravel()
        keep = np.isfinite(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(rows, order.shape[1])[keep]), pa.array(cols[order].ravel()[keep]), pa.array(value[keep])],
            names=["user", "neighbor", "sim"])

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.finish_with == "raters":
            # Held rows are of the ranking phase once the similarities exist.
            if self.sim is not None:
                yield from self._flush(self._rank_raters)
            return
        yield from self._flush(self._accumulate)
        self._similarity()
        if len(self.left) and len(self.right):
            yield from self._best(self.sim, self.left, self.right)
            if self.mirror:
                yield from self._best(self.sim.T, self.right, self.left)


def _run(mirror: bool, k: int | None, skip_self: bool, finish: str):
    def run(batches):
        tile = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b, phase, side, user, item, rating = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(a)]):
                if tile is None or (tile.a, tile.b) != (a[lo], b[lo]):
                    if tile is not None:
                        yield from tile.finish()
                    tile = _Tile(a[lo], b[lo], mirror, k, skip_self, finish)
                yield from tile.add(phase[lo:hi], side[lo:hi], user[lo:hi], item[lo:hi], rating[lo:hi])
        if tile is not None:
            yield from tile.finish()

    return run


class _Stored:
    """Blocks written once: which files a block's pieces are in. The users of a block come
    first, so that its ratings name them by their place among these."""

    def __init__(self, rows: DataFrame, blocks: int, label: str):
        names = ["user", "item", "rating"]

        def pack(batches):
            held, now, n, ids, of = [], None, 0, [], None

            def out():
                columns = [np.concatenate(c) for c in zip(*held)]
                if now[1] == RATINGS:
                    columns[0] = np.searchsorted(np.concatenate(ids), columns[0])
                columns = [c.tobytes() for c in columns]
                return pa.RecordBatch.from_arrays(
                    [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), *[pa.array([c], pa.binary()) for c in columns]],
                    names=["block", "phase", *names])

            for b in batches:
                keys = np.stack([b.column(c).to_numpy() for c in ("block", "phase")], axis=1)
                edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if len(keys) else []
                for lo, hi in zip(edges[:-1], edges[1:]):
                    key = keys[lo].tolist()
                    if n and (key != now or n >= PACKED_ROWS):
                        yield out()
                        held, n = [], 0
                    held.append([b.column(c).slice(lo, hi - lo).to_numpy() for c in names])
                    now, n = key, n + hi - lo
                    if key[1] == USERS:
                        ids, of = [*(ids if of == key[0] else []), held[-1][0]], key[0]
            if n:
                yield out()

        arrow_rows(rows.sparkSession, 64)
        dealt = rows.select(_block("user", blocks).alias("block"), "phase", *names).repartition(
            max(1, min(blocks, 16 * cores(rows.sparkSession))), "block").sortWithinPartitions("block", "phase", "item", "user")
        packed = dealt.mapInArrow(pack, "block int, phase int, user binary, item binary, rating binary")
        path = scratch_path(rows.sparkSession, label)
        packed.write.option("compression", "none").option("parquet.enable.dictionary", "false").option(
            "parquet.block.size", str(STORED_BYTES)).options(**PIECEWISE).parquet(path)
        stored = rows.sparkSession.read.schema(packed.schema).parquet(path)
        self.files: dict[int, str] = {}
        for r in stored.select("block", F.input_file_name().alias("file")).distinct().collect():
            self.files[r["block"]] = local_path(r["file"])

    def read(self, block: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """phase -> user, item, rating of a block, by item; of ratings, the user's place."""
        held: dict[int, list] = {}
        if block in self.files:
            with pq.ParquetFile(self.files[block], memory_map=True) as file:
                at = file.read(["block"], use_threads=False).column(0).to_numpy()
                low = 0
                for group in range(file.num_row_groups):
                    n = file.metadata.row_group(group).num_rows
                    if (at[low:low + n] == block).any():
                        table = file.read_row_group(group, use_threads=False)
                        if not (at[low:low + n] == block).all():
                            table = table.filter(pa.array(at[low:low + n] == block))
                        for row, phase in enumerate(table.column("phase").to_pylist()):
                            held.setdefault(phase, []).append([np.frombuffer(table.column(c)[row].as_buffer(), t) for c, t in (
                                ("user", np.int64), ("item", np.int64), ("rating", np.float64))])
                    low += n
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return {p: tuple(np.concatenate(c) for c in zip(*held[p])) if p in held else none for p in (USERS, RATINGS, TARGETS)}


def _grouped(item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a sorted column, where each starts and how often it comes."""
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
    return item[starts], starts, np.diff(np.r_[starts, len(item)])


class _Side:
    """A block in memory: users in order, ratings by item, lengths of the rows."""

    def __init__(self, read):
        self.ids = read[USERS][0]
        row, self.item, self.value = read[RATINGS]
        self.row = row.astype(np.int32)
        self.norm = np.sqrt(np.bincount(self.row, self.value * self.value, len(self.ids)))
        self.norm[self.norm == 0] = 1.0
        self.targets = read[TARGETS]
        self.items, self.starts, self.n_of = _grouped(self.item)


class _ByRow:
    """The left block of many pairs of blocks in which few users share an item."""

    def __init__(self, side: _Side):
        self.ids, self.norm, self.items = side.ids, side.norm, side.items
        order = np.argsort(side.row, kind="stable")
        self.row, self.value = side.row[order].astype(np.int32), side.value[order]
        self.what = np.repeat(np.arange(len(side.items), dtype=np.int32), side.n_of)[order]
        self.edges = np.searchsorted(self.row, np.arange(len(self.ids) + 1))

    def only(self, rows: np.ndarray) -> _ByRow:
        """The same block with the ratings of ``rows`` alone."""
        some = object.__new__(_ByRow)
        some.ids, some.norm, some.items = self.ids, self.norm, self.items
        wanted = np.zeros(len(self.ids), bool)
        wanted[rows] = True
        at = wanted[self.row]
        some.row, some.value, some.what = self.row[at], self.value[at], self.what[at]
        some.edges = np.searchsorted(some.row, np.arange(len(some.ids) + 1))
        return some

    def met(self, right: _Side) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """``low, high, rows, columns, dots``: the pairs with a common item of the rows from low
        to high, by row. The runs of rows follow each other and cover the block."""
        low, n = 0, len(self.ids)
        if len(right.items) and len(self.items):
            at = np.minimum(np.searchsorted(right.items, self.items), len(right.items) - 1)
            here = right.items[at] == self.items
            each, begin = np.where(here, right.n_of[at], 0).astype(np.int32), right.starts[at].astype(np.int32)
            of_rating = each[self.what]
            pairs = np.r_[0, np.cumsum(of_rating)][self.edges]  # before every row
            shift = len(right.ids).bit_length()
            while low < n:
                # As many whole rows as are few pairs, and one at least.
                high = max(low + 1, int(np.searchsorted(pairs, pairs[low] + _MET, side="right")) - 1)
                total = int(pairs[high] - pairs[low])
                entry = self.edges[low] + np.flatnonzero(of_rating[self.edges[low]:self.edges[high]])
                rep, place = of_rating[entry], np.arange(total)
                mine = np.repeat(entry, rep)
                theirs = place + np.repeat(begin[self.what[entry]] - np.cumsum(rep) + rep, rep)
                dots = self.value[mine] * right.value[theirs]
                code = (self.row[mine].astype(np.int64) - low) << shift | right.row[theirs]
                bits = total.bit_length()
                # Sorted as one number with its place: numbers alone sort many times as fast as pairs.
                code = np.sort(code << bits | place)
                order, code = code & ((1 << bits) - 1), code >> bits
                starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if total else place
                code = code[starts]
                dots = np.add.reduceat(dots[order], starts) if total else dots
                yield low, high, (code >> shift) + low, code & ((1 << shift) - 1), dots
                low = high
        if low < n:
            none = np.zeros(0, np.int64)
            yield low, n, none, none, np.zeros(0)


def _common(left: _Side, right: _Side):
    """Dense dot products of two blocks or, where few pairs share an item, ``rows, columns, dots``."""
    items, starts, n_of = left.items, left.starts, left.n_of
    at = np.minimum(np.searchsorted(items, right.item), max(len(items) - 1, 0))
    hit = items[at] == right.item if len(items) else np.zeros(len(right.item), bool)
    at, col, val = at[hit], right.row[hit], right.value[hit]
    pairs, size = int(n_of[at].sum()), len(left.ids) * len(right.ids)
    seen = np.unique(at)
    if pairs and size * len(seen) <= 40 * pairs:
        dot = np.zeros((len(left.ids), len(right.ids)))
        here, of_left = np.zeros(len(items), bool), np.repeat(np.arange(len(items)), n_of)
        here[seen] = True
        number = np.cumsum(here) - 1
        step = max(1, 4_000_000 // max(dot.shape))
        for lo in range(0, len(seen), step):
            ml = here[of_left] & (number[of_left] >= lo) & (number[of_left] < lo + step)
            mr = (number[at] >= lo) & (number[at] < lo + step)
            x, y = np.zeros((len(left.ids), min(step, len(seen) - lo))), np.zeros((len(right.ids), min(step, len(seen) - lo)))
            x[left.row[ml], number[of_left[ml]] - lo] = left.value[ml]
            y[col[mr], number[at[mr]] - lo] = val[mr]
            dot += x @ y.T
        return dot, None
    codes, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, j in _expand(at, n_of, starts, at):
        code, inverse = np.unique(left.row[j].astype(np.int64) * len(right.ids) + col[i], return_inverse=True)
        codes.append(code)
        sums.append(np.bincount(inverse, left.value[j] * val[i], len(code)))
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(sums), len(code))
    return None, (code // max(len(right.ids), 1), code % max(len(right.ids), 1), total)


def _ordered(row: np.ndarray, sim: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """The order by row, then the larger similarity, then the smaller id."""
    whole, scale = np.isfinite(sim), 10**DECIMALS
    if not len(row) or row.max() >= 1 << 17 or np.abs(sim[whole]).max(initial=0) > 8000:
        return np.lexsort((ident, -sim, row))
    # Similarities have nine decimals: a row and one of them are a single number.
    place = np.full(len(row), 1 << 44, np.int64)
    place[whole] = -np.rint(sim[whole] * scale).astype(np.int64)
    key = (row.astype(np.int64) << 45) + (place + (1 << 43))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    order[tied] = order[tied][np.lexsort((ident[order[tied]], key[tied]))]
    return order


class _Best:
    """The k best of every row so far: larger similarity first, then the smaller id."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.sim, self.id = np.full((rows, k), -np.inf), np.full((rows, k), np.iinfo(np.int64).max)
        self.value = np.zeros((rows, k))
        self.least = self.sim[:, -1].copy()
        self.held, self.n_held = [], 0

    def better(self, row, sim, ident):
        """Which of these would still enter."""
        last = self.least[row]
        return (sim > last) | ((sim == last) & (ident < self.id[row, -1]))

    def hold(self, row, sim, ident, value=None) -> None:
        """As ``offer``, of many together, at the latest when ``flush`` is called."""
        ok = self.better(row, sim, ident) & np.isfinite(sim)
        self.held.append([row[ok], sim[ok], ident[ok], np.zeros(int(ok.sum())) if value is None else value[ok]])
        self.n_held += len(self.held[-1][0])
        if self.n_held >= _HELD:
            self.flush()

    def flush(self) -> None:
        if self.n_held:
            held, self.held, self.n_held = self.held, [], 0
            self.offer(*[np.concatenate(c) for c in zip(*held)])

    def offer(self, row, sim, ident, value=None) -> None:
        ok = self.better(row, sim, ident) & np.isfinite(sim)
        if not ok.any():
            return
        row, sim, ident = row[ok], sim[ok], ident[ok]
        value = np.zeros(len(row)) if value is None else value[ok]
        if len(row) > 1:
            order = np.argsort(row, kind="stable")
            row, sim, ident, value = row[order], sim[order], ident[order], value[order]
        some, starts, n_of = _grouped(row)
        edges, lo = starts + n_of + np.arange(1, len(some) + 1) * self.k, 0
        while lo < len(some):
            # A few rows at a time, with what they have and what is new.
            done = edges[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(edges, done + _SORTED, side="right")))
            first, last = starts[lo], starts[hi - 1] + n_of[hi - 1]
            self._merge(some[lo:hi], np.repeat(np.arange(hi - lo), n_of[lo:hi]), sim[first:last], ident[first:last], value[first:last])
            lo = hi

    def _merge(self, some, place, sim, ident, value) -> None:
        row, sim, ident, value = (np.concatenate([old.ravel(), new]) for old, new in (
            (np.repeat(np.arange(len(some)), self.k), place), (self.sim[some], sim), (self.id[some], ident), (self.value[some], value)))
        order = _ordered(row, sim, ident)
        row = row[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        keep = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < self.k
        order = order[keep]
        self.sim[some], self.id[some], self.value[some] = (c[order].reshape(len(some), self.k) for c in (sim, ident, value))
        self.least[some] = self.sim[some, -1]

    def offer_dense(self, rows, sim, ids) -> None:
        """A row of similarities with ``ids`` (in order) for each of ``rows``."""
        step = max(1, 4_000_000 // max(len(ids), 1))
        for lo in range(0, len(rows), step):
            part, own = sim[lo:lo + step], rows[lo:lo + step]
            if len(ids) > self.k:
                # No more than k of one block can enter: below its k-th best nothing does.
                least = np.maximum(np.partition(part, len(ids) - self.k, axis=1)[:, len(ids) - self.k], self.sim[own, -1])
            else:
                least = self.sim[own, -1]
            i, j = np.nonzero(part >= least[:, None])
            self.offer(own[i], part[i, j], ids[j])


def _nearest_of(left: _Side, right: _Side, best: _Best, skip_self: bool) -> None:
    dot, few = _common(left, right)
    if dot is not None:
        sim = np.round(dot / np.outer(left.norm, right.norm), DECIMALS) + 0.0
        rows = np.arange(len(left.ids))
    else:
        i, j, sums = few
        value = np.round(sums / (left.norm[i] * right.norm[j]), DECIMALS) + 0.0
        own = left.ids[i] == right.ids[j] if skip_self else np.zeros(len(i), bool)
        # Users who share nothing have similarity 0, which counts only where the k-th best isn't above.
        rows = np.flatnonzero(best.sim[:, -1] <= 0)
        place = np.full(len(left.ids), -1)
        place[rows] = np.arange(len(rows))
        sim = np.zeros((len(rows), len(right.ids)))
        at = place[i] >= 0
        sim[place[i[at]], j[at]] = value[at]
        best.offer(i[~at & ~own], value[~at & ~own], right.ids[j[~at & ~own]])
    if skip_self and len(rows):
        both, i, j = np.intersect1d(left.ids[rows], right.ids, return_indices=True)
        sim[i, j] = -np.inf
    if len(rows) and len(right.ids):
        best.offer_dense(rows, sim, right.ids)


def _raters_of(left: _Side, right: _Side, best: _Best) -> None:
    """The same among the raters of each requested item; a row of ``best`` is a request."""
    dot, few = _common(left, right)
    if dot is None:
        i, j, sums = few
        dot = np.zeros((len(left.ids), len(right.ids)))
        dot[i, j] = sums
    sim = np.round(dot / np.outer(left.norm, right.norm), DECIMALS) + 0.0
    who, what, _ = left.targets
    asked = np.searchsorted(left.ids, who)
    items, starts, n_of = right.items, right.starts, right.n_of
    at = np.minimum(np.searchsorted(items, what), max(len(items) - 1, 0))
    hit = np.flatnonzero(items[at] == what) if len(items) else np.zeros(0, np.int64)
    edges = np.flatnonzero(np.r_[True, at[hit][1:] != at[hit][:-1], True]) if len(hit) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1], edges[1:]):
        rows, t = hit[lo:hi], at[hit[lo]]
        raters = np.arange(starts[t], starts[t] + n_of[t])
        part = sim[np.ix_(asked[rows], right.row[raters])]
        least = best.sim[rows, -1]
        if len(raters) > best.k and np.isneginf(least).any():
            least = np.maximum(np.partition(part, len(raters) - best.k, axis=1)[:, len(raters) - best.k], least)
        i, j = np.nonzero(part >= least[:, None])
        best.offer(rows[i], part[i, j], right.ids[right.row[raters[j]]], right.value[raters[j]])


def _nearest_met(left: _ByRow, right: _Side, best: _Best, skip_self: bool) -> None:
    """Offers the users who share an item, unless their similarity is 0."""
    for _, _, row, col, dot in left.met(right):
        sim = dot / (left.norm[row] * right.norm[col])
        high = np.flatnonzero(sim >= best.least[row] - 10.0**-DECIMALS)
        row, col, sim = row[high], col[high], np.round(sim[high], DECIMALS) + 0.0
        near = sim != 0
        if skip_self:
            near &= left.ids[row] != right.ids[col]
        best.hold(row[near], sim[near], right.ids[col[near]])


def _fill_zeros(left: _ByRow, right: _Side, best: _Best, skip_self: bool, wanted: np.ndarray) -> None:
    """Offers ``wanted`` rows, in order, the first of the users at similarity 0. ``left`` has the
    ratings of these rows alone."""
    if not len(right.ids):
        return
    for low, high, row, col, dot in left.met(right):
        rows = wanted[np.searchsorted(wanted, low):np.searchsorted(wanted, high)]
        rows = rows[best.better(rows, np.zeros(len(rows)), right.ids[0])]
        if not len(rows):
            continue
        near = np.round(dot / (left.norm[row] * right.norm[col]), DECIMALS) + 0.0 != 0
        row, col = row[near], col[near]
        n_near = np.bincount(row - low, minlength=high - low)
        starts = np.cumsum(n_near) - n_near
        # At most so many of the first users are no candidates; rows with many come first.
        width = np.minimum(n_near[rows - low] + best.k + 1, len(right.ids))
        order = np.argsort(-width, kind="stable")
        rows, width, lo = rows[order], width[order], 0
        while lo < len(rows):
            some, wide = rows[lo:lo + max(1, _CELLS // int(width[lo]))], int(width[lo])
            free = np.ones((len(some), wide), bool)
            each = n_near[some - low]
            at = np.repeat(np.arange(len(some)), each)
            there = col[np.arange(len(at)) + np.repeat(starts[some - low] - np.cumsum(each) + each, each)]
            free[at[there < wide], there[there < wide]] = False
            if skip_self:
                own = np.searchsorted(right.ids[:wide], left.ids[some])
                same = np.flatnonzero(right.ids[:wide][np.minimum(own, wide - 1)] == left.ids[some])
                free[same, own[same]] = False
            i, j = np.nonzero(free & (np.cumsum(free, axis=1) <= best.k))
            best.hold(some[i], np.zeros(len(i)), right.ids[j])
            lo += len(some)


class _Asked:
    """A left block of requests whose users share items with most others."""

    def __init__(self, side: _Side):
        self.side = side
        who, what, _ = side.targets
        asked = np.searchsorted(side.ids, who)
        self.order = np.argsort(asked, kind="stable")
        self.n_asked = np.bincount(asked, minlength=len(side.ids))
        self.first = np.cumsum(self.n_asked) - self.n_asked
        self.universe = distinct(np.concatenate([side.items, what]))
        self.what = np.searchsorted(self.universe, what)
        self.x = None
        if self.fits(len(side.ids)):
            self.x = np.zeros((len(side.ids), len(self.universe)))
            self.x[side.row, np.searchsorted(self.universe, side.item)] = side.value
            self.unit = (self.x / side.norm[:, None]).astype(np.float32)
            # More than the error of an inner product of unit vectors in single precision.
            self.slack = np.float32(2**-22 * (len(self.universe) + 16) + 10.0**-DECIMALS)

    def fits(self, rows: int) -> bool:
        return rows * len(self.universe) <= _CELLS

    def offer(self, right: _Side, best: _Best) -> None:
        """As ``_raters_of``."""
        if self.x is None or not self.fits(len(right.ids)) or not len(self.order):
            return _raters_of(self.side, right, best)
        at = np.minimum(np.searchsorted(self.universe, right.item), len(self.universe) - 1)
        known = self.universe[at] == right.item
        rated = np.full((len(right.ids), len(self.universe)), np.nan)
        rated[right.row[known], at[known]] = right.value[known]
        y = np.nan_to_num(rated, nan=0.0)
        # What the weakest request of a user would still take.
        users = np.flatnonzero(self.n_asked)
        least = np.full(len(self.side.ids), np.inf, np.float32)
        least[users] = np.minimum.reduceat(best.least[self.order], self.first[users])
        near = self.unit @ (y / right.norm[:, None]).astype(np.float32).T >= (least - self.slack)[:, None]
        cell = np.flatnonzero(near)
        if len(cell) > near.size // 64:
            best.flush()
            return _raters_of(self.side, right, best)
        row, col = cell // len(right.ids), cell % len(right.ids)
        step, sim = max(1, _CELLS // len(self.universe)), np.zeros(len(cell))
        for lo in range(0, len(cell), step):
            i, j = row[lo:lo + step], col[lo:lo + step]
            dot = np.einsum("ij,ij->i", self.x[i], y[j])
            sim[lo:lo + step] = np.round(dot / (self.side.norm[i] * right.norm[j]), DECIMALS) + 0.0
        each = self.n_asked[row]
        ends, lo, done = np.cumsum(each), 0, 0
        while lo < len(cell):
            hi = max(lo + 1, int(np.searchsorted(ends, done + _PAIRS_AT_ONCE, side="right")))
            pair = np.repeat(np.arange(lo, hi), each[lo:hi])
            within = np.arange(len(pair)) - np.repeat(ends[lo:hi] - each[lo:hi] - done, each[lo:hi])
            request = self.order[self.first[row[pair]] + within]
            value = rated[col[pair], self.what[request]]
            has = np.flatnonzero(~np.isnan(value))
            best.hold(request[has], sim[pair[has]], right.ids[col[pair[has]]], value[has])
            lo, done = hi, int(ends[hi - 1])


def _by_blocks(left: DataFrame, bl: int, right: DataFrame | None, b: int, k: int, skip_self: bool, finish: str, wide: bool = False) -> DataFrame:
    """The best ``k`` over stored blocks, with ranks: a task has one left block and a run of right ones."""
    spark = left.sparkSession
    mine = _Stored(left, bl, "left-blocks")
    theirs = mine if right is None else _Stored(right, b, "right-blocks")
    runs = min(b, max(1, math.ceil(2 * cores(spark) / bl)))
    raters = finish == "raters"

    def run(batches):
        for batch in batches:
            for number in batch.column("id").to_pylist():
                a, part = divmod(number, runs)
                ours = _Side(mine.read(a))
                best = _Best(len(ours.targets[0]) if raters else len(ours.ids), k)
                others = lambda: (other for n in range(part, b, runs) if len((other := _Side(theirs.read(n))).ids))
                if not len(ours.ids):
                    continue
                if raters:
                    asked = _Asked(ours)
                    for other in others():
                        asked.offer(other, best)
                    best.flush()
                elif wide:
                    rows = _ByRow(ours)
                    ours.row = ours.item = ours.value = None
                    for other in others():
                        _nearest_met(rows, other, best, skip_self)
                    best.flush()
                    short = np.flatnonzero(best.least <= 0)
                    if len(short):
                        rows = rows.only(short)
                        for other in others():
                            _fill_zeros(rows, other, best, skip_self, short)
                            best.flush()
                else:
                    for other in others():
                        _nearest_of(ours, other, best, skip_self)
                keep = np.isfinite(best.sim).ravel()
                keys = [np.repeat(c, k)[keep] for c in (ours.targets[:2] if raters else [ours.ids])]
                values = [best.id.ravel()[keep], best.sim.ravel()[keep], *([best.value.ravel()[keep]] if raters else [])]
                rank = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), best.sim.shape).ravel()[keep]
                for lo in range(0, len(rank), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[lo:lo + 100_000]) for c in (*keys, *values, rank)],
                        names=["user", "item", "rater", "sim", "rating", "rank"] if raters else ["user", "neighbor", "sim", "rank"])

    tasks = spark.range(0, bl * runs, 1, bl * runs)
    found = tasks.mapInArrow(run, (RATERS if raters else NEIGHBOURS) + ", rank int")
    # One task saw all candidates of a row: its ranks are final.
    return found if runs == 1 else _keep_best(found.drop("rank"), k, *(["item", "rater"] if raters else [None, "neighbor"]))


def _is_shared(spark, bl: int, b: int) -> bool:
    return max(bl, b) > SENT_BLOCKS and is_mounted(spark)


def _block(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _rows(phase: int, df: DataFrame) -> DataFrame:
    """Common shape of everything that enters a tile."""
    item = F.col("item") if "item" in df.columns else F.lit(0).cast("bigint")
    rating = F.col("rating").cast("double") if "rating" in df.columns else F.lit(0.0)
    return df.select(F.lit(phase).cast("tinyint").alias("phase"), F.col("user").cast("bigint").alias("user"),
                     item.cast("bigint").alias("item"), rating.alias("rating"))


def _one_side(df: DataFrame, side: int, own: int, others: int) -> DataFrame:
    """Send each row to every tile of its block's row (or column) of the grid."""
    other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    at = df.select("*", _block("user", own).alias("p"), other.alias("q"))
    a, b = ("p", "q") if side == LEFT else ("q", "p")
    return at.select(F.col(a).alias("a"), F.col(b).alias("b"), "phase", F.lit(side).cast("tinyint").alias("side"),
                     "user", "item", "rating")


def _both_sides(df: DataFrame, blocks: int) -> DataFrame:
    """Upper triangle only: similarity is symmetric, so each tile serves both its blocks."""
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    at = df.select("*", _block("user", blocks).alias("p"), other.alias("q"))
    return at.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "phase",
                     F.when(F.col("p") <= F.col("q"), LEFT).otherwise(RIGHT).cast("tinyint").alias("side"),
                     "user", "item", "rating")


def _tile_tasks(spark, count: int) -> int:
    """Every core gets tiles, and no task more than a few, however many there are."""
    return max(1, min(count, max(16 * cores(spark), math.ceil(count / TILES_PER_TASK))))


def _tiles(rows: DataFrame, count: int) -> DataFrame:
    arrow_rows(rows.sparkSession, 64)
    return rows.repartition(_tile_tasks(rows.sparkSession, count), "a", "b").sortWithinPartitions("a", "b", "phase", "item", "side")


def _blocks_for(users: DataFrame, block: int) -> int:
    """Blocks of at most about ``block`` users, and enough of them to give every
    task a tile unless that would make the blocks tiny."""
    n = users.count()
    spread = math.ceil(math.sqrt(2 * cores(users.sparkSession)))
    return max(1, math.ceil(n / block), min(spread, n // 64))


def _wide_blocks(users: DataFrame, ratings: DataFrame, block: int) -> int:
    n, spread = users.count(), math.ceil(math.sqrt(2 * cores(users.sparkSession)))
    return max(1, math.ceil(n / WIDE_USERS), math.ceil(ratings.count() / WIDE_RATINGS), min(spread, n // block))


def _share_little(left: DataFrame, right: DataFrame) -> bool:
    """Whether a user of ``left`` and one of ``right`` share few items, in the mean over all pairs."""
    count = lambda df, name: df.groupBy("item").agg(F.count(F.lit(1)).cast("double").alias(name))
    shared = count(left, "m").join(count(right, "n"), "item").agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0.0
    pairs = left.select("user").distinct().count() * right.select("user").distinct().count()
    return shared < DENSE_ITEMS * pairs


def _keep_best(found: DataFrame, k: int, item: str | None = None, ident: str = "neighbor") -> DataFrame:
    best = Window.partitionBy("user", *([item] if item else [])).orderBy(F.desc("sim"), ident)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def similarities(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cosine of every left row with every right row (0 where nothing is co-rated).

    The result has |left| x |right| rows by definition: ``left`` is meant to be a
    handful of profiles.
    """
    lu, ru = left.select("user").distinct(), right.select("user").distinct()
    bl, br = _blocks_for(lu, block), _blocks_for(ru, block)
    rows = (
        _one_side(_rows(USERS, lu).unionByName(_rows(RATINGS, left)), LEFT, bl, br)
        .unionByName(_one_side(_rows(USERS, ru).unionByName(_rows(RATINGS, right)), RIGHT, br, bl))
    )
    return _tiles(rows, bl * br).mapInArrow(_run(False, None, False, "best"), NEIGHBOURS)


def top_neighbours(
    ratings: DataFrame, k: int, queries: DataFrame | None = None, new_ratings: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """user, neighbor, sim, rank: the k most similar users by cosine, never oneself.

    Users without a co-rated item have similarity 0 and are legal neighbours.
    ``queries`` (column user) restricts the work to those users. ``new_ratings``
    are rows of users outside ``ratings``, compared with everyone in it.
    """
    users = ratings.select("user").distinct()
    b = _blocks_for(users, block)
    everyone = _rows(USERS, users).unionByName(_rows(RATINGS, ratings))
    if queries is None and new_ratings is None and _is_shared(ratings.sparkSession, b, b):
        wide = _share_little(ratings, ratings)
        b = _wide_blocks(users, ratings, block) if wide else b
        return _by_blocks(everyone, b, None, b, k, True, "best", wide)
    if queries is None and new_ratings is None:
        found = _tiles(_both_sides(everyone, b), b * (b + 1) // 2).mapInArrow(
            _run(True, k, True, "best"), NEIGHBOURS)
        return _keep_best(found, k)
    if new_ratings is not None:
        left, ask = new_ratings, new_ratings.select("user").distinct()
    else:
        ask = queries.select("user").distinct()
        left = ratings.join(ask, "user", "left_semi")
    bl = _blocks_for(ask, block)
    asking = _rows(USERS, ask).unionByName(_rows(RATINGS, left))
    if _is_shared(ratings.sparkSession, bl, b):
        wide = _share_little(left, ratings)
        if wide:
            bl, b = _wide_blocks(ask, left, block), _wide_blocks(users, ratings, block)
        return _by_blocks(asking, bl, everyone, b, k, new_ratings is None, "best", wide)
    rows = _one_side(asking, LEFT, bl, b).unionByName(_one_side(everyone, RIGHT, b, bl))
    found = _tiles(rows, bl * b).mapInArrow(_run(False, k, new_ratings is None, "best"), NEIGHBOURS)
    return _keep_best(found, k)


def nearest_raters(pairs: DataFrame, ratings: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """user, item, rater, sim, rating: for each pair, the k users most similar to
    the user among those who rated the item (the user included)."""
    users, ask = ratings.select("user").distinct(), pairs.select("user").distinct()
    b, bl = _blocks_for(users, block), _blocks_for(ask, block)
    left = (
        _rows(USERS, ask).unionByName(_rows(RATINGS, ratings.join(ask, "user", "left_semi")))
        .unionByName(_rows(TARGETS, pairs.select("user", "item").distinct()))
    )
    right = _rows(USERS, users).unionByName(_rows(RATINGS, ratings))
    if _is_shared(ratings.sparkSession, bl, b):
        return _by_blocks(left, bl, right, b, k, False, "raters")
    rows = _one_side(left, LEFT, bl, b).unionByName(_one_side(right.unionByName(_rows(TARGETS, ratings)), RIGHT, b, bl))
    found = _tiles(rows, bl * b).mapInArrow(_run(False, k, False, "raters"), RATERS)
    return _keep_best(found, k, "item", "rater")


def nearest_vectors(
    vectors: DataFrame, dim: int, k: int, queries: DataFrame | None = None, skip_self: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """user, neighbor, distance, f: the k nearest rows by Euclidean distance.

    ``vectors`` has user and f; ``queries`` the same, by default the vectors
    themselves. ``skip_self`` excludes a row's own id. The neighbour's vector
    comes along, so that averaging needs no further join.
    """
    ask = vectors if queries is None else queries
    b, bl = _blocks_for(vectors, block), _blocks_for(ask, block)

    def side(df: DataFrame, s: int, own: int, others: int) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        at = df.select("user", "f", _block("user", own).alias("p"), other.alias("q"))
        a, c = ("p", "q") if s == LEFT else ("q", "p")
        return at.select(F.col(a).alias("a"), F.col(c).alias("b"), F.lit(s).alias("side"),
                         F.col("user").cast("bigint").alias("user"), "f")

    arrow_rows(vectors.sparkSession, 8 * (dim + 4))
    rows = side(ask, LEFT, bl, b).unionByName(side(vectors, RIGHT, b, bl))
    tiles = rows.repartition(_tile_tasks(rows.sparkSession, bl * b), "a", "b").sortWithinPartitions(
        "a", "b", "side", "user")

    def emit(parts):
        sides = [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]
        s, user, f = (np.concatenate(c) for c in sides)
        lu, ru, lf, rf = user[s == LEFT], user[s == RIGHT], f[s == LEFT], f[s == RIGHT]
        if not len(lu) or not len(ru):
            return
        # Differences, in slices: the expanded form loses the digits of near points.
        for lo in range(0, len(lu), step := max(1, 4_000_000 // (len(ru) * dim))):
            d = np.sqrt(((lf[lo:lo + step, None, :] - rf[None, :, :]) ** 2).sum(axis=2))
            d = np.round(d, DECIMALS)
            if skip_self:
                d[lu[lo:lo + step, None] == ru[None, :]] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(d, order, axis=1).ravel()
            keep, at = np.isfinite(value), order.ravel()
            flat = np.ascontiguousarray(rf[at[keep]])
            offsets = np.arange(len(flat) + 1, dtype=np.int32) * dim
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(lu[lo:lo + step], order.shape[1])[keep]), pa.array(ru[at[keep]]),
                 pa.array(value[keep]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))],
                names=["user", "neighbor", "distance", "f"])

    def run(batches):
        code, parts = None, []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, c, s, user = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("a", "b", "side", "user")]
            f = matrix(batch.column("f"), dim)
            cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(a)]):
                if code != (a[lo], c[lo]) and parts:
                    yield from emit(parts)
                    parts = []
                code = (a[lo], c[lo])
                parts.append((s[lo:hi], user[lo:hi], f[lo:hi]))
        if parts:
            yield from emit(parts)

    found = tiles.mapInArrow(run, "user bigint, neighbor bigint, distance double, f array<double>")
    best = Window.partitionBy("user").orderBy("distance", "neighbor")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
