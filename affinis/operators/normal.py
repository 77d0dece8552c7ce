"""Least squares per user (or per item) from one pass over the ratings.

A half-sweep of any alternating least-squares model is the same job: route the fixed
side's rows to the stored ratings, sum ``[x 1]'[x 1]`` and ``[x 1]'y`` per key, then
solve one small system per key, a whole batch at a time. What differs between the
models is only the target, the regressors and the solver.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions.vectors import vector_sum
from affinis.operators.layout import Met, RatingStore, arrow_rows, materialise

STATS = "key bigint, n bigint, gram array<double>, rhs array<double>"
FACTORS = "key bigint, bias double, f array<double>"
# Numbers in one temporary array of a half-sweep (16 MB); a task holds several of them.
SLICE_VALUES = 2_000_000
# Products in a run of rows from which on a call of BLAS for it alone is worth its cost.
RUN_VALUES = 600
_LIST = pa.list_(pa.float64())
_SOLVED = pa.schema([
    ("key", pa.int64()), ("bias", pa.float64()), ("f", _LIST), ("n", pa.int64()), ("gram", _LIST), ("rhs", _LIST)])


def list_array(m: np.ndarray) -> pa.ListArray:
    rows, width = m.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))


def matrix(col, width: int) -> np.ndarray:
    """2-d view of an Arrow list column whose rows all have ``width`` entries."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(col), width)


def packed(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(k)


def unpack(flat: np.ndarray, k: int) -> np.ndarray:
    i, j = packed(k)
    full = np.empty((len(flat), k, k))
    full[:, i, j] = flat
    full[:, j, i] = flat
    return full


def _gram_runs(x: np.ndarray, starts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Packed x'x of every run of rows. Runs with many products go to BLAS one by one;
    where they have few, products are formed for many rows at once, in slices so that
    a wide model does not multiply a whole batch by k*k."""
    out = np.zeros((len(starts), len(i)))
    if len(x) >= 4 * len(starts) and len(x) * len(i) >= RUN_VALUES * len(starts):
        square = np.empty((x.shape[1], x.shape[1]))
        for g, (lo, hi) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(x)])):
            np.dot(x[lo:hi].T, x[lo:hi], out=square)
            out[g] = square[i, j]
        return out
    step = max(1, SLICE_VALUES // len(i))
    for lo in range(0, len(x), step):
        part = x[lo:lo + step]
        run = np.searchsorted(starts, np.arange(lo, lo + len(part)), side="right") - 1
        cut = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        out[run[cut]] += np.add.reduceat(part[:, i] * part[:, j], cut, axis=0)
    return out


def _slices(batches: Iterator[pa.RecordBatch], k: int, width: int):
    """Rows in pieces small enough that a sum per row would still fit in 64 MB."""
    step = max(1, 8_000_000 // width)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key = batch.column("key").to_numpy(zero_copy_only=False)
        y = batch.column("y").to_numpy(zero_copy_only=False)
        x = matrix(batch.column("x"), k)
        for lo in range(0, len(key), step):
            yield key[lo:lo + step], y[lo:lo + step], x[lo:lo + step]


def _partials(batches: Iterator[pa.RecordBatch], k: int):
    """Yield ``(keys, n, gram, rhs)`` for runs of equal keys, complete within the
    partition because its rows are sorted by key. Memory: one batch."""
    i, j = packed(k + 1)
    held = None
    for key, y, raw in _slices(batches, k, len(i)):
        x = np.empty((len(key), k + 1))
        x[:, :k] = raw
        x[:, k] = 1.0
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        keys = key[starts]
        n = np.diff(np.r_[starts, len(key)])
        gram = _gram_runs(x, starts, i, j)
        rhs = np.add.reduceat(x * y[:, None], starts, axis=0)
        if held is not None:
            if held[0][0] == keys[0]:
                n[0] += held[1][0]
                gram[0] += held[2][0]
                rhs[0] += held[3][0]
            else:
                yield held
        if len(keys) > 1:
            yield keys[:-1], n[:-1], gram[:-1], rhs[:-1]
        held = keys[-1:], n[-1:].copy(), gram[-1:].copy(), rhs[-1:].copy()
    if held is not None:
        yield held


def _stats_batch(keys, n, gram, rhs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), list_array(gram), list_array(rhs)],
        names=["key", "n", "gram", "rhs"],
    )


def _merge(batches: Iterator[pa.RecordBatch], k: int):
    width = (k + 1) * (k + 2) // 2
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key = batch.column("key").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        cols = [
            key[starts],
            np.add.reduceat(batch.column("n").to_numpy(zero_copy_only=False), starts),
            np.add.reduceat(matrix(batch.column("gram"), width), starts, axis=0),
            np.add.reduceat(matrix(batch.column("rhs"), k + 1), starts, axis=0),
        ]
        if held is not None:
            if held[0][0] == cols[0][0]:
                for c, h in zip(cols[1:], held[1:]):
                    c[0] += h[0]
            else:
                yield held
        if len(starts) > 1:
            yield tuple(c[:-1] for c in cols)
        held = tuple(c[-1:].copy() for c in cols)
    if held is not None:
        yield held


# A solver maps (n, gram, rhs, prior) to (bias, factors), all batched over keys:
# gram is (m, k+1, k+1) and rhs (m, k+1), the last position being the constant.
Solver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _solved(keys, n, gram, rhs, prior, k: int, solver: Solver) -> Iterator[pa.RecordBatch]:
    step = max(1, SLICE_VALUES // ((k + 1) * (k + 1)))
    for lo in range(0, len(keys), step):
        s = slice(lo, lo + step)
        bias, f = solver(n[s].astype(float), unpack(gram[s], k + 1), rhs[s], prior[s])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[s], pa.int64()), pa.array(bias, pa.float64()), list_array(f)],
            names=["key", "bias", "f"],
        )


def key_statistics(rows: DataFrame, k: int, split: bool) -> DataFrame:
    """Normal-equation sums per key; ``rows`` has key, y, x and is sorted by key
    within partitions. ``split`` says that a key may span several partitions."""

    def sums(it):
        for part in _partials(it, k):
            yield _stats_batch(*part)

    stats = rows.mapInArrow(sums, STATS)
    return merge_statistics(stats, k) if split else stats


def partial_statistics(rows: DataFrame, k: int) -> DataFrame:
    """Sums per key within each Arrow batch, for rows in any order (streams)."""

    def sums(it):
        for batch in it:
            if batch.num_rows:
                for part in _partials(iter([batch.sort_by("key")]), k):
                    yield _stats_batch(*part)

    return rows.mapInArrow(sums, STATS)


def merge_statistics(stats: DataFrame, k: int) -> DataFrame:
    """Add up the partial sums of a key."""

    def merge(it):
        for part in _merge(it, k):
            yield _stats_batch(*part)

    return (
        stats.select("key", "n", "gram", "rhs").repartition("key")
        .sortWithinPartitions("key").mapInArrow(merge, STATS)
    )


def _runs_of(met: Met, k: int, regress):
    """``(keys, hot, n, gram, rhs)`` of a part, keys in slices that stay small."""
    i, j = packed(k + 1)
    starts = np.flatnonzero(np.r_[True, met.key[1:] != met.key[:-1]]) if len(met.key) else np.zeros(0, np.int64)
    own_at, _ = met.own.find(met.key[starts]) if len(met.own.ids) else (None, None)
    rows_at_once, keys_at_once = max(1, SLICE_VALUES // (k + 1)), max(1, SLICE_VALUES // len(i))
    ends, lo = np.r_[starts, len(met.key)], 0
    while lo < len(starts):
        # As many whole keys as fit; a key with more rows than that comes in pieces.
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + rows_at_once, side="right")) - 1)
        hi = min(hi, lo + keys_at_once)
        first, last = ends[lo], ends[hi]
        gram, rhs = np.zeros((hi - lo, len(i))), np.zeros((hi - lo, k + 1))
        for piece in range(first, last, rows_at_once):
            rows = slice(piece, min(piece + rows_at_once, last))
            y, raw = regress(met, rows)
            x = np.empty((len(y), k + 1))
            x[:, :k], x[:, k] = raw, 1.0
            cut = np.maximum(starts[lo:hi] - piece, 0) if hi - lo > 1 else np.zeros(1, np.int64)
            gram += _gram_runs(x, cut, i, j)
            rhs += np.add.reduceat(x * y[:, None], cut, axis=0)
        yield met.key[starts[lo:hi]], met.hot[starts[lo:hi]], np.diff(np.r_[starts[lo:hi], last]), gram, rhs, None if own_at is None else own_at[lo:hi]
        lo = hi


def as_they_are(met: Met, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Regressors: the other side's vectors. Target: the rating less the other side's number."""
    at = met.at[rows]
    return met.rating[rows] - met.fixed.v[at], met.fixed.f[at]


def half_sweep(
    store: RatingStore, key: str, k: int, solver: Solver, fixed: DataFrame, *, width: int | None = None,
    prior: DataFrame | None = None, own: DataFrame | None = None, own_width: int = 0, regress=as_they_are,
) -> DataFrame:
    """Solve every ``key`` against the other side; returns ``key, bias, f``.

    ``fixed`` has the other side's ``id, v, f``, routed to the stored ratings
    (``RatingStore.meet``). ``regress`` turns a part's rows into targets and ``k``
    regressors; it may look at ``own`` (``key, v, f``), the key's own rows. ``prior``
    (``key, bias``) gives the solver the bias of the previous sweep. Keys whose ratings
    are spread over several parts are summed first and solved after a merge.
    """
    split, has_prior = store.is_split(key), prior is not None
    if has_prior:
        own, own_width = prior.select(key, F.col("bias").alias("v"), F.array().cast("array<double>").alias("f")), 0

    def task(met: Met) -> pa.Table:
        out = []
        for keys, hot, n, gram, rhs, at in _runs_of(met, k, regress):
            before = met.own.v[at] if has_prior else np.zeros(len(keys))
            for b in _solved(keys[~hot], n[~hot], gram[~hot], rhs[~hot], before[~hot], k, solver):
                out.append(b.append_column("n", pa.nulls(len(b), pa.int64())).append_column("gram", pa.nulls(len(b), _LIST)).append_column("rhs", pa.nulls(len(b), _LIST)))
            if hot.any():
                b = _stats_batch(keys[hot], n[hot], gram[hot], rhs[hot])
                out.append(pa.RecordBatch.from_arrays(
                    [b.column("key"), pa.nulls(len(b), pa.float64()), pa.nulls(len(b), _LIST), *b.columns[1:]], schema=_SOLVED))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=_SOLVED) for b in out], _SOLVED)

    found = store.meet(key, fixed, k if width is None else width, task, f"{FACTORS}, n bigint, gram array<double>, rhs array<double>", own, own_width)
    factors = ["key", "bias", "f"]
    if not split:
        return found.select(*factors).withColumnRenamed("key", key)
    found = materialise(found, "half-sweep")
    merged = merge_statistics(found.where("n is not null"), k)
    return found.where("n is null").select(*factors).withColumnRenamed("key", key).unionByName(solve_statistics(merged, k, solver, key, prior))


def product(store: RatingStore, key: str, fixed: DataFrame, k: int) -> DataFrame:
    """Sparse product: per ``key``, the sum of rating * vector of the other side (``key, f``)."""

    def task(met: Met) -> pa.Table:
        if not len(met.key):
            return pa.table({"key": pa.array([], pa.int64()), "f": pa.array([], _LIST)})
        starts = np.flatnonzero(np.r_[True, met.key[1:] != met.key[:-1]])
        total, step = np.zeros((len(starts), k)), 16_000_000 // max(k, 1)
        run = np.cumsum(np.r_[False, met.key[1:] != met.key[:-1]])
        for lo in range(0, len(met.key), step):
            rows = slice(lo, lo + step)
            part = run[rows]
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            total[part[cut]] += np.add.reduceat(met.fixed.f[met.at[rows]] * met.rating[rows, None], cut, axis=0)
        return pa.table({"key": met.key[starts], "f": list_array(total)})

    sums = store.meet(key, fixed.select(store.KEYS[key], F.lit(0.0).alias("v"), "f"), k, task, "key bigint, f array<double>")
    if store.is_split(key):
        sums = sums.groupBy("key").agg(vector_sum(F.lit(1.0), F.col("f"), k).alias("f"))
    return sums.withColumnRenamed("key", key)


def solve_statistics(stats: DataFrame, k: int, solver: Solver, key: str, prior: DataFrame | None = None) -> DataFrame:
    if prior is None:
        stats = stats.withColumn("prior", F.lit(0.0))
    else:
        before = prior.select(F.col(key).alias("key"), F.col("bias").alias("prior"))
        stats = stats.join(before, "key", "left").fillna(0.0, ["prior"])
    width = (k + 1) * (k + 2) // 2

    def solve(it):
        for b in it:
            if b.num_rows:
                yield from _solved(
                    b.column("key").to_numpy(zero_copy_only=False),
                    b.column("n").to_numpy(zero_copy_only=False),
                    matrix(b.column("gram"), width), matrix(b.column("rhs"), k + 1),
                    b.column("prior").to_numpy(zero_copy_only=False), k, solver,
                )

    return stats.mapInArrow(solve, FACTORS).withColumnRenamed("key", key)


def ridge(k: int, penalty: float) -> Solver:
    """(sum x x' + penalty n I) f = sum y x."""

    def solver(n, gram, rhs, prior):
        a = gram[:, :k, :k] + (penalty * n)[:, None, None] * np.eye(k)
        return np.zeros(len(n)), np.linalg.solve(a, rhs[:, :k, None])[:, :, 0]

    return solver


def ridge_around_mean(k: int, penalty: float) -> Solver:
    """Ridge on ratings centred by the key's own mean, which becomes its bias.

    The sums are over raw ratings: sum (r - m) x = sum r x - m sum x.
    """

    def solver(n, gram, rhs, prior):
        mean = rhs[:, k] / n
        a = gram[:, :k, :k] + (penalty * n)[:, None, None] * np.eye(k)
        b = rhs[:, :k] - mean[:, None] * gram[:, :k, k]
        return mean, np.linalg.solve(a, b[:, :, None])[:, :, 0]

    return solver


def ridge_with_bias(k: int, penalty: float, intercept: float) -> Solver:
    """Factors against the previous bias, then the shrunken mean residual as the new bias."""

    def solver(n, gram, rhs, prior):
        sums = gram[:, :k, k]
        a = gram[:, :k, :k] + (penalty * n)[:, None, None] * np.eye(k)
        b = rhs[:, :k] - (intercept + prior)[:, None] * sums
        f = np.linalg.solve(a, b[:, :, None])[:, :, 0]
        bias = (rhs[:, k] - (f * sums).sum(axis=1)) / n / (1.0 + penalty) - intercept
        return bias, f

    return solver


def joint_ridge(k: int, penalty_w: float, penalty_v: float) -> Solver:
    """Weight and factors of a key solved together, with fixed penalties."""

    def solver(n, gram, rhs, prior):
        a = gram + np.diag([penalty_v] * k + [penalty_w])
        theta = np.linalg.solve(a, rhs[:, :, None])[:, :, 0]
        return theta[:, k], theta[:, :k]

    return solver


def gram_matrix(table: DataFrame, k: int, vec: str = "f") -> np.ndarray:
    """k x k matrix of sum f f' over a whole table: one partial per task, summed
    in Spark by position, so the driver receives k*(k+1)/2 numbers."""
    i, j = packed(k)

    arrow_rows(table.sparkSession, 8 * (k + 1))

    def partial(it):
        total = np.zeros((k, k))
        for b in it:
            if b.num_rows:
                x = matrix(b.column("f"), k)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(i))), pa.array(total[i, j])], names=["pos", "v"])

    rows = (
        table.select(F.col(vec).alias("f")).mapInArrow(partial, "pos bigint, v double")
        .groupBy("pos").agg(F.sum("v").alias("v")).collect()
    )
    flat = np.zeros(len(i))
    for r in rows:
        flat[r["pos"]] = r["v"]
    return unpack(flat[None, :], k)[0]


def times_matrix(table: DataFrame, m: np.ndarray, vec: str = "f") -> DataFrame:
    """Replace the vector of each row by ``vec @ m`` (m is k x k', a constant)."""
    k = m.shape[0]
    at = table.schema.names.index(vec)
    arrow_rows(table.sparkSession, 16 * (k + 4))

    def multiply(it):
        for b in it:
            cols = b.columns
            cols[at] = list_array(matrix(b.column(at), k) @ m)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return table.mapInArrow(multiply, table.schema)


def implicit_step(n, gram, rhs, bias, f, k: int, rate: float, penalty: float, with_bias: bool) -> tuple[np.ndarray, np.ndarray]:
    """One implicit gradient step of every key on its bias and factors together.

    The n serial steps that a key's ratings would take are, to first order in the
    rate, theta + rate (rhs - (gram + penalty n) theta). Taking the gradient at the
    end point instead, theta' = (1 + rate (gram + penalty n))^-1 (theta + rate rhs),
    agrees with them to that order and is stable for any number of ratings.
    """
    size = k + 1 if with_bias else k
    theta = np.column_stack([f, bias])[:, :size]
    a = np.eye(size) + rate * (gram[:, :size, :size] + (penalty * n)[:, None, None] * np.eye(size))
    theta = np.linalg.solve(a, (theta + rate * rhs[:, :size])[:, :, None])[:, :, 0]
    return (theta[:, k] if with_bias else np.zeros(len(n))), theta[:, :k]


def implicit_steps(k: int, factors_start: np.ndarray, epochs: int, rate: float, penalty: float) -> Solver:
    """Implicit steps on one key's bias and factors with the other side fixed.

    They depend on the ratings only through the normal-equation sums, so all epochs
    run on them without touching the ratings again. The bias starts at the prior,
    the factors at ``factors_start``.
    """

    def solver(n, gram, rhs, prior):
        f = np.tile(np.asarray(factors_start, dtype=float), (len(n), 1))
        bias = prior.astype(float)
        for _ in range(epochs):
            bias, f = implicit_step(n, gram, rhs, bias, f, k, rate, penalty, True)
        return bias, f

    return solver


def lasso(k: int, alpha: float, with_bias: bool, method: str = "descent", rounds: int = 1000, tol: float = 1e-9) -> Solver:
    """min 1/(2n) |y - b - x w|^2 + alpha |w|_1 for every key at once.

    ``descent``: cyclic coordinate descent until no weight moves. ``ista``:
    exactly ``rounds`` proximal steps of length n / trace.
    """

    def shrink(v, t):
        return np.sign(v) * np.maximum(np.abs(v) - t, 0.0)

    def solver(n, gram, rhs, prior):
        sums = gram[:, :k, k] if with_bias else np.zeros((len(n), k))
        sy = rhs[:, k] if with_bias else np.zeros(len(n))
        g = (gram[:, :k, :k] - sums[:, :, None] * sums[:, None, :] / n[:, None, None]) / n[:, None, None]
        b = (rhs[:, :k] - sums * (sy / n)[:, None]) / n[:, None]
        w = np.zeros((len(n), k))
        diagonal = np.einsum("mii->mi", g)
        # Columns without spread carry rounding noise only; they keep weight 0.
        live = diagonal > 1e-12
        if method == "ista":
            size = np.maximum(diagonal.sum(axis=1), 1e-12)[:, None]
            for _ in range(rounds):
                w = shrink(w - (np.einsum("mij,mj->mi", g, w) - b) / size, alpha / size)
        else:
            # Only keys whose weights still move, and of those only columns with spread.
            active = np.arange(len(n))
            for _ in range(rounds):
                moved = np.zeros(len(n))
                for j in range(k):
                    at = active[live[active, j]]
                    if len(at):
                        rest = b[at, j] - np.einsum("mi,mi->m", g[at, j], w[at]) + diagonal[at, j] * w[at, j]
                        new = shrink(rest, alpha) / diagonal[at, j]
                        moved[at] = np.maximum(moved[at], np.abs(new - w[at, j]))
                        w[at, j] = new
                active = active[moved[active] >= tol]
                if not len(active):
                    break
            else:
                warnings.warn(f"{len(active)} of {len(n)} regressions still move after {rounds} rounds", RuntimeWarning, stacklevel=2)
        bias = (sy - (sums * w).sum(axis=1)) / n
        return bias, w

    return solver


def pooled_statistics(rows: DataFrame, k: int) -> DataFrame:
    """Sums for a few, mostly hot keys: added up inside each task first, so that
    only one row per task and key is shuffled."""
    return key_statistics(rows.sortWithinPartitions("key"), k, split=True)
