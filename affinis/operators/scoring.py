"""Inner products of pairs of rows, without a shuffle that carries a vector.

Joined to their vectors, pairs take k numbers each through every exchange and sort that
follows. Here both tables are written once to the shared folder, as for a half-sweep.
Pairs are dealt by user with their own columns only, and a task takes up to ``CHUNK_ROWS`` of them,
reads their users' vectors and then the items piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.vectors import zeros
from affinis.operators.layout import (
    BROADCAST_BYTES, PART_BYTES, Rows, arrow_rows, distinct, is_mounted, share_rows, shared_files, shared_pieces)

# Pairs that a task works on at once, and how often it counts their users meanwhile.
CHUNK_ROWS, COUNTED_ROWS = 1_000_000, 100_000
# Shorter vectors take no more room in an exchange than the pairs themselves.
LEAST_WIDTH = 8
SLICE_VALUES = 2_000_000
_IDS = ("tinyint", "smallint", "int", "bigint")


def worth_it(pairs: DataFrame, items: DataFrame, k: int) -> bool:
    """Whether the vectors are long and the items too many to be sent to every executor."""
    types = [dict(pairs.dtypes).get("user"), dict(pairs.dtypes).get("item"), dict(items.dtypes)["item"]]
    return (
        k >= LEAST_WIDTH and not pairs.isStreaming and all(t in _IDS for t in types) and is_mounted(pairs.sparkSession)
        and items.count() * 8 * (k + 4) > BROADCAST_BYTES)


def _vector(f: Column, k: int) -> Column:
    """A vector without a value, or with too few, has product 0, as in ``dot`` made 0 where null."""
    whole = (F.size(f) >= k) & ~F.exists(f, lambda e: e.isNull())
    return F.coalesce(F.when(whole, F.slice(f, 1, k)), zeros(k))


def _chunks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.Table]:
    held, rows, new, users = [], 0, 0, np.zeros(0, np.int64)
    for batch in batches:
        held.append(batch)
        rows, new = rows + batch.num_rows, new + batch.num_rows
        if new >= COUNTED_ROWS or rows >= CHUNK_ROWS:
            late = pa.Table.from_batches(held).column("user").slice(rows - new)
            users, new = distinct(np.r_[users, late.cast(pa.int64()).fill_null(0).to_numpy()]), 0
            if rows >= CHUNK_ROWS or len(users) * 8 * (k + 2) >= PART_BYTES:
                yield pa.Table.from_batches(held)
                held, rows, users = [], 0, np.zeros(0, np.int64)
    if rows:
        yield pa.Table.from_batches(held)


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return column.cast(pa.int64()).fill_null(0).to_numpy(), ~column.is_null().to_numpy()


def _scored(table: pa.Table, k: int, users: list[str], items: list[str]) -> pa.Table:
    user, has_user = _ids(table.column("user"))
    item, has_item = _ids(table.column("item"))
    rows = Rows.wanted(users, k, user[has_user])
    at, known = rows.find(user)
    known &= has_user
    user_bias, item_bias, product = (np.zeros(len(user)) for _ in range(3))
    user_bias[known] = rows.v[at[known]]
    order = np.flatnonzero(has_item)
    order = order[np.argsort(item[order], kind="stable")]
    wanted, first, n = np.unique(item[order], return_index=True, return_counts=True)
    step = max(1, SLICE_VALUES // k)
    for ids, v, f in shared_pieces(items, k) if len(wanted) else ():
        met = np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)
        piece = np.flatnonzero(wanted[met] == ids)
        met = met[piece]
        # Every pair of the piece's items, and where its item is in the piece.
        each = n[met]
        pair = order[np.repeat(first[met] - np.cumsum(each) + each, each) + np.arange(each.sum())]
        there = np.repeat(piece, each)
        item_bias[pair] = v[there]
        pair, there = pair[known[pair]], there[known[pair]]
        for lo in range(0, len(pair), step):
            a, b = rows.f[at[pair[lo:lo + step]]], f[there[lo:lo + step]]
            total = a[:, 0] * b[:, 0]
            for j in range(1, k):  # in the order of ``dot``
                total += a[:, j] * b[:, j]
            product[pair[lo:lo + step]] = total
    for name, values in (("__ub", user_bias), ("__ib", item_bias), ("__product", product), ("__known", known)):
        table = table.append_column(name, pa.array(values))
    return table


def with_products(pairs: DataFrame, users: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``pairs`` and the biases, the inner product (0 where a row is missing), and whether
    the user has a row: ``__ub, __ib, __product, __known``. Users and items occur once."""
    spark = pairs.sparkSession

    def shared(of: str, table: DataFrame) -> list[str]:
        rows = table.select(of, F.coalesce("bias", F.lit(0.0)).alias("v"), _vector(F.col("f"), k).alias("f"))
        return shared_files(spark, share_rows(of, rows, k))

    mine, theirs = shared("user", users), shared("item", items)

    def run(batches):
        for table in _chunks(batches, k):
            yield from _scored(table, k, mine, theirs).combine_chunks().to_batches(max_chunksize=10_000)

    arrow_rows(spark, 64)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.hint("rebalance", "user").mapInArrow(
        run, schema + ", __ub double, __ib double, __product double, __known boolean")
