"""Sharding along a Hilbert curve (operator 3).

Several metadata columns of a document are quantised to a few bits each; the cell's
index on the Hilbert curve orders the documents, and equal runs of that order are the
shards. Neighbours on the curve are neighbours in every dimension, so a file's minimum
and maximum are narrow in all of them and readers can skip files by any.

The order is made by one range sort, written: files are the pieces of the curve. A
document's rank is its place in its file plus the rows of the files before it, so no
task sees more than its range, and a value that a third of all rows share is split like
any other, because ids break ties.

Law ``rows``: with n documents, shard s holds ranks from ceil(s n / shards) on, so
counts are at most one apart.

Defined cases: a null text has size 1 and checksum 0 of an empty text; null metadata is
the cell 0 of its dimension; rows without doc_id come first in their cell. Repeated rows
each get a place. An empty table gives no shards. The other columns go along unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.text import free_name, materialise

BITS = 6
SHARDS = 8


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell coordinates (0 to 2**bits - 1)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    # Undo the rotations and reflections of every level, from the coarsest on.
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0]) ^ swap
            if i:  # a coordinate does not swap with itself
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x = [v ^ fix for v in x]
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | ((v >> bit) & 1)
    return out


def name_cell(value: Column) -> Column:
    """Cell of a name: 1 and up by checksum, null is 0."""
    return F.coalesce(1 + F.crc32(value.cast("string")) % ((1 << BITS) - 1), F.lit(0)).cast("int")


def size_cell(value: Column) -> Column:
    """Cell of a size: three to a doubling; null is 0."""
    steps = F.floor(3 * F.log2(1 + F.greatest(value.cast("double"), F.lit(0.0))))
    return F.coalesce(F.least(steps, F.lit((1 << BITS) - 1)), F.lit(0)).cast("int")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 1


def document_cells(docs: DataFrame) -> list[Column]:
    """Source, language and size; a column that the table lacks is left out."""
    names = [name_cell(F.col(c)) for c in ("source", "lang") if c in docs.columns]
    return [*names, size_cell(size_of(F.col("text")))]


def curve(cells: list[Column]) -> Column:
    @F.pandas_udf("long")
    def index(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(hilbert_index(np.column_stack([c.to_numpy() for c in columns])))

    return index(*cells)


def sharded(docs: DataFrame, cells: list[Column], shards: int = SHARDS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` in curve order with three more columns, and their names: ``curve``, ``shard``, ``slot``.

    Names that ``docs`` has already get an underscore.
    """
    spark = docs.sparkSession
    names = {n: free_name(docs, n) for n in ("curve", "shard", "slot", "place", "part", "before")}
    c = {k: F.col(f"`{v}`") for k, v in names.items()}
    lined = docs.withColumn(names["curve"], curve(cells))
    order = [c["curve"], F.col("doc_id")]
    lined = lined.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(names["place"], F.monotonically_increasing_id())
    stored = materialise(lined, "curve")
    part = F.shiftright(c["place"], 33).cast("int")
    counts = stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    total, firsts = 0, []
    for row in counts:  # one row per partition of the sort
        firsts.append((row["part"], total))
        total += row["n"]
    before = spark.createDataFrame(firsts, f"`{names['part']}` int, `{names['before']}` long")
    rank = c["before"] + c["place"].bitwiseAND((1 << 33) - 1)
    shard = F.expr(f"cast((`{names['before']}` + (`{names['place']}` & {(1 << 33) - 1})) * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"({total} * cast(`{names['shard']}` as bigint) + {shards - 1}) div {shards}")
    out = (
        stored.withColumn(names["part"], part).join(F.broadcast(before), names["part"])
        .withColumn(names["shard"], shard).withColumn(names["slot"], rank - first).drop(*[names[x] for x in ("place", "part", "before")]))
    return out, {k: names[k] for k in ("curve", "shard", "slot")}


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Shard folders of parquet files in curve order."""
    out, names = sharded(docs, document_cells(docs), shards)
    out.sortWithinPartitions(names["shard"], names["slot"]).write.partitionBy(names["shard"]).parquet(path)
