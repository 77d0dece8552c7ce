"""Words, hashes and written tables shared by the operators on texts.

Words are what the contracts call words: maximal runs of anything but space and
\\x09-\\x0D. A null text counts as empty everywhere in this package.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.operators.layout import scratch_path, shuffles_dropped
from affinis.sources.tables import delete_path

SHINGLE_WORDS = 5
# Word hashes a task remembers; beyond it the memory starts anew, results stay.
REMEMBERED = 250_000


# Where ``materialise`` notes its tables, if anybody asked for it.
_noted: list[str] | None = None


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back (see ``layout.materialise``).
    What it was shuffled to on the way is deleted."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    if _noted is not None:
        _noted.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tables_written() -> Iterator[list[str]]:
    """The tables that ``materialise`` writes inside the block."""
    global _noted
    before, _noted = _noted, []
    try:
        yield _noted
    finally:
        _noted = before


def drop_tables(spark, tables: list[str], but: DataFrame) -> list[str]:
    """Delete ``tables``, all but those that ``but`` reads from; returns these."""
    used = but.inputFiles()
    keep = [t for t in tables if any(f"{t.split(':', 1)[-1].rstrip('/')}/" in file for file in used)]
    for path in set(tables) - set(keep):
        delete_path(spark, path)
    return keep


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned, once all that reads them is written."""
    for table in tables:
        files = table.inputFiles()
        if files:
            delete_path(table.sparkSession, files[0].rsplit("/", 1)[0])


def kept(name: str, make):
    """A value that a Python worker keeps from task to task, made by the first that asks.

    Only for caches: a new worker starts without them and gets the same results. One at a
    time: workers live on from operator to operator, and would add up what each remembers.
    """
    state = sys.modules.setdefault("affinis_worker_state", types.ModuleType("affinis_worker_state"))
    if name not in state.__dict__:
        for other in [n for n in state.__dict__ if not n.startswith("__")]:
            del state.__dict__[other]
        state.__dict__[name] = make()
    return state.__dict__[name]


def word_hashes() -> WordHashes:
    return kept("word_hashes", WordHashes)


class WordHashes(dict):
    """word -> 64-bit hash, computed at the first use of a word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a UTF-8 text."""
    return text.lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(total)]
    return mixed(total)


def shingles(h: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Every n-word shingle in order; a shorter text is one shingle, an empty one none."""
    return runs(h, min(n, len(h))) if len(h) else h


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def pairs_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch; the column ``text`` comes as UTF-8 bytes or None."""
    columns = [
        batch.column(n).cast(pa.large_binary()).to_pylist() if n == "text" else batch.column(n).to_pylist() for n in names]
    return zip(*columns, strict=True)


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows gathered into record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def documents(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators read, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while a column of ``df`` has it (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Above this the optimizer's size is no estimate but its word for "unknown" (4 PB).
UNKNOWN_BYTES = 1 << 52


def tasks_for(df: DataFrame, mb: float = 16.0) -> int:
    """Partitions for a shuffle of work that follows the size of ``df``."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:
        return max(least, df.rdd.getNumPartitions())
    return max(least, int(size / (mb * 1e6)) + 1)
