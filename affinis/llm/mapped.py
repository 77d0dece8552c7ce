"""Sorted tables that tasks map into memory.

Spark writes the table in key order to the shared scratch folder. The first worker of an
executor that needs it lays its columns out as flat files in the executor's own work
folder; all workers there map those. A lost executor's replacement does the same again.
"""

from __future__ import annotations

import fcntl
import os
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from affinis.llm.text import materialise, scratch_path

ROWS_PER_FILE = 1_000_000
BYTES = "bytes"


class MappedTable:
    """Where a published table is. ``columns``: name -> numpy type, or ``BYTES`` for texts."""

    def __init__(self, name: str, paths: list[str], rows: int, columns: dict, mounted: bool):
        self.name, self.paths, self.rows, self.columns, self.mounted = name, paths, rows, columns, mounted

    def arrays(self) -> dict[str, np.ndarray]:
        """Columns by name; a ``BYTES`` column ``c`` comes as ``c`` (all bytes) and ``c_at`` (offsets)."""
        base, out = self._laid_out(), {}
        for c, kind in self.columns.items():
            if kind == BYTES:
                out[c + "_at"] = np.load(f"{base}-{c}_at.npy", mmap_mode="r")
                out[c] = self._mapped(f"{base}-{c}.bin")
            else:
                out[c] = np.load(f"{base}-{c}.npy", mmap_mode="r") if self.rows else np.zeros(0, kind)
        return out

    def _laid_out(self) -> str:
        base = os.path.join(SparkFiles.getRootDirectory(), self.name)
        with open(base + ".lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not os.path.exists(base + ".done"):
                self._lay_out(base)
                open(base + ".done", "w").close()
        return base

    @staticmethod
    def _mapped(path: str) -> np.ndarray:
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)

    def _lay_out(self, base: str) -> None:
        plain = {c: k for c, k in self.columns.items() if k != BYTES}
        texts = [c for c, k in self.columns.items() if k == BYTES]
        create = lambda c, kind, n: np.lib.format.open_memmap(f"{base}-{c}.npy", "w+", kind, (n,))
        out = {c: create(c, kind, self.rows) for c, kind in plain.items()} if self.rows else {}
        at = {c: create(c + "_at", np.int64, self.rows + 1) for c in texts}
        blobs = {c: open(f"{base}-{c}.bin", "wb") for c in texts}
        row = 0
        for path in self.paths:
            with pq.ParquetFile(self._local(path)) as file:
                for batch in file.iter_batches(200_000, columns=list(self.columns)):
                    for c, array in out.items():
                        array[row : row + len(batch)] = batch.column(c).to_numpy(zero_copy_only=False)
                    for c in texts:
                        values = batch.column(c).cast(pa.large_binary()).to_pylist()
                        at[c][row + 1 : row + 1 + len(values)] = at[c][row] + np.cumsum([len(v) for v in values])
                        blobs[c].write(b"".join(values))
                    row += len(batch)
        for file in blobs.values():
            file.close()
        if row != self.rows:
            raise OSError(f"{self.name}: {row} rows of {self.rows}")

    def _local(self, path: str) -> str:
        """A shared folder that is mounted is read where it is; else Spark has sent the file."""
        return unquote(urlparse(path).path) if self.mounted else SparkFiles.get(os.path.basename(path))


class MappedCounts(MappedTable):
    """Counts under keys of ``bits`` leading bits and a 40-bit remainder, in key order.

    It is made of pieces, rows of bytes that each cover a range of leading bits: the
    remainders (32 and 8 bits), counts of one byte, how many keys share each value of the
    leading bits, and the counts that don't fit a byte with their places. The leading bits
    themselves aren't stored; offsets per value stand for them.
    """

    WIDE = 255
    FIELDS = {"low": np.uint32, "high": np.uint8, "count": np.uint8}

    def __init__(self, name: str, paths: list[str], bits: int, pieces: dict[int, tuple[int, int]], mounted: bool):
        rows = sum(n for _, n in pieces.values())
        super().__init__(name, paths, rows, {}, mounted)
        self.bits, self.pieces = bits, pieces  # piece -> (first value of its leading bits, keys)

    @classmethod
    def packed(cls, top: np.ndarray, rest: np.ndarray, count: np.ndarray, first: int, values: int) -> tuple[bytes, ...]:
        """A piece of keys in order whose leading bits are ``first`` .. ``first + values - 1``."""
        wide = np.flatnonzero(count >= cls.WIDE)
        return tuple(x.tobytes() for x in (
            (rest & np.uint64(0xFFFFFFFF)).astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint8), np.minimum(count, cls.WIDE).astype(np.uint8),
            np.bincount((top - np.uint64(first)).astype(np.int64), minlength=values).astype(np.uint32), wide.astype(np.int64), count[wide].astype(np.int64)))

    def _lay_out(self, base: str) -> None:
        create = lambda c, kind, n: np.lib.format.open_memmap(f"{base}-{c}.npy", "w+", kind, (n,))
        out = {c: create(c, kind, max(self.rows, 1)) for c, kind in self.FIELDS.items()}
        sizes = np.zeros((1 << self.bits) + 1, np.int64)
        starts, at = {}, 0
        for piece in sorted(self.pieces):
            starts[piece] = at
            at += self.pieces[piece][1]
        wide, seen = [], 0
        for path in self.paths:
            with pq.ParquetFile(self._local(path)) as file:
                for group in range(file.num_row_groups):
                    # Other kinds of rows in the file have no piece.
                    rows = file.read_row_group(group, columns=["piece", *self.FIELDS, "sizes", "wide_at", "wide"])
                    for row in rows.filter(rows.column("piece").is_valid()).to_pylist():
                        first, n = self.pieces[row["piece"]]
                        for c, kind in self.FIELDS.items():
                            out[c][starts[row["piece"]] : starts[row["piece"]] + n] = np.frombuffer(row[c], kind)
                        per_value = np.frombuffer(row["sizes"], np.uint32)
                        sizes[first + 1 : first + 1 + len(per_value)] = per_value
                        wide.append((starts[row["piece"]] + np.frombuffer(row["wide_at"], np.int64), np.frombuffer(row["wide"], np.int64)))
                        seen += n
        if seen != self.rows:
            raise OSError(f"{self.name}: {seen} keys of {self.rows}")
        np.save(f"{base}-offsets.npy", np.cumsum(sizes).astype(np.uint32 if self.rows < 1 << 32 else np.int64))
        place, value = (np.concatenate([w[k] for w in wide]) if wide else np.zeros(0, np.int64) for k in range(2))
        order = np.argsort(place)
        np.save(f"{base}-wide.npy", np.stack([place[order], value[order]]))

    def arrays(self) -> dict[str, np.ndarray]:
        base = self._laid_out()
        return {c: np.load(f"{base}-{c}.npy", mmap_mode="r") for c in (*self.FIELDS, "offsets", "wide")}

    @staticmethod
    def find(arrays: dict[str, np.ndarray], top: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Counts of the keys, 0 where a key isn't there, by binary search inside the leading bits."""
        low, end = arrays["offsets"][top].astype(np.int64), arrays["offsets"][top + np.uint64(1)].astype(np.int64)
        last, high = len(arrays["low"]) - 1, end
        key_at = lambda at: arrays["low"][at] | arrays["high"][at].astype(np.uint64) << np.uint64(32)
        left = np.flatnonzero(low < high)  # most ranges are a few keys, those of frequent words are long
        high = high.copy()
        while len(left):
            middle = (low[left] + high[left]) >> 1
            less = key_at(middle) < rest[left]
            low[left[less]], high[left[~less]] = middle[less] + 1, middle[~less]
            left = left[low[left] < high[left]]
        at = np.minimum(low, last)
        count = np.where((low < end) & (key_at(at) == rest), arrays["count"][at], 0).astype(np.int64)
        wide = count == MappedCounts.WIDE
        if wide.any():
            places_, values = arrays["wide"]
            count[wide] = values[np.searchsorted(places_, at[wide])]
        return count


def publish_counts(stored: DataFrame, bits: int, pieces: dict[int, tuple[int, int]], mounted: bool | None = None) -> MappedCounts:
    """A table already written with the pieces of a :class:`MappedCounts` (``piece`` and its bytes)."""
    spark, paths = stored.sparkSession, sorted(stored.inputFiles())
    if mounted is None:
        mounted = urlparse(scratch_path(spark, "counts")).scheme in ("", "file")
    if not mounted:
        for path in paths:
            spark.sparkContext.addFile(path)
    name = os.path.basename(os.path.dirname(paths[0])) + "-counts" if paths else "empty-counts"
    return MappedCounts(name, paths, bits, pieces, mounted)


def publish(df: DataFrame, rows: int, columns: dict, label: str, mounted: bool | None = None) -> MappedTable:
    """Writes ``df`` (of ``rows`` rows) in the order of its column ``key``.

    ``mounted``: whether workers can open the scratch folder's files by path; by default,
    if it is a file: path. Otherwise Spark's file distribution carries them.
    """
    spark = df.sparkSession
    if mounted is None:
        mounted = urlparse(scratch_path(spark, label)).scheme in ("", "file")
    ordered = df.select(*columns).repartitionByRange(max(1, -(-rows // ROWS_PER_FILE)), "key").sortWithinPartitions("key")
    stored = materialise(ordered, label)
    # The number in a part's name is its place in the order.
    paths = sorted(stored.inputFiles(), key=os.path.basename)
    name = os.path.basename(os.path.dirname(paths[0])) if paths else label + "-empty"
    if not mounted:
        for path in paths:
            spark.sparkContext.addFile(path)
    return MappedTable(name, paths, rows, columns, mounted)


def places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of ``wanted`` in the sorted ``keys``, and whether each is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, np.asarray(keys[at] == wanted)
