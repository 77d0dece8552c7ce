"""Where rows live: scratch tables, checked broadcasts and skew-safe layouts."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.sources.tables import delete_path

SCRATCH_CONF = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Largest table we ship to every executor on our own account. Anything larger
# goes through a shuffle join, where adaptive execution splits skewed keys.
BROADCAST_BYTES = 32 << 20
# Most that a sweep sends by routes; beyond it rows are written once for all parts.
ROUTED_BYTES = 64 << 20
# Rows of the other side in one packed row of such a table, and their values at most.
SHARED_ROWS, SHARED_VALUES = 65_536, 1 << 20
# A key with more rows than this is spread over several tasks.
ROWS_PER_SLOT = 1_000_000

# With a byte limit per Arrow batch, Spark measures all buffers again for every
# row, which costs several times the transfer itself. Batches are limited by
# row count anyway, so the limit is lifted while such a batch stays below this.
ARROW_BATCH_BYTES = 256 << 20
ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

# Most that the other side's rows may take in a part, if each of its ratings needs another.
PART_BYTES = 128 << 20
# Ratings in one packed row of a stored layout.
PACKED_ROWS = 250_000
# Numbers between the least and the largest id of rows that are looked up by position (at most 64 MB).
PLACES = 16 << 20

# So that a writer looks at the size of its row group after every packed row: it counts whole pages.
PIECEWISE = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}

_local_scratch: str | None = None
# number of parts -> their names (see part_names)
_part_names: dict[int, list[int]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates, as named by the session.

    Only a local-mode session without the setting gets a private temporary
    folder; on a cluster a missing setting is an error, because executors on
    other machines could not read such a folder.
    """
    global _local_scratch
    named = spark.conf.get(SCRATCH_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SCRATCH_CONF} to a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="affinis-")
        atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_dir(spark).rstrip('/')}/affinis/{app}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Cuts lineage, survives the loss of executors, and gives the optimizer a
    true size for the next join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside the block delete their shuffle files when they end, instead of
    when the driver happens to collect its garbage. For queries on written tables alone:
    a persisted one may want its shuffle again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


class Sweeps:
    """Tables written by an iteration. Once two newer ones of the same label
    exist, nothing reads a table any more and its files are deleted."""

    def __init__(self):
        self._paths: dict[str, list[str]] = {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        spark = df.sparkSession
        path = scratch_path(spark, label)
        df.write.parquet(path)
        kept = self._paths.setdefault(label, [])
        kept.append(path)
        if len(kept) > 2:
            delete_path(spark, kept.pop(0))
        return spark.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    return unquote(urlparse(path).path)


def is_mounted(spark: SparkSession) -> bool:
    """Whether workers can open the scratch folder's files by path."""
    return urlparse(scratch_dir(spark)).scheme in ("", "file")


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def arrow_rows(spark: SparkSession, row_bytes: int) -> None:
    """Prepare the session for Arrow stages whose rows take ``row_bytes``."""
    rows = int(spark.conf.get(ARROW_ROWS))
    bounded = 0 < rows and rows * row_bytes <= ARROW_BATCH_BYTES
    spark.conf.set(ARROW_LIMIT, str(2**31 - 1) if bounded else "64m")


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def task_count(spark: SparkSession, rows: int, width: int = 0) -> int:
    """Tasks for a Python stage over ``rows`` rows: every core gets one, and the
    session's shuffle partitions are followed between one and five million rows
    per task. The number is fixed, so that adaptive execution does not merge
    stages that are small in bytes but heavy in arithmetic. Where every row may need
    a vector of ``width`` numbers of its own, a task's vectors stay in ``PART_BYTES``."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most, least = math.ceil(rows / 1_000_000), math.ceil(rows / 5_000_000)
    vectors = math.ceil(rows * 8 * (width + 2) / PART_BYTES) if width else 0
    return max(cores(spark), vectors, min(most, max(wanted, least)))


def part_names(spark: SparkSession, tasks: int) -> list[int]:
    """A number for every part that Spark's hash deals to a partition of its own, so that
    no partition gets two parts and none stays empty."""
    if tasks not in _part_names:
        names: dict[int, int] = {}
        low, step = 0, 20 * tasks
        while len(names) < tasks:
            dealt = F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("part")
            for r in spark.range(low, low + step, 1, 1).groupBy(dealt).agg(F.min("id").alias("id")).collect():
                names.setdefault(r["part"], r["id"])
            low += step
        _part_names[tasks] = [names[p] for p in range(tasks)]
    return _part_names[tasks]


class RatingStore:
    """Ratings held once, laid out by user and by item for repeated sweeps.

    ``by(key)`` deals the ratings to ``tasks`` stored parts by a hash of ``(key, slot)``
    and sorts them. ``slot`` is 0 except for keys above ``rows_per_slot`` rows, whose rows
    are spread over several slots by a hash of the other id, so that a key holding a
    third of the table is worked on by many tasks. Partial results per slot are merged by
    the caller (see ``normal.half_sweep``).

    ``routes(key)`` is the static routing table that belongs to it: which parts need
    which id of the other side. A sweep joins the other side's rows to their routes, so
    that each is sent once to every part that needs it, and meets the stored ratings
    there by co-grouping (``meet``). No exchange of a sweep carries a rating.

    The routes send a row once per part, so that what they move grows with the parts as
    well. Where that is more than ``ROUTED_BYTES``, the other side is written once to the
    shared folder instead, and every part reads it in pieces and keeps the rows of its ids.
    """

    KEYS = {"user": "item", "item": "user"}

    def __init__(self, ratings: DataFrame, rows_per_slot: int = ROWS_PER_SLOT, *, width: int = 0):
        self.spark = ratings.sparkSession
        self.df = ratings.persist(StorageLevel.MEMORY_AND_DISK)
        row = self.df.agg(
            F.count(F.lit(1)).alias("n"),
            F.max("user").alias("u"),
            F.max("item").alias("i"),
            F.avg("rating").alias("m"),
        ).first()
        if row["n"] == 0:
            raise ValueError("no ratings to fit")
        self.n_ratings, self.mean = row["n"], row["m"]
        self.top_id = {"user": row["u"], "item": row["i"]}
        self.rows_per_slot = rows_per_slot
        self.tasks = task_count(self.spark, self.n_ratings, width)
        # A slot is a share of a part: no part gets a key of many times its size.
        if width:
            self.rows_per_slot = min(rows_per_slot, max(1, PART_BYTES // (8 * (width + 2))))
        self._laid: dict[str, DataFrame] = {}
        self._stored: dict[str, DataFrame] = {}
        self._dealt: dict[str, DataFrame] = {}
        self._broadcast: list[Broadcast] = []
        self._shared: list[str] = []
        self._hot: dict[str, bool] = {}
        self._counted: dict[str, DataFrame] = {}
        self._routes: dict[tuple[str, str], DataFrame] = {}

    def max_rows(self, key: str) -> int:
        """Upper bound on distinct ids of ``key`` (ids are not negative)."""
        return min(self.n_ratings, int(self.top_id[key]) + 1)

    def is_split(self, key: str) -> bool:
        self.by(key)
        return self._hot[key]

    def by(self, key: str) -> DataFrame:
        """``user, item, rating, part, slot, hot``, dealt to parts and sorted by key there."""
        if key in self._laid:
            return self._laid[key]
        other = self.KEYS[key]
        rows, self._hot[key] = self.df.withColumns({"slot": F.lit(0), "hot": F.lit(False)}), False
        if self.n_ratings > self.rows_per_slot:
            # At most n / per_slot keys can be hot; per_slot grows with n so that
            # the broadcast below never exceeds 100,000 rows.
            per_slot = max(self.rows_per_slot, -(-self.n_ratings // 100_000))
            hot = self.counted(key).where(F.col("count") > per_slot).select(
                key, F.ceil(F.col("count") / per_slot).alias("slots"))
            if hot.limit(1).count():
                self._hot[key] = True
                slot = F.coalesce(F.pmod(F.xxhash64(other), F.col("slots")), F.lit(0)).cast("int")
                rows = self.df.join(F.broadcast(hot), key, "left").withColumns(
                    {"slot": slot, "hot": F.col("slots").isNotNull()}).drop("slots")
        part = F.get(F.array(*[F.lit(n) for n in part_names(self.spark, self.tasks)]), F.pmod(F.xxhash64(key, "slot"), F.lit(self.tasks)).cast("int"))
        # By one column alone: Spark then sorts by the number itself instead of comparing rows.
        laid = rows.withColumn("part", part.cast("int")).repartition(self.tasks, "part").sortWithinPartitions(key)
        self._laid[key] = laid
        return laid

    def stored(self, key: str) -> DataFrame:
        """``by(key)`` in rows of up to ``PACKED_ROWS`` ratings: a part and arrays as bytes."""
        if key not in self._stored:
            names = [key, self.KEYS[key], "rating", "hot"]
            rows = self.by(key).select(
                "part", F.col(names[0]).cast("bigint"), F.col(names[1]).cast("bigint"), F.col("rating").cast("double"), F.col("hot").cast("byte"))

            def pack(batches):
                held: dict[int, list] = {}
                for b in batches:
                    parts = b.column("part").to_numpy()
                    for part in np.unique(parts).tolist():  # one, unless a partition got several
                        own = b if (parts == part).all() else b.filter(pa.array(parts == part))
                        mine = held.setdefault(part, [])
                        if sum(len(c[0]) for c in mine) >= PACKED_ROWS:
                            yield _packed_row(part, mine)
                            mine.clear()
                        mine.append([own.column(c).to_numpy(zero_copy_only=False) for c in names])
                for part, mine in held.items():
                    yield _packed_row(part, mine)

            arrow_rows(self.spark, 40)
            self._stored[key] = rows.mapInArrow(pack, "part int, key binary, other binary, rating binary, hot binary").persist(StorageLevel.MEMORY_AND_DISK)
        return self._stored[key]

    def dealt(self, key: str) -> DataFrame:
        """The stored rows with a partitioning that the optimizer knows, for co-grouping."""
        if key not in self._dealt:
            self._dealt[key] = self.stored(key).repartition(self.tasks, "part").persist(StorageLevel.MEMORY_AND_DISK)
        return self._dealt[key]

    def routes(self, key: str, of: str) -> DataFrame:
        """``of, parts``: the parts of ``by(key)`` in which an id of ``of`` occurs."""
        if (key, of) not in self._routes:
            self._routes[key, of] = (
                self.by(key).groupBy(of).agg(F.collect_set("part").alias("parts")).persist(StorageLevel.MEMORY_AND_DISK))
        return self._routes[key, of]

    def counted(self, key: str) -> DataFrame:
        """``key, count``, written once for large tables: who is hot, and which ids there are."""
        if key not in self._counted:
            self._counted[key] = materialise(self.df.groupBy(key).count(), f"counted-{key}")
        return self._counted[key]

    def ids(self, key: str) -> DataFrame:
        if self.n_ratings > self.rows_per_slot:
            return self.counted(key).select(key)
        return self.df.select(key).distinct()

    def sent(self, key: str, of: str, table: DataFrame, width: int, side: int = 0) -> DataFrame:
        """The rows ``of, v, f`` of ``table``, each packed once for every part that needs it.
        They are shuffled to the routes, whose partitioning is already that of the join."""
        rows = self.routes(key, of).join(table, of).select(
            F.col(of).cast("bigint").alias("id"), F.col("v").cast("double").alias("v"), "f", "parts")

        def pack(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                parts = b.column("parts")
                to = parts.flatten().to_numpy()
                row = np.repeat(np.arange(b.num_rows), parts.value_lengths().to_numpy())
                order = np.argsort(to, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0, True])
                ids, v = b.column("id").to_numpy(), b.column("v").to_numpy(zero_copy_only=False)
                f = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                picked = [row[order[lo:hi]] for lo, hi in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(to[order[edges[:-1]]], pa.int32()), pa.array(np.full(len(picked), side, np.int32)),
                    *[pa.array([c[p].tobytes() for p in picked], pa.binary()) for c in (ids, v, f)]],
                    names=["part", "side", "id", "v", "f"])

        arrow_rows(self.spark, 8 * (width + 8))
        return rows.mapInArrow(pack, "part int, side int, id binary, v binary, f binary")

    def broadcast_rows(self, of: str, table: DataFrame) -> Broadcast:
        """All rows ``of, v, f`` of a table proved small, packed. Only the last few of an
        iteration stay with the executors; an older one is fetched again if it is asked for."""
        got = table.select(F.col(of).cast("bigint").alias("id"), F.col("v").cast("double").alias("v"), "f").toArrow()
        f = got.column("f").combine_chunks().flatten()
        columns = [got.column("id").to_numpy(), got.column("v").to_numpy(), f.to_numpy(zero_copy_only=False)]
        self._broadcast.append(self.spark.sparkContext.broadcast(tuple(c.tobytes() for c in columns)))
        if len(self._broadcast) > 8:
            self._broadcast.pop(0).unpersist()
        return self._broadcast[-1]

    def shared_rows(self, of: str, table: DataFrame, width: int) -> list[str]:
        """Files with the rows ``of, v, f`` of a table, packed in pieces with ids in order.
        Only the last few of an iteration are kept: a sweep reads the one before it."""
        path = share_rows(of, table, width)
        self._shared.append(path)
        if len(self._shared) > 8:
            delete_path(self.spark, self._shared.pop(0))
        return shared_files(self.spark, path)

    def meet(self, key: str, fixed: DataFrame, width: int, task, schema: str, own: DataFrame | None = None, own_width: int = 0) -> DataFrame:
        """``task(Met)`` for every stored part of ``by(key)``; its tables are the result.

        ``fixed`` has the other side's rows ``other, v, f`` (a number and an array), ``own``
        such rows of the key itself. A part holds a bounded number of ratings
        (``task_count``) and the rows of the ids in it. Tables proved small (row bound x
        width under ``BROADCAST_BYTES``) go to all executors, and nothing is shuffled;
        others take their routes, or are shared as files if that is less to move.
        """
        other = self.KEYS[key]
        small = fits_broadcast(self.max_rows(other), 8 * (width + 4)) and (
            own is None or fits_broadcast(self.max_rows(key), 8 * (own_width + 4)))
        if small:
            theirs = self.broadcast_rows(other, fixed)
            mine = None if own is None else self.broadcast_rows(key, own)

            def whole(batches):
                left = [r for b in batches for r in b.to_pylist()]
                met = Met(left, [theirs.value], [mine.value] if mine else [], width, own_width)
                yield from task(met).to_batches()

            return self.stored(key).mapInArrow(whole, schema)
        routed = min(self.n_ratings, self.max_rows(other) * self.tasks) * 8 * (width + 2)
        if routed > ROUTED_BYTES and is_mounted(self.spark):
            theirs = self.shared_rows(other, fixed, width)
            mine = None if own is None else self.shared_rows(key, own, own_width)

            def reading(batches):
                left = [r for b in batches for r in b.to_pylist()]
                ids = lambda name: _unpacked([r[name] for r in left], np.int64)
                rows = Rows.wanted(theirs, width, ids("other"))
                owned = Rows([], own_width) if mine is None else Rows.wanted(mine, own_width, ids("key"))
                yield from task(Met(left, rows, owned, width, own_width)).to_batches()

            return self.stored(key).mapInArrow(reading, schema)
        sent = self.sent(key, other, fixed, width)
        if own is not None:
            sent = sent.unionAll(self.sent(key, key, own, own_width, 1))

        def grouped(left, right):
            sides: list[list[tuple]] = [[], []]
            for row in right.to_pylist():
                sides[row["side"]].append((row["id"], row["v"], row["f"]))
            return task(Met(left.to_pylist(), *sides, width, own_width))

        return self.dealt(key).groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(grouped, schema)

    def attach(self, key: str, table: DataFrame, width: int) -> DataFrame:
        """Ratings with the other side's row attached, for aggregates that combine map-side."""
        other = self.KEYS[key]
        small = fits_broadcast(self.max_rows(other), 8 * (width + 4))
        return self.df.join(F.broadcast(table) if small else table, other)

    def release(self) -> None:
        for held in [self.df, *self._stored.values(), *self._dealt.values(), *self._routes.values(), *self._broadcast]:
            held.unpersist()
        for path in self._shared:
            delete_path(self.spark, path)
        self._shared = []


def share_rows(of: str, table: DataFrame, width: int) -> str:
    """Folder with the rows ``of, v, f`` of a table, packed in pieces with ids in order."""
    path = scratch_path(table.sparkSession, "shared")
    rows = table.where(F.col(of).isNotNull()).select(
        F.col(of).cast("bigint").alias("id"), F.col("v").cast("double").alias("v"), "f")
    most = max(1, min(SHARED_ROWS, SHARED_VALUES // (width + 1)))

    def pack(batches):
        held, n = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, most):
                piece = b.slice(lo, most)
                if n + piece.num_rows > most:
                    yield _shared_row(held, width)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield _shared_row(held, width)

    arrow_rows(table.sparkSession, 8 * (width + 8))
    packed = rows.mapInArrow(pack, "id binary, v binary, f binary")
    # A row group of about one piece: that is what a reader holds.
    packed.write.option("compression", "none").option("parquet.enable.dictionary", "false").option(
        "parquet.block.size", str(8 * SHARED_VALUES)).options(**PIECEWISE).parquet(path)
    return path


def shared_files(spark: SparkSession, path: str) -> list[str]:
    return [local_path(f) for f in spark.read.parquet(path).inputFiles()]


def _shared_row(held: list[pa.RecordBatch], width: int) -> pa.RecordBatch:
    ids, v, f = (np.concatenate(c) for c in zip(*[
        (b.column("id").to_numpy(), b.column("v").to_numpy(zero_copy_only=False),
         b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)) for b in held]))
    order = np.argsort(ids, kind="stable")
    return pa.RecordBatch.from_arrays([pa.array([c[order].tobytes()], pa.binary()) for c in (ids, v, f)], names=["id", "v", "f"])


def shared_pieces(files: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for path in files:
        with pq.ParquetFile(path, memory_map=True) as file:
            for group in range(file.num_row_groups):
                table = file.read_row_group(group, use_threads=False)
                for row in range(table.num_rows):
                    ids, v, f = (np.frombuffer(c[row].as_buffer(), t) for c, t in zip(table.columns, (np.int64, np.float64, np.float64)))
                    yield ids, v, f.reshape(len(ids), width)


def _packed_row(part: int, held: list) -> pa.RecordBatch:
    columns = [np.concatenate(c).tobytes() for c in zip(*held)]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), *[pa.array([c], pa.binary()) for c in columns]], names=["part", "key", "other", "rating", "hot"])


def distinct(ids: np.ndarray) -> np.ndarray:
    """``np.unique`` of whole numbers by sorting them; numpy's own hashes them, ten times as slowly."""
    ids = np.sort(ids)
    return ids[np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])] if len(ids) else ids


def _unpacked(values: list[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype)


class Rows:
    """Rows ``id, v, f`` of one side, found by id."""

    _places: np.ndarray | None = None

    def __init__(self, packed: list[tuple[bytes, bytes, bytes]], width: int):
        ids, v, f = ([row[k] for row in packed] for k in range(3))
        ids = _unpacked(ids, np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], _unpacked(v, np.float64)[order]
        self.f = _unpacked(f, np.float64).reshape(len(ids), width)[order]

    @classmethod
    def wanted(cls, files: list[str], width: int, ids: np.ndarray) -> Rows:
        """The rows of ``ids`` in files of ``RatingStore.shared_rows``, read piece by piece."""
        out = cls([], width)
        out.ids = distinct(ids)
        if not len(out.ids):
            return out
        out.v, out.f, seen = np.zeros(len(out.ids)), np.zeros((len(out.ids), width)), np.zeros(len(out.ids), bool)
        low, high, marked = int(out.ids[0]), int(out.ids[-1]), None
        if high - low < PLACES:
            marked = np.zeros(high - low + 1, bool)
            marked[out.ids - low] = True
        for there, v, f in shared_pieces(files, width):
            # Every part sees every row there is, so that one it does not want costs a byte.
            if marked is not None:
                first, last = np.searchsorted(there, low), np.searchsorted(there, high, side="right")
                here = first + np.flatnonzero(marked[there[first:last] - low])
                at = np.searchsorted(out.ids, there[here])
            else:
                at, here = out.find(there)
                at = at[here]
            out.v[at], out.f[at], seen[at] = v[here], f[here], True
        if not seen.all():
            out.ids, out.v, out.f, out._places = out.ids[seen], out.v[seen], out.f[seen], None
        return out

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``ids``, and which of them are here.

        A part looks up an id per rating. Where ids are dense, that is a table from
        id to position; otherwise a binary search."""
        if not len(self.ids):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        low, high = int(self.ids[0]), int(self.ids[-1])
        if high - low >= min(PLACES, 32 * len(self.ids)):
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        else:
            if self._places is None:
                self._places = np.zeros(high - low + 1, np.int32)
                # Backwards, so that of equal ids the first counts, as in a search.
                self._places[self.ids[::-1] - low] = np.arange(len(self.ids) - 1, -1, -1, dtype=np.int32)
            at = self._places[np.clip(ids, low, high) - low]
        return at, self.ids[at] == ids


class Met:
    """A stored part of the ratings, sorted by key, with the rows that were sent to it.

    Ratings of which the other side has no row are left out.
    """

    def __init__(self, left: list[dict], fixed: list[tuple] | Rows, own: list[tuple] | Rows, width: int, own_width: int):
        self.fixed, self.own = (r if isinstance(r, Rows) else Rows(r, w) for r, w in ((fixed, width), (own, own_width)))
        stored = lambda name, dtype: _unpacked([r[name] for r in left], dtype)
        at, here = self.fixed.find(stored("other", np.int64))
        self.at, self.key = at[here], stored("key", np.int64)[here]
        self.rating, self.hot = stored("rating", np.float64)[here], stored("hot", np.int8)[here] != 0
        if len(self.key) and (self.key[1:] < self.key[:-1]).any():  # packed rows came in another order
            order = np.argsort(self.key, kind="stable")
            self.at, self.key, self.rating, self.hot = (c[order] for c in (self.at, self.key, self.rating, self.hot))
