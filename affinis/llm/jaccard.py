"""N-gram Jaccard join (operator 4): an exact self join in the Jaccard metric space.

Documents are sets of distinct five-word shingles; two link when
100 * |intersection| >= 75 * |union|, that is at a Jaccard distance of 1/4 or less.

Two levels of pivots, because whole documents are useless as first pivots: almost
all texts are at distance 1 of each other, so every window would cover every region.

1. Regions. The first pivots are the one-shingle sets {s}. A document of n shingles
   is at distance 1 - 1/n of its own shingles' pivots and at 1 of all others; ties go
   by one global order (rare shingles first), so the nearest pivot, whose Voronoi
   region is the document's home, is its first shingle. A partner shares more than n
   minus ceil(3n/4) of them, hence by the triangle inequality for set differences it
   lies at home or within reach of one of the document's first
   n - ceil(3n/4) + 1 pivots: the document is replicated to these regions, and no
   link is lost whatever the order is. Shingle counts over all documents choose it,
   to keep passages that many documents share out of the windows.
2. Inside a region (documents that share a rare shingle) documents are pivots: the
   smallest member p. Exact distances to it are measured, those within 1/4 are links,
   and regions that are one component by then are closed. In the others members of
   different components are compared, in blocks of bounded size, inside three windows:
   the triangle window |d(x, p) - d(y, p)| <= 1/4, the length window, and the distance
   of sketches (how many shingles fall into each of 256 or more classes), which bounds the
   symmetric difference from below. Pairs that stand all three are measured exactly.

Equal sets are one class from the start, so groups of exact copies cost one member.
Results are classes, not pairs: a link between members of one component decides
nothing more.

Defined cases: null or empty texts, and texts without words, have an empty set and are
linked with nothing; a text of one to four words is one shingle. A row without doc_id
is counted but never linked, and its component is null. Rows that repeat a doc_id
are one document: links of any of its texts count. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.components import components
from affinis.llm.text import WordHashes, batches, documents, drop, free_name, materialise, mixed, pairs_of, shingles, signed, tasks_for, word_hashes, words_of

PERCENT = 75
# Shingles held in one task before they are counted and sent on.
CHUNK = 1_000_000
# Shingles in at least this many documents go last in the global order ...
COMMON_AT_LEAST = 48
# ... as far as they fit in this many entries (16 bytes each, sent to every executor);
# the threshold rises until they do. Which ones are known changes speed, never results.
COMMON_ENTRIES = 1_000_000
# Members of a region that are compared with one another in one go.
BLOCK = 256
# Bits of a shingle's hash that name its class in a sketch, at least and at most.
CLASS_BITS, MOST_CLASS_BITS = 8, 16
# Members compared with a pivot in one go.
SLOT = 128

_COUNTED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
# Two kinds of rows: a document (kind 1, with its sketch), and a region of a set (kind 0).
_CELLS = pa.schema([
    ("kind", pa.int32()), ("key", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("common", pa.bool_()),
    ("doc_id", pa.int64()), ("sketch", pa.binary())])
_DISTANCE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("either", pa.int64())])


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingles(hashes.of(words_of(text))))


def signature(unique: np.ndarray) -> int:
    """A set's name: 64 bits, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(unique.tobytes())).astype(np.int64))


def sketch(unique: np.ndarray) -> bytes:
    """Shingles per class of the hash space: the distance of two sketches bounds
    the symmetric difference of the sets from below. Large sets have more classes;
    neighbouring classes added up are those of a smaller sketch."""
    bits = min(max(CLASS_BITS, len(unique).bit_length() - 2), MOST_CLASS_BITS)
    counts = np.bincount((unique >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _folded(sketched: bytes, classes: int) -> np.ndarray:
    return np.frombuffer(sketched, np.uint8).reshape(classes, -1).sum(axis=1, dtype=np.int32)


def _distinct_texts(parts, hashes: WordHashes) -> Iterator[tuple[int, np.ndarray]]:
    """Sets of a task's documents, each set once."""
    seen: set[int] = set()
    for batch in parts:
        for doc_id, text in pairs_of(batch, "doc_id", "text"):
            unique = shingle_set(text, hashes)
            if len(unique) and doc_id is not None:
                sig = signature(unique)
                if sig not in seen:
                    seen.add(sig)
                    yield sig, unique


def shingle_counts(docs: DataFrame, tasks: int) -> DataFrame:
    """``key, count`` of the shingles in ``COMMON_AT_LEAST`` or more documents' sets.

    Each task sends its shingles as sorted arrays, one per bucket of the hash space,
    and counts what it has twice before sending it.
    """
    buckets = 4 * tasks

    def packed(parts) -> Iterator[tuple]:
        hashes, held, n = word_hashes(), [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(keys, (np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)))
            for b, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)):
                # Low bytes carry no order: 6 of 8 bytes tell enough shingles apart to count them.
                yield b, np.ascontiguousarray((k >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), c.astype(np.uint16 if len(c) and c.max() < 65536 else np.uint32).tobytes()

        for _, unique in _distinct_texts(parts, hashes):
            held.append(unique)
            n += len(held[-1])
            if n >= CHUNK:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def merged(parts) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in parts:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                wide = np.zeros((len(k) // 6, 8), np.uint8)
                wide[:, :6] = np.frombuffer(k, np.uint8).reshape(-1, 6)
                keys.append(wide.reshape(-1).view(np.uint64))
                counts.append(np.frombuffer(c, np.uint16 if len(c) == len(wide) * 2 else np.uint32).astype(np.int64))
        if keys:
            k, c = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
            total = np.add.reduceat(c, starts) if len(k) else c
            keep = total >= COMMON_AT_LEAST
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(signed(k[starts][keep])), pa.array(total[keep])], names=["key", "count"])

    return (
        documents(docs).mapInArrow(lambda parts: batches(packed(parts), _COUNTED, 64), "bucket int, keys binary, counts binary")
        .repartition(tasks, "bucket").mapInArrow(merged, "key long, count long"))


def common_shingles(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of the commonest shingles: all from a threshold on, so many
    that at most ``COMMON_ENTRIES`` are sent to the executors."""
    by_size = counted.groupBy(F.floor(8 * F.log2("count")).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    total, least = 0, None
    for row in by_size.orderBy(F.desc("step")).collect():  # eight steps per doubling of a count
        total += row["n"]
        if total > COMMON_ENTRIES:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counted.where(F.floor(8 * F.log2("count")) >= least).toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["count"].to_numpy()[order]


def windows(docs: DataFrame, common, tasks: int) -> DataFrame:
    """Every document (kind 1: ``doc_id, n, sig, sketch``; ``sig`` null for an empty set), and
    the regions each distinct set is replicated to (kind 0: ``key, sig, n, pos, common``)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def places(unique: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.zeros(len(unique), np.int64)
        if len(keys):
            short = unique >> np.uint64(16)
            at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
            rank = np.where(keys[at] == short, counts[at], 0)
        first = np.lexsort((unique, rank))[: len(unique) - -(-PERCENT * len(unique) // 100) + 1]
        return signed(unique[first]), rank[first] > 0

    def rows(parts) -> Iterator[pa.RecordBatch]:
        hashes, seen = word_hashes(), set()
        keys, counts = shared.value
        for batch in parts:
            named, regions = [], []
            for doc_id, text in pairs_of(batch, "doc_id", "text"):
                unique = shingle_set(text, hashes)
                sig = signature(unique) if len(unique) else None
                named.append((sig, len(unique), doc_id, sketch(unique)))
                if sig is not None and doc_id is not None and sig not in seen:
                    seen.add(sig)
                    at, is_common = places(unique, keys, counts)
                    regions.append((at, np.full(len(at), sig, np.int64), np.full(len(at), len(unique), np.int32),
                                    np.arange(len(at), dtype=np.int32), is_common))
            if named:
                sigs, sizes, ids, sketches = zip(*named, strict=True)
                m = len(named)
                # Any key does that spreads them.
                spread = signed(mixed(np.arange(m, dtype=np.uint64) + np.uint64(len(seen) << 20)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.ones(m, np.int32)), pa.array(spread), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()),
                    pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary())], schema=_CELLS)
            for low in range(0, len(regions), 1024):
                key, sig, n, pos, is_common = (np.concatenate(c) for c in zip(*regions[low : low + 1024], strict=True))
                m = len(key)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(m, np.int32)), pa.array(key), pa.array(sig), pa.array(n), pa.array(pos), pa.array(is_common),
                    pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], schema=_CELLS)

    found = documents(docs).mapInArrow(
        rows, "kind int, key long, sig long, n int, pos int, common boolean, doc_id long, sketch binary")
    # A region of uncommon shingles is small, so its rows may meet in one task; rows of
    # common ones are salted and all kept, for the count says that others have them.
    salt = F.when(F.col("kind") == 1, -1).when(F.col("common"), F.pmod("sig", F.lit(64))).otherwise(0)
    found = found.withColumn("salt", salt).repartition(tasks, "key", "salt")
    region = Window.partitionBy("key", "salt")
    return (
        found.withColumn("lo", F.min("sig").over(region)).withColumn("hi", F.max("sig").over(region))
        .where((F.col("kind") == 1) | F.col("common") | (F.col("lo") < F.col("hi"))).drop("salt", "lo", "hi"))


def _apart(x: np.ndarray, y: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sketches rule a link out: it needs |x and y| >= PERCENT / (100 + PERCENT) (|x| + |y|)."""
    return (100 + PERCENT) * np.abs(x - y).sum(axis=-1, dtype=np.int64) > (100 - PERCENT) * total


def _ruled_out(x: bytes, y: bytes, total: int) -> bool:
    classes = min(len(x), len(y))
    return bool(_apart(_folded(x, classes), _folded(y, classes), total))


def _plausible(pairs: DataFrame) -> DataFrame:
    """Pairs ``a, p`` whose sketches ``sa, sp`` don't rule a link out."""

    def near(parts) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            keep = [not _ruled_out(x, y, n + m) for x, y, n, m in pairs_of(batch, "sa", "sp", "na", "np")]
            yield batch.select(["a", "p"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(near, "a long, p long")


def _crossing(rows: DataFrame, tasks: int) -> DataFrame:
    """Pairs ``a, b`` of members of one region but of two components, inside the length
    window, the triangle window and what the sketches allow, with their groups ``g, i, j``.

    A region's members are dealt to ``blocks`` blocks, and a group is two blocks (or
    one with itself): at most about 2 * BLOCK members, however large the region is.
    Only pairs that stand all tests leave a task.
    """
    slot = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("slot", slot).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("p", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "sig", "n", "label", "d", "sketch")

    def pairs_in(group: list[tuple], i: int, j: int) -> Iterator[tuple[int, int]]:
        slot, sig, n, label, d = (np.array(c) for c in zip(*[r[:5] for r in group], strict=True))
        d = d.astype(float)  # None becomes nan, and comparisons with it are false
        x = np.array([_folded(r[5], 1 << CLASS_BITS) for r in group])
        for k in np.flatnonzero(slot == i).tolist():
            apart = np.abs(d - d[k]) > 1 - PERCENT / 100 + 1e-9
            with_k = (label != label[k]) & ~apart & (100 * np.minimum(n, n[k]) >= PERCENT * np.maximum(n, n[k]))
            with_k &= (slot == j) if i != j else (np.arange(len(group)) > k)
            at = np.flatnonzero(with_k)
            at = at[~_apart(x[at], x[k], n[at].astype(np.int64) + n[k])]
            for m in at.tolist():
                if _ruled_out(group[k][5], group[m][5], int(n[k] + n[m])):
                    continue
                yield max(int(sig[k]), int(sig[m])), min(int(sig[k]), int(sig[m]))

    def found(parts) -> Iterator[tuple[int, int]]:
        key, group = None, []
        for batch in parts:
            for p, i, j, *row in pairs_of(batch, "p", "i", "j", "slot", "sig", "n", "label", "d", "sketch"):
                if key != (p, i, j):
                    if group:
                        yield from (key + pair for pair in pairs_in(group, *key[1:]))
                    key, group = (p, i, j), []
                group.append(row)
        if group:
            yield from (key + pair for pair in pairs_in(group, *key[1:]))

    schema = pa.schema([("g", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
    return dealt.repartition(tasks, "p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(
        lambda parts: batches(found(parts), schema), "g long, i int, j int, a long, b long")


def _starred(pairs: DataFrame) -> DataFrame:
    """Groups ``p, i, j`` for pairs with a pivot: about ``SLOT`` members of a pivot each."""
    slots = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / SLOT).alias("slots"))
    return pairs.join(slots, "p").select(
        F.col("p").alias("g"), F.pmod(F.xxhash64("a"), "slots").cast("int").alias("i"), F.lit(-1).alias("j"), "a", F.col("p").alias("b"))


def distances(pairs: DataFrame, texts: DataFrame, tasks: int) -> DataFrame:
    """``a, b, both, either``: exact set sizes of each pair; ``texts`` has ``sig, text``.

    Pairs come in groups ``g, i, j`` of bounded size. A set's text goes once to every
    group that names it, ahead of the group's pairs, however many pairs it is in.
    """
    group = ["g", "i", "j"]
    named = pairs.select(*group, F.explode(F.array("a", "b")).alias("sig")).distinct()
    nothing = F.lit(None)
    rows_of = (
        named.join(texts.hint("merge"), "sig").select(*group, F.lit(0).alias("role"), F.col("sig").alias("a"), nothing.cast("long").alias("b"), "text")
        .unionAll(pairs.select(*group, F.lit(1).alias("role"), "a", "b", nothing.cast("string").alias("text"))))

    def rows(parts) -> Iterator[tuple]:
        hashes, key, sets = word_hashes(), None, {}
        for batch in parts:
            for g, i, j, role, a, b, text in pairs_of(batch, *group, "role", "a", "b", "text"):
                if key != (g, i, j):
                    key, sets = (g, i, j), {}
                if role == 0:
                    unique = shingle_set(text, hashes)
                    if signature(unique) == a:  # not another text of a repeated doc_id
                        sets[a] = unique
                else:
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    yield a, b, both, len(sets[a]) + len(sets[b]) - both

    return (
        rows_of.repartition(tasks, *group).sortWithinPartitions(*group, "role")
        .mapInArrow(lambda parts: batches(rows(parts), _DISTANCE), "a long, b long, both long, either long"))


def _linked(measured: DataFrame) -> DataFrame:
    return measured.where(100 * F.col("both") >= PERCENT * F.col("either")).select("a", "b")


def _length_window(a: str, b: str):
    small, large = F.least(a, b), F.greatest(a, b)
    return 100 * small >= PERCENT * large


def _merge(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``node, label`` after more links: only the labels that they join are looked at again."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    between = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = materialise(components(between), "labels").withColumnRenamed("label", "to")
    moved = labels.withColumnRenamed("node", "own").join(joined, F.col("label") == joined["node"], "left").select(
        F.col("own").alias("node"), F.coalesce("to", "label").alias("label"))
    fresh = joined.join(labels.select("node"), "node", "left_anti").select("node", F.col("to").alias("label"))
    return materialise(moved.unionAll(fresh), "labels")


def links(docs: DataFrame, cells: DataFrame, named: DataFrame) -> DataFrame:
    """``node, label`` of every set that is linked with another; nodes are named by ``sig``."""
    tasks = tasks_for(docs)
    sets = named.where("doc_id is not null and sig is not null").groupBy("sig").agg(
        F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    # A region's pivot is its smallest member; regions with one pivot are one from here on.
    pivots = cells.groupBy("key").agg(F.min(F.struct("sig", "n")).alias("m")).select("key", F.col("m.sig").alias("p"), F.col("m.n").alias("np"))
    members = materialise(cells.join(pivots, "key").select("p", "np", "sig", "n").distinct().join(sets.drop("doc_id"), "sig"), "members")
    texts = materialise(
        documents(docs).join(sets.select("sig", "doc_id").join(members.select("sig").distinct(), "sig").hint("merge"), "doc_id")
        .select("sig", "text"), "texts")

    own = members.where("sig = p").select("p", F.col("sketch").alias("sp"))
    near = members.where((F.col("sig") != F.col("p")) & _length_window("n", "np")).join(own, "p").select(
        F.col("sig").alias("a"), "p", F.col("sketch").alias("sa"), "sp", F.col("n").alias("na"), "np")
    starred = materialise(_starred(_plausible(near)), "pairs")
    measured = materialise(distances(starred, texts, tasks), "measured")
    drop(starred)
    labels = materialise(components(_linked(measured)), "labels")

    # Regions with members of several components, and each member's distance to the
    # pivot: 0 for the pivot itself, null where the pair was ruled out before.
    coordinate = F.when(F.col("sig") == F.col("p"), 0.0).otherwise(1.0 - F.col("both") / F.col("either"))
    marked = (
        members.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        .join(measured.select(F.col("a").alias("sig"), F.col("b").alias("p"), "both", "either"), ["sig", "p"], "left").withColumn("d", coordinate).drop("both", "either", "np"))
    still_open = marked.groupBy("p").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("lo < hi")
    # A pair that several groups name is measured in one of them.
    last = materialise(
        _crossing(marked.join(still_open.select("p", "blocks"), "p"), tasks).groupBy("a", "b")
        .agg(F.min(F.struct("g", "i", "j")).alias("at")).select("at.g", "at.i", "at.j", "a", "b"), "pairs")
    drop(members, measured)
    more = materialise(distances(last, texts, tasks), "measured")
    drop(last, texts)
    return _merge(labels, _linked(more))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    tasks = tasks_for(docs)
    counted = materialise(shingle_counts(docs, tasks), "shingles")
    common = common_shingles(counted)
    drop(counted)
    stored = materialise(windows(docs, common, tasks), "cells")
    # Copies of a text in several tasks put the same set into a region more than once; no harm.
    cells = stored.where("kind = 0").select("key", "sig", "n", "pos", "common")
    named = stored.where("kind = 1").select("doc_id", F.col("n").cast("long").alias("n"), "sig", "sketch")
    known = named.where("doc_id is not null and sig is not null")
    label = links(docs, cells, named)
    # Classes of equal sets, then components of linked classes, then documents that have several texts.
    sets = known.join(label.withColumnRenamed("node", "sig"), "sig", "left").select("doc_id", F.coalesce("label", "sig").alias("label"))
    repeated = sets.groupBy("doc_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    if repeated.limit(1).count():
        several = sets.join(repeated, "doc_id").select(F.col("label").alias("a"), F.col("lo").alias("b"))
        joined = materialise(components(several), "joined")
        sets = sets.join(joined.withColumnRenamed("label", "to"), sets["label"] == joined["node"], "left").select(
            "doc_id", F.coalesce("to", "label").alias("label"))
    smallest = sets.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = sets.join(smallest, "label").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return named.join(of, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of every component the row with the smallest doc_id, all columns kept.

    Rows are compared by their texts alone: two rows of one doc_id are two documents
    unless their texts link, and rows without doc_id take part and come last in the order.
    Rows without words link with nothing and all stay.
    """
    row, order = free_name(docs, "row"), free_name(docs, "order")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    # Rows stand for documents: numbers that follow doc_id (no doc_id last) are not needed, for
    # the smallest doc_id of a component is looked up afterwards.
    found = materialise(near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text")), "near").select(
        F.col("doc_id").alias(row), F.col("component_id").alias(order))
    first = (
        numbered.select(row, F.col("doc_id").cast("long").alias("doc_id")).join(found, row)
        .groupBy(order).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("best")).select(F.col(f"best.{row}").alias(row)))
    return numbered.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
