"""Conversation prefix trie (operator 12): a z-fast trie over rebuilt conversations.

A conversation is the sequence of its turns (role, text), and a node of the trie is a
sequence that some conversations start with. Turns are known by 16 bytes of a SHA-256,
and a sequence of turns by a chained digest, so texts are read once and never shuffled.

1. The turns of five neighbouring conversations (``c - c % 5`` on) meet in one task in
   order, as digests and byte counts; conversations are rebuilt there and every prefix
   gets its digest.
2. A task inserts them batch by batch into a :class:`ZFastTrie`: compacted nodes, hashed
   under the prefix at the two-fattest depth of their edge (their handle). A fat binary
   search of about log2(turns) look-ups finds the node where a conversation leaves the
   trie; the edge is split there and one leaf is hung on. A trie holds ``BATCH`` turns
   (and always a whole conversation), so memory is bounded; a prefix that a third of all
   conversations share costs one node per batch from here on.
3. Edges are expanded to a row per depth, in preorder. Rows of one prefix from several
   batches meet by digest: sums of members, the smallest member, and the batch that owns
   the node (the one with the smallest member, exactly one).
4. Each batch's rows go back into preorder, where one pass with a stack sums over
   subtrees what the batch owns: children, leaves and tokens. A node's sums over all
   batches are those of the whole trie, since every node below it is owned once.
5. The ids that end at a node are hashed one after the other, in order, without ever
   being held together.

Defined cases: rows without conv_id belong to no conversation and take no part. A null
turn comes first; turns of equal number come in the order of their digests. Null role or
text counts as empty. Repeated rows are turns of their own. A conversation of which nothing is left
ends at the root. An empty table has no root. Other columns are not read. A negative
conv_id's group starts at the next multiple of five below.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.text import batches, materialise, pairs_of, tasks_for

# Conversations that share their first turns, and one more than the most turns shared.
GROUP, SHARED = 5, 9
# Turns in one trie; a longer conversation has a trie of its own.
BATCH = 100_000
WIDTH = 16
ROOT = bytes(WIDTH)

_ROWS = pa.schema([
    ("batch", pa.int64()), ("pre", pa.int64()), ("digest", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()),
    ("n_convs", pa.int64()), ("n_ends", pa.int64()), ("owner", pa.int64())])
_SUMS = pa.schema([
    ("digest", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])
_ENDS = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the highest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Rebuilt:
    """A conversation: the digest of every prefix, and the bytes of every turn's text."""

    def __init__(self, conv_id: int):
        self.conv_id, self.prefixes, self.bytes = conv_id, bytearray(ROOT), array("q", [0])

    def add(self, digest: bytes, size: int) -> None:
        self.prefixes += hashlib.blake2b(self.prefixes[-WIDTH:] + digest, digest_size=WIDTH).digest()
        self.bytes.append(size)

    @property
    def turns(self) -> int:
        return len(self.bytes) - 1

    def prefix(self, depth: int) -> bytes:
        return bytes(self.prefixes[depth * WIDTH : (depth + 1) * WIDTH])


class ZFastTrie:
    """Compacted nodes with edges (low, high] in turns; a node's prefixes are those of ``rep``."""

    def __init__(self):
        self.low, self.high, self.parent = [0], [0], [0]
        self.rep: list[Rebuilt | None] = [None]
        self.ends: list[list[int]] = [[]]
        self.handles: dict[bytes, int] = {}  # prefix at the two-fattest depth of the edge -> node
        self.edges: dict[bytes, int] = {}  # prefix at the first depth of the edge -> node
        self.turns = 0

    def _hang(self, node: int) -> None:
        low, high, rep = self.low[node], self.high[node], self.rep[node]
        self.handles[rep.prefix(two_fattest(low, high))] = node
        self.edges[rep.prefix(low + 1)] = node

    def _new(self, low: int, high: int, rep: Rebuilt, parent: int) -> int:
        for column, value in ((self.low, low), (self.high, high), (self.rep, rep), (self.parent, parent), (self.ends, [])):
            column.append(value)
        self._hang(len(self.low) - 1)
        return len(self.low) - 1

    def _common(self, conv: Rebuilt, node: int, known: int) -> int:
        """How many turns ``conv`` shares with ``node``, at least ``known``: the digests of
        two sequences agree up to there and nowhere beyond."""
        rep, most = self.rep[node], min(self.high[node], conv.turns)
        while known < most:
            middle = (known + most + 1) // 2
            if rep.prefix(middle) == conv.prefix(middle):
                known = middle
            else:
                most = middle - 1
        return known

    def exit_node(self, conv: Rebuilt) -> tuple[int, int]:
        """The node on whose edge, or at whose end, ``conv`` leaves the trie, and the depth."""
        node, low, high = 0, 0, conv.turns
        while low < high:
            depth = two_fattest(low, high)
            found = self.handles.get(conv.prefix(depth))
            if found is None:
                high = depth - 1
                continue
            node, low = found, self._common(conv, found, depth)
            if low < self.high[node]:
                return node, low
        # All handles on the way are passed; an edge that is left before its handle remains.
        while low < conv.turns and (below := self.edges.get(conv.prefix(low + 1))) is not None:
            node, low = below, self._common(conv, below, low + 1)
            if low < self.high[node]:
                break
        return node, low

    def insert(self, conv: Rebuilt) -> None:
        node, depth = self.exit_node(conv)
        if depth < self.high[node]:
            rep = self.rep[node]
            del self.handles[rep.prefix(two_fattest(self.low[node], self.high[node]))]
            upper = self._new(self.low[node], depth, rep, self.parent[node])
            self.low[node], self.parent[node] = depth, upper
            self._hang(node)
            node = upper
        if depth < conv.turns:
            node = self._new(depth, conv.turns, conv, node)
        self.ends[node].append(conv.conv_id)
        self.turns += conv.turns + 1

    def expanded(self, batch: int) -> Iterator[tuple]:
        """A row per depth in preorder, then a row (``pre`` -1) per conversation and where it ends."""
        below: list[list[int]] = [[] for _ in self.low]
        for node in range(1, len(self.low)):
            below[self.parent[node]].append(node)
        order, todo = [], [0]
        while todo:
            order.append(node := todo.pop())
            todo += below[node]
        members = [len(e) for e in self.ends]
        owner = [min(e, default=None) for e in self.ends]
        for node in reversed(order[1:]):
            up = self.parent[node]
            members[up] += members[node]
            owner[up] = owner[node] if owner[up] is None else min(owner[up], owner[node])
        pre = 0
        for node in order:
            rep, last = self.rep[node], self.high[node]
            for depth in range(self.low[node] + 1, last + 1) if node else [0]:
                at, size = (rep.prefix(depth), rep.bytes[depth]) if node else (ROOT, 0)
                yield batch, pre, at, depth, size, members[node], len(self.ends[node]) if depth == last else 0, owner[node]
                pre += 1
            at = rep.prefix(last) if node else ROOT
            for conv_id in self.ends[node]:
                yield batch, -1, at, last, 0, 0, 0, conv_id


def turns(conversations: DataFrame) -> DataFrame:
    """``first, conv_id, turn, digest, bytes``: a narrow row per turn; ``first`` names the group of five."""
    conv = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.coalesce(F.try_subtract(conv, F.pmod(conv, F.lit(GROUP).cast("long"))), conv).alias("first"), conv.alias("conv_id"),
        F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(F.sha2(said, 256), 1, 2 * WIDTH)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(rows: Iterator[tuple]) -> Iterator[Rebuilt]:
    """Conversations from rows ``first, conv_id, digest, bytes`` in the order of (first, conv_id, turn)."""
    held, at, conv, skipped, place = [], None, None, 0, 0
    for first, conv_id, digest, size in rows:
        if first != at:
            held, at = [], first
        if conv is None or conv_id != conv.conv_id:
            if conv is not None:
                yield conv
            conv, place = Rebuilt(conv_id), 0
            skipped = zlib.crc32(b"%d" % conv_id) % SHARED if conv_id != first else 0
            for turn in held[:skipped]:
                conv.add(*turn)
        if place >= skipped:
            conv.add(digest, size)
        if conv_id == first and place < SHARED - 1:
            held.append((digest, size))
        place += 1
    if conv is not None:
        yield conv


def local_tries(narrow: DataFrame, tasks: int) -> DataFrame:
    """Expanded rows of the tries of all batches (see :meth:`ZFastTrie.expanded`)."""

    def rows(parts) -> Iterator[tuple]:
        batch, trie = TaskContext.get().partitionId() << 32, ZFastTrie()
        of = (row for part in parts for row in pairs_of(part, "first", "conv_id", "digest", "bytes"))
        for conv in rebuilt(of):
            if trie.turns and trie.turns + conv.turns > BATCH:
                yield from trie.expanded(batch)
                batch, trie = batch + 1, ZFastTrie()
            trie.insert(conv)
        if trie.turns:
            yield from trie.expanded(batch)

    ordered = narrow.repartition(tasks, "first").sortWithinPartitions("first", "conv_id", "turn", "digest")
    return ordered.mapInArrow(
        lambda parts: batches(rows(parts), _ROWS),
        "batch long, pre long, digest binary, depth long, bytes long, n_convs long, n_ends long, owner long")


def subtree_sums(nodes: DataFrame, tasks: int) -> DataFrame:
    """Each batch's share of its nodes' sums, in one pass over its preorder.

    ``nodes`` has the rows of the tries with what is known over all batches: ``conv_id``
    (the smallest member), ``all_convs`` and ``all_ends``.
    """
    names = ["batch", "digest", "depth", "bytes", "owner", "conv_id", "all_convs", "all_ends"]

    def rows(parts) -> Iterator[tuple]:
        stack: list[list] = []  # digest, conv_id, depth, parent, members, children, leaves, tokens

        def popped(depth: int) -> Iterator[tuple]:
            while len(stack) > depth:
                done = stack.pop()
                if stack:
                    stack[-1][6] += done[6]
                    stack[-1][7] += done[7]
                yield tuple(done)

        now = None
        for part in parts:
            for batch, digest, depth, size, owner, conv_id, convs, ends in pairs_of(part, *names):
                yield from popped(depth if batch == now else 0)
                now, mine = batch, owner == conv_id
                if stack and mine:
                    stack[-1][5] += 1
                leaf = int(mine and convs == ends)
                stack.append([digest, conv_id, depth, stack[-1][1] if stack else None, convs, 0, leaf, (convs - 1) * size if mine else 0])
        yield from popped(0)

    return nodes.repartition(tasks, "batch").sortWithinPartitions("batch", "pre").select(*names).mapInArrow(
        lambda parts: batches(rows(parts), _SUMS),
        "digest binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")


def ends_hashed(ends: DataFrame, tasks: int) -> DataFrame:
    """``digest, ends_sha256`` of every node where conversations end (rows ``digest, owner``)."""

    def rows(parts) -> Iterator[tuple]:
        now, sha = None, None
        for part in parts:
            for digest, conv_id in pairs_of(part, "digest", "owner"):
                if digest != now:
                    if sha is not None:
                        yield now, sha.hexdigest()
                    now, sha = digest, hashlib.sha256(b"%d" % conv_id)
                else:
                    sha.update(b",%d" % conv_id)
        if sha is not None:
            yield now, sha.hexdigest()

    return ends.repartition(tasks, "digest").sortWithinPartitions("digest", "owner").mapInArrow(
        lambda parts: batches(rows(parts), _ENDS), "digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    tasks = tasks_for(conversations)
    local = materialise(local_tries(turns(conversations), tasks), "tries")
    same = Window.partitionBy("digest")
    nodes = local.where("pre >= 0").select(
        "*", F.min("owner").over(same).alias("conv_id"), F.sum("n_convs").over(same).alias("all_convs"), F.sum("n_ends").over(same).alias("all_ends"))
    sums = subtree_sums(nodes, tasks)
    ends = ends_hashed(local.where("pre < 0").select("digest", "owner"), tasks)
    rows = sums.withColumn("ends_sha256", F.lit(None).cast("string")).unionByName(ends, allowMissingColumns=True)
    known = [F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")]
    summed = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.groupBy("digest").agg(*known, *summed, F.coalesce(F.max("ends_sha256"), F.lit(nothing)).alias("ends_sha256")).drop("digest")
