"""Best-fit packing with Martello-Toth dominance reduction (operator 7).

Documents become token ids (and a closing id 0), are cut only if longer than a
sequence, and the pieces are packed into sequences of ``CAPACITY`` tokens.

The packing itself only depends on how many pieces there are of each length, so it is
computed on that histogram: ``CAPACITY`` numbers, however many documents there are.
Equal sequences are made in one step with a multiplicity.

1. Reduction. For every piece j, the longest first, a set holding j *dominates* if every other
   feasible set holding j can be mapped into it part by part; an optimal packing with
   that set exists, so it is fixed and its pieces leave the instance. Checked, as in
   Martello and Toth's procedure, for sets of up to three pieces: j alone if nothing
   fits beside it; j and the longest i that fits beside it if they fill the sequence,
   if no two pieces fit beside j, or if any two or three that do are no longer than i.
   A piece without such a set is passed over and left for best fit.
2. The rest is packed best-fit, longest first: into the fullest sequence with room.

Pieces then take their places: a range sort by length numbers the pieces of a length
from 0, and intervals of those numbers belong to runs of equal sequences.

Defined cases: a null or empty text is the closing id alone. Repeated rows, and rows
with null doc_id, are packed like any other. An empty table gives an empty result.
Texts that name a special token of the vocabulary get its id, as the tokenizer does.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.text import batches, documents, kept, materialise, pairs_of

CAPACITY = 2048
END = 0
# Words whose ids a task remembers; beyond it the memory starts anew, results stay.
REMEMBERED = 250_000

_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("ids", pa.binary())])


# The tokenizer's own split, for words of ASCII and these Latin letters only: among them
# a letter is its own lower case once lowered, and no two of them compose.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_PLAIN = re.compile(f"[\x21-\x7e{_LATIN}]+")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it
    prints, else the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names = {b: chr(b) for b in plain}
    names.update({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in names)})
    return names


class WordIds(dict):
    """UTF-8 word -> ids as little-endian 32-bit numbers, coded at its first use.

    The tokenizer drops white space and never joins across it, so words can be coded
    one by one. A plain word is cut into its pieces here and only those go to the
    tokenizer's merges; any other word, and one with a special token's brackets, goes
    through the whole tokenizer.
    """

    def __init__(self, vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.merges = self.tokenizer.model
        self.names = _byte_names()
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode()
        if word.isalpha():  # letters of ASCII only
            ids = self._piece(text.lower())
        elif "<|" not in text and _PLAIN.fullmatch(text):
            ids = b"".join(map(self._piece, _PIECES.findall(text.lower())))
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            named = piece if piece.isascii() else "".join(map(self.names.__getitem__, piece.encode()))
            ids = self.pieces[piece] = array("I", [t.id for t in self.merges.tokenize(named)]).tobytes()
        return ids

    def encode(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, text.split() if text else ())) + END.to_bytes(4, "little")


def pieces(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and the ids) of every piece."""
    with open(vocabulary, "rb") as file:  # an installed file of a few MB, sent to the tasks
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    width, name = 4 * CAPACITY, os.path.basename(vocabulary)

    def rows(parts) -> Iterator[tuple]:
        coder = kept(f"word_ids {name}", lambda: WordIds(shared.value))
        for batch in parts:
            for doc_id, text in pairs_of(batch, "doc_id", "text"):
                ids = coder.encode(text)
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    yield doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None

    out = documents(docs).mapInArrow(
        lambda parts: batches(rows(parts), _PIECE, 512), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def reduce_and_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """Packs pieces given as length -> count.

    Returns placements ``(length, first, n, sequence, offset, each)``: pieces number
    first .. first + n - 1 of that length go ``each`` to a sequence, from ``sequence``
    on, at ``offset``; the number of sequences; and how many of them the reduction fixed.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    sizes = sorted(left)
    taken = dict.fromkeys(left, 0)
    placed: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def take(size: int, n: int, sequence: int, offset: int, each: int = 1) -> None:
        placed.append((size, taken[size], n, sequence, offset, each))
        taken[size] += n
        left[size] -= n
        if not left[size]:
            sizes.pop(bisect.bisect_left(sizes, size))

    def smallest(k: int, but: int) -> list[int]:
        """The k shortest pieces besides one of length ``but``."""
        out: list[int] = []
        for s in sizes:
            out += [s] * min(k - len(out), left[s] - (s == but))
            if len(out) >= k:
                break
        return out

    def longest_sum(k: int, room: int, but: int) -> int:
        """Largest total up to ``room`` of exactly k pieces (2 or 3) besides one of ``but``."""
        have = lambda s, used: left[s] - (s == but) - used.count(s)
        best = 0
        usable = sizes[: bisect.bisect_right(sizes, room)]
        if k == 2:
            for a in usable:
                i = bisect.bisect_right(usable, min(room - a, room)) - 1
                while i >= 0 and not (have(usable[i], [a]) > 0 and have(a, []) > 0):
                    i -= 1
                if i >= 0:
                    best = max(best, a + usable[i])
            return best
        for a in usable:
            if have(a, []) > 0 and a < room:
                two = longest_sum(2, room - a, but)
                best = max(best, a + two if two else 0)
        return best

    bound = capacity + 1
    while below := bisect.bisect_left(sizes, bound):
        j = sizes[below - 1]
        room = capacity - j
        low = smallest(3, j)
        if not low or low[0] > room:  # alone
            n = left[j] if j > room or left[j] == 1 else 1
            take(j, n, sequences, 0)
            sequences += n
            continue
        at = bisect.bisect_right(sizes, room) - 1
        while sizes[at] == j and left[j] < 2:
            at -= 1
        i = sizes[at]
        full = i == room
        no_two = len(low) < 2 or low[0] + low[1] > room
        no_three = len(low) < 3 or sum(low) > room
        # Beyond three pieces nothing is proved: then four that fit might be longer than i.
        four = smallest(4, j)
        no_four = len(four) < 4 or sum(four) > room
        dominates = full or no_two or (no_three and longest_sum(2, room, j) <= i) or (
            no_four and longest_sum(2, room, j) <= i and longest_sum(3, room, j) <= i)
        if not dominates:
            bound = j  # stays in the instance, as a partner for shorter ones too
            continue
        # All copies at once while the reason holds for each of them.
        n = min(left[i], left[j]) if i != j else left[j] // 2
        if i == j:
            take(j, 2 * n, sequences, 0, 2)
        else:
            take(j, n, sequences, 0)
            take(i, n, sequences, j)
        sequences += n
    fixed = sequences

    # Best fit, longest first: runs of sequences by the room they have left.
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def put(room: int, sequence: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append((sequence, n))

    while sizes:
        size = sizes[-1]
        while size in left and left[size]:
            k = bisect.bisect_left(order, size)
            if k == len(order):
                each = min(capacity // size, left[size])
                n = left[size] // each
                take(size, n * each, sequences, 0, each)
                put(capacity - size * each, sequences, n)
                sequences += n
                continue
            room = order[k]
            sequence, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(k)
            each = min(room // size, left[size])
            m = min(n, left[size] // each)
            take(size, m * each, sequence, capacity - room, each)
            put(room - size * each, sequence, m)
            put(room, sequence + m, n - m)
    return placed, sequences, fixed


def packed(cut: DataFrame) -> DataFrame:
    """``cut`` (with ``doc_id, piece, length``) and each piece's ``sequence_id, offset``."""
    spark = cut.sparkSession
    # Written first: the range sort draws a sample of its rows beforehand.
    lined = materialise(cut, "cut").repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    stored = materialise(lined.withColumn("place", F.monotonically_increasing_id()), "pieces")
    # The high bits of the place are the range partition, the low 33 the row in it.
    part = F.shiftright("place", 33)
    ends = stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed, _, _ = reduce_and_fit(counts)
    before = np.cumsum([0] + [r["n"] for r in ends])[:-1].tolist()
    lengths = sorted(counts)
    below = dict(zip(lengths, np.cumsum([0] + [counts[s] for s in lengths])[:-1].tolist()))
    # Placements as intervals of the overall order: length, then number within it.
    runs = spark.createDataFrame(
        [(s, below[s] + first, below[s] + first + n, sequence, offset, each) for s, first, n, sequence, offset, each in placed],
        "s_length long, s_first long, s_end long, s_sequence long, s_offset long, s_each long")
    starts = spark.createDataFrame([(r["part"], b) for r, b in zip(ends, before)], "s_part long, s_before long")
    # Both are small and go to the pieces, which never leave the JVM: with their ids they
    # take 8 KB each, and an Arrow batch of them more than a task's share of memory.
    number = F.col("s_before") + F.col("place").bitwiseAND((1 << 33) - 1)
    numbered = stored.join(F.broadcast(starts), part == F.col("s_part")).withColumn("s_number", number)
    inside = (F.col("length") == F.col("s_length")) & (F.col("s_number") >= F.col("s_first")) & (F.col("s_number") < F.col("s_end"))
    at = F.col("s_number") - F.col("s_first")
    return numbered.join(F.broadcast(runs), inside).select(
        *cut.columns, (F.col("s_sequence") + F.expr("(s_number - s_first) div s_each")).alias("sequence_id"),
        (F.col("s_offset") + at % F.col("s_each") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for all documents (and ``ids``)."""
    return packed(pieces(docs, vocabulary, with_ids))
