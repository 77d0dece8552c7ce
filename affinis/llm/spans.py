"""Substring dedup by sliding sentence spans (operator 5).

A text is cut into sentences at ``.``, ``!`` or ``?`` before white space and at line
breaks, and a sentence of ``CUT_WORDS`` or more words is cut on where its content says so:
in every window of that many words, after the word with the smallest hash (ties go by the
words before it, then to the cut that is already there). No piece is longer than the
window, and two copies of a passage are cut alike from the first window inside it to the
last, wherever they stand in their sentences.

Runs are as many consecutive pieces as it takes to reach ``MIN_WORDS`` words: the shortest
from every piece on, and the shortest up to every piece. They are hashed (case and white
space don't count, line breaks do). Any 51 equal words with the same line breaks lose at
most 20 words to the first cut and 19 after the last, so they hold a run, ties at their
first two words aside. Runs that occur more than once in the corpus are found by a global
aggregate; the occurrence with the smallest (doc_id, text hash, position) is the first.
Every piece that a non-first occurrence covers is removed. :func:`repeats` without
``whole`` takes only runs of exactly ``SPAN`` pieces; the query doesn't use it that way.

Plans: hashes are aggregated with map-side combine, so a passage in a third of all
documents costs one row per task; only repeated hashes survive and are joined back to
the runs, where adaptive execution splits the frequent ones.

Defined cases: null and empty texts have no sentences. Rows without doc_id take part and
come last in the order. Repeated rows are copies: all but one lose their repeated runs
(equal ids and texts are told apart by a row number). Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.text import batches, drop, free_name, materialise, pairs_of

SPAN = 3
MIN_WORDS = 12
CUT_WORDS = 20
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?]+(?=\s|$)|(?=\n)|$)", re.S)
_WORD = re.compile(r"\S+")
_RUN = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())])


def _cuts(h: list[int]) -> list[int]:
    """Where a long sentence of these word hashes is cut: numbers of words before each cut."""
    none = 1 << 64
    keys = list(zip(h, [none, *h], [none, none, *h], strict=False))
    out, at = [], -1
    for last in range(CUT_WORDS - 1, len(h)):
        first = last - CUT_WORDS + 1
        if at < first:
            at = min(range(last, first - 1, -1), key=keys.__getitem__)
        elif keys[last] < keys[at]:
            at = last
        else:
            continue
        out.append(at + 1)
    return out


def sentences(text: str) -> list[tuple[int, int, int, int]]:
    """``start, end, words, hash`` of every sentence or piece of one, positions in code points."""
    out = []
    digest = lambda s: xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    for match in _SENTENCE.finditer(text):
        low, high = match.span()
        words = [m.span() for m in _WORD.finditer(text, low, high)]
        said = [text[a:b].lower() for a, b in words]
        cuts = _cuts([digest(w) for w in said]) if len(words) >= CUT_WORDS else []
        for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True):
            if a < b:
                out.append((words[a][0], words[b - 1][1], b - a, digest(" ".join(said[a:b]))))
    return out


def fixed_runs(words: list[int]) -> list[tuple[int, int]]:
    """Runs of ``SPAN`` pieces with enough words, as ranges of pieces."""
    return [(k, k + SPAN) for k in range(len(words) - SPAN + 1) if sum(words[k : k + SPAN]) >= MIN_WORDS]


def shortest_runs(words: list[int]) -> list[tuple[int, int]]:
    """The shortest run with enough words from every piece on, and up to every piece."""
    out, low, high, held = set(), 0, 0, 0
    for low in range(len(words)):
        while high < len(words) and held < MIN_WORDS:
            held += words[high]
            high += 1
        if held < MIN_WORDS:
            break
        out.add((low, high))
        held -= words[low]
    low = held = 0
    for high, n in enumerate(words, 1):
        held += n
        while held - words[low] >= MIN_WORDS:
            held -= words[low]
            low += 1
        if held >= MIN_WORDS:
            out.add((low, high))
    return sorted(out)


def numbered(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text``, written, so that the number of a row is always the same."""
    return materialise(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text")), "rows")


def spans(rows: DataFrame, whole: bool = False) -> DataFrame:
    """``row, doc_id, pos, start, end, hash`` of every run of sentences."""
    runs_of = shortest_runs if whole else fixed_runs

    def found(parts) -> Iterator[tuple]:
        for batch in parts:
            for row, doc_id, text in pairs_of(batch, "row", "doc_id", "text"):
                parts_of = sentences(text.decode()) if text else []
                for low, high in runs_of([p[2] for p in parts_of]):
                    h = xxhash.xxh3_64_intdigest(b"".join(p[3].to_bytes(8, "little") for p in parts_of[low:high]))
                    yield row, doc_id, low, parts_of[low][0], parts_of[high - 1][1], h - (h >> 63 << 64)

    return rows.mapInArrow(
        lambda parts: batches(found(parts), _RUN), "row long, doc_id long, pos int, start int, end int, hash long")


def repeats(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``row, doc_id, spans, n_spans, n_chars``: what each document with repeated runs loses.

    ``spans`` are merged ranges of code points ``(start, end)`` in order, end exclusive.
    With ``whole``, runs are the shortest with ``MIN_WORDS`` words; else ``SPAN`` pieces each.
    """
    given = {"row", "doc_id", "text"} == set(docs.columns)
    rows = docs if given else numbered(docs)
    runs = materialise(spans(rows, whole), "runs")
    if not given:
        drop(rows)  # all that follows reads the runs
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "pos")
    twice = materialise(
        runs.groupBy("hash").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "first"), "repeated")
    later = runs.join(twice, "hash").where((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
    # A document's own runs meet in one row; they are at most twice as many as its pieces.
    ranges = later.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))

    def merge(held, r):
        last = F.element_at(held, -1)
        apart = (F.size(held) == 0) | (F.get(held, F.size(held) - 1)["end"] < r["start"])
        return F.when(apart, F.concat(held, F.array(r))).otherwise(F.concat(
            F.slice(held, F.lit(1), F.size(held) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end")))))

    merged = ranges.select("row", "doc_id", F.aggregate("ranges", F.array().cast("array<struct<start:int,end:int>>"), merge).alias("spans"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return merged.withColumn("n_spans", F.size("spans")).withColumn("n_chars", lost)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated sentences cut out of ``text``; all columns and rows kept."""
    row, cut = free_name(docs, "row"), free_name(docs, "cut")
    whole = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    plain = whole.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lost = repeats(plain, whole=True).select(F.col("row").alias(row), F.col("spans").alias(cut))
    text, state = F.col("text"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    kept = F.aggregate(
        cut, state,
        lambda s, r: F.struct(r["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, r["start"] - s["at"])).alias("out")),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return whole.join(lost, row, "left").withColumn("text", F.when(F.col(cut).isNotNull(), kept).otherwise(text)).select(
        *[F.col(f"`{c}`") for c in docs.columns])
