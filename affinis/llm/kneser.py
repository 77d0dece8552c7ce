"""Interpolated modified Kneser-Ney language model (operator 9), order two.

Tokens are lower-cased words and one end per text; the first token's context is a start
mark. Counting is a Spark job over all training texts: tasks count what they hold, send
sorted arrays per hash bucket, and merge them there. With c the bigram counts and N1 the
number of different words before w,

    p(w | v)  = (c(vw) - D(c)) / c(v) + g(v) p1(w)
    p1(w)     = (N1(w) - D'(N1)) / (number of bigrams) + g' / (V + 1)

where D and D' are the modified discounts from the counts of counts, and g(v), g' give
what was taken away to the lower order, so both sum to one over the V training tokens
and one unknown. Every bigram of the training texts is in the model.

The model is two sorted hash arrays, bigrams and words. A bigram's key begins with a hash
of its second word (of a frequent one, of a part of its contexts) and the bigrams are
dealt to tasks by ranges of it, so that what a task merges already is a piece of the
sorted array, about six bytes a bigram, and all bigrams of a word but a frequent one are
counted in one place. Every executor lays the pieces out once as flat files beside its
own work, and its workers map those files into memory and look keys up by binary search.
Nothing of the model passes through the driver but its size and a dozen sums.

Defined cases: a null or empty text is one end token. Rows without doc_id train, and are
not held out; repeated rows count and score each. An empty table gives an empty result,
and with no training rows every token has probability one. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.mapped import MappedCounts, MappedTable, places, publish, publish_counts
from affinis.llm.text import documents, materialise, mixed, pairs_of, signed, tasks_for, word_hashes, words_of

# A word with this share of all tokens is dealt over SALT buckets, as next word of a bigram.
HOT_SHARE = 1 / 2000
SALT = 16
# Tokens a task holds before it counts and sends them, or scores them.
CHUNK = 800_000
GROUP = 250_000

_UNI = pa.schema([("w", pa.int64()), ("c", pa.int64())])
_PACKED = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("runs", pa.binary()), ("before", pa.binary()), ("counts", pa.binary())])
_PIECE = ["low", "high", "count", "sizes", "wide_at", "wide"]
_MERGED = pa.schema([
    ("kind", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("piece", pa.int32()),
    *[(c, pa.binary()) for c in _PIECE]])
_MERGED_DDL = "kind int, key long, a long, b long, c long, piece int, " + ", ".join(f"{c} binary" for c in _PIECE)
# Rows of the merged table: a piece of the bigrams (key: its first leading bits, a: how many), different words before a
# word, bigrams of a context seen once, twice and more often, and counts of counts.
BIGRAMS, CONTINUATION, CONTEXT, COUNTS = range(4)
# Bits of a key that count its remainder, and leading bits at least and at most.
REST_BITS, LEAST_BITS, MOST_BITS = 40, 4, 26


def _marks() -> tuple[int, int]:
    """Hashes of the start and the end; no word contains a space."""
    hashes = word_hashes()
    return hashes[b"  "], hashes[b" "]


def _token_arrays(parts, size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Groups of documents: ids, all tokens' hashes, and where each document starts."""
    hashes = word_hashes()
    end = np.array([_marks()[1]], np.uint64)
    ids, held, n = [], [], 0
    for batch in parts:
        for doc_id, text in pairs_of(batch, "doc_id", "text"):
            h = hashes.of(words_of(text))
            ids.append(doc_id)
            held += [h, end]
            n += len(h) + 1
            if n >= size:
                yield ids, *_joined(held)
                ids, held, n = [], [], 0
    if ids:
        yield ids, *_joined(held)


def _joined(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(h) + 1 for h in held[::2]])
    return np.concatenate(held), np.r_[0, np.cumsum(lengths)[:-1]]


def _contexts(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    before = np.r_[tokens[:1], tokens[:-1]]
    before[starts] = _marks()[0]
    return before


def short(h: np.ndarray) -> np.ndarray:
    """What a bigram keeps of its first word: 48 bits."""
    return h >> np.uint64(16)


class Keys:
    """Keys of bigrams: ``bits`` leading bits and a remainder. ``hot`` words, sorted, are spread."""

    def __init__(self, hot: np.ndarray, bits: int):
        self.hot, self.bits = np.sort(hot), bits

    def of(self, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lead = mixed(word)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, word), len(self.hot) - 1)
            spread = self.hot[at] == word
            with np.errstate(over="ignore"):
                lead[spread] = mixed(word[spread] + mixed(before[spread]) % np.uint64(SALT))
        with np.errstate(over="ignore"):
            rest = mixed(word * np.uint64(0x9E3779B97F4A7C15) + before) & np.uint64((1 << REST_BITS) - 1)
        return lead >> np.uint64(64 - self.bits), rest


def word_counts(train: DataFrame) -> DataFrame:
    """``w, c``: every training token's hash and count."""

    def rows(parts) -> Iterator[pa.RecordBatch]:
        for _, tokens, _ in _token_arrays(parts, CHUNK):
            w, c = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(w)), pa.array(c)], schema=_UNI)

    return train.mapInArrow(rows, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def bigram_counts(train: DataFrame, keys: Keys, buckets: int, tasks: int) -> DataFrame:
    """Rows of four kinds, see ``BIGRAMS``. ``buckets``, a power of two, cut the leading bits."""
    shared, shift = train.sparkSession.sparkContext.broadcast(keys), keys.bits - (buckets.bit_length() - 1)

    def packed(parts) -> Iterator[pa.RecordBatch]:
        for _, tokens, starts in _token_arrays(parts, CHUNK):
            before = short(_contexts(tokens, starts))
            order = np.lexsort((before, tokens))
            w, v = tokens[order], before[order]
            first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])])
            counts = np.diff(np.r_[first, len(w)])
            w, v = w[first], v[first]
            bucket = shared.value.of(v, w)[0] >> np.uint64(shift)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(1, buckets, dtype=np.uint64))
            out = []
            for b, at in enumerate(np.split(order, cuts)):
                if len(at):
                    words, runs = np.unique(w[at], return_counts=True)
                    kind = np.uint8 if (most := counts[at].max()) < 256 else np.uint16 if most < 65536 else np.uint32
                    out.append((b, words.tobytes(), runs.astype(np.uint32).tobytes(),
                                np.ascontiguousarray(v[at].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), counts[at].astype(kind).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PACKED, strict=True)], schema=_PACKED)

    def merged(b: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        w, v, c = [], [], []
        for words, runs, before, counts in rows:
            w.append(np.repeat(np.frombuffer(words, np.uint64), np.frombuffer(runs, np.uint32)))
            wide = np.zeros((len(before) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(before, np.uint8).reshape(-1, 6)
            v.append(wide.reshape(-1).view(np.uint64))
            c.append(np.frombuffer(counts, f"u{len(counts) // len(wide)}").astype(np.int64))
        w, v, c = np.concatenate(w), np.concatenate(v), np.concatenate(c)
        order = np.lexsort((v, w))
        w, v, c = w[order], v[order], c[order]
        first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])])
        w, v, c = w[first], v[first], np.add.reduceat(c, first)
        words, types = np.unique(w, return_counts=True)
        yield from _rows(CONTINUATION, signed(words), types)
        yield from _rows(COUNTS, np.arange(1, 5), np.array([(c == k).sum() for k in range(1, 5)]))
        contexts, at = np.unique(v, return_inverse=True)
        sums = [np.bincount(at, weights=x, minlength=len(contexts)).astype(np.int64) for x in (c == 1, c == 2, c > 2)]
        yield from _rows(CONTEXT, contexts.view(np.int64), *sums)
        top, rest = shared.value.of(v, w)
        order = np.lexsort((rest, top))
        piece = MappedCounts.packed(top[order], rest[order], c[order], b << shift, 1 << shift)
        plain = [BIGRAMS, b << shift, len(c), None, None, b]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([*plain, *piece], _MERGED, strict=True)], schema=_MERGED)

    def by_bucket(parts) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in parts:
            for bucket, *row in pairs_of(batch, "bucket", "words", "runs", "before", "counts"):
                if bucket != now:
                    if held:
                        yield from merged(now, held)
                    now, held = bucket, []
                held.append(row)
        if held:
            yield from merged(now, held)

    return (
        train.mapInArrow(packed, "bucket int, words binary, runs binary, before binary, counts binary")
        .repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(by_bucket, _MERGED_DDL))


def _rows(kind: int, key: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(key), 100_000):
        part = [pa.array(x[at : at + 100_000].astype(np.int64)) for x in (key, *values)]
        m = len(part[0])
        rest = [pa.nulls(m, f.type) for f in list(_MERGED)[1 + len(part) :]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), *part, *rest], schema=_MERGED)


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from counts of counts."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


class Model:
    """What tasks need to find and read the model."""

    def __init__(self, words: MappedTable, bigrams: MappedCounts, keys: Keys, numbers: dict):
        self.words, self.bigrams, self.keys, self.numbers = words, bigrams, keys, numbers


def fit(train: DataFrame, mounted: bool | None = None) -> Model:
    """Counts ``train`` (``doc_id, text``) and writes the model.

    ``mounted``: see :func:`affinis.llm.mapped.publish`.
    """
    spark = train.sparkSession
    tasks = tasks_for(train)
    uni = materialise(word_counts(train), "words")
    n, v = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # At most 1 / HOT_SHARE words can have that share.
    hot = uni.where(F.col("c") > max(1000, n * HOT_SHARE)).select("w").toArrow()["w"].to_numpy().view(np.uint64)
    # A power of two of buckets, several to a task; leading bits for a few bigrams each.
    buckets = 1 << (4 * tasks - 1).bit_length()
    keys = Keys(hot, min(max(int(n).bit_length() - 4, LEAST_BITS, buckets.bit_length() - 1), MOST_BITS))
    merged = materialise(bigram_counts(train, keys, buckets, tasks), "bigrams")
    totals = {(r["kind"], r["k"]): r["a"] for r in merged.groupBy("kind", F.when(F.col("kind") == COUNTS, F.col("key")).alias("k")).agg(F.sum("a").alias("a")).collect()}
    d = discounts([totals.get((COUNTS, k), 0) for k in range(1, 5)])
    n1 = merged.where(F.col("kind") == CONTINUATION).groupBy("key").agg(F.sum("a").alias("n1"))
    context = merged.where(F.col("kind") == CONTEXT).groupBy("key").agg(
        F.sum(F.col("a") * d[0] + F.col("b") * d[1] + F.col("c") * d[2]).alias("taken"))
    start = signed(np.array([_marks()[0]], np.uint64))[0]
    texts = train.count()
    # The start mark is a context too: it comes before every text's first token.
    known = uni.unionAll(spark.createDataFrame([(int(start), 0)], "w long, c long"))
    words = materialise(
        known.join(n1.withColumnRenamed("key", "w"), "w", "left")
        .withColumn("v", F.shiftrightunsigned("w", 16)).join(context.withColumnRenamed("key", "v"), "v", "left")
        .select(F.col("w").alias("key"), "c", F.coalesce("n1", F.lit(0)).cast("int").alias("n1"), F.coalesce("taken", F.lit(0.0)).alias("taken")), "words")
    of = words.agg(*[F.count(F.when(F.col("n1") == k, 1)).alias(f"n{k}") for k in range(1, 5)], F.count(F.when(F.col("n1") > 2, 1)).alias("more")).first()
    d1 = discounts([of[f"n{k}"] for k in range(1, 5)])
    types = totals.get((CONTINUATION, None), 0)
    taken = of["n1"] * d1[0] + of["n2"] * d1[1] + of["more"] * d1[2]
    pieces = {r["piece"]: (r["key"], r["a"]) for r in merged.where(F.col("kind") == BIGRAMS).select("piece", "key", "a").collect()}
    numbers = {
        "tokens": int(n), "types": int(v), "texts": texts, "d": d, "d1": d1, "pairs": int(types), "g1": taken / types if types else 1.0}
    return Model(
        publish(words, v + 1, {"key": np.int64, "c": np.int64, "n1": np.int32, "taken": np.float64}, "words-mapped", mounted),
        publish_counts(merged, keys.bits, pieces, mounted), keys, numbers)


def _discount(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.where(c == 0, 0.0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def rows(parts) -> Iterator[pa.RecordBatch]:
        words, bigrams, m = model.words.arrays(), model.bigrams.arrays(), model.numbers
        for ids, tokens, starts in _token_arrays(parts, GROUP):
            before = _contexts(tokens, starts)
            every, inverse = np.unique(signed(np.concatenate([tokens, before])), return_inverse=True)
            at, there = places(words["key"], every)
            pick = lambda c: np.where(there, words[c][at], 0)  # noqa: B023, E731
            c, n1, taken = pick("c"), pick("n1").astype(float), pick("taken")
            is_start = every == signed(np.array([_marks()[0]], np.uint64))[0]
            followed = np.where(is_start, m["texts"], c).astype(float)
            lower = (n1 - _discount(n1, m["d1"])) / max(m["pairs"], 1) + m["g1"] / (m["types"] + 1)
            base = np.log10((c + 0.5) / (m["tokens"] + 0.5 * (m["types"] + 1)))
            back = np.where(followed > 0, taken / np.maximum(followed, 1), 1.0)
            w, v = inverse[: len(tokens)], inverse[len(tokens) :]
            top, rest = model.keys.of(short(before), tokens)
            order = np.lexsort((rest, top))
            pair = np.zeros(len(tokens))
            pair[order] = MappedCounts.find(bigrams, top[order], rest[order])
            p = np.maximum(pair - _discount(pair, m["d"]), 0) / np.maximum(followed[v], 1) + back[v] * lower[w]
            total = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(np.diff(np.r_[starts, len(tokens)])), pa.array(total((c > 0)[w].astype(np.int64))),
                pa.array(total(base[w])), pa.array(total(np.log10(p)))], schema=schema)

    return documents(docs).mapInArrow(rows, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexity(log10_probability: float, tokens: int) -> float:
    return math.pow(10, -log10_probability / tokens)
