"""Quality classifier (operator 1): random Fourier features, ridge, isotonic calibration.

Statistics of a text (no label, language, source or id among them) are standardised and
lifted by random Fourier features, which approximate a Gaussian kernel. Every partition
of the training rows sums its normal equations; the sums of all partitions are added in
two steps and the ridge weights solved once on the driver: ``FEATURES`` squared numbers,
whatever the number of rows. A part of the training rows is kept out of the fit and
calibrates its scores: isotonic regression on a histogram of scores, interpolated between
its levels, so that a score of 1/2 means that either label is as likely.

Defined cases: a null or empty text has its own statistics (all zero) and gets their
score. Repeated rows score each, and train each; rows without doc_id are never trained
on. Labels that are null, or that no document has, are ignored. With no labels at all
every score is 1/2; with one label every score is that label. Empty tables give empty
results. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.text import documents, materialise, pairs_of

FEATURES = 384
RIDGE = 1e-2
# Kernel width in standard deviations of the standardised statistics.
WIDTH = 4.0
SEED = 20240
# One training row in so many calibrates.
CALIBRATES = 4
SCORE_STEPS = 400

_LOWER, _UPPER = bytes(range(97, 123)), bytes(range(65, 91))
_DIGIT, _SPACE = b"0123456789", b" \t\n\r\x0b\x0c"
_SYMBOL, _POINT = b"#*$%&|<>@^~=+_\\/{}[]", b".,;:!?'\"()-"
_HIGH = bytes(range(128, 256))
_RUN = re.compile(rb"(.)\1{3,}", re.S)
STATISTICS = 24


def statistics(text: bytes | None) -> list[float]:
    """``STATISTICS`` numbers of one UTF-8 text; shares are in 0 to 1."""
    if not text:
        return [0.0] * STATISTICS
    n = len(text)
    share = lambda chars: (n - len(text.translate(None, chars))) / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(len(words), 1)
    lowered = [w.lower() for w in words]
    counts = Counter(lowered)
    pairs, triples = list(zip(lowered, lowered[1:], strict=False)), list(zip(lowered, lowered[1:], lowered[2:], strict=False))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    top = counts.most_common(10)
    plain = sum(w.isalpha() for w in words)
    upper = sum(w.isupper() for w in words)
    return [
        np.log1p(n), np.log1p(len(words)), share(_LOWER), share(_UPPER), share(_DIGIT), share(_SPACE), share(_SYMBOL), share(_POINT),
        share(_HIGH), np.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), float(lengths.mean()), float(lengths.std()),
        len(counts) / m, top[0][1] / m if top else 0.0, sum(c for _, c in top) / m, 1 - len(set(pairs)) / max(len(pairs), 1),
        1 - len(set(triples)) / max(len(triples), 1), sum(a == b for a, b in pairs) / m, plain / m, upper / m,
        sum(text.count(c) for c in (b". ", b".\n", b"? ")) / m, text.count(b"!") / m, sum(len(r.group()) for r in _RUN.finditer(text)) / n]


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: statistics of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def rows(parts) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, x = zip(*[(i, statistics(t)) for i, t in pairs_of(batch, "doc_id", "text")], strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(x, schema.field("x").type)], schema=schema)

    return documents(docs).mapInArrow(rows, "doc_id long, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), STATISTICS)


class Lift:
    """Standardised statistics -> random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        random = np.random.default_rng(SEED)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, np.inf)
        self.frequencies = random.normal(0, 1 / WIDTH, (STATISTICS, FEATURES))
        self.phases = random.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        # Beyond six deviations a statistic says no more.
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        out = np.sqrt(2 / FEATURES) * np.cos(z @ self.frequencies + self.phases)
        return np.column_stack([out, np.ones(len(out))])


def _summed(rows: DataFrame, lift: Lift, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows with columns ``x, y``."""
    size = FEATURES + 1
    as_bytes = "a binary"

    def partial(parts) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in parts:
            if len(batch):
                z = lift(_matrix(batch))
                total += z.T @ np.column_stack([z, batch.column("y").to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["a"])

    def added(parts) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size * (size + 1)), False
        for batch in parts:
            for a in batch.column("a").to_pylist():
                total += np.frombuffer(a)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["a"])

    # Of P partial sums, the square root of P tasks make as many sums again.
    sums = rows.mapInArrow(partial, as_bytes).repartition(max(1, int(np.sqrt(tasks)))).mapInArrow(added, as_bytes).toArrow()["a"].to_pylist()
    total = sum((np.frombuffer(a) for a in sums), np.zeros(size * (size + 1))).reshape(size, size + 1)
    return total[:, :size], total[:, size]


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and levels, both ascending, of means ``y`` with weights ``n``."""
    blocks: list[list[float]] = []
    for at, mean, weight in zip(x, y, n, strict=True):
        blocks.append([at * weight, mean * weight, weight])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Classifier:
    def __init__(self, lift: Lift | None, weights: np.ndarray | None, centres: np.ndarray, levels: np.ndarray):
        self.lift, self.weights, self.centres, self.levels = lift, weights, centres, levels

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.lift is None:
            return np.full(len(x), self.levels[0])
        # A little of the raw score keeps documents of one level in order.
        raw = self.raw(x)
        calibrated = np.interp(raw, self.centres, self.levels)
        return np.clip(0.998 * calibrated + 0.002 * np.clip(raw, 0, 1), 0, 1)


def fit(features: DataFrame, labels: DataFrame, train) -> Classifier:
    """Learns ``labels.quality`` from the rows of ``features`` whose doc_id ``train`` (a column) admits."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where(
        "doc_id is not null and y is not null")
    rows = materialise(
        features.where(train).join(marks, "doc_id").withColumn("calibrates", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATES)) == 0), "train")
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"),
        *[f(F.get("x", F.lit(i))).alias(f"{name}{i}") for i in range(STATISTICS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"] or moments["y"] in (0.0, 1.0):
        return Classifier(None, None, np.zeros(1), np.array([moments["y"] if moments["n"] else 0.5]))
    lift = Lift(np.array([moments[f"m{i}"] for i in range(STATISTICS)]), np.array([moments[f"s{i}"] for i in range(STATISTICS)]))
    fitted = rows.where("not calibrates") if rows.where("not calibrates").limit(1).count() else rows
    tasks = max(1, rows.rdd.getNumPartitions())
    gram, moment = _summed(fitted.select("x", "y"), lift, tasks)
    weights = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), moment)
    out = Classifier(lift, weights, np.zeros(1), np.zeros(1))

    def scored(parts) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield pa.RecordBatch.from_arrays([pa.array(out.raw(_matrix(batch)) if len(batch) else np.zeros(0)), batch.column("y")], names=["raw", "y"])

    held = rows.where("calibrates") if rows.where("calibrates").limit(1).count() else rows
    step = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("raw"))) * SCORE_STEPS)
    # At most 3 * SCORE_STEPS + 1 rows.
    table = held.select("x", "y").mapInArrow(scored, "raw double, y double").groupBy(step.alias("step")).agg(
        F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("step").toArrow()
    centres, levels = isotonic(*[table[c].to_numpy() for c in ("raw", "y", "n")])
    return Classifier(lift, weights, centres, levels)


def score(features: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id, score`` of every row of ``features``."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def rows(parts) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x = classifier.score(_matrix(batch)) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x)], schema=schema)

    return features.mapInArrow(rows, "doc_id long, score double")
