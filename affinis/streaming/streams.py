"""The batch operators on file streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from affinis.models.base import FactorModel
from affinis.operators.normal import partial_statistics, ridge_around_mean, unpack
from affinis.operators.vectorsum import _join_limbs, _limb_sums
from affinis.sources.fixtures import EVENT_LABELS


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Events as a stream of files, with the event time as a zoned timestamp.

    The files carry local timestamps, which watermarks refuse; the session zone
    must be UTC for the cast to keep them.
    """
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    names = F.create_map(*[F.lit(x) for kv in EVENT_LABELS.items() for x in kv])
    return reader.parquet(folder).select(
        F.col("user_id").alias("user"), F.from_json("props", "k bigint")["k"].alias("item"),
        names[F.col("event_type")].alias("label"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def _drain(writer, path: str) -> None:
    query = writer.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _upserts(spark: SparkSession, path: str, key: str, schema) -> DataFrame:
    """Current row per key from a folder of per-batch upserts."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    values = [c for c in schema.names if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("row")).select(
        key, *[F.col(f"row.{c}").alias(c) for c in values])


def item_statistics(ratings: DataFrame, path: str) -> DataFrame:
    """Running count and sum per item, in update mode; returns the current table.

    Every batch writes the rows it changed to its own folder, so repeating a
    batch after a failure overwrites it instead of counting twice.
    """
    spark = ratings.sparkSession
    sums = ratings.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    _drain(sums.writeStream.outputMode("update").foreachBatch(write), path)
    return _upserts(spark, f"{path}/rows", "item", sums.schema)


def quorum_sums(messages: DataFrame, path: str, threshold: int, length: str = "1 day", delay: str = "0 seconds") -> DataFrame:
    """Wrapping sum per round and position, for rounds the watermark has closed.

    ``messages``: user, ts, arrived, vec. A round is a time window; the last
    message of a user counts; rounds with fewer than ``threshold`` senders are
    left out; messages of closed rounds are dropped by the watermark.
    """
    spark = messages.sparkSession
    latest = (
        messages.withWatermark("ts", delay)
        .groupBy(F.window("ts", length).alias("round"), "user").agg(F.max_by("vec", "arrived").alias("vec"))
    )
    # Position -1 holds the length of the vector: its row counts a round's senders
    # and knows the shortest vector, to which the round is cut.
    led = F.concat(F.array(F.size("vec").cast("bigint")), F.col("vec"))
    sums = (
        latest.where("vec is not null").select("round", F.posexplode(led).alias("at", "value"))
        .groupBy("round", "at").agg(F.count(F.lit(1)).alias("senders"), F.min("value").alias("least"), *_limb_sums(F.col("value")))
        .select(F.col("round.start").alias("round"), (F.col("at") - 1).alias("pos"), "senders", "least", _join_limbs().alias("total"))
    )
    _drain(sums.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows"), path)
    rows = spark.read.schema(sums.schema).parquet(f"{path}/rows")
    rounds = rows.where((F.col("pos") == -1) & (F.col("senders") >= threshold)).select(
        "round", "senders", F.col("least").alias("shortest"))
    return rows.where("pos >= 0").select("round", "pos", "total").join(rounds, "round").where(
        F.col("pos") < F.col("shortest")).select("round", "pos", "senders", "total")


def latest_ratings(ratings: DataFrame, path: str) -> DataFrame:
    """The last rating of every pair by ``arrived``, whatever order batches bring them in.

    ``ratings``: user, item, rating, arrived. The state is a native aggregate per pair;
    every batch writes the pairs it changed, and repeating it overwrites them.
    """
    spark = ratings.sparkSession
    last = ratings.groupBy("user", "item").agg(F.max_by("rating", "arrived").alias("rating"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    _drain(last.writeStream.outputMode("update").foreachBatch(write), path)
    rows = spark.read.schema(T.StructType([*last.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    return rows.groupBy("user", "item").agg(F.max_by("rating", "batch").alias("rating"))


def fold_in_latest(ratings: DataFrame, model: FactorModel, path: str, lam: float = 0.1) -> DataFrame:
    """Fold-in of a stream in which the last rating of a pair replaces earlier ones.

    The stream keeps the ratings; users are solved against the fixed items in one pass
    over the current table, as in the batch fold-in.
    """
    from affinis.models.foldin import fold_in_als

    return fold_in_als(model, latest_ratings(ratings, path), lam)


def fold_in(ratings: DataFrame, model: FactorModel, path: str, lam: float = 0.1) -> DataFrame:
    """Continuous fold-in of a stream of ratings against fixed item factors.

    The state of a user is its normal-equation sums, which are additive, kept in
    the stream's state store: a batch touches the users it contains and nothing
    else. Ratings are summed per user inside each Arrow batch before they are
    shuffled, so a user who dominates the stream costs one row per batch.
    Centring by the user's mean is derived from the sums. Returns the current
    user rows.
    """
    spark, k = ratings.sparkSession, model.params["k"]
    solver = ridge_around_mean(k, lam)
    rows = ratings.join(model.items.select("item", "f"), "item").select(
        F.col("user").alias("key"), F.col("rating").alias("y"), F.col("f").alias("x"))

    def update(key, parts, state):
        n, gram, rhs = 0, 0.0, 0.0
        if state.exists:
            n, packed_sums = state.get[0], np.frombuffer(state.get[1])
            rhs, gram = packed_sums[: k + 1], packed_sums[k + 1:]
        for part in parts:
            n += int(part["n"].sum())
            gram = gram + np.stack(part["gram"].to_numpy()).sum(axis=0)
            rhs = rhs + np.stack(part["rhs"].to_numpy()).sum(axis=0)
        state.update((n, np.concatenate([rhs, gram]).tobytes()))
        bias, f = solver(np.array([float(n)]), unpack(gram[None, :], k + 1), rhs[None, :], np.zeros(1))
        yield pd.DataFrame({"user": [key[0]], "bias": bias, "f": [f[0].tolist()]})

    out_schema = "user bigint, bias double, f array<double>"
    solved = partial_statistics(rows, k).groupBy("key").applyInPandasWithState(
        update, out_schema, "n bigint, sums binary", "update", GroupStateTimeout.NoTimeout)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    _drain(solved.writeStream.outputMode("update").foreachBatch(write), path)
    return _upserts(spark, f"{path}/rows", "user", solved.schema)
