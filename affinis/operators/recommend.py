"""Top-k items for a group of users.

For models whose score is linear in the user's row the group mean is taken
first: mean(b_u) + mean(u).v + c_i needs one aggregate over the group and one
pass over the items, never group x items.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.functions.vectors import dot, elem, literal_vector, zeros
from affinis.models.base import FactorModel, Model
from affinis.operators.layout import arrow_rows, cores, fits_broadcast
from affinis.operators.prepare import dense_ids

USERS_PER_SLOT = 256
# Member x item scores that a task holds at once, and those it computes in all.
SCORES_AT_ONCE, SCORES_PER_TASK = 2_000_000, 1_000_000_000
# Up to this many rows the final numbering happens in one small task.
SMALL_TOP = 10_000


def group_members(users: DataFrame) -> DataFrame:
    """user, weight: a member named several times counts as often."""
    return users.groupBy("user").agg(F.count(F.lit(1)).alias("weight"))


def candidates(model: Model, items: DataFrame | None) -> DataFrame:
    """The items named, else all of 0 .. n_items - 1, rated or not."""
    if items is not None:
        return items.select("item").distinct()
    return SparkSession.active().range(model.n_items()).withColumnRenamed("id", "item")


def group_grid(users: DataFrame, items: DataFrame) -> DataFrame:
    """(user, item, weight) for every member and candidate, as an equi-join on a slot.

    Members are dealt to slots of bounded size and candidates are repeated once
    per slot, so each task holds a few hundred members at most.
    """
    members = group_members(users)
    n = members.count()
    slots = max(1, math.ceil(n / USERS_PER_SLOT))
    dealt = members.withColumn("slot", F.pmod(F.xxhash64("user"), F.lit(slots)).cast("int"))
    spread = items.select("item", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    if fits_broadcast(n, 24):  # counted: the candidates then stay where they are
        dealt = F.broadcast(dealt)
    return spread.join(dealt, "slot").select("user", "item", "weight")


def _group_row(model: FactorModel, users: DataFrame | None, extra: DataFrame | None):
    """Mean bias and mean factors of known and folded-in members: k + 1 numbers."""
    k = model.params["k"]
    parts = []
    if users is not None:
        parts.append(users.select("user").join(model.user_rows(users).select("user", "bias", "f"), "user", "left"))
    if extra is not None:
        parts.append(extra.select("user", "bias", "f"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    row = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("bias", F.lit(0.0))).alias("b"),
        *[F.sum(F.coalesce(elem(F.col("f"), j), F.lit(0.0))).alias(f"c{j}") for j in range(k)]).first()
    if row["n"] == 0:
        raise ValueError("the group is empty")
    return row["b"] / row["n"], [row[f"c{j}"] / row["n"] for j in range(k)]


def _filled(k: int) -> list[Column]:
    """b, f and whether f lacks a number, which makes its products count as 0 whatever the other side has."""
    whole = F.col("f").isNotNull() & ~F.exists("f", lambda e: e.isNull())
    return [F.coalesce("bias", F.lit(0.0)).alias("b"), F.when(whole, F.col("f")).otherwise(zeros(k)).alias("f"), (~whole).alias("lacks")]


def _member_rows(model: FactorModel, users: DataFrame | None, extra: DataFrame | None) -> DataFrame:
    """weight, b, f, lacks of every member; what a member lacks counts as 0."""
    parts = []
    if users is not None:
        known = model.users.select("user", "bias", "f")
        parts.append(group_members(users).join(known, "user", "left").select("weight", "bias", "f"))
    if extra is not None:
        parts.append(extra.select(F.lit(1).cast("bigint").alias("weight"), "bias", "f"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select(F.col("weight").cast("double").alias("weight"), *_filled(model.params["k"]))


def _all_scores(model: FactorModel, members: DataFrame, n: int, items: DataFrame) -> DataFrame:
    """item, score: every member scored against every item inside the items' tasks, which
    hold all members' rows (counted to be small). Neither pairs nor vectors are shuffled."""
    k, spark = model.params["k"], items.sparkSession
    got = members.toArrow()
    f = got.column("f").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, k)
    held = spark.sparkContext.broadcast((got.column("weight").to_numpy(), got.column("b").to_numpy(), f, got.column("lacks").to_numpy()))
    base, low, high = float(model.params.get("intercept", 0.0)), model.params.get("low"), model.params.get("high")
    most = items.count()
    cand = items.join(model.items.select("item", "bias", "f"), "item", "left").select(
        F.col("item").cast("bigint").alias("item"), *_filled(k))
    tasks = max(cores(spark), min(max(1, most // 100), math.ceil(most * n / SCORES_PER_TASK)))

    def score(batches):
        weight, b, f, lacks = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ib = batch.column("b").to_numpy(zero_copy_only=False)
            bare = batch.column("lacks").to_numpy(zero_copy_only=False)
            vf = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k)
            total = np.zeros(batch.num_rows)
            for lo in range(0, len(weight), step := max(1, SCORES_AT_ONCE // batch.num_rows)):
                part = slice(lo, lo + step)
                product = vf @ f[part].T
                product[bare], product[:, lacks[part]] = 0.0, 0.0
                each = base + b[None, part] + ib[:, None] + product
                if low is not None:  # a score that is no number is above all others, as in FactorModel.clip
                    each = np.where(np.isnan(each), high, np.clip(each, low, high))
                total += each @ weight[part]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(total / weight.sum())], names=["item", "score"])

    arrow_rows(spark, 8 * (k + 4))
    return cand.repartition(tasks, "item").mapInArrow(score, "item bigint, score double")


def item_scores(
    model: Model, users: DataFrame | None, extra: DataFrame | None = None, items: DataFrame | None = None,
    pushdown: bool = True,
) -> DataFrame:
    """item, score: mean prediction over the group for every candidate."""
    if users is None and extra is None:
        raise ValueError("the group is empty")
    if pushdown and model.bilinear and model.params.get("low") is None:
        bias, f = _group_row(model, users, extra)
        cand = candidates(model, items).join(model.items.select("item", "bias", "f"), "item", "left")
        k = model.params["k"]
        score = F.lit(float(model.params["intercept"]) + float(bias)) + F.coalesce("bias", F.lit(0.0)) + F.coalesce(
            dot(F.col("f"), literal_vector(f), k) if k else F.lit(0.0), F.lit(0.0))
        return cand.select("item", score.alias("score"))
    items = candidates(model, items)
    if users is not None and extra is None and hasattr(model, "item_scores"):
        members = group_members(users)
        n = members.agg(F.sum("weight")).first()[0]
        if not n:
            raise ValueError("the group is empty")
        known = model.item_scores(members).join(members, "user").groupBy("item").agg(
            (F.sum(F.col("prediction") * F.col("weight")) / n).alias("score"))
        return items.join(known, "item", "left").fillna(0.0, ["score"])
    if type(model).predict is FactorModel.predict:
        members = _member_rows(model, users, extra)
        n = members.count()
        if n and fits_broadcast(n, 8 * (model.params["k"] + 4)):
            return _all_scores(model, members, n, items)
    scored = []
    if users is not None:
        scored.append(model.predict(group_grid(users, items)))
    if extra is not None:
        # A newcomer's rows, several for neighbour lists, make one member.
        once = group_grid(extra.select("user").distinct(), items)
        scored.append(model.predict(once, extra))
    stacked = scored[0] if len(scored) == 1 else scored[0].unionByName(scored[1])
    weight = F.when(F.col("prediction").isNotNull(), F.col("weight"))
    return stacked.groupBy("item").agg((F.sum(F.col("prediction") * F.col("weight")) / F.sum(weight)).alias("score"))


def top(scores: DataFrame, k: int | None) -> DataFrame:
    """rank, item, score, best first; equal scores put the larger id first."""
    order = [F.desc_nulls_last("score"), F.desc("item")]
    if k == 0:
        return scores.select(F.lit(0).cast("bigint").alias("rank"), "item", "score").where(F.lit(False))
    if k is not None and k <= SMALL_TOP:
        first = scores.orderBy(*order).limit(k)
        return first.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), "item", "score")
    lowest = F.lit(float("-inf"))
    numbered = dense_ids(scores.select("item", "score"), [-F.coalesce("score", lowest), -F.col("item")], "__r", "ranked")
    ranked = numbered.select((F.col("__r") + 1).alias("rank"), "item", "score")
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def recommend(
    model: Model, users: DataFrame | None, extra: DataFrame | None = None, items: DataFrame | None = None,
    k: int | None = None, method: str = "mean", exclude_seen: DataFrame | None = None, pushdown: bool = True,
) -> DataFrame:
    """The ``k`` best items (all when None) for known and folded-in members.

    Only the mean is defined as combination. ``exclude_seen`` (a ratings table)
    leaves out what a known member has rated; by default nothing is left out.
    """
    if method != "mean":
        raise NotImplementedError(f"combination {method!r}")
    scores = item_scores(model, users, extra, items, pushdown)
    if exclude_seen is not None and users is not None:
        seen = exclude_seen.join(users.select("user").distinct(), "user", "left_semi").select("item").distinct()
        scores = scores.join(seen, "item", "left_anti")
    return top(scores, k)
