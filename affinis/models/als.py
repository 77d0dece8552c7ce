"""Alternating least squares: plain, biased, tag-extended and zero-filled.

All of them run the half-sweep of :mod:`affinis.operators.normal`. Users are
solved first, then items, in every sweep. Starting factors are functions of the id.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.vectors import start_value, start_vector, zeros
from affinis.models.base import FactorModel
from affinis.operators import stats
from affinis.operators.layout import ROUTED_BYTES, RatingStore, Sweeps, materialise, scratch_path, task_count
from affinis.operators.normal import (
    gram_matrix, half_sweep, joint_ridge, product, ridge, ridge_with_bias, times_matrix)

# What a sweep of Spark's ALS may move per rating: about as much as dealing the rating anew.
MOVED_BYTES = 24
# Ratings in one of its blocks, of 12 bytes while the block is built and 8 afterwards.
BLOCK_RATINGS = 64_000_000
# What a task of it may hold: factors as Java arrays, and ratings while they are sorted.
HELD_BYTES = 512 << 20


def _due(sweep: int, iterations: int, every: int) -> bool:
    return sweep == iterations - 1 or (sweep + 1) % every == 0


def _fixed(table: DataFrame, key: str, offset: Column | None = None) -> DataFrame:
    """``key, v, f`` for a half-sweep: v is what a rating loses before it is a target."""
    return table.select(key, (F.lit(0.0) if offset is None else offset).alias("v"), "f")


def _started(store: RatingStore, key: str, k: int, seed: int, init: str, offset: Column | None = None, scale: float = 1.0) -> DataFrame:
    f = start_vector(F.col(key), k, seed, init)
    if scale != 1.0:
        f = F.transform(f, lambda e: e * F.lit(scale))
    return _fixed(store.ids(key).withColumn("f", f), key, offset)


def fit_als(
    ratings: DataFrame, k: int = 20, iterations: int = 40, lam: float = 0.1, seed: int = 42,
    init: str = "uniform", checkpoint_every: int = 4, on_sweep=None,
) -> FactorModel:
    """User-centred ratings factorised with penalty lam * (ratings of the key)."""
    means = materialise(stats.user_means(ratings), "user-means")
    store = RatingStore(stats.center_by_user(ratings, means))
    solver = ridge(k, lam)

    def model(u: DataFrame, v: DataFrame) -> FactorModel:
        users = means.join(u.select("user", "f"), "user")
        return FactorModel("als", {"user_factors": users, "item_factors": v}, {"k": k, "intercept": 0.0})

    v, sweeps = None, Sweeps()
    for sweep in range(iterations):
        fixed = _started(store, "item", k, seed, init) if v is None else _fixed(v, "item")
        u = half_sweep(store, "user", k, solver, fixed)
        last = _due(sweep, iterations, checkpoint_every)
        if last or on_sweep:
            u = sweeps.write(u, "als-user")
        v = half_sweep(store, "item", k, solver, _fixed(u, "user"))
        if last or on_sweep:
            v = sweeps.write(v, "als-item")
        if on_sweep:
            on_sweep(sweep, model(u, v))
    store.release()
    return model(u, v)


def mllib_blocks(spark: SparkSession, ratings: int, ids: int, k: int) -> int:
    """Blocks for Spark's ALS, which sends the factors of nearly every user and item to
    each block in every sweep. A block is also a task: small tables get one per task.
    Otherwise the sends of a sweep stay below ``MOVED_BYTES`` per rating however many
    ratings there are, unless blocks would then hold more than ``BLOCK_RATINGS``."""
    blocks, sent = task_count(spark, ratings), ids * (4 * k + 10)
    if blocks * sent <= ROUTED_BYTES:
        return blocks
    return max(math.ceil(ratings / BLOCK_RATINGS), min(blocks, ratings * MOVED_BYTES // sent), 1)


def held_by_block(blocks: int, ratings: int, users: int, items: int, k: int) -> float:
    """Bytes of one of ``blocks`` blocks: its ratings, its factors and those that are sent to it,
    of all ids with a rating in the block. Ratings are taken to be spread evenly."""
    per_id, most = 4 * k + 24, max(users, items, 1)
    missed = lambda ids: math.exp(ratings / max(ids, 1) * math.log1p(-1 / blocks)) if blocks > 1 else 0.0
    sent = max(ids * (1 - missed(ids)) for ids in (users, items))
    return (sent + most / blocks) * per_id + 24 * ratings / blocks


def fitting_blocks(ratings: int, users: int, items: int, k: int) -> int:
    """The fewest blocks that hold at most ``HELD_BYTES``."""
    low, high = 0, 1
    while held_by_block(high, ratings, users, items, k) > HELD_BYTES:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if held_by_block(middle, ratings, users, items, k) > HELD_BYTES else (low, middle)
    return high


def fit_als_mllib(
    ratings: DataFrame, k: int = 20, iterations: int = 40, lam: float = 0.1, seed: int = 42,
) -> FactorModel:
    """The same objective through Spark's own ALS (single-precision factors).

    Spark solves its item column first, so the two columns are swapped to keep
    users first. Ids must fit in 32 bits.
    """
    from pyspark.ml.recommendation import ALS

    means = materialise(stats.user_means(ratings), "user-means")
    centred = stats.center_by_user(ratings, means)
    spark = ratings.sparkSession
    # Ratings without a user find no mean and are not in ``centred``.
    n, users, items = ratings.agg(
        F.count("user"), F.approx_count_distinct("user"), F.approx_count_distinct("item")).first()
    blocks = max(mllib_blocks(spark, n, users + items, k), fitting_blocks(n, users, items, k))
    # Large tables: blocks wait on disk, and the files of a sweep's sends go with that sweep.
    large = blocks * (users + items) * (4 * k + 10) > ROUTED_BYTES
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "als"))
    als = ALS(rank=k, maxIter=iterations, regParam=lam, seed=seed, userCol="item", itemCol="user",
              ratingCol="rating", checkpointInterval=1 if large else 4, numUserBlocks=blocks, numItemBlocks=blocks,
              intermediateStorageLevel="DISK_ONLY" if large else "MEMORY_AND_DISK")
    fitted = als.fit(centred.select(F.col("user").cast("int"), F.col("item").cast("int"), "rating"))

    def side(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col("id").cast("bigint").alias(key), F.lit(0.0).alias("bias"),
                         F.col("features").cast("array<double>").alias("f"))

    users = means.join(side(fitted.itemFactors, "user").drop("bias"), "user")
    return FactorModel("als_mllib", {"user_factors": users, "item_factors": side(fitted.userFactors, "item")},
                       {"k": k, "intercept": 0.0})


def fit_als_biased(
    ratings: DataFrame, k: int = 20, iterations: int = 40, lam: float = 0.1, seed: int = 42,
    init: str = "uniform", global_mean: bool = False, on_sweep=None, name: str = "als2",
) -> FactorModel:
    """r = w + b_u + b_i + u.v; each side updates its factors, then its bias.

    With ``global_mean`` w is the mean rating, otherwise 0. Each half-sweep's
    result is read twice by the next (as the fixed side and as the prior bias),
    so it is written out rather than recomputed.
    """
    store = RatingStore(ratings.select("user", "item", "rating"))
    w = float(store.mean) if global_mean else 0.0
    solver = ridge_with_bias(k, lam, w)
    start = lambda key: start_value(F.col(key), k, seed, init)
    u = store.ids("user").select("user", start("user").alias("bias"))
    v, sweeps = None, Sweeps()
    for sweep in range(iterations):
        fixed = _started(store, "item", k, seed, init, start("item")) if v is None else _fixed(v, "item", F.col("bias"))
        u = sweeps.write(half_sweep(store, "user", k, solver, fixed, prior=u), "als2-user")
        if v is None:
            v = store.ids("item").select("item", start("item").alias("bias"))
        v = sweeps.write(half_sweep(store, "item", k, solver, _fixed(u, "user", F.col("bias")), prior=v), "als2-item")
        if on_sweep:
            on_sweep(sweep, FactorModel(name, {"user_factors": u, "item_factors": v}, {"k": k, "intercept": w}))
    store.release()
    return FactorModel(name, {"user_factors": u, "item_factors": v}, {"k": k, "intercept": w})


def fit_als3(ratings: DataFrame, k: int = 20, iterations: int = 20, lam: float = 0.1, seed: int = 42,
             init: str = "gaussian", on_sweep=None) -> FactorModel:
    return fit_als_biased(ratings, k, iterations, lam, seed, init, global_mean=True, on_sweep=on_sweep, name="als3")


def tag_vectors(item_tags: DataFrame, n_tags: int) -> DataFrame:
    """item, t: the item's tag weights as one array (rows of the side matrix)."""
    weights = F.map_from_entries(F.collect_list(F.struct("tag", "weight")))
    got = item_tags.groupBy("item").agg(weights.alias("w"))
    return got.select("item", F.array(*[
        F.coalesce(F.element_at("w", F.lit(t)), F.lit(0.0)) for t in range(n_tags)]).alias("t"))


def fit_xals(
    ratings: DataFrame, item_tags: DataFrame, n_tags: int, k: int = 10, iterations: int = 10, lam: float = 0.1,
    seed: int = 42, init: str = "uniform", checkpoint_every: int = 4, on_sweep=None,
) -> FactorModel:
    """ALS whose item vector is [k free factors, the item's tags].

    Users get k + tags factors. The item step solves only the free block,
    against what the tags leave unexplained.
    """
    width = k + n_tags
    tags = materialise(tag_vectors(item_tags.withColumn("tag", F.col("tag").cast("int")), n_tags), "item-tags")
    means = materialise(stats.user_means(ratings), "user-means")
    store = RatingStore(stats.center_by_user(ratings, means))
    own = materialise(store.ids("item").join(tags, "item", "left").select(
        "item", F.lit(0.0).alias("v"), F.coalesce("t", zeros(n_tags)).alias("f")), "rated-tags")
    v, sweeps = None, Sweeps()

    def free_block(met, rows):
        """What the tags leave unexplained, against the users' free factors."""
        theirs = met.fixed.f[met.at[rows]]
        t = met.own.f[met.own.find(met.key[rows])[0]]
        return met.rating[rows] - (theirs[:, k:] * t).sum(axis=1), theirs[:, :k]

    def model() -> FactorModel:
        items = v.join(tags, "item", "left").select(
            "item", "bias", F.concat("f", F.coalesce("t", zeros(n_tags))).alias("f"))
        return FactorModel("xals", {"user_factors": means.join(u.select("user", "f"), "user"), "item_factors": items},
                           {"k": width, "intercept": 0.0})

    for sweep in range(iterations):
        free = _started(store, "item", k, seed, init) if v is None else _fixed(v, "item")
        whole = free.join(own.select("item", F.col("f").alias("t")), "item").select("item", "v", F.concat("f", "t").alias("f"))
        u = half_sweep(store, "user", width, ridge(width, lam), whole)
        last = _due(sweep, iterations, checkpoint_every) or on_sweep is not None
        u = sweeps.write(u, "xals-user") if last else u
        v = half_sweep(store, "item", k, ridge(k, lam), _fixed(u, "user"), width=width, own=own, own_width=n_tags, regress=free_block)
        v = sweeps.write(v, "xals-item") if last else v
        if on_sweep:
            on_sweep(sweep, model())
    store.release()
    return model()


def fit_wals(
    ratings: DataFrame, k: int = 20, iterations: int = 25, reg: float = 0.001, seed: int = 42,
    init: str = "uniform",
) -> FactorModel:
    """Zero-filled ALS: missing cells are 0 with the same weight as stored ones.

    Every key shares the system matrix V'V + reg I, so a half-sweep is one
    weighted vector sum per key times a constant k x k matrix.
    """
    means = materialise(stats.user_means(ratings), "user-means")
    store = RatingStore(stats.center_by_user(ratings, means))

    def half(key: str, fixed: DataFrame | None) -> DataFrame:
        if fixed is None:
            fixed = materialise(_started(store, store.KEYS[key], k, seed, init), "wals-start")
        inverse = np.linalg.inv(gram_matrix(fixed, k) + reg * np.eye(k))
        return sweeps.write(times_matrix(product(store, key, fixed, k), inverse), f"wals-{key}")

    v, sweeps = None, Sweeps()
    for _ in range(iterations):
        u = half("user", v)
        v = half("item", u)
    store.release()
    return FactorModel(
        "wals", {"user_factors": means.join(u, "user"), "item_factors": v.withColumn("bias", F.lit(0.0))},
        {"k": k, "intercept": 0.0})


def fit_cfm(
    ratings: DataFrame, k: int = 20, iterations: int = 10, reg_w: float = 0.1, reg_v: float = 0.1,
    seed: int = 42, init: str = "gaussian", scale: float = 0.1,
) -> FactorModel:
    """Second-order factorisation machine on the one-hot pair (user, item).

    For such a pair the machine reduces to w0 + w_u + w_i + v_u.v_i, so no
    design matrix is built: each side's [v, w] is one ridge solve on [v', 1].
    Block updates, so it agrees with a coordinate solver in objective only.
    """
    store = RatingStore(ratings.select("user", "item", "rating"))
    w0 = float(store.mean)
    solver = joint_ridge(k, reg_w, reg_v)
    v, sweeps = None, Sweeps()
    for sweep in range(iterations):
        whole = w0 + F.col("bias")
        fixed = _started(store, "item", k, seed, init, F.lit(w0), scale) if v is None else _fixed(v, "item", whole)
        u = half_sweep(store, "user", k, solver, fixed)
        u = sweeps.write(u, "cfm-user") if _due(sweep, iterations, 4) else u
        v = half_sweep(store, "item", k, solver, _fixed(u, "user", whole))
        v = sweeps.write(v, "cfm-item") if _due(sweep, iterations, 4) else v
    store.release()
    return FactorModel("cfm", {"user_factors": u, "item_factors": v}, {"k": k, "intercept": w0})
