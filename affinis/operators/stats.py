"""Means, centring and counts over the long ratings table.

Group means are plain partial aggregates joined back, not window functions: a
window would bring all rows of a hot user into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def global_mean(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.avg("rating").alias("mean"))


def user_means(ratings: DataFrame) -> DataFrame:
    """Mean over rated items; users without ratings are absent (mean 0 downstream)."""
    return ratings.groupBy("user").agg(F.avg("rating").alias("bias"))


def nonzero_ratings(ratings: DataFrame) -> DataFrame:
    """Stored zeros count as missing."""
    return ratings.where(F.col("rating") != 0)


def center_by_user(ratings: DataFrame, means: DataFrame | None = None) -> DataFrame:
    means = user_means(ratings) if means is None else means
    return ratings.join(means, "user").select("user", "item", (F.col("rating") - F.col("bias")).alias("rating"))


def item_column_means(residuals: DataFrame, n_users: int) -> DataFrame:
    """Column sum over *all* users, rated or not, as the divisor."""
    return residuals.groupBy("item").agg((F.sum("rating") / F.lit(float(n_users))).alias("bias"))


def double_center(ratings: DataFrame, n_users: int):
    """Residuals after user centring, then column centring of the stored cells.

    Returns ``(residuals, user_means, item_means)``.
    """
    rows = user_means(ratings)
    first = center_by_user(ratings, rows)
    cols = item_column_means(first, n_users)
    second = first.join(cols, "item").select("user", "item", (F.col("rating") - F.col("bias")).alias("rating"))
    return second, rows, cols


def item_stats(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"), F.avg("rating").alias("mean"))


def user_norms(ratings: DataFrame) -> DataFrame:
    """Row L2 norms with 1 in place of 0, as used for normalising."""
    norm = F.sqrt(F.sum(F.col("rating") * F.col("rating")))
    return ratings.groupBy("user").agg(F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0)).alias("norm"))


def normalise_rows(ratings: DataFrame) -> DataFrame:
    return ratings.join(user_norms(ratings), "user").select(
        "user", "item", (F.col("rating") / F.col("norm")).alias("rating"))


def mean_over_rows(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Mean of the stored ratings of ``users``, per requested item; 0 where none."""
    means = (
        ratings.join(users.select("user"), "user", "left_semi")
        .join(items.select("item"), "item", "left_semi").groupBy("item").agg(F.avg("rating").alias("mean"))
    )
    return items.select("item").join(means, "item", "left").fillna(0.0, ["mean"])


def dims(ratings: DataFrame) -> tuple[int, int]:
    row = ratings.agg(F.max("user").alias("u"), F.max("item").alias("i")).first()
    return int(row["u"]) + 1, int(row["i"]) + 1


def component_share(factors: DataFrame, digits: int = 1) -> DataFrame:
    """Share of each non-zero component in a user's factor vector, in percent."""
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
    parts = factors.select("user", total.alias("total"), F.posexplode("f").alias("component", "value"))
    share = F.round(F.col("value") * 100 / F.col("total"), digits)
    return parts.where("value != 0 and total != 0").select("user", "component", share.alias("share"))


def split_dispersion(metrics: DataFrame) -> DataFrame:
    """Mean, population variance and 95% half-width of a metric over splits."""
    value = F.col("value")
    return metrics.groupBy("model", "metric").agg(
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("var"),
        (1.96 * F.sqrt(F.var_pop(value) / F.count(value))).alias("ci95"),
    )


def one_hot(ratings: DataFrame, n_users: int, n_items: int, item_tags: DataFrame | None = None) -> DataFrame:
    """Sparse design row of each pair: columns user, n_users + item, then the tags.

    Adds ``columns`` and ``values``. No model here needs it (a pair is two keys);
    it is for handing the data to a solver that wants a design matrix.
    """
    columns = F.array(F.col("user").cast("bigint"), (F.col("item") + n_users).cast("bigint"))
    values = F.array(F.lit(1.0), F.lit(1.0))
    if item_tags is None:
        return ratings.select("*", columns.alias("columns"), values.alias("values"))
    sides = item_tags.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("tag") + n_users + n_items).cast("bigint").alias("c"), F.bround("weight").alias("v")))).alias("side"))
    side = F.filter(F.coalesce("side", F.array().cast("array<struct<c:bigint,v:double>>")), lambda t: t["v"] != 0)
    return ratings.join(sides, "item", "left").select(
        *ratings.columns, F.concat(columns, F.transform(side, lambda t: t["c"])).alias("columns"),
        F.concat(values, F.transform(side, lambda t: t["v"])).alias("values"))
