"""Fitting new users against a fixed model. Every function takes ratings
(user, item, rating) of any number of newcomers and returns their factor rows,
to be given to ``model.predict(pairs, users=rows)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.vectors import combine, elem, literal_vector, zeros
from affinis.models.base import FactorModel
from affinis.models.spectral import NeighbourSVDModel
from affinis.operators import stats
from affinis.operators.layout import RatingStore, materialise
from affinis.operators.normal import half_sweep, ridge


def _centred(new_ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    means = stats.user_means(new_ratings)
    return means, stats.center_by_user(new_ratings, means)


def _solve(rows: DataFrame, k: int, lam: float, regressors: Column, items: DataFrame) -> DataFrame:
    store = RatingStore(rows)
    fixed = items.select("item", F.lit(0.0).alias("v"), regressors.alias("f"))
    solved = materialise(half_sweep(store, "user", k, ridge(k, lam), fixed), "newcomers")
    store.release()
    return solved


def fold_in_als(model: FactorModel, new_ratings: DataFrame, lam: float = 0.1) -> DataFrame:
    """Ridge against the item factors after centring by the newcomer's own mean."""
    k = model.params["k"]
    means, rows = _centred(new_ratings)
    u = _solve(rows, k, lam, F.col("f"), model.items)
    return means.join(u.select("user", "f"), "user", "left")


def fold_in_svd(model: FactorModel, new_ratings: DataFrame) -> DataFrame:
    """Projection of the doubly centred ratings on V."""
    k = model.params["k"]
    means, rows = _centred(new_ratings)
    hit = rows.join(model.items.select("item", "bias", "f").where(F.col("f").isNotNull()), "item")
    rest = F.col("rating") - F.col("bias")
    f = hit.groupBy("user").agg(F.array(*[F.sum(rest * elem(F.col("f"), j)) for j in range(k)]).alias("f"))
    own = means.join(f, "user", "left").withColumn("f", F.coalesce("f", zeros(k)))
    return model.average_new(own) if isinstance(model, NeighbourSVDModel) else own


def fold_in_svd_ridge(model: FactorModel, new_ratings: DataFrame, lam: float = 0.1) -> DataFrame:
    """Ridge in the sigma*V space; the row returned already includes sigma."""
    k = model.params["k"]
    sigma = literal_vector(model.params["sigma"])
    means, rows = _centred(new_ratings)
    scaled = combine(F.col("f"), sigma, k, lambda a, b: a * b)
    u = _solve(rows, k, lam, scaled, model.items.where(F.col("f").isNotNull()))
    return means.join(u.select("user", scaled.alias("f")), "user", "left")
