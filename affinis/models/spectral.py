"""Singular-value models: svd, svd1, svd2, svdknn, and pca."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions.vectors import combine, elem, literal_vector
from affinis.models.base import FactorModel
from affinis.operators import stats
from affinis.operators.layout import materialise
from affinis.operators.similarity import nearest_vectors
from affinis.operators.subspace import truncated_svd


def _model(name: str, means: DataFrame, users: DataFrame, items: DataFrame, k: int, sigma, kind=FactorModel, **tables):
    return kind(name, {"user_factors": means.join(users, "user", "left"), "item_factors": items, **tables},
                {"k": k, "intercept": 0.0, "sigma": [float(s) for s in sigma]})


def fit_svd(
    ratings: DataFrame, k: int = 20, iterations: int = 6, seed: int = 42, init: str = "gaussian",
    oversample: int = 8, n_users: int | None = None, name: str = "svd", kind=FactorModel,
) -> FactorModel:
    """Truncated SVD of the user- then column-centred cells.

    The column mean divides by all users (``n_users``, by default the largest
    id + 1) but is subtracted from stored cells only.
    """
    n_users = n_users or stats.dims(ratings)[0]
    cells, rows, cols = stats.double_center(ratings, n_users)
    rows, cols = materialise(rows, "row-means"), materialise(cols, "col-means")
    cells = materialise(cells, "cells")
    s, _, _ = truncated_svd(cells, k, iterations, seed, init, oversample)
    items = cols.join(s.items, "item", "left")
    return _model(name, rows, s.users, items, s.k, s.sigma, kind)


def fit_svd2(
    ratings: DataFrame, k: int = 20, iterations: int = 6, seed: int = 42, init: str = "gaussian",
    oversample: int = 8, name: str = "svd2",
) -> FactorModel:
    """Truncated SVD of the user-centred cells."""
    rows = materialise(stats.user_means(ratings), "row-means")
    cells = materialise(stats.center_by_user(ratings, rows), "cells")
    s, _, _ = truncated_svd(cells, k, iterations, seed, init, oversample)
    return _model(name, rows, s.users, s.items.withColumn("bias", F.lit(0.0)), s.k, s.sigma)


def fit_svd1(
    ratings: DataFrame, k: int = 20, iterations: int = 10, seed: int = 42, init: str = "gaussian",
    oversample: int = 10,
) -> FactorModel:
    """Randomised SVD; a stored 0 counts as missing."""
    return fit_svd2(stats.nonzero_ratings(ratings), k, iterations, seed, init, oversample, name="svd1")


@dataclass
class NeighbourSVDModel(FactorModel):
    """SVD whose user embedding is replaced by the mean of the nearest others'.

    Averaging runs when a prediction asks for a user, for those users only.
    """

    def _averaged(self, near: DataFrame, own: DataFrame) -> DataFrame:
        """``own`` with f replaced by the weighted mean of up to ``neighbors``
        rows of ``near``; kept where every distance is 0."""
        k, d = self.params["k"], F.col("distance")
        weight = F.when(d > 0, 1.0 / d if self.params["weighted"] else F.lit(1.0)).otherwise(0.0)
        mean = near.select("user", "f", weight.alias("w")).groupBy("user").agg(
            F.sum("w").alias("total"), *[F.sum(F.col("w") * elem(F.col("f"), j)).alias(f"s{j}") for j in range(k)])
        new = mean.where("total > 0").select(
            "user", F.array(*[F.col(f"s{j}") / F.col("total") for j in range(k)]).alias("g"))
        return own.join(new, "user", "left").withColumn("f", F.coalesce("g", "f")).drop("g")

    def embeddings(self) -> DataFrame:
        return self.users.where(F.col("f").isNotNull()).select("user", "f")

    def user_rows(self, users: DataFrame) -> DataFrame:
        """Averaged rows of known users: each one's own row is no neighbour."""
        own = self.users.join(users.select("user").distinct(), "user", "left_semi")
        asked = own.where(F.col("f").isNotNull()).select("user", "f")
        near = nearest_vectors(self.embeddings(), self.params["k"], self.params["neighbors"], asked, skip_self=True)
        return self._averaged(near, own)

    def average_new(self, own: DataFrame) -> DataFrame:
        """Averaged rows of folded-in users: every stored user may be a neighbour."""
        near = nearest_vectors(self.embeddings(), self.params["k"], self.params["neighbors"], own.select("user", "f"))
        return self._averaged(near, own)

    def predict(self, pairs: DataFrame, users: DataFrame | None = None) -> DataFrame:
        return super().predict(pairs, self.user_rows(pairs) if users is None else users)


def fit_svdknn(
    ratings: DataFrame, k: int = 20, neighbors: int = 5, weighted: bool = True, iterations: int = 6, seed: int = 42,
    init: str = "gaussian", oversample: int = 8, n_users: int | None = None,
) -> NeighbourSVDModel:
    model = fit_svd(ratings, k, iterations, seed, init, oversample, n_users, "svdknn", NeighbourSVDModel)
    model.params.update(neighbors=neighbors, weighted=weighted)
    return model


def fit_pca(
    ratings: DataFrame, k: int = 10, iterations: int = 6, seed: int = 42, init: str = "gaussian",
    oversample: int = 8, n_users: int | None = None, compat: bool = False,
) -> FactorModel:
    """Principal components of the user-centred, zero-filled matrix.

    The default is the ordinary reconstruction. ``compat`` scales each score by
    sqrt(explained variance / n_users) and leaves the column means out.
    """
    cells = stats.nonzero_ratings(ratings)
    n_users = n_users or stats.dims(ratings)[0]
    rows = materialise(stats.user_means(cells), "row-means")
    cells = materialise(stats.center_by_user(cells, rows), "cells")
    s, shift, mu = truncated_svd(cells, k, iterations, seed, init, oversample, center_items=n_users)
    scale = np.ones(s.k)
    if compat:
        scale = np.sqrt(s.sigma**2 / (n_users - 1) / n_users)
    centred = combine(F.col("f"), literal_vector(shift), s.k, lambda a, b: a - b)
    users = s.users.select("user", combine(centred, literal_vector(scale), s.k, lambda a, b: a * b).alias("f"))
    bias = F.lit(0.0) if compat else F.col("mu")
    items = mu.join(s.items, "item", "left").select("item", bias.alias("bias"), "f")
    return _model("pca", rows, users, items, s.k, s.sigma)
