"""Fitted models: a few DataFrames plus scalars, with predictions as joins."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.vectors import dot
from affinis.operators import scoring
from affinis.sources.tables import delete_path, read_text, write_text


@dataclass
class Model:
    """Named tables and parameters. ``predict`` returns one row per input pair."""

    name: str
    tables: dict[str, DataFrame]
    params: dict = field(default_factory=dict)
    history: DataFrame | None = None

    bilinear = False

    def predict(self, pairs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def set_parameters(self, n_users: int | None = None, n_items: int | None = None) -> Model:
        """Dimensions of the matrix, where they exceed the largest rated ids."""
        given = {"n_users": n_users, "n_items": n_items}
        self.params.update({k: int(v) for k, v in given.items() if v is not None})
        return self

    def rated_items(self) -> DataFrame | None:
        """Items the model knows, or None if it knows none."""
        return None

    def n_items(self) -> int:
        """Items 0 .. n - 1 are candidates unless others are named."""
        if "n_items" not in self.params:
            known = self.rated_items()
            top = None if known is None else known.agg(F.max("item")).first()[0]
            self.params["n_items"] = 0 if top is None else int(top) + 1
        return self.params["n_items"]

    def save(self, path: str) -> None:
        """Write every table as parquet under ``path``, the manifest last.

        Every save goes to a folder of its own, which the manifest names once all is
        written; only then is the folder of the save before deleted. A save that
        breaks off leaves the older snapshot readable, and a model may be saved to
        where it was loaded from. The model reads the new files from then on.
        """
        spark = SparkSession.active()
        try:
            old = json.loads(read_text(spark, f"{path}/manifest.json")).get("folder")
        except FileNotFoundError:
            old = None
        folder = f"data-{uuid.uuid4().hex}"
        parts = self.parts()
        for label, df in self.tables.items():
            df.write.parquet(f"{path}/{folder}/{label}")
        for label, part in parts.items():
            part.save(f"{path}/{folder}/{label}")
        manifest = {"kind": type(self).__name__, "name": self.name, "params": self.params, "folder": folder,
                    "tables": list(self.tables), "parts": list(parts)}
        write_text(spark, f"{path}/manifest.json", json.dumps(manifest))
        self.tables = {t: spark.read.schema(df.schema).parquet(f"{path}/{folder}/{t}") for t, df in self.tables.items()}
        if old:
            delete_path(spark, f"{path}/{old}")

    def parts(self) -> dict[str, Model]:
        """Models this one is made of, saved along with it."""
        return {}


@dataclass
class FactorModel(Model):
    """score = intercept + user bias + item bias + <user factors, item factors>.

    A user or item the training set did not contain contributes 0, so the score
    falls back on the known means and biases. ``params``: ``k``, ``intercept``
    and, for clipped models, ``low`` and ``high``.
    """

    bilinear = True

    @property
    def users(self) -> DataFrame:
        return self.tables["user_factors"]

    @property
    def items(self) -> DataFrame:
        return self.tables["item_factors"]

    def rated_items(self) -> DataFrame | None:
        return self.items

    def clip(self, score: Column) -> Column:
        if self.params.get("low") is None:
            return score
        return F.greatest(F.lit(self.params["low"]), F.least(F.lit(self.params["high"]), score))

    def score(self, user_bias: Column, item_bias: Column, product: Column) -> Column:
        zero = F.lit(0.0)
        total = (
            F.lit(float(self.params.get("intercept", 0.0))) + F.coalesce(user_bias, zero)
            + F.coalesce(item_bias, zero) + F.coalesce(product, zero)
        )
        return self.clip(total)

    def products(self, pairs: DataFrame) -> DataFrame | None:
        """``scoring.with_products`` for the model's own users, where that moves less than joins."""
        k = self.params["k"]
        if not scoring.worth_it(pairs, self.items, k) or dict(self.users.dtypes)["user"] not in ("int", "bigint"):
            return None
        return scoring.with_products(pairs, self.users, self.items, k)

    def user_rows(self, users: DataFrame) -> DataFrame:
        """Factor rows of the given users; unknown users are absent."""
        return self.users.join(users.select("user").distinct(), "user", "left_semi")

    def predict(self, pairs: DataFrame, users: DataFrame | None = None) -> DataFrame:
        met = self.products(pairs) if users is None else None
        if met is not None:
            return met.select(*pairs.columns, self.score(F.col("__ub"), F.col("__ib"), F.col("__product")).alias("prediction"))
        users = self.users if users is None else users
        u = users.select("user", F.col("bias").alias("ub"), F.col("f").alias("uf"))
        i = self.items.select("item", F.col("bias").alias("ib"), F.col("f").alias("vf"))
        scored = pairs.join(u, "user", "left").join(i, "item", "left")
        return scored.select(
            *[F.col(c) for c in pairs.columns],
            self.score(F.col("ub"), F.col("ib"), dot(F.col("uf"), F.col("vf"), self.params["k"])).alias("prediction"),
        )


@dataclass
class ZeroModel(Model):
    bilinear = False

    def rated_items(self) -> DataFrame | None:
        return None

    def predict(self, pairs: DataFrame, users: DataFrame | None = None) -> DataFrame:
        return pairs.withColumn("prediction", F.lit(0.0))


def load(spark: SparkSession, path: str) -> Model:
    """Read a saved model; a missing snapshot raises FileNotFoundError."""
    from affinis.models import registry

    manifest = json.loads(read_text(spark, f"{path}/manifest.json"))
    kind = registry.KINDS[manifest["kind"]]
    base = f"{path}/{manifest['folder']}"
    tables = {t: spark.read.parquet(f"{base}/{t}") for t in manifest["tables"]}
    parts = {p: load(spark, f"{base}/{p}") for p in manifest["parts"]}
    return kind(manifest["name"], tables, manifest["params"], **parts)


def delete_snapshot(spark: SparkSession, path: str) -> None:
    read_text(spark, f"{path}/manifest.json")
    delete_path(spark, path)
