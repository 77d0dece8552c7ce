"""Rating, catalogue and tag files, in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM_SCHEMA = "item bigint, title string, category string"


def load_ratings(spark: SparkSession, path: str, convert: Column | None = None,
                 columns=("user", "item", "rating")) -> DataFrame:
    """CSV with a header holding at least user, item and rating, in any order.

    Columns are picked by name and extra ones ignored: only the header line is
    read for the schema. Files of one folder must have the same header; one with
    another order is an error, not a table with its columns exchanged. ``convert`` is an expression over the text column
    ``rating``; by default the text is cast to a number.
    """
    header = spark.read.option("header", True).csv(path).schema.names
    missing = set(columns) - set(header)
    if missing:
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    rating = F.col("rating").cast("double") if convert is None else convert.cast("double")
    return raw.select(F.col("user").cast("bigint").alias("user"), F.col("item").cast("bigint").alias("item"),
                      rating.alias("rating"))


def dimensions(ratings: DataFrame) -> DataFrame:
    """Matrix dimensions are largest id + 1; gaps count as empty rows and columns."""
    return ratings.agg((F.max("user") + 1).alias("n_users"), (F.max("item") + 1).alias("n_items"))


def save_ratings(ratings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Encoded ids with the original label, with a header so that it loads again."""
    out = ratings.select("user", "item", F.col("label").alias("rating"))
    out.write.mode(mode).option("header", True).csv(path)


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV ``item, title[, category]``; the id column is the key."""
    return spark.read.schema(ITEM_SCHEMA).option("mode", "PERMISSIVE").csv(path)


def save_items(items: DataFrame, item_ids: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Catalogue rows of encoded items only, in item order."""
    ids = item_ids.select(F.col("raw_id").alias("item"), "dense_id")
    out = items.join(ids, "item").select(F.col("dense_id").alias("item"), "title", "category")
    out.orderBy("item").write.mode(mode).csv(path)


def load_tags(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """item, tag, weight; the tag count is the largest tag + 1, 0 for an empty table."""
    tags = spark.read.parquet(path).select("item", "tag", F.col("weight").cast("double").alias("weight"))
    top = tags.agg(F.max("tag").alias("t")).first()["t"]
    return tags, 0 if top is None else int(top) + 1
