"""Turning raw rating triples into clean ones: labels, duplicates, ids, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.operators.layout import materialise

RATED_BY_AT_LEAST = 2


def dedup(ratings: DataFrame, keep: str = "last", order: list[str] | None = None) -> DataFrame:
    """One row per (user, item): the last by ``order``, or the sum or mean of the ratings.

    ``last`` is an aggregate (``max_by``), so repeated pairs collapse before the
    shuffle however often one pair is repeated.
    """
    rest = [c for c in ratings.columns if c not in ("user", "item")]
    grouped = ratings.groupBy("user", "item")
    if keep == "last":
        if not order:
            raise ValueError("keep='last' needs the columns that order the ratings")
        row = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
        return grouped.agg(row).select("user", "item", *[F.col(f"row.{c}").alias(c) for c in rest])
    if keep in ("sum", "mean"):
        fn = F.sum if keep == "sum" else F.avg
        return grouped.agg(fn("rating").alias("rating"))
    raise ValueError(f"unknown keep {keep!r}")


def duplicate_pairs(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user", "item").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def label_to_value(ratings: DataFrame, values: dict[str, float] | DataFrame, strict: bool = True) -> DataFrame:
    """Add ``rating`` from ``label``. An unknown label stops the job, or, with
    ``strict=False``, gives a NULL rating that :func:`rejected_labels` lists.

    ``values`` is a mapping (the vocabulary is a constant of the program, so it
    becomes a literal map) or a table ``label, value``.
    """
    if isinstance(values, DataFrame):
        known = ratings.join(values.select("label", F.col("value").alias("rating")), "label", "left")
    else:
        table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        known = ratings.withColumn("rating", F.try_element_at(table, F.col("label")))
    if not strict:
        return known
    checked = F.coalesce("rating", F.raise_error(F.concat(F.lit("unknown label "), F.col("label"))).cast("double"))
    return known.withColumn("rating", checked)


def rejected_labels(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("rating").isNull())


def convert_ratings(ratings: DataFrame, convert: Column) -> DataFrame:
    """User-supplied conversion as a Column expression over the raw columns."""
    return ratings.withColumn("rating", convert.cast("double"))


def dense_ids(ids: DataFrame, order: list[Column], dense: str = "dense_id", label: str = "ids") -> DataFrame:
    """Number the rows of ``ids`` 0..n-1 in the given total order.

    Range-partitioned sort, written out, then one offset per written partition:
    no step sees more than its own partition, and the offsets table has one row
    per partition. The sort is written before it is numbered because range
    bounds are sampled and must not be drawn twice.
    """
    keys = [f"__k{j}" for j in range(len(order))]
    named = ids.select("*", *[c.alias(k) for k, c in zip(keys, order)])
    ordered = named.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    marked = ordered.withColumn("__at", F.monotonically_increasing_id())
    written = materialise(
        marked.select("*", F.shiftright("__at", 33).alias("__part"),
                      F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")).drop("__at"), label)
    offset, starts = 0, []
    for row in sorted(written.groupBy("__part").count().collect()):
        starts.append((row["__part"], offset))
        offset += row["count"]
    spark = ids.sparkSession
    offsets = spark.createDataFrame(starts, "__part bigint, __start bigint")
    # One row per written partition, so its size does not follow the data.
    numbered = written.join(F.broadcast(offsets), "__part")
    return numbered.select(*ids.columns, (F.col("__start") + F.col("__row")).alias(dense))


def random_ids(ratings: DataFrame, column: str, seed: int = 42) -> DataFrame:
    """raw_id, dense_id in a seeded pseudo-random order."""
    ids = ratings.select(F.col(column).alias("raw_id")).distinct()
    return dense_ids(ids, [F.xxhash64(F.lit(seed), F.col("raw_id")), F.col("raw_id")], label=f"random-{column}")


def popularity_ids(ratings: DataFrame, column: str = "item") -> DataFrame:
    """raw_id, dense_id, n: id 0 is the most rated; equal counts in id order."""
    ids = ratings.groupBy(F.col(column).alias("raw_id")).agg(F.count(F.lit(1)).alias("n"))
    return dense_ids(ids, [-F.col("n"), F.col("raw_id")], label=f"popular-{column}")


def anonymise(ratings: DataFrame, ordered: bool = False, seed: int = 42):
    """Replace both ids by dense ones. Returns (ratings, user_ids, item_ids)."""
    users = random_ids(ratings, "user", seed)
    items = popularity_ids(ratings).drop("n") if ordered else random_ids(ratings, "item", seed)
    return encode(encode(ratings, users, "user"), items, "item"), users, items


def encode(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Raw id to dense id; rows with an unknown id are dropped."""
    lookup = ids.select(F.col("raw_id").alias(column), F.col("dense_id"))
    return df.join(lookup, column).withColumn(column, F.col("dense_id")).drop("dense_id")


def decode(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Dense id to raw id; an unknown id stops the job."""
    lookup = ids.select(F.col("dense_id").alias(column), F.struct("raw_id").alias("hit"))
    bad = F.raise_error(F.concat(F.lit(f"unknown {column} "), F.col(column).cast("string")))
    joined = df.join(lookup, column, "left")
    raw = F.when(F.col("hit").isNull(), bad.cast(ids.schema["raw_id"].dataType)).otherwise(F.col("hit.raw_id"))
    return joined.withColumn(column, raw).drop("hit")


def scramble(ratings: DataFrame, seed: int = 42) -> DataFrame:
    """Order that hides when a rating was given; only meaningful before a write."""
    return ratings.orderBy(F.xxhash64(F.lit(seed), "user", "item"))


def interesting_items(ratings: DataFrame, at_least: int = RATED_BY_AT_LEAST) -> DataFrame:
    return ratings.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def by_popularity(ratings: DataFrame) -> DataFrame:
    """item, n, rank from 1, the most rated first; equal counts in id order."""
    ids = popularity_ids(ratings)
    return ids.select(F.col("raw_id").alias("item"), "n", (F.col("dense_id") + 1).alias("rank")).orderBy("rank")


def round_tags(item_tags: DataFrame) -> DataFrame:
    return item_tags.withColumn("weight", F.bround("weight"))


def integer_ratings(ratings: DataFrame) -> DataFrame:
    """Truncate towards zero, as an integer cast does."""
    return ratings.withColumn("rating", F.col("rating").cast("bigint").cast("double"))


def candidate_items(ratings_or_items: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    items = ratings_or_items.select("item").distinct()
    return items if candidates is None else items.join(candidates.select("item"), "item", "left_semi")


def split_column(round_no: int, seed: int = 42, share: int = 10) -> Column:
    """True for the test rows of one random split (a tenth by default)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(round_no), "user", "item"), F.lit(share)) == 0


def grid_split() -> Column:
    """Arithmetic split of about a tenth, which SQL can state."""
    return (F.col("user") * 31 + F.col("item") * 17) % 10 == 0
