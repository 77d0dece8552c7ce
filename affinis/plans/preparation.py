"""Loading, cleaning, numbering and splitting (and the model snapshot)."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.functions.values import LABEL_VALUES, THREE_WAY_VALUES
from affinis.models.base import delete_snapshot, load
from affinis.operators import prepare, stats
from affinis.operators.layout import scratch_path
from affinis.plans.registry import query, r, rs
from affinis.sources import fixtures as fx
from affinis.sources import ratings as src


@query(f"""SELECT "user", item, label, {fx.VALUE_CASE} AS rating, event_id FROM ({fx.EVENT_LOG})""")
def label_to_value(spark, sf):
    return prepare.label_to_value(fx.event_log(spark, sf), LABEL_VALUES).select(
        "user", "item", "label", "rating", "event_id")


@query(f"""SELECT label, CAST(count(*) AS BIGINT) AS n, max(CASE label WHEN 'like' THEN 2.0::DOUBLE
   WHEN 'dislike' THEN (-2.0)::DOUBLE WHEN 'dontknow' THEN 0.0::DOUBLE END) AS rating FROM ({fx.EVENT_LOG}) GROUP BY label""")
def label_to_value_three_way(spark, sf):
    got = prepare.label_to_value(fx.event_log(spark, sf), THREE_WAY_VALUES, strict=False)
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("rating").alias("rating"))


@query(fx.D3)
def dedup_last(spark, sf):
    return fx.event_ratings(spark, sf)


@query(f"""SELECT "user", item, {rs('sum(rating)')} AS rating FROM (
   SELECT "user", item, {fx.VALUE_CASE} AS rating FROM ({fx.EVENT_LOG})) GROUP BY "user", item""")
def dedup_sum(spark, sf):
    log = prepare.label_to_value(fx.event_log(spark, sf), LABEL_VALUES)
    return prepare.dedup(log, "sum").withColumn("rating", r("rating"))


@query(f"""SELECT "user", item, CAST(count(*) AS BIGINT) AS n FROM ({fx.EVENT_LOG}) GROUP BY "user", item HAVING count(*) > 1""")
def duplicate_pairs(spark, sf):
    return prepare.duplicate_pairs(fx.event_log(spark, sf))


@query(f"""SELECT item, CAST(count(*) AS BIGINT) AS n FROM ({fx.D3}) GROUP BY item HAVING count(*) >= 2""")
def interesting_items(spark, sf):
    return prepare.interesting_items(fx.event_ratings(spark, sf))


@query(f"""SELECT raw_id, n, CAST(row_number() OVER (ORDER BY n DESC, raw_id) - 1 AS BIGINT) AS dense_id
   FROM (SELECT item AS raw_id, CAST(count(*) AS BIGINT) AS n FROM ({fx.D3}) GROUP BY item)""")
def popularity_ids(spark, sf):
    return prepare.popularity_ids(fx.event_ratings(spark, sf))


@query(f"""SELECT "user", item, rating FROM ({fx.D3})""")
def encode_decode(spark, sf):
    """Every rating through both id maps and back."""
    ratings = fx.event_ratings(spark, sf)
    coded, users, items = prepare.anonymise(ratings, ordered=True)
    return prepare.decode(prepare.decode(coded, users, "user"), items, "item").select("user", "item", "rating")


@query(f"""SELECT CAST(count(DISTINCT "user") AS BIGINT) AS n, CAST(count(DISTINCT "user") AS BIGINT) AS distinct_ids,
   0::BIGINT AS low, CAST(count(DISTINCT "user") - 1 AS BIGINT) AS high FROM ({fx.D1})""")
def random_ids(spark, sf):
    """The random numbering is a bijection onto 0..n-1."""
    ids = prepare.random_ids(fx.part_ratings(spark, sf), "user")
    return ids.agg(F.count("raw_id").alias("n"), F.countDistinct("dense_id").alias("distinct_ids"),
                   F.min("dense_id").alias("low"), F.max("dense_id").alias("high"))


@query(f"""SELECT "user", item, rating FROM ({fx.D1})""")
def load_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "ratings-csv")
    src.save_ratings(prepare.scramble(fx.part_ratings(spark, sf).withColumn("label", F.col("rating"))), path)
    return src.load_ratings(spark, path)


@query(f"""SELECT CAST(max("user") + 1 AS BIGINT) AS n_users, CAST(max(item) + 1 AS BIGINT) AS n_items FROM ({fx.D1})""")
def dimensions(spark, sf):
    return src.dimensions(fx.part_ratings(spark, sf))


@query(f"""WITH e AS (SELECT raw_id, CAST(row_number() OVER (ORDER BY n DESC, raw_id) - 1 AS BIGINT) AS item
     FROM (SELECT item AS raw_id, count(*) AS n FROM ({fx.D1}) GROUP BY item))
   SELECT item, p_name AS title, p_type AS category FROM part JOIN e ON p_partkey = raw_id""")
def item_catalog(spark, sf):
    """Titles of encoded items, written and read back."""
    path = scratch_path(spark, "items-csv")
    src.save_items(fx.catalogue(spark, sf), prepare.popularity_ids(fx.part_ratings(spark, sf)), path)
    return src.load_items(spark, path)


@query(f"""SELECT tag, CAST(count(*) AS BIGINT) AS n, {rs('sum(weight)')} AS weight,
   CAST(sum(round_even(weight, 0)) AS BIGINT) AS rounded FROM ({fx.D4}) GROUP BY tag""")
def side_information(spark, sf):
    path = scratch_path(spark, "item-tags")
    fx.item_tags(spark, sf).write.parquet(path)
    tags, n_tags = src.load_tags(spark, path)
    both = prepare.round_tags(tags.withColumn("exact", F.col("weight"))).select(
        "tag", F.col("weight").alias("even"), F.col("exact").alias("weight"))
    return both.groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("weight")).alias("weight"), F.sum("even").cast("bigint").alias("rounded"))


@query(f"""SELECT "user", item, {rs('avg(rating) OVER (PARTITION BY "user")')} AS prediction FROM ({fx.D1})""")
def model_save_load(spark, sf):
    """A saved model predicts as it did; the snapshot is then deleted."""
    from affinis.models.means import fit_user_mean

    ratings = fx.stored(fx.part_ratings(spark, sf))
    path = scratch_path(spark, "snapshot")
    fit_user_mean(ratings).save(path)
    out = load(spark, path).predict(ratings.select("user", "item"))
    # The copy is what is read below, so that the original can be deleted here.
    keep = scratch_path(spark, "snapshot-copy")
    out.write.parquet(keep)
    delete_snapshot(spark, path)
    return spark.read.parquet(keep).withColumn("prediction", r("prediction"))


@query(f"""SELECT "user", item, CAST(trunc(rating) AS DOUBLE) AS truncated, rating <> 0 AS stored,
   greatest(-2.0::DOUBLE, least(2.0::DOUBLE, rating)) AS clipped, rating * 10 + 1 AS converted FROM ({fx.D3})""")
def rating_transforms(spark, sf):
    """Truncation, the non-zero test, clipping and a user-supplied conversion."""
    d3 = fx.event_ratings(spark, sf)
    cut = prepare.integer_ratings(d3).withColumnRenamed("rating", "truncated")
    base = prepare.convert_ratings(d3.withColumn("raw", F.col("rating")), F.col("raw") * 10 + 1)
    joined = base.withColumnRenamed("rating", "converted").join(cut, ["user", "item"])
    return joined.select("user", "item", "truncated", (F.col("raw") != 0).alias("stored"),
                         F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("raw"))).alias("clipped"), "converted")
