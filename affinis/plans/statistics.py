"""Means, centring, norms and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.operators import stats
from affinis.plans.registry import query, r, rs
from affinis.sources import fixtures as fx


@query(f"""SELECT {rs('avg(rating)')} AS mean FROM ({fx.D1})""")
def global_mean(spark, sf):
    return stats.global_mean(fx.part_ratings(spark, sf)).select(r("mean").alias("mean"))


@query(f"""WITH r AS ({fx.D1}), m AS (SELECT "user", avg(rating) AS m FROM r GROUP BY "user")
   SELECT "user", item, {rs('rating - m')} AS rating FROM r JOIN m USING ("user")""")
def user_mean_center(spark, sf):
    return stats.center_by_user(fx.part_ratings(spark, sf)).withColumn("rating", r("rating"))


@query(f"""WITH r AS (SELECT "user", item, rating - 3 AS rating FROM ({fx.D1})), k AS (SELECT * FROM r WHERE rating <> 0),
   m AS (SELECT "user", avg(rating) AS m FROM k GROUP BY "user") SELECT "user", item, {rs('rating - m')} AS rating FROM k JOIN m USING ("user")""")
def nonzero_center(spark, sf):
    """Ratings from -2 to 2, of which stored zeros count as missing, centred by user."""
    shifted = fx.part_ratings(spark, sf).withColumn("rating", F.col("rating") - 3)
    return stats.center_by_user(stats.nonzero_ratings(shifted)).withColumn("rating", r("rating"))


DOUBLE_CENTER = f"""r AS ({fx.D2}), m AS (SELECT "user", avg(rating) AS m FROM r GROUP BY "user"),
   e AS (SELECT r."user", item, rating - m AS e FROM r JOIN m USING ("user")),
   c AS (SELECT item, sum(e) / (SELECT max("user") + 1 FROM r) AS c FROM e GROUP BY item)"""


@query(f"""WITH {DOUBLE_CENTER} SELECT "user", item, {rs('e - c')} AS rating FROM e JOIN c USING (item)""")
def double_center(spark, sf):
    ratings = fx.supplier_ratings(spark, sf)
    n_users, _ = stats.dims(ratings)
    return stats.double_center(ratings, n_users)[0].withColumn("rating", r("rating"))


@query(f"""SELECT item, CAST(count(*) AS BIGINT) AS n, {rs('sum(rating)')} AS total, {rs('avg(rating)')} AS mean
   FROM ({fx.D1}) GROUP BY item""")
def item_stats(spark, sf):
    got = stats.item_stats(fx.part_ratings(spark, sf))
    return got.select("item", "n", r("total").alias("total"), r("mean").alias("mean"))


@query(f"""WITH r AS ({fx.D3}), n AS (SELECT "user", coalesce(nullif(sqrt(sum(rating * rating)), 0), 1) AS norm FROM r GROUP BY "user")
   SELECT "user", item, {rs('rating / norm')} AS rating FROM r JOIN n USING ("user")""")
def normalise_rows(spark, sf):
    return stats.normalise_rows(fx.event_ratings(spark, sf)).withColumn("rating", r("rating"))


@query(f"""WITH r AS ({fx.D1}) SELECT i.item, {rs('coalesce(avg(r.rating), 0)')} AS mean
   FROM (SELECT p_partkey AS item FROM part) i
   LEFT JOIN (SELECT * FROM r WHERE "user" IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) r USING (item)
   GROUP BY i.item""")
def mean_over_rows(spark, sf):
    """Mean rating of every part among one market segment's customers."""
    segment = fx.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user"))
    items = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("item"))
    return stats.mean_over_rows(fx.part_ratings(spark, sf), segment, items).withColumn("mean", r("mean"))


@query(f"""SELECT CAST(count(DISTINCT "user") AS BIGINT) AS users, CAST(count(DISTINCT item) AS BIGINT) AS items FROM ({fx.D1})""")
def distinct_ids(spark, sf):
    d1 = fx.part_ratings(spark, sf)
    return d1.agg(F.countDistinct("user").alias("users"), F.countDistinct("item").alias("items"))


@query(f"""WITH d AS ({fx.D1}), n AS (SELECT max("user") + 1 AS nu, max(item) + 1 AS ni FROM d)
   SELECT "user", item, CAST("user" AS BIGINT) AS col, 1.0::DOUBLE AS value FROM d
   UNION ALL SELECT "user", item, CAST(nu + item AS BIGINT), 1.0::DOUBLE FROM d, n
   UNION ALL SELECT "user", item, CAST(nu + ni + tag AS BIGINT), round_even(weight, 0) FROM d JOIN ({fx.D4}) USING (item), n
     WHERE round_even(weight, 0) <> 0""")
def one_hot_rows(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    rows = stats.one_hot(d1, *stats.dims(d1), fx.item_tags(spark, sf))
    cells = F.inline(F.arrays_zip(F.col("columns").alias("col"), F.col("values").alias("value")))
    return rows.select("user", "item", cells).toDF("user", "item", "col", "value")
