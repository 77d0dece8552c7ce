"""Rating-shaped views of the star tables, with the same definition in SQL.

Every view covers its whole input tables. The SQL text is what the checks give
to the comparison engine; the Spark side is built from the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.values import LABEL_VALUES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _purchases(spark: SparkSession, sf_dir: str, item: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", item, "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rating = (1 + F.floor((F.max("l_quantity") - 1) / 10)).cast("double")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").alias("user"), F.col(item).alias("item")).agg(rating.alias("rating"))
    )


def part_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1: customer x part, rating 1..5 from the largest quantity bought."""
    return _purchases(spark, sf_dir, "l_partkey")


def supplier_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2: customer x supplier, denser."""
    return _purchases(spark, sf_dir, "l_suppkey")


def stored(ratings: DataFrame) -> DataFrame:
    """Written once, for jobs that read the derived ratings several times."""
    from affinis.operators.layout import materialise

    return materialise(ratings, "ratings")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled events, still with repeated (user, item) pairs."""
    names = F.create_map(*[F.lit(x) for kv in EVENT_LABELS.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("user"),
        F.from_json("props", "k bigint")["k"].alias("item"),
        names[F.col("event_type")].alias("label"), "ts", "event_id",
    )


# Which rating label each event type stands for.
EVENT_LABELS = {
    "purchase": "favorite",
    "click": "like",
    "signup": "willsee",
    "view": "neutral",
    "error": "dislike",
}


def event_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: last event per (user, item), label turned into a number."""
    from affinis.operators.prepare import dedup, label_to_value

    last = dedup(event_log(spark, sf_dir), keep="last", order=["ts", "event_id"])
    return label_to_value(last, LABEL_VALUES).select("user", "item", "rating")


def item_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4: a tag per brand (0..24), per type (25..30), and the size as tag 31."""
    part = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") - F.lit(1)
    kind = F.lit(25) + F.array_position(F.array(*[F.lit(t) for t in PART_TYPES]), F.col("p_type")).cast("int") - 1
    one = F.lit(1.0)
    tags = F.array(
        F.struct(brand.alias("tag"), one.alias("weight")),
        F.struct(kind.alias("tag"), one.alias("weight")),
        F.struct(F.lit(31).alias("tag"), (F.col("p_size") / 50.0).alias("weight")),
    )
    return part.select(F.col("p_partkey").alias("item"), F.inline(tags)).where("tag is not null")


N_TAGS = 32
# The part types of the test tables, in alphabetical order.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5: one BIGINT vector per user, grouped in cohorts."""
    fixed = F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("bigint"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("user"), F.col("label").alias("cohort"), fixed.alias("vec"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6: item titles and categories."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_type").alias("category"))


def _purchases_sql(item: str) -> str:
    return f"""SELECT o_custkey AS "user", {item} AS item,
      CAST(1 + floor((max(l_quantity) - 1) / 10) AS DOUBLE) AS rating
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, {item}"""


D1 = _purchases_sql("l_partkey")
D2 = _purchases_sql("l_suppkey")
EVENT_LOG = """SELECT user_id AS "user", CAST(props->>'$.k' AS BIGINT) AS item, ts, event_id,
      CASE event_type WHEN 'purchase' THEN 'favorite' WHEN 'click' THEN 'like' WHEN 'signup' THEN 'willsee'
        WHEN 'view' THEN 'neutral' WHEN 'error' THEN 'dislike' END AS label FROM events"""
VALUE_CASE = """CASE label WHEN 'favorite' THEN 4.0::DOUBLE WHEN 'like' THEN 2.0::DOUBLE
      WHEN 'dislike' THEN (-2.0)::DOUBLE WHEN 'neutral' THEN 0.1::DOUBLE
      WHEN 'willsee' THEN 0.5::DOUBLE WHEN 'wontsee' THEN (-0.5)::DOUBLE END"""
D3 = f"""SELECT "user", item, {VALUE_CASE} AS rating FROM ({EVENT_LOG})
    QUALIFY row_number() OVER (PARTITION BY "user", item ORDER BY ts DESC, event_id DESC) = 1"""
D4 = """SELECT p_partkey AS item, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) - 1 AS tag,
      1.0::DOUBLE AS weight FROM part
    UNION ALL SELECT p_partkey, CAST(24 + list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type)
      AS INTEGER), 1.0::DOUBLE FROM part
    UNION ALL SELECT p_partkey, 31, p_size / 50.0::DOUBLE FROM part"""
D5 = """SELECT vec_id AS "user", label AS cohort,
      list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT)) AS vec FROM embeddings"""
