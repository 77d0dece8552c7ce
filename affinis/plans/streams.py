"""File streams, compared with the same computation in one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.functions.values import LABEL_VALUES
from affinis.models import als
from affinis.operators.layout import scratch_path
from affinis.operators.prepare import label_to_value
from affinis.plans.least_squares import SEED, als_chain
from affinis.plans.registry import query, r, rs
from affinis.plans.secure_sum import wrap_sql
from affinis.sources import fixtures as fx
from affinis.streaming import streams


@query(f"""SELECT item, CAST(count(*) AS BIGINT) AS n, {rs('sum(rating)')} AS total FROM (
   SELECT item, {fx.VALUE_CASE} AS rating FROM ({fx.EVENT_LOG})) GROUP BY item""")
def stream_item_stats(spark, sf):
    rated = label_to_value(streams.event_stream(spark, sf), LABEL_VALUES)
    got = streams.item_statistics(rated, scratch_path(spark, "stream-items"))
    return got.select("item", "n", r("total").alias("total"))


@query(f"""WITH m AS (SELECT date_trunc('day', ts) AS round, user_id, CAST(round(value * 100) AS BIGINT) AS a,
     CAST(props->>'$.k' AS BIGINT) + 9223372036854775000 AS b FROM events
     QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts), user_id ORDER BY ts DESC, event_id DESC) = 1),
   x AS (SELECT round, 0 AS pos, a AS x FROM m UNION ALL SELECT round, 1, b FROM m)
   SELECT strftime(round, '%Y-%m-%d') AS round, pos, CAST(count(*) AS BIGINT) AS senders, {wrap_sql('sum(CAST(x AS HUGEINT))')} AS total FROM x
   WHERE round + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) GROUP BY round, pos HAVING count(*) >= 10""")
def stream_quorum_sum(spark, sf):
    """Daily rounds; the last day is still open and must not appear."""
    sent = streams.event_stream(spark, sf).select(
        "user", "ts", F.struct("ts", "event_id").alias("arrived"),
        F.array(F.round(F.col("value") * 100).cast("bigint"), F.col("item") + F.lit(9223372036854775000)).alias("vec"))
    got = streams.quorum_sums(sent, scratch_path(spark, "stream-quorum"), threshold=10)
    return got.select(F.date_format("round", "yyyy-MM-dd").alias("round"), "pos", "senders", "total")


@query(f"""{als_chain(2).replace(fx.D1, fx.D3)}, w AS (SELECT "user", item, {fx.VALUE_CASE} AS rating FROM ({fx.EVENT_LOG})),
   wm AS (SELECT w."user", avg(rating) AS wm FROM w JOIN v2 USING (item) GROUP BY w."user")
   SELECT w."user", {rs('any_value(wm)', 9)} AS bias, {rs('sum((rating - wm) * v) / (sum(v * v) + 0.1 * count(*))', 5)} AS factor
   FROM w JOIN wm USING ("user") JOIN v2 USING (item) GROUP BY w."user" """)
def stream_foldin(spark, sf):
    """Every event counts as one rating of a newcomer."""
    model = als.fit_als(fx.event_ratings(spark, sf), k=1, iterations=2, seed=SEED, init="grid")
    rated = label_to_value(streams.event_stream(spark, sf), LABEL_VALUES).select("user", "item", "rating")
    rows = streams.fold_in(rated, model, scratch_path(spark, "stream-foldin"))
    return rows.select("user", r("bias", 9).alias("bias"), r(F.col("f")[0], 5).alias("factor"))


@query(f"""{als_chain(2).replace(fx.D1, fx.D3)}, w AS ({fx.D3}), wm AS (SELECT "user", avg(rating) AS wm FROM w GROUP BY "user")
   SELECT w."user", {rs('any_value(wm)', 9)} AS bias, {rs('sum((rating - wm) * v) / (sum(v * v) + 0.1 * count(*))', 5)} AS factor
   FROM w JOIN wm USING ("user") JOIN v2 USING (item) GROUP BY w."user" """)
def stream_foldin_latest(spark, sf):
    """Later events of a pair replace earlier ones."""
    model = als.fit_als(fx.event_ratings(spark, sf), k=1, iterations=2, seed=SEED, init="grid")
    rated = label_to_value(streams.event_stream(spark, sf), LABEL_VALUES).select(
        "user", "item", "rating", F.struct("ts", "event_id").alias("arrived"))
    rows = streams.fold_in_latest(rated, model, scratch_path(spark, "stream-latest"))
    return rows.select("user", r("bias", 9).alias("bias"), r(F.col("f")[0], 5).alias("factor"))
