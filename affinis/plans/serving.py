"""Group recommendations, splits, metrics and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.models import als, foldin, means, neighbours, registry
from affinis.operators import evaluate, prepare, stats
from affinis.operators.layout import scratch_path
from affinis.operators.recommend import recommend
from affinis.plans.least_squares import SEED, als_chain
from affinis.plans.neighbourhood import COSINE
from affinis.plans.registry import query, r, rs
from affinis.plans.spectral import NEW_BUYERS
from affinis.sources import fixtures as fx


def _als(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return d1, als.fit_als(d1, k=1, iterations=2, seed=SEED, init="grid")


def _nation(spark, sf, nation: int):
    return fx.table(spark, sf, "customer").where(F.col("c_nationkey") == nation).select(F.col("c_custkey").alias("user"))


def _shown(df):
    return df.withColumn("score", r("score"))


GROUP = f"""grp AS (SELECT c_custkey AS "user" FROM customer WHERE c_nationkey = 3),
   gu AS (SELECT "user", coalesce(m, 0) AS m, coalesce(u, 0) AS u FROM grp LEFT JOIN m USING ("user") LEFT JOIN u2 USING ("user"))"""
TOP = "SELECT CAST(row_number() OVER (ORDER BY s DESC, item DESC) AS BIGINT) AS rank, item, " + rs("s") + " AS score FROM sc"


@query(f"""{als_chain(2)}, {GROUP}, sc AS (SELECT item, avg(m + u * v) AS s FROM gu CROSS JOIN v2 GROUP BY item)
   {TOP} QUALIFY rank <= 20""")
def recommend_group(spark, sf):
    """Best 20 parts for all customers of one nation, by the group-mean shortcut."""
    d1, model = _als(spark, sf)
    return _shown(recommend(model, _nation(spark, sf, 3), items=d1, k=20))


@query(f"""{als_chain(2)}, {GROUP}, sc AS (SELECT item, avg(m + u * v) AS s FROM gu CROSS JOIN v2 GROUP BY item) {TOP}""")
def recommend_all(spark, sf):
    """All parts ranked, numbered without a single-task sort."""
    d1, model = _als(spark, sf)
    return _shown(recommend(model, _nation(spark, sf, 3), items=d1))


@query(f"""{als_chain(2)}, {GROUP}, cand AS (SELECT p_partkey AS item FROM part WHERE p_brand = 'Brand#7'),
   sc AS (SELECT item, avg(m + u * coalesce(v, 0)) AS s FROM gu CROSS JOIN (SELECT item, v FROM cand LEFT JOIN v2 USING (item)) GROUP BY item)
   {TOP} QUALIFY rank <= 10""")
def recommend_subset(spark, sf):
    _, model = _als(spark, sf)
    brand = fx.table(spark, sf, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("item"))
    return _shown(recommend(model, _nation(spark, sf, 3), items=brand, k=10))


@query(f"""{als_chain(2)}, {GROUP}, w AS ({NEW_BUYERS}), wm AS (SELECT "user", avg(rating) AS wm FROM w GROUP BY "user"),
   f AS (SELECT w."user", sum((rating - wm) * v) / (sum(v * v) + 0.1 * count(*)) AS f FROM w JOIN wm USING ("user") JOIN v2 USING (item) GROUP BY w."user"),
   everyone AS (SELECT m, u FROM gu UNION ALL SELECT wm, f FROM wm JOIN f USING ("user")),
   sc AS (SELECT item, avg(m + u * v) AS s FROM everyone CROSS JOIN v2 GROUP BY item) {TOP} QUALIFY rank <= 20""")
def recommend_with_extra(spark, sf):
    """One nation together with every newcomer."""
    d1, model = _als(spark, sf)
    new = d1.select((F.col("user") + 1_000_000_000).alias("user"), "item", (6 - F.col("rating")).alias("rating"))
    return _shown(recommend(model, _nation(spark, sf, 3), extra=foldin.fold_in_als(model, new), items=d1, k=20))


@query(f"""{als_chain(2)}, {GROUP}, seen AS (SELECT DISTINCT item FROM d JOIN grp USING ("user")),
   sc AS (SELECT item, avg(m + u * v) AS s FROM gu CROSS JOIN v2 WHERE item NOT IN (SELECT item FROM seen) GROUP BY item)
   {TOP} QUALIFY rank <= 20""")
def recommend_unseen(spark, sf):
    d1, model = _als(spark, sf)
    return _shown(recommend(model, _nation(spark, sf, 3), items=d1, k=20, exclude_seen=d1))


@query(f"""{als_chain(2)}, {GROUP}, sc AS (SELECT item, avg(m + u * v) AS s FROM gu CROSS JOIN v2 GROUP BY item)
   {TOP} QUALIFY rank <= 20""")
def recommend_pairwise(spark, sf):
    """The same without the shortcut: every member scored against every part."""
    d1, model = _als(spark, sf)
    return _shown(recommend(model, _nation(spark, sf, 3), items=d1, k=20, pushdown=False))


SOME = f'(SELECT * FROM ({fx.D1}) WHERE item % 7 <> 0)'


@query(f"""{als_chain(2).replace(fx.D1, 'SELECT * FROM ' + SOME)}, {GROUP},
   cand AS (SELECT range AS item FROM range(0, CAST((SELECT max(item) + 1 FROM d) AS BIGINT))),
   sc AS (SELECT item, avg(m + u * coalesce(v, 0)) AS s FROM gu CROSS JOIN (SELECT item, v FROM cand LEFT JOIN v2 USING (item)) GROUP BY item)
   {TOP}""")
def recommend_cold_items(spark, sf):
    """Without named candidates all items up to the largest id are scored, also those nobody has rated."""
    d1 = fx.stored(fx.part_ratings(spark, sf).where("item % 7 != 0"))
    return _shown(recommend(als.fit_als(d1, k=1, iterations=2, seed=SEED, init="grid"), _nation(spark, sf, 3)))


@query(f"""{als_chain(2)}, {GROUP}, often AS (SELECT * FROM gu UNION ALL SELECT * FROM gu WHERE "user" % 2 = 0),
   sc AS (SELECT item, avg(m + u * v) AS s FROM often CROSS JOIN v2 GROUP BY item) {TOP} QUALIFY rank <= 20""")
def recommend_repeated_members(spark, sf):
    """A member named twice counts twice."""
    d1, model = _als(spark, sf)
    group = _nation(spark, sf, 3)
    return _shown(recommend(model, group.unionAll(group.where("user % 2 = 0")), items=d1, k=20, pushdown=False))

@query(f"""WITH {COSINE}, grp AS (SELECT DISTINCT "user" FROM r WHERE "user" IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
   kk AS (SELECT u, v FROM k JOIN grp ON u = grp."user" WHERE rank <= 20), im AS (SELECT item, avg(rating) AS mean FROM r GROUP BY item),
   h AS (SELECT kk.u, r.item, count(*) AS n, sum(rating) AS wr FROM kk JOIN r ON r."user" = kk.v GROUP BY 1, 2),
   a AS (SELECT u, count(*) AS near FROM kk GROUP BY u),
   sc AS (SELECT im.item, sum(CASE WHEN coalesce(n, 0) < 3 THEN 0 ELSE (wr + (near - n) * mean) / near END) / count(*) AS s
     FROM grp JOIN a ON a.u = grp."user" CROSS JOIN im LEFT JOIN h ON h.u = grp."user" AND h.item = im.item GROUP BY im.item)
   {TOP.replace('ORDER BY s DESC', 'ORDER BY round(s, 9) DESC').replace(rs('s'), rs('s', 9))} QUALIFY rank <= 20""")
def recommend_knn(spark, sf):
    """Group recommendation by a neighbourhood model, without group x items."""
    d3 = fx.stored(fx.event_ratings(spark, sf))
    segment = fx.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user"))
    users = d3.select("user").distinct().join(segment, "user", "left_semi")
    model = neighbours.fit_knn(d3)
    from affinis.operators.recommend import item_scores, top

    scores = item_scores(model, users, items=d3.select("item").distinct())
    return top(scores.withColumn("score", r("score", 9)), 20)


@query(f"""SELECT "user", item, 0.0::DOUBLE AS prediction FROM ({fx.D1})""")
def zero_predict(spark, sf):
    return means.fit_zero().predict(fx.part_ratings(spark, sf).select("user", "item"))


SPLIT = f"""d AS ({fx.D1}), train AS (SELECT * FROM d WHERE ("user" * 31 + item * 17) % 10 <> 0),
   test AS (SELECT * FROM d WHERE ("user" * 31 + item * 17) % 10 = 0),
   mm AS (SELECT "user", avg(rating) AS p FROM train GROUP BY "user"),
   z AS (SELECT test."user", test.item, rating, coalesce(p, 0) AS p FROM test LEFT JOIN mm USING ("user"))"""


def _scored(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    train, test = d1.where(~prepare.grid_split()), d1.where(prepare.grid_split())
    return means.fit_user_mean(train).predict(test)


@query(f"""WITH {SPLIT} SELECT (SELECT CAST(count(*) AS BIGINT) FROM train) AS n_train, (SELECT CAST(count(*) AS BIGINT) FROM test) AS n_test""")
def split_eval(spark, sf):
    flag = prepare.grid_split()
    return fx.part_ratings(spark, sf).agg(F.count_if(~flag).alias("n_train"), F.count_if(flag).alias("n_test"))


@query(f"""SELECT CAST(count(*) AS BIGINT) AS n, true AS near_a_tenth, true AS differs FROM ({fx.D1})""")
def random_split(spark, sf):
    """Two hash splits: each about a tenth, and not the same one."""
    one, two = prepare.split_column(0), prepare.split_column(1)
    n = F.count(F.lit(1))
    return fx.part_ratings(spark, sf).agg(
        n.alias("n"), (F.abs(F.count_if(one) / n - 0.1) < 0.02).alias("near_a_tenth"),
        (F.count_if(one & two) / n < 0.03).alias("differs"))


@query(f"""WITH {SPLIT} SELECT 'rmse' AS metric, {rs('sqrt(avg((rating - p) * (rating - p)))')} AS value FROM z
   UNION ALL SELECT 'mae', {rs('avg(abs(rating - p))')} FROM z""")
def rmse_mae(spark, sf):
    return evaluate.metrics(_scored(spark, sf), ["rmse", "mae", "rmse"]).withColumn("value", r("value"))


def _dcg(order: str, source: str = "z") -> str:
    return f"""(SELECT sum((pow(2, rating) - 1) / log2(k + 1)) FROM (
      SELECT rating, row_number() OVER (ORDER BY {order} DESC, "user", item) AS k FROM {source}) WHERE k <= 100)"""


@query(f"""WITH {SPLIT} SELECT {rs(_dcg('p'))} AS dcg, {rs(_dcg('p') + ' / ' + _dcg('rating'))} AS ndcg""")
def dcg_ndcg(spark, sf):
    got = evaluate.ranked_metrics(_scored(spark, sf))
    return got.select(r("dcg").alias("dcg"), r("ndcg").alias("ndcg"))


@query(f"""WITH {SPLIT} SELECT 'coverage' AS metric, {rs('count(p) / count(*)')} AS value FROM z
   UNION ALL SELECT 'bias', {rs('avg(rating - p)')} FROM z""")
def user_defined_metric(spark, sf):
    evaluate.register_metric("bias", lambda: F.avg(F.col("rating") - F.col("prediction")))
    scored = _scored(spark, sf)
    covered = evaluate.coverage(scored).select(F.lit("coverage").alias("metric"), F.col("coverage").alias("value"))
    return covered.unionByName(evaluate.metrics(scored, ["bias"])).withColumn("value", r("value"))


def _per_model(names: dict[str, str]) -> str:
    parts = []
    for label, source in names.items():
        for metric, value in (("rmse", f"(SELECT sqrt(avg((rating - p) * (rating - p))) FROM {source})"),
                              ("mae", f"(SELECT avg(abs(rating - p)) FROM {source})"), ("dcg", _dcg("p", source)),
                              ("ndcg", _dcg("p", source) + " / " + _dcg("rating", source))):
            parts.append(f"SELECT '{label}' AS model, 0 AS split, '{metric}' AS metric, {rs(value, 5)} AS value")
    return "\nUNION ALL ".join(parts)


@query(f"""{als_chain(1).replace(fx.D1, 'SELECT * FROM (' + fx.D1 + ') WHERE ("user" * 31 + item * 17) % 10 <> 0')},
   test AS (SELECT * FROM ({fx.D1}) WHERE ("user" * 31 + item * 17) % 10 = 0),
   zm AS (SELECT test."user", test.item, rating, coalesce(m, 0) AS p FROM test LEFT JOIN m USING ("user")),
   z0 AS (SELECT "user", item, rating, 0.0::DOUBLE AS p FROM test),
   za AS (SELECT test."user", test.item, rating, coalesce(m, 0) + coalesce(u * v, 0) AS p FROM test
     LEFT JOIN m USING ("user") LEFT JOIN u1 USING ("user") LEFT JOIN v1 USING (item))
   {_per_model({'zero': 'z0', 'user_mean': 'zm', 'als': 'za'})}""")
def compare_models(spark, sf):
    """Three models, one of them user-defined, on the arithmetic split; the
    result goes through its sink."""
    registry.register("user_mean", means.fit_user_mean)
    table = evaluate.compare_models(
        fx.part_ratings(spark, sf),
        [("zero", "zero", {}), ("user_mean", "user_mean", {}),
         ("als", "als", {"k": 1, "iterations": 1, "seed": SEED, "init": "grid"})],
        ["rmse", "mae", "dcg", "ndcg"], is_test=prepare.grid_split())
    path = scratch_path(spark, "results")
    evaluate.save_metrics(table, path)
    return spark.read.parquet(path).select(
        F.col("model").cast("string").alias("model"), "split", "metric", r("value", 5).alias("value"))


def _history_sql() -> str:
    parts = []
    for sweep in (1, 2):
        for mode, source in (("train", "train"), ("test", "test")):
            p = f"""(SELECT x."user", x.item, rating, coalesce(m, 0) + coalesce(u * v, 0) AS p FROM {source} x
              LEFT JOIN m USING ("user") LEFT JOIN u{sweep} USING ("user") LEFT JOIN v{sweep} USING (item))"""
            parts.append(f"""SELECT 'als' AS model, '{mode}' AS mode, {sweep - 1} AS epoch, 'rmse' AS metric,
              {rs('sqrt(avg((rating - p) * (rating - p)))')} AS value FROM {p}""")
    return "\nUNION ALL ".join(parts)


@query(f"""{als_chain(2).replace(fx.D1, 'SELECT * FROM (' + fx.D1 + ') WHERE ("user" * 31 + item * 17) % 10 <> 0')},
   train AS (SELECT * FROM d), test AS (SELECT * FROM ({fx.D1}) WHERE ("user" * 31 + item * 17) % 10 = 0) {_history_sql()}""")
def metric_history(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    train, test = d1.where(~prepare.grid_split()), d1.where(prepare.grid_split())
    curve = evaluate.MetricHistory(train, test, ["rmse"])
    als.fit_als(train, k=1, iterations=2, seed=SEED, init="grid", on_sweep=curve)
    return curve.table(spark).withColumn("value", r("value"))


@query(f"""WITH {SPLIT}, s AS (SELECT c_nationkey, sqrt(avg((rating - p) * (rating - p))) AS value FROM z
     JOIN customer ON c_custkey = z."user" GROUP BY c_nationkey)
   SELECT 'user_mean' AS model, 'rmse' AS metric, {rs('avg(value)')} AS mean, {rs('var_pop(value)')} AS var,
     {rs('1.96 * sqrt(var_pop(value) / count(value))')} AS ci95 FROM s""")
def ci95(spark, sf):
    """Dispersion of a metric over splits, the splits here being nations."""
    nation = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("split"))
    table = evaluate.metrics(_scored(spark, sf).join(nation, "user"), ["rmse"], ["split"])
    got = stats.split_dispersion(table.withColumn("model", F.lit("user_mean")))
    return got.select("model", "metric", *[r(c).alias(c) for c in ("mean", "var", "ci95")])


@query(f"""SELECT item, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, item) AS BIGINT) AS rank FROM ({fx.D3}) GROUP BY item""")
def popularity_order(spark, sf):
    return prepare.by_popularity(fx.event_ratings(spark, sf))
