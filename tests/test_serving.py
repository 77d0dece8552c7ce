import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions.values import LABEL_VALUES
from affinis.models import als, foldin, means, neighbours, registry, tagged
from affinis.operators import evaluate, vectorsum as vs
from affinis.operators.prepare import label_to_value
from affinis.operators.recommend import group_grid, recommend
from affinis.sources.fixtures import N_TAGS
from affinis.streaming import streams


@pytest.fixture(scope="module")
def model(d1):
    return als.fit_als(d1, k=3, iterations=2)


def listed(df):
    return [(r["rank"], r["item"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]


def users(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "user bigint")


def test_shortcut_equals_pairs(spark, model):
    group = users(spark, 1, 3, 10**9)
    assert listed(recommend(model, group, k=8)) == listed(recommend(model, group, k=8, pushdown=False))


def test_recommend_edges(spark, model):
    group = users(spark, 1)
    assert recommend(model, group, k=0).count() == 0
    every = recommend(model, group)
    assert every.count() == model.n_items()
    assert sorted(r["rank"] for r in every.collect()) == list(range(1, every.count() + 1))
    assert recommend(model, group, k=10**6).count() == every.count()
    some = spark.createDataFrame([(2,), (4,), (5,)], "item bigint")
    got = recommend(model, users(spark, 1, 3), items=some, k=2)
    assert {r["item"] for r in got.collect()} <= {2, 4, 5} and got.count() == 2
    with pytest.raises(NotImplementedError):
        recommend(model, group, method="max")
    with pytest.raises(ValueError):
        recommend(model, users(spark).where("user > 0"), k=2)
    with pytest.raises(ValueError):
        recommend(model, None)


def test_equal_scores_put_the_larger_id_first(spark, d1):
    flat = means.fit_user_mean(d1)
    got = recommend(flat, users(spark, 1), items=spark.createDataFrame([(2,), (9,), (5,)], "item bigint"), k=3)
    assert [i for _, i, _ in listed(got)] == [9, 5, 2]


def test_models_without_the_shortcut(spark, d1, d3, tags):
    items = d1.select("item").distinct()
    lasso = tagged.fit_lasso(d1, tags, N_TAGS)
    got = listed(recommend(lasso, users(spark, 1, 2), items=items, k=3))
    pairs = lasso.predict(group_grid(users(spark, 1, 2), items)).groupBy("item").agg(F.avg("prediction").alias("s"))
    best = sorted(((r["s"], r["item"]) for r in pairs.collect()), reverse=True)[:3]
    assert [i for _, i, _ in got] == [i for _, i in best]
    knn = neighbours.fit_knn(d3, k=5)
    assert recommend(knn, users(spark, 1, 2), items=d3.select("item"), k=3).count() == 3


QUICK = {"iterations": 1, "epochs": 1, "rounds": 3, "k": 2}


@pytest.mark.parametrize("name", registry.available())
def test_every_model_scores_all_items_by_default(spark, d1, tags, name):
    import inspect

    fit = registry.ALGORITHMS[name][0]
    known = inspect.signature(fit).parameters
    kw = {p: v for p, v in QUICK.items() if p in known} | ({"base": None} if name == "gbr" else {})
    args = (tags, N_TAGS) if "item_tags" in known else ()
    model = registry.fit_named(name, d1.where("item != 5"), *args, **kw)
    top = d1.agg(F.max("item")).first()[0]
    got = recommend(model, users(spark, 1, 3))
    assert sorted(r["item"] for r in got.collect()) == list(range(top + 1))
    model.set_parameters(n_items=top + 4)
    assert recommend(model, users(spark, 1), k=10**6).count() == top + 4


def test_repeated_members_weigh_the_same_on_every_path(spark, d1, d3):
    group, items = users(spark, 1, 1, 1, 3), d1.select("item").distinct()
    model = als.fit_als(d1, k=2, iterations=1)
    quick, grid = (listed(recommend(model, group, items=items, pushdown=p)) for p in (True, False))
    assert [(i, round(s, 9)) for _, i, s in quick] == [(i, round(s, 9)) for _, i, s in grid]
    knn = neighbours.fit_knn(d3, k=5)
    rated = d3.select("item").distinct()
    pairs = knn.predict(group_grid(users(spark, 1, 3), rated)).withColumn("w", F.when(F.col("user") == 1, 3).otherwise(1))
    want = {r["item"]: r["s"] for r in pairs.groupBy("item").agg((F.sum(F.col("prediction") * F.col("w")) / 4).alias("s")).collect()}
    got = {i: s for _, i, s in listed(recommend(knn, group, items=rated))}
    assert all(abs(got[i] - s) < 1e-9 for i, s in want.items())


def test_newcomers_of_neighbour_and_switch_models(spark, d1, d3, tags):
    knn = neighbours.fit_knn(d3, k=5)
    near = neighbours.fold_in_knn(knn, d3.where("user = 2").withColumn("user", F.lit(10**6).cast("bigint")))
    got = recommend(knn, users(spark, 1), extra=near, items=d3)
    alone = recommend(knn, None, extra=near, items=d3)
    assert got.count() == alone.count() == d3.select("item").distinct().count()
    switch = tagged.fit_balse(d1, tags, N_TAGS, k=2, iterations=1, gamma=25)
    rows = switch.warm.users.where("user = 1").withColumn("user", F.lit(10**6).cast("bigint"))
    cold = switch.cold.users.where("user = 1").select(F.col("bias").alias("cold_bias"), F.col("f").alias("cold_f"))
    extra = rows.join(F.broadcast(cold))
    a = {i: round(s, 9) for _, i, s in listed(recommend(switch, None, extra=extra))}
    assert a == {i: round(s, 9) for _, i, s in listed(recommend(switch, users(spark, 1)))}


def test_large_groups_are_dealt_to_slots(spark):
    members = spark.range(1000).withColumnRenamed("id", "user")
    items = spark.range(30).withColumnRenamed("id", "item")
    grid = group_grid(members, items)
    assert grid.count() == 30_000 and grid.distinct().count() == 30_000


def test_metrics_by_hand(spark):
    df = spark.createDataFrame(
        [(1, 1, 3.0, 2.0), (1, 2, 1.0, 4.0), (2, 1, 2.0, 3.0), (2, 2, 5.0, None)],
        "user bigint, item bigint, rating double, prediction double")
    got = {r["metric"]: r["value"] for r in evaluate.metrics(df, ["rmse", "mae", "dcg", "ndcg"]).collect()}
    assert abs(got["rmse"] - np.sqrt(11 / 3)) < 1e-12 and abs(got["mae"] - 5 / 3) < 1e-12
    gains = [1 / np.log2(2), 3 / np.log2(3), 7 / np.log2(4)]
    assert abs(got["dcg"] - sum(gains)) < 1e-12
    ideal = 7 / np.log2(2) + 3 / np.log2(3) + 1 / np.log2(4)
    assert abs(got["ndcg"] - sum(gains) / ideal) < 1e-12
    zero = df.withColumn("rating", F.lit(0.0))
    assert evaluate.ranked_metrics(zero).first()["ndcg"] == 0.0
    with pytest.raises(ValueError):
        evaluate.metrics(df, ["nope"])


def test_splits_are_reproducible_and_differ(d1):
    from affinis.operators.prepare import split_column

    one = {tuple(r) for r in d1.where(split_column(0)).select("user", "item").collect()}
    again = {tuple(r) for r in d1.where(split_column(0)).select("user", "item").collect()}
    two = {tuple(r) for r in d1.where(split_column(1)).select("user", "item").collect()}
    assert one == again != two


def test_compare_on_random_splits(d1):
    table = evaluate.compare_models(d1, [("m", "zero", {}), ("u", "als", {"k": 2, "iterations": 1})], ["rmse", "ndcg"], splits=2)
    got = table.toPandas()
    assert len(got) == 8 and set(got.split) == {0, 1}
    pivot = got[got.metric == "rmse"].groupby("model").value.mean()
    assert pivot["u"] < pivot["m"]


def wrap(x):
    return (x + 2**63) % 2**64 - 2**63


def test_wrapping_arithmetic(spark):
    rng = np.random.default_rng(3)
    low, high = -(2**63), 2**63 - 1
    rows = [(int(a), int(b)) for a, b in rng.integers(low, high, (200, 2))] + [(low, -1), (low, low), (high, high), (high, 1)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    got = df.select("a", "b", vs.wrap_multiply(F.col("a"), F.col("b")).alias("m"), vs.signed(F.col("a"), F.lit(-1)).alias("n")).collect()
    assert all(r["m"] == wrap(r["a"] * r["b"]) and r["n"] == wrap(-r["a"]) for r in got)
    total = vs.wrapping_sum_rows(df.select(F.lit(0).alias("g"), F.col("a").alias("value")), ["g"]).first()["total"]
    assert total == wrap(sum(a for a, _ in rows))


def test_short_vector_cuts_the_sum(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [10, 20])], "user bigint, vec array<bigint>").withColumn("g", F.lit(1))
    assert vs.wrapping_sum(df, ["g"]).first()["vec"] == [11, 22]
    assert vs.wrapping_sum(df, ["g"], length=1).first()["vec"] == [11]


@pytest.mark.parametrize("n, step, alive, threshold, length", [(8, 2, 6, 3, 9), (9, 2, 9, 5, 9), (13, 2, 8, 5, 15)])
def test_protocol_scenarios(spark, n, step, alive, threshold, length):
    """Everyone shares, some drop out, the plain sum of the rest is recovered."""
    ids = [500 + step * u for u in range(n)]
    vec = {u: [j + 1 if j % n == p else 0 for j in range(length)] for p, u in enumerate(ids)}
    rng = np.random.default_rng(n)
    rand = lambda: [int(x) for x in rng.integers(-(2**63), 2**63 - 1, length)]
    masks = [(u, u, "own", rand()) for u in ids]
    for a in ids:
        for b in ids:
            if a < b:
                m = rand()
                masks += [(a, b, "pair", m), (b, a, "pair", m)]
    vectors = spark.createDataFrame(list(vec.items()), "user bigint, vec array<bigint>")
    mask_table = spark.createDataFrame(masks, "user bigint, peer bigint, kind string, vec array<bigint>")
    masked = vs.apply_masks(vectors, mask_table)
    assert {r["user"]: r["vec"] for r in masked.collect()} != vec
    came = masked.where(F.col("user").isin(ids[:alive]))
    assert vs.quorum(came.withColumn("g", F.lit(1)), ["g"], threshold, strict=True).first()["senders"] == alive
    got = {r["pos"]: r["total"] for r in vs.remove_masks(came, mask_table, vectors).collect()}
    assert [got[j] for j in range(length)] == [sum(vec[u][j] for u in ids[:alive]) for j in range(length)]


def test_below_quorum(spark):
    df = spark.createDataFrame([(u, [1]) for u in (1, 2, 2)], "user bigint, vec array<bigint>").withColumn("g", F.lit(1))
    assert vs.quorum_sum(df, ["g"], 3).count() == 0
    with pytest.raises(Exception, match="below quorum: 2"):
        vs.quorum(df, ["g"], 3, strict=True).collect()


def test_completeness_by_count(spark):
    full = [(a, b) for a in range(4) for b in range(4) if a != b]
    df = spark.createDataFrame(full, "holder bigint, sender bigint")
    assert vs.incomplete(df, None).count() == 0
    cut = spark.createDataFrame(full[1:], "holder bigint, sender bigint")
    assert [tuple(r) for r in vs.incomplete(cut, None).collect()] == [(0, 1)]


def split_events(spark, folder, parts):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts", "event_id")
    pdf = events.toPandas()
    step = -(-len(pdf) // parts)
    for p in range(parts):
        path = f"{folder}/part-{p}.parquet"
        pdf.iloc[p * step:(p + 1) * step].to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + 60 * p,) * 2)  # files are taken in this order


def test_ragged_vectors_are_cut_in_streams_as_in_batches(spark, tmp_path):
    sent = [(1, [1, 2, 3]), (2, [10, 20]), (3, [100, 200, 300])]
    df = spark.createDataFrame([(u, "2024-01-01 10:00:00", u, v) for u, v in sent] + [(9, "2024-01-03 10:00:00", 9, [0])],
                               "user bigint, t string, arrived bigint, vec array<bigint>").withColumn("ts", F.col("t").cast("timestamp"))
    df.drop("t").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.drop("t").schema).parquet(str(tmp_path / "in"))
    got = streams.quorum_sums(stream, str(tmp_path / "out"), threshold=3)
    assert sorted((r["pos"], r["senders"], r["total"]) for r in got.collect()) == [(0, 3, 111), (1, 3, 222)]


def test_metrics_of_a_model_are_replaced(spark, tmp_path):
    path = str(tmp_path / "results")
    for model in ("a", "b", "a"):
        evaluate.save_metrics(spark.createDataFrame([(model, 0, "rmse", 1.0)], "model string, split int, metric string, value double"), path)
    assert sorted(r["model"] for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_streams_in_many_batches_equal_one(spark, d3, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    split_events(spark, str(folder), 4)
    whole, pieces = [], []
    model = als.fit_als(d3, k=2, iterations=2)
    for out, source, pattern, limit in ((whole, "/root/testdata/sf0.001", "events.parquet", None), (pieces, str(folder), "*.parquet", 1)):
        rated = label_to_value(streams.event_stream(spark, source, pattern, limit), LABEL_VALUES)
        base = str(tmp_path / f"out-{limit}")
        stats_ = streams.item_statistics(rated, f"{base}-stats")
        out.append(sorted((r["item"], r["n"], round(r["total"], 9)) for r in stats_.collect()))
        rows = streams.fold_in(rated.select("user", "item", "rating"), model, f"{base}-fold")
        out.append(sorted((r["user"], round(r["bias"], 9), *np.round(r["f"], 7)) for r in rows.collect()))
        dated = rated.select("user", "item", "rating", F.struct("ts", "event_id").alias("arrived"))
        rows = streams.fold_in_latest(dated, model, f"{base}-latest")
        out.append(sorted((r["user"], round(r["bias"], 9), *np.round(r["f"], 7)) for r in rows.collect()))
        sent = streams.event_stream(spark, source, pattern, limit).select(
            "user", "ts", F.struct("ts", "event_id").alias("arrived"), F.array("item", "event_id").alias("vec"))
        sums = streams.quorum_sums(sent, f"{base}-sums", threshold=2)
        out.append(sorted(map(tuple, sums.collect())))
    assert whole == pieces
    # The last rating of a pair wins, so the stream agrees with the batch fold-in of the cleaned ratings.
    batch = foldin.fold_in_als(model, d3.select("user", "item", "rating"))
    assert whole[2] == sorted((r["user"], round(r["bias"], 9), *np.round(r["f"], 7)) for r in batch.collect())


def test_list_of_metrics():
    """The metrics by name; one that a user adds is listed with them."""
    names = evaluate.available_metrics()
    assert [n for n in names if n in ("rmse", "mae", "dcg", "ndcg")] == ["rmse", "mae", "dcg", "ndcg"]
    try:
        evaluate.register_metric("bias of errors", lambda: F.avg(F.col("prediction") - F.col("rating")))
        assert "bias of errors" in evaluate.available_metrics()
    finally:
        evaluate.METRICS.pop("bias of errors")
