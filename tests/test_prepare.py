import pytest
from pyspark.sql import functions as F

from affinis.functions.values import LABEL_VALUES
from affinis.operators import layout, prepare, stats
from affinis.sources import ratings as src


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_dedup_modes(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 1), (1, 1, 4.0, 2), (1, 2, 1.0, 1)], "user bigint, item bigint, rating double, ts int")
    assert rows(prepare.dedup(df, "last", ["ts"]), "user", "item", "rating") == [(1, 1, 4.0), (1, 2, 1.0)]
    assert rows(prepare.dedup(df, "sum"), "user", "item", "rating") == [(1, 1, 6.0), (1, 2, 1.0)]
    assert rows(prepare.dedup(df, "mean"), "user", "item", "rating") == [(1, 1, 3.0), (1, 2, 1.0)]
    with pytest.raises(ValueError):
        prepare.dedup(df, "last")
    with pytest.raises(ValueError):
        prepare.dedup(df, "first")


def test_unknown_label_stops_or_is_rejected(spark):
    df = spark.createDataFrame([(1, 1, "like"), (1, 2, "what")], "user bigint, item bigint, label string")
    with pytest.raises(Exception, match="unknown label what"):
        prepare.label_to_value(df, LABEL_VALUES).collect()
    loose = prepare.label_to_value(df, LABEL_VALUES, strict=False)
    assert rows(prepare.rejected_labels(loose), "label") == [("what",)]
    table = spark.createDataFrame([("like", 2.0), ("what", 7.0)], "label string, value double")
    assert rows(prepare.label_to_value(df, table), "label", "rating") == [("like", 2.0), ("what", 7.0)]


def test_ids_are_dense_seeded_and_invertible(spark):
    df = spark.createDataFrame([(u, f"i{i % 7}", 1.0) for u in (10, 20, 30) for i in range(9)], "user bigint, item string, rating double")
    ids = prepare.random_ids(df, "item", seed=1)
    again = prepare.random_ids(df, "item", seed=1)
    assert rows(ids, "dense_id") == [(i,) for i in range(7)]
    assert rows(ids, "raw_id", "dense_id") == rows(again, "raw_id", "dense_id")
    assert rows(ids, "raw_id", "dense_id") != rows(prepare.random_ids(df, "item", seed=2), "raw_id", "dense_id")
    some = spark.createDataFrame([("i1",), ("nope",)], "item string")
    coded = prepare.encode(some, ids, "item")
    assert coded.count() == 1
    assert rows(prepare.decode(coded, ids, "item"), "item") == [("i1",)]
    with pytest.raises(Exception, match="unknown item 99"):
        prepare.decode(spark.createDataFrame([(99,)], "item bigint"), ids, "item").collect()


def test_popularity_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (2, 5, 1.0), (1, 3, 1.0), (1, 4, 1.0)], "user bigint, item bigint, rating double")
    assert rows(prepare.popularity_ids(df), "raw_id", "dense_id", "n") == [(3, 1, 1), (4, 2, 1), (5, 0, 2)]
    assert rows(prepare.by_popularity(df), "rank", "item", "n") == [(1, 5, 2), (2, 3, 1), (3, 4, 1)]


def test_files_with_another_header_are_refused(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("user,item,rating\n1,2,3\n")
    assert [tuple(r) for r in src.load_ratings(spark, str(folder)).collect()] == [(1, 2, 3.0)]
    (folder / "b.csv").write_text("item,user,rating\n7,8,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        src.load_ratings(spark, str(folder)).collect()


def test_empty_ids(spark):
    df = spark.createDataFrame([], "user bigint, item bigint, rating double")
    assert prepare.random_ids(df, "user").count() == 0


def test_csv_extra_columns_and_missing_ones(spark, tmp_path):
    spark.createDataFrame([("x", 3, 1, "4.5")], "note string, item int, user int, rating string").write.option("header", True).csv(str(tmp_path / "a"))
    assert rows(src.load_ratings(spark, str(tmp_path / "a")), "user", "item", "rating") == [(1, 3, 4.5)]
    doubled = src.load_ratings(spark, str(tmp_path / "a"), convert=F.col("rating").cast("double") * 2)
    assert rows(doubled, "rating") == [(9.0,)]
    spark.createDataFrame([(1, 2)], "user int, item int").write.option("header", True).csv(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="rating"):
        src.load_ratings(spark, str(tmp_path / "b"))


def test_catalogue_without_category(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text("0,First\n1,\"Second, longer\",anime\n")
    assert sorted(map(tuple, src.load_items(spark, str(path)).collect())) == [(0, "First", None), (1, "Second, longer", "anime")]


def test_empty_tags(spark, tmp_path):
    spark.createDataFrame([], "item bigint, tag int, weight double").write.parquet(str(tmp_path / "t"))
    assert src.load_tags(spark, str(tmp_path / "t"))[1] == 0


def test_row_norms_are_one(spark):
    df = spark.createDataFrame([(0, 0, 0.3), (0, 1, 0.9), (1, 0, 0.0), (2, 1, -2.0)], "user bigint, item bigint, rating double")
    norms = stats.normalise_rows(df).groupBy("user").agg(F.sum(F.pow("rating", F.lit(2))).alias("n"))
    assert [round(n, 6) for _, n in rows(norms, "user", "n")] == [1.0, 0.0, 1.0]


def test_hot_keys_are_spread_over_slots(spark):
    df = spark.range(4000).selectExpr("if(id < 3000, 7, id % 50) as user", "id as item", "1.0D as rating")
    store = layout.RatingStore(df, rows_per_slot=500)
    laid = store.by("user")
    assert store.is_split("user") and not store.is_split("item")
    per_slot = laid.groupBy("user", "slot").count()
    assert per_slot.where("user = 7").count() >= 5
    assert per_slot.agg(F.max("count")).first()[0] < 1000
    assert laid.count() == 4000
    store.release()


def test_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        layout.scratch_dir(Session())


def test_scramble_orders_by_the_pair_alone(spark):
    """The order hides the input's: it is that of a seeded hash, whatever order rows came in."""
    df = spark.range(300).selectExpr("id % 20 as user", "id as item", "1.0D as rating", "id as given")
    one = [r["given"] for r in prepare.scramble(df).collect()]
    assert sorted(one) == list(range(300)) and one != sorted(one)
    assert one == [r["given"] for r in prepare.scramble(df.orderBy(F.desc("given"))).collect()]
    assert one != [r["given"] for r in prepare.scramble(df, seed=7).collect()]
