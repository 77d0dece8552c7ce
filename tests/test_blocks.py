"""Neighbours over stored blocks: the same rows as by sent tiles, of ratings dense, sparse, negative and tied."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from affinis.llm import spans
from affinis.models import als, gradient
from affinis.operators import layout, recommend, similarity, strata


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("items", [4, 400])
def test_stored_blocks_find_the_same_neighbours(spark, monkeypatch, items):
    rng = np.random.default_rng(items)
    pairs = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 90, 700), rng.integers(0, items, 700))})
    rated = spark.createDataFrame([(u, i, float(rng.choice([-2.0, 0.0, 0.5, 2.0, 4.0]))) for u, i in pairs], "user bigint, item bigint, rating double").cache()
    new = rated.where("user % 3 = 0").select((F.col("user") + 1000).alias("user"), "item", (F.col("rating") + 1).alias("rating"))
    asked = rated.where("user % 5 = 1").select("user").unionAll(spark.createDataFrame([(5000,)], "user bigint"))
    wanted = rated.where("user % 2 = 0").select("user", "item").unionAll(spark.createDataFrame([(1, 999_999), (5000, 1)], "user bigint, item bigint"))

    def results():
        near = lambda **kw: rows_of(similarity.top_neighbours(rated, 6, block=9, **kw).select("user", "neighbor", "sim", "rank"), "user", "rank")
        raters = similarity.nearest_raters(wanted, rated, 3, block=9).select("user", "item", "rater", "sim", "rating", "rank")
        return near(), near(queries=asked), near(new_ratings=new), rows_of(raters, "user", "item", "rank")

    stored = results()
    plan = similarity.top_neighbours(rated, 6, block=9)._jdf.queryExecution().executedPlan().toString()
    assert "phase" not in plan  # no rating is sent to a tile
    monkeypatch.setattr(similarity, "SENT_BLOCKS", 10**6)
    assert stored == results()
    assert all(len(r) for r in stored)


@pytest.mark.parametrize("items", [4, 40, 4000])
def test_wide_blocks_form_only_pairs_with_a_common_item(spark, monkeypatch, items):
    rng = np.random.default_rng(items)
    pairs = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 90, 700), rng.integers(0, items, 700))})
    values = [-2.0, 0.0, 0.5, 2.0, 4.0]
    rated = spark.createDataFrame([(u, i, float(rng.choice(values))) for u, i in pairs], "user bigint, item bigint, rating double").cache()
    new = rated.where("user % 3 = 0").select((F.col("user") + 1000).alias("user"), "item", (F.col("rating") + 1).alias("rating"))
    asked = rated.where("user % 5 = 1").select("user").unionAll(spark.createDataFrame([(5000,)], "user bigint"))

    def results():
        near = lambda **kw: rows_of(similarity.top_neighbours(rated, 6, block=9, **kw).select("user", "neighbor", "sim", "rank"), "user", "rank")
        return near(), near(queries=asked), near(new_ratings=new)

    def dense(*_):
        raise AssertionError("a pair of blocks was compared densely")

    with monkeypatch.context() as m:
        m.setattr(similarity, "SENT_BLOCKS", 10**6)
        sent = results()
    monkeypatch.setattr(similarity, "DENSE_ITEMS", 10**6)
    monkeypatch.setattr(similarity, "_nearest_of", dense)
    for users, at_once, held, cells in ((65_536, 2_000_000, 1_000_000, 4_000_000), (30, 50, 100, 64)):
        monkeypatch.setattr(similarity, "WIDE_USERS", users)
        monkeypatch.setattr(similarity, "_MET", at_once)
        monkeypatch.setattr(similarity, "_HELD", held)
        monkeypatch.setattr(similarity, "_CELLS", cells)
        assert results() == sent


def test_a_tile_looks_up_only_raters_that_can_enter(monkeypatch):
    """Requests of users with common items: most tiles pass without a look at the raters."""
    rng = np.random.default_rng(7)
    none = np.zeros(0, np.int64)

    def side(low, n, asks):
        row, item = np.nonzero(rng.random((n, 40)) < 0.5)
        order = np.lexsort((row, item))
        row, item = row[order], item[order]
        value = rng.choice([-2.0, 0.1, 2.0, 4.0], len(row))
        targets = (low + row, item, np.zeros(len(row))) if asks else (none, none, np.zeros(0))
        return similarity._Side({similarity.USERS: (np.arange(low, low + n), none, none), similarity.RATINGS: (row, item, value), similarity.TARGETS: targets})

    ours, others = side(0, 60, True), [side(1000 * t, 400, False) for t in range(1, 13)]
    want, got, calls = similarity._Best(len(ours.row), 5), similarity._Best(len(ours.row), 5), []
    for other in others:
        similarity._raters_of(ours, other, want)
    whole = similarity._raters_of
    monkeypatch.setattr(similarity, "_raters_of", lambda *a: (calls.append(1), whole(*a)))
    asked = similarity._Asked(ours)
    for other in others:
        asked.offer(other, got)
        got.flush()
    assert len(calls) < len(others) / 2
    assert (got.id == want.id).all() and (got.sim == want.sim).all() and (got.value == want.value).all()


def test_the_order_of_the_best_is_that_of_three_keys():
    rng = np.random.default_rng(8)
    for scale in (1.0, 1e6):
        row, ident = rng.integers(0, 50, 4000), rng.permutation(4000)
        sim = np.round(rng.choice([-1.0, -0.25, 0.0, 0.123456789, 0.123456788, 1.0], 4000) * scale, 9)
        sim[::7] = -np.inf
        assert (similarity._ordered(row, sim, ident) == np.lexsort((ident, -sim, row))).all()


@pytest.mark.parametrize("broken", [False, True])
def test_pairwise_group_scores_shuffle_no_pairs(spark, d1, monkeypatch, broken):
    model = als.fit_als(d1, k=2, iterations=1)
    group = d1.select("user").distinct().where("user % 4 = 0")
    group = group.unionAll(group.where("user % 8 = 0")).unionAll(spark.createDataFrame([(10**6,)], "user bigint"))
    extra = model.users.where("user % 5 = 1").withColumn("user", F.col("user") + 10**7)
    if broken:  # a member whose numbers are none: items without factors, and only these, keep a score
        extra = extra.withColumn("f", F.when(F.col("user") % 2 == 0, F.array(F.lit(float("nan")), F.lit(1.0))).otherwise(F.array(F.lit(None).cast("double"), F.lit(1.0))))
    items = d1.select("item").unionAll(spark.createDataFrame([(10**6,)], "item bigint"))
    for low in (None, 2.5):
        model.params.update(low=low, high=None if low is None else 3.5)
        score = lambda: {r["item"]: r["score"] for r in recommend.item_scores(model, group, extra, items, pushdown=False).collect()}
        got = score()
        plan = recommend.item_scores(model, group, extra, items, pushdown=False)._jdf.queryExecution().executedPlan().toString()
        assert "slot" not in plan
        with monkeypatch.context() as m:
            m.setattr(recommend, "fits_broadcast", lambda rows, size: False)
            want = score()
        assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()), atol=1e-9, equal_nan=True)


def test_the_copy_of_the_documents_goes_once_the_runs_are_written(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(layout, "scratch_dir", lambda spark: str(tmp_path))
    text = "One two three four five six seven eight nine ten eleven twelve thirteen. And more."
    docs = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id bigint, text string")
    got = spans.repeats(docs, whole=True)
    assert [r["doc_id"] for r in got.collect()] == [2]
    assert not list(tmp_path.glob("affinis/*/rows-*")) and list(tmp_path.glob("affinis/*/runs-*"))


def test_rounds_together_are_serial_steps():
    """Many rounds in one operation, with the result of one step after the other."""
    rng = np.random.default_rng(5)
    n, m, k, rate, penalty = 1500, 2000, 2, 0.05, 0.1
    pairs = rng.permutation(n * m)[:4000]
    user, item, rating = pairs // m, pairs % m, rng.integers(1, 6, 4000).astype(float)

    def block(side, size, seed):
        made = np.random.default_rng(seed)
        return strata.Block({"side": side, "block": 0, "w": 0.5, "n": 0, "id": np.arange(size).tobytes(),
                             "b": made.random(size).tobytes(), "f": made.random((size, k)).tobytes()}, k)

    for with_bias, learn_w in ((True, True), (True, False), (False, False)):
        users, items, u, v = block(0, n, 1), block(1, m, 2), block(0, n, 1), block(1, m, 2)
        strata.serial_steps(users, items, user, item, rating, rate, penalty, with_bias, learn_w)
        w, turn = 0.5, (user + item) % m
        for r in range(m):
            errors = []
            for j in np.flatnonzero(turn == r).tolist():
                a, c = user[j], item[j]
                err = w + u.b[a] + v.b[c] + u.f[a] @ v.f[c] - rating[j]
                errors.append(err)
                if with_bias:
                    u.b[a] -= rate * (err + penalty * u.b[a])
                    v.b[c] -= rate * (err + penalty * v.b[c])
                u.f[a] -= rate * (err * v.f[c] + penalty * u.f[a])
                v.f[c] -= rate * (err * u.f[a] + penalty * v.f[c])
            if learn_w and errors:
                w -= (1 - (1 - rate) ** len(errors)) * float(np.mean(errors))
        for got, want in ((users.b, u.b), (items.b, v.b), (users.f, u.f), (items.f, v.f), (users.w, w)):
            assert np.allclose(got, want, rtol=0, atol=1e-12)


@pytest.mark.parametrize("mounted", [True, False])
def test_a_stratum_reads_its_ratings_a_range_of_rounds_at_a_time(spark, monkeypatch, mounted):
    """A task holds no more of a pair's ratings than a range, and takes the same steps."""
    rng = np.random.default_rng(9)
    pairs = rng.permutation(80 * 120)[:3000].tolist()
    rated = spark.createDataFrame([(n // 120 * 7, n % 120 * 5, float(rng.integers(1, 6))) for n in pairs], "user bigint, item bigint, rating double").cache()

    def fitted():
        model = gradient.fit_sgd(rated, k=2, epochs=2, seed=3, blocks=2)
        return rows_of(model.users, "user"), rows_of(model.items, "item"), model.params["intercept"]

    want = fitted()
    monkeypatch.setattr(strata, "RANGE_RATINGS", 100)
    monkeypatch.setattr(strata, "HELD_RATINGS", 300)
    monkeypatch.setattr(strata, "ID_ROWS", 16)
    if mounted:
        plain = strata.placed_steps

        def few(users, items, a, *rest):
            assert len(a) < 250, len(a)
            plain(users, items, a, *rest)

        monkeypatch.setattr(strata, "placed_steps", few)
    else:
        monkeypatch.setattr(strata, "is_mounted", lambda spark: False)
    assert fitted() == want


def test_packed_rows_are_row_groups_of_their_own(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(layout, "scratch_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(layout, "SHARED_ROWS", 20_000)
    table = spark.range(0, 200_000, 1, 1).select(F.col("id").alias("item"), F.lit(0.0).alias("v"), F.array(*[F.rand(1)] * 60).alias("f"))
    files = layout.shared_files(spark, layout.share_rows("item", table, 60))
    groups = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in files for g in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(groups) > 10 and max(groups) <= 2


def test_rounds_are_taken_together():
    rng = np.random.default_rng(6)
    n, m = 1500, 2000
    pairs = rng.permutation(n * m)[:4000]
    a, c = pairs // m, pairs % m
    order = np.lexsort((a, (a + c) % m))
    a, c = a[order], c[order]
    turn = (a + c) % m
    edges = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1], True])
    ranges = list(strata.independent(a, c, edges))
    assert [first for first, _ in ranges] == [0, *(last for _, last in ranges[:-1])] and ranges[-1][1] == len(edges) - 1
    assert len(ranges) < len(edges) / 5
    for first, last in ranges:
        got = np.arange(edges[first], edges[last])
        assert len(np.unique(a[got])) == len(np.unique(c[got])) == len(got)
