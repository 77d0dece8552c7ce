"""Properties of the models at full rank, against brute force on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.models import als, boosted, foldin, gradient, latent, means, neighbours, registry, spectral, tagged
from affinis.models.base import delete_snapshot, load
from affinis.operators import evaluate, layout, normal, stats
from affinis.sources.fixtures import N_TAGS


def rmse(model, ratings):
    return evaluate.metrics(model.predict(ratings), ["rmse"]).first()["value"]


def dense(ratings):
    pdf = ratings.toPandas()
    m = np.zeros((int(pdf.user.max()) + 1, int(pdf.item.max()) + 1))
    m[pdf.user, pdf.item] = pdf.rating
    return m, pdf


def vectors(df, key):
    pdf = df.toPandas()
    return dict(zip(pdf[key], pdf["f"].map(np.array))), dict(zip(pdf[key], pdf["bias"]))


@pytest.fixture(scope="module")
def mean_rmse(d1):
    return rmse(means.fit_user_mean(d1), d1)


def als_loss(model, ratings, lam):
    pdf = stats.center_by_user(ratings).toPandas()
    u, _ = vectors(model.users, "user")
    v, _ = vectors(model.items, "item")
    loss = sum((r - u[a] @ v[i]) ** 2 + lam * (u[a] @ u[a] + v[i] @ v[i]) for a, i, r in pdf[["user", "item", "rating"]].values)
    return loss


def test_als_loss_falls_and_items_solve_their_equations(d1, mean_rmse):
    losses = []
    model = als.fit_als(d1, k=5, iterations=4, on_sweep=lambda s, m: losses.append(als_loss(m, d1, 0.1)))
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    assert rmse(model, d1) < mean_rmse
    pdf = stats.center_by_user(d1).toPandas()
    u, _ = vectors(model.users, "user")
    v, _ = vectors(model.items, "item")
    for item, part in list(pdf.groupby("item"))[:20]:
        x = np.array([u[a] for a in part.user])
        left = (x.T @ x + 0.1 * len(part) * np.eye(5)) @ v[item]
        assert np.allclose(left, x.T @ part.rating.values, atol=1e-8)


def test_splitting_and_shuffling_change_nothing(d1, monkeypatch):
    """Hot keys in slots, and factor tables too large to broadcast."""
    pairs = d1.select("user", "item")
    for fit in (als.fit_als, als.fit_als_biased):
        plain = fit(d1, k=3, iterations=2).predict(pairs).toPandas().sort_values(["user", "item"]).prediction.values
        monkeypatch.setattr(layout, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(layout.RatingStore.__init__, "__defaults__", (20,))
        other = fit(d1, k=3, iterations=2).predict(pairs).toPandas().sort_values(["user", "item"]).prediction.values
        monkeypatch.undo()
        assert np.allclose(plain, other, atol=1e-9)


@pytest.mark.parametrize("small", [True, False])
def test_no_exchange_of_a_half_sweep_carries_a_rating(d1, monkeypatch, small):
    """Beside the stored layouts, a plan moves routes and factors only, whatever their size."""
    if not small:
        monkeypatch.setattr(layout, "BROADCAST_BYTES", 0)
    store = layout.RatingStore(d1)
    store.dealt("user").count(), store.routes("user", "item").count()
    fixed = layout.materialise(d1.select("item").distinct().select("item", F.lit(0.0).alias("v"), F.array(F.lit(1.0), F.lit(2.0)).alias("f")), "t")
    for out in (normal.half_sweep(store, "user", 2, normal.ridge(2, 0.1), fixed), normal.product(store, "user", fixed, 2)):
        plan = out._jdf.queryExecution().executedPlan()
        moved, todo = [], [plan]
        while todo:
            node = todo.pop()
            if "Exchange" in node.nodeName():
                moved.append({a.name() for a in (node.output().apply(k) for k in range(node.output().size()))})
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
            if node.nodeName() == "AdaptiveSparkPlan":
                todo.append(node.executedPlan())
        assert (moved or small) and not any("rating" in m for m in moved)
    store.release()


@pytest.mark.parametrize("per_slot", [20, 1_000_000])
def test_tables_too_large_for_routes_are_shared(d1, tags, monkeypatch, per_slot):
    """Same predictions, and no exchange at all in a half-sweep: what it moves is one copy of a table."""
    pairs = d1.select("user", "item")
    fits = (lambda: als.fit_als(d1, k=3, iterations=2), lambda: als.fit_als_biased(d1, k=3, iterations=2),
            lambda: als.fit_xals(d1, tags, N_TAGS, k=2, iterations=1), lambda: latent.fit_nmf(d1, k=2, iterations=2))
    score = lambda fit: fit().predict(pairs).toPandas().sort_values(["user", "item"]).prediction.values
    plain = [score(fit) for fit in fits]
    monkeypatch.setattr(layout, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(layout, "ROUTED_BYTES", 0)
    monkeypatch.setattr(layout, "SHARED_ROWS", 7)
    monkeypatch.setattr(layout.RatingStore.__init__, "__defaults__", (per_slot,))
    for fit, want in zip(fits, plain):
        assert np.allclose(score(fit), want, atol=1e-9)
    store = layout.RatingStore(d1)
    fixed = d1.select("item").distinct().select("item", F.lit(0.0).alias("v"), F.array(F.lit(1.0), F.lit(2.0)).alias("f"))
    plan = store.meet("user", fixed, 2, lambda met: None, "key bigint")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "cogroup" not in plan.lower() and "CoGroup" not in plan
    store.release()


def test_a_product_without_columns_is_empty(d1):
    store = layout.RatingStore(d1)
    fixed = d1.select("item").distinct().select("item", F.array().cast("array<double>").alias("f"))
    got = normal.product(store, "user", fixed, 0)
    assert got.where("size(f) = 0").count() == d1.select("user").distinct().count()
    store.release()


def test_gram_runs_agree():
    rng = np.random.default_rng(1)
    x = rng.random((600, 4))
    i, j = normal.packed(4)
    for starts in (np.arange(0, 600, 50), np.arange(0, 600, 2)):
        got = normal._gram_runs(x, starts, i, j)
        want = np.array([(x[a:b].T @ x[a:b])[i, j] for a, b in zip(starts, [*starts[1:], 600])])
        assert np.allclose(got, want)


def test_gram_runs_agree_where_runs_are_long():
    rng = np.random.default_rng(2)
    i, j = normal.packed(2)
    x, starts = rng.random((6000, 2)), np.array([0, 3000, 3500])
    want = np.array([(x[a:b].T @ x[a:b])[i, j] for a, b in zip(starts, [3000, 3500, 6000])])
    assert np.allclose(normal._gram_runs(x, starts, i, j), want)
    assert np.allclose(normal._gram_runs(x[:, :1], starts, *normal.packed(1)), (want[:, :1]))


@pytest.mark.parametrize("spread", [1, 40, 10**12])
@pytest.mark.parametrize("places", [1, 16 << 20])
def test_rows_are_found_by_id(tmp_path, monkeypatch, spread, places):
    """Dense ids, ids with gaps and ids far apart; asked for more than is there, in any order."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(layout, "PLACES", places)
    rng = np.random.default_rng(3)
    ids = (rng.permutation(500)[:300] - 100) * spread
    f = rng.random((300, 2))
    files, pieces = [], []
    for k, at in enumerate(np.array_split(np.arange(300), 4)):
        at = at[np.argsort(ids[at])]
        pieces.append((ids[at].tobytes(), ids[at].astype(float).tobytes(), f[at].tobytes()))
        files.append(str(tmp_path / f"{k}.parquet"))
        pq.write_table(pa.table({n: pa.array([c], pa.binary()) for n, c in zip(("id", "v", "f"), pieces[-1])}), files[-1])
    asked = rng.integers(-150, 450, 2000) * spread + rng.integers(0, 2, 2000)
    there = {int(a): n for n, a in enumerate(ids)}
    for rows in (layout.Rows.wanted(files, 2, asked), layout.Rows(pieces, 2)):
        at, here = rows.find(asked)
        assert here.tolist() == [int(a) in there for a in asked]
        assert (rows.v[at[here]] == asked[here]).all()
        assert (rows.f[at[here]] == f[[there[int(a)] for a in asked[here]]]).all()
    assert not len(layout.Rows.wanted(files, 2, asked[:0]).ids)
    assert not layout.Rows([], 2).find(asked)[1].any()


def test_a_large_store_counts_a_side_once(d1):
    """Who is hot and which ids there are come from one written count; the layouts sort by one number."""
    store = layout.RatingStore(d1, rows_per_slot=100)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for key in ("user", "item"):
        assert "Exchange" not in plan(store.ids(key))
        assert sorted(store.ids(key).collect()) == sorted(d1.select(key).distinct().collect())
        assert f"Sort [{key}#" in plan(store.by(key)) and "slot" not in plan(store.by(key)).split("Sort [")[1].split("]")[0]
    store.release()


def test_parts_that_share_a_partition_stay_apart(spark, d1, monkeypatch):
    """Where a partition holds several parts, every packed row still has one part, sorted by key."""
    monkeypatch.setattr(layout, "part_names", lambda spark, tasks: [5] * (tasks // 2) + [6] * (tasks - tasks // 2))
    monkeypatch.setattr(layout, "PACKED_ROWS", 500)
    store = layout.RatingStore(d1)
    store.tasks = 4
    rows, seen = store.stored("user").collect(), 0
    for r in rows:
        key = np.frombuffer(r["key"], np.int64)
        assert (key[1:] >= key[:-1]).all()
        seen += len(key)
    assert {r["part"] for r in rows} == {5, 6} and len(rows) < 60 and seen == d1.count()
    store.release()


def test_mllib_als_has_the_same_objective(d1):
    ours, theirs = als.fit_als(d1, k=4, iterations=15), als.fit_als_mllib(d1, k=4, iterations=15)
    assert abs(rmse(ours, d1) - rmse(theirs, d1)) < 0.02


def test_mllib_blocks_follow_what_they_send(d1, monkeypatch):
    """Every block gets almost every factor: more ratings of the same shape make no more of them."""
    from pyspark.ml.recommendation import ALS

    used, plain = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, df: used.append((self.getNumUserBlocks(), self.getNumItemBlocks())) or plain(self, df))
    small = als.fit_als_mllib(d1, k=4, iterations=1)
    monkeypatch.setattr(als, "task_count", lambda spark, rows: 36)
    als.fit_als_mllib(d1, k=4, iterations=1)
    monkeypatch.setattr(als, "ROUTED_BYTES", 0)
    large = als.fit_als_mllib(d1, k=4, iterations=1)
    assert used[0] == (layout.task_count(d1.sparkSession, d1.count()),) * 2 and used[1] == (36, 36)
    assert 1 <= used[2][0] == used[2][1] < 36
    assert small.predict(d1).count() == large.predict(d1).where("prediction is not null").count() == d1.count()
    for times in (1, 10, 100):
        assert als.mllib_blocks(d1.sparkSession, 1_000_000 * times, 58_000 * times, 20) == 4


def test_mllib_blocks_hold_a_bounded_share(d1, monkeypatch):
    """At 360 times the tables four blocks would each hold most factors of the other side and 54 million ratings."""
    from pyspark.ml.recommendation import ALS

    shape = lambda times: (600_000 * times, 15_000 * times, 20_000 * times)
    assert als.held_by_block(4, *shape(360), 20) > 3 * als.HELD_BYTES
    for times in (60, 360, 3600):
        blocks = als.fitting_blocks(*shape(times), 20)
        assert als.held_by_block(blocks, *shape(times), 20) <= als.HELD_BYTES < als.held_by_block(blocks - 1, *shape(times), 20)
    assert als.fitting_blocks(*shape(1), 20) == als.fitting_blocks(1_000_000_000 // 100, 10_000, 1, 20) == 1
    used, plain = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, df: used.append(self) or plain(self, df))
    monkeypatch.setattr(als, "ROUTED_BYTES", 0)
    kept = als.fit_als_mllib(d1, k=4, iterations=2)
    monkeypatch.setattr(als, "HELD_BYTES", 15_000)
    als.fit_als_mllib(d1, k=4, iterations=1)
    assert used[0].getIntermediateStorageLevel() == "DISK_ONLY" and used[0].getCheckpointInterval() == 1
    assert used[1].getNumUserBlocks() == used[1].getNumItemBlocks() > used[0].getNumUserBlocks()
    monkeypatch.undo()
    assert kept.predict(d1).where("prediction is not null").count() == d1.count()


def test_biased_and_tagged_als_beat_the_mean(d1, tags, mean_rmse):
    for model in (als.fit_als_biased(d1, k=4, iterations=4), als.fit_als3(d1, k=4, iterations=4),
                  als.fit_xals(d1, tags, N_TAGS, k=3, iterations=3), als.fit_wals(d1, k=4, iterations=4),
                  als.fit_cfm(d1, k=4, iterations=4)):
        assert rmse(model, d1) < mean_rmse, model.name


def test_wals_matches_dense_algebra(d1):
    k, reg = 3, 0.001
    m, pdf = dense(stats.center_by_user(d1))
    model = als.fit_wals(d1, k=k, iterations=3, seed=7, init="grid")
    items = sorted(set(pdf.item))
    v = np.array([[((i % 1000) * 7919 + j * 104729 + 7) % 1000 / 1000 for j in range(k)] for i in items])
    x = m[:, items]
    for _ in range(3):
        u = x @ v @ np.linalg.inv(v.T @ v + reg * np.eye(k))
        v = x.T @ u @ np.linalg.inv(u.T @ u + reg * np.eye(k))
    got, _ = vectors(model.items, "item")
    assert np.allclose(np.array([got[i] for i in items]), v)


def test_svd_equals_numpy(d1):
    n = stats.dims(d1)[0]
    cells, _, _ = stats.double_center(d1, n)
    m, _ = dense(cells)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    model = spectral.fit_svd(d1, k=5, iterations=15, oversample=50)
    assert np.allclose(model.params["sigma"], s[:5], rtol=1e-6)
    v, _ = vectors(model.items, "item")
    basis = np.array(list(v.values()))
    assert np.allclose(basis.T @ basis, np.eye(5), atol=1e-8)
    uf, _ = vectors(model.users, "user")
    full = (u[:, :5] * s[:5]) @ vt[:5]
    a, i = next(iter(uf)), next(iter(v))
    assert abs(uf[a] @ v[i] - full[a, i]) < 1e-4


def test_rank_larger_than_the_matrix(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 5.0), (2, 0, 1.0)], "user bigint, item bigint, rating double")
    for fit in (spectral.fit_svd, spectral.fit_svd1, spectral.fit_svd2):
        assert fit(df, k=20, iterations=3).predict(df).where("prediction is null or isnan(prediction)").count() == 0


def test_pca_equals_numpy(d1):
    n = stats.dims(d1)[0]
    m, pdf = dense(stats.center_by_user(d1))
    mu = m.mean(axis=0)
    u, s, vt = np.linalg.svd(m - mu, full_matrices=False)
    model = spectral.fit_pca(d1, k=3, iterations=20, oversample=50, n_users=n)
    assert np.allclose(model.params["sigma"], s[:3], rtol=1e-6)
    got = model.predict(d1.select("user", "item")).toPandas()
    means_ = d1.groupBy("user").agg(F.avg("rating").alias("m")).toPandas().set_index("user").m
    full = (u[:, :3] * s[:3]) @ vt[:3] + mu
    want = full[got.user, got.item] + means_.loc[got.user].values
    assert np.allclose(got.prediction, want, atol=1e-6)


def test_svdknn_ignores_itself_and_averages_others(d3):
    model = spectral.fit_svdknn(d3, k=3, neighbors=2, iterations=6)
    base, _ = vectors(model.users, "user")
    got, _ = vectors(model.user_rows(d3), "user")
    ids = sorted(base)
    for u in ids[:5]:
        d = sorted((round(float(np.linalg.norm(base[u] - base[o])), 9), o) for o in ids if o != u)[:2]
        w = np.array([1 / x for x, _ in d])
        want = sum(wi * base[o] for wi, (_, o) in zip(w, d)) / w.sum()
        assert np.allclose(got[u], want)


def test_nmf_loss_falls_and_stays_positive(d1):
    m, _ = dense(d1)
    losses = []
    for rounds in (1, 3, 6):
        model = latent.fit_nmf(d1, k=4, iterations=rounds)
        w, _ = vectors(model.users, "user")
        h, _ = vectors(model.items, "item")
        full = np.zeros_like(m)
        for a, f in w.items():
            for i, g in h.items():
                full[a, i] = f @ g
        assert min(f.min() for f in [*w.values(), *h.values()]) >= 0
        losses.append(((m - full) ** 2).sum())
    assert losses[0] > losses[1] > losses[2]


def test_nmf_rejects_negative_ratings(d3):
    with pytest.raises(ValueError):
        latent.fit_nmf(d3, k=2, iterations=1)


def test_factor_analysis_likelihood_rises(d3):
    m, pdf = dense(d3)
    n = m.shape[0]
    mu, s = m.mean(axis=0), np.cov(m.T, bias=True)

    def likelihood(model):
        t = model.items.toPandas().sort_values("item")
        w, psi = np.array(t.f.tolist()), np.maximum(t.psi.values, 1e-12)
        c = w @ w.T + np.diag(psi)
        keep = t.item.values
        return -n / 2 * (np.linalg.slogdet(c)[1] + np.trace(np.linalg.solve(c, s[np.ix_(keep, keep)])))

    got = [likelihood(latent.fit_efa(d3, k=2, iterations=r, n_users=n)) for r in (1, 3, 8)]
    assert got[0] < got[1] < got[2]
    cut = latent.fit_efa(d3, k=1, iterations=1, truncated=20, whole_numbers=True)
    assert cut.items.agg(F.max("item")).first()[0] < 20


def test_lasso_satisfies_its_optimality_conditions(d1, tags):
    alpha = 0.01
    model = tagged.fit_lasso(d1, tags, N_TAGS, alpha=alpha)
    w, b = vectors(model.users, "user")
    t, _ = vectors(model.items, "item")
    for user, part in list(d1.toPandas().groupby("user"))[:25]:
        x = np.array([t[i] for i in part.item])
        xc = x - x.mean(axis=0)
        res = part.rating.values - b[user] - x @ w[user]
        assert abs(res.mean()) < 1e-8
        grad = xc.T @ res / len(part)
        on = w[user] != 0
        assert np.allclose(grad[on], alpha * np.sign(w[user][on]), atol=1e-6)
        assert (np.abs(grad[~on]) <= alpha + 1e-6).all()
    sparse = tagged.user_sparsity(model).toPandas().set_index("user").nonzero
    assert all(sparse[u] == np.count_nonzero(w[u]) for u in w)


def test_lasso_unknown_users(spark, d1, tags):
    pairs = spark.createDataFrame([(999_999, 0), (0, 0)], "user bigint, item bigint")
    clipped = tagged.fit_lasso(d1, tags, N_TAGS).predict(pairs).toPandas().set_index("user").prediction
    assert clipped[999_999] == 0.0 and -2 <= clipped[0] <= 2
    assert tagged.fit_lasso(d1, tags, N_TAGS, clipped=False).predict(pairs).count() == 1
    assert tagged.fit_lasso(d1, tags, N_TAGS, with_bias=False).users.where("bias != 0").count() == 0


def test_machine_with_tags_learns(d1, tags, mean_rmse):
    seen = [rmse(tagged.fit_fma(d1, tags, N_TAGS, k=3, iterations=i), d1) for i in (1, 4)]
    assert seen[1] < seen[0] and seen[1] < mean_rmse


def test_machine_with_tags_scores_by_its_formula(d1, tags):
    """The stored bilinear form equals the second-order formula on one-hot + tags."""
    k = 2
    model = tagged.fit_fma(d1, tags, N_TAGS, k=k, iterations=2)
    theta, tb = vectors(model.tables["tag_factors"], "tag")
    u, ub = vectors(model.users, "user")
    seen, sb = vectors(model.items, "item")
    x = tags.withColumn("x", F.bround("weight")).where("x != 0").toPandas()
    item = int(x.item.iloc[0])
    mine = x[x.item == item]
    t = sum(r.x * theta[r.tag] for r in mine.itertuples())
    v = seen[item] - t
    own = sum(r.x * tb[r.tag] for r in mine.itertuples())
    pair = 0.5 * (t @ t - sum(r.x**2 * theta[r.tag] @ theta[r.tag] for r in mine.itertuples()))
    w_i = sb[item] - own - pair - v @ t
    user = next(iter(u))
    total = u[user] + v + t
    squares = u[user] @ u[user] + v @ v + sum(r.x**2 * theta[r.tag] @ theta[r.tag] for r in mine.itertuples())
    want = model.params["intercept"] + ub[user] + w_i + own + 0.5 * (total @ total - squares)
    got = model.predict(d1.where((F.col("item") == item)).limit(1).select(F.lit(user).cast("bigint").alias("user"), "item")).first()
    assert abs(got["prediction"] - want) < 1e-9


def test_boosting_reduces_the_error(d1):
    model = boosted.fit_gbr(d1, k=4, trees=3, iterations=3)
    score = model.params["train_score"]
    assert score[0] > score[1] > score[2]
    assert abs(sum(model.importances()) - 1) < 1e-9
    assert abs(rmse(model, d1) ** 2 - score[-1]) < 1e-9
    with pytest.raises(NotImplementedError):
        model.save("/nowhere")


def test_default_gradient_models_beat_the_user_mean(d1, mean_rmse):
    assert rmse(gradient.fit_sgd(d1), d1) < mean_rmse
    assert rmse(gradient.fit_ssvd(d1), d1) < mean_rmse


def test_strata_take_one_serial_step_per_rating(d1):
    """An epoch equals a plain loop over the ratings in the order of strata and rounds."""
    blocks, k, rate, lam = 3, 2, 0.02, 0.1
    start = gradient.fit_sgd(d1, k=k, epochs=0, blocks=blocks)
    u, ub = vectors(start.users, "user")
    v, vb = vectors(start.items, "item")
    block = lambda x: x % 104729 * 7919 % 104729 % blocks
    place = {}
    for key, ids in (("u", u), ("v", v)):
        for b in range(blocks):
            inside = sorted(x for x in ids if block(x) == b)
            place.update({(key, x): (at, len(inside)) for at, x in enumerate(inside)})
    turns = {}
    for a, i, rating in d1.toPandas()[["user", "item", "rating"]].itertuples(index=False):
        (p, n), (q, m) = place["u", a], place["v", i]
        turns.setdefault(((block(i) - block(a)) % blocks, block(a), (p + q) % max(n, m)), []).append((p, a, i, rating))
    w = dict.fromkeys(range(blocks), 0.5)
    n = dict.fromkeys(range(blocks), 0)
    for (_, b, _), rows in sorted(turns.items()):
        errors = []
        assert len({a for _, a, *_ in rows}) == len({i for *_, i, _ in rows}) == len(rows)
        for _, a, i, rating in sorted(rows):
            err = w[b] + ub[a] + vb[i] + u[a] @ v[i] - rating
            ub[a] -= rate * (err + lam * ub[a])
            vb[i] -= rate * (err + lam * vb[i])
            u[a] = u[a] - rate * (err * v[i] + lam * u[a])
            v[i] = v[i] - rate * (err * u[a] + lam * v[i])
            errors.append(err)
        w[b] -= (1 - (1 - rate) ** len(rows)) * np.mean(errors)
        n[b] += len(rows)
    got = gradient.fit_sgd(d1, k=k, epochs=1, rate=rate, blocks=blocks)
    f, b = vectors(got.users, "user")
    g, c = vectors(got.items, "item")
    assert all(np.allclose(f[x], u[x], atol=1e-12) and np.isclose(b[x], ub[x]) for x in u)
    assert all(np.allclose(g[x], v[x], atol=1e-12) and np.isclose(c[x], vb[x]) for x in v)
    assert np.isclose(got.params["intercept"], sum(n[x] * w[x] for x in w) / sum(n.values()))


def test_strata_move_blocks_and_never_ratings(d1):
    from affinis.operators.strata import Strata

    strata = Strata(d1, 3)
    strata.cells.count()
    state = layout.materialise(strata.packed(
        *[d1.select(c).distinct().select(c, F.lit(0.0).alias("bias"), F.array(F.lit(1.0)).alias("f")) for c in ("user", "item")], 1), "state")
    out = strata.stratum(state.selectExpr("side", "block", "id", "b", "f", "0.5D as w", "0L as n"), 1, 1, 0.01, 0.1, True, True)
    plan = out._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0] + out._jdf.queryExecution().executedPlan().toString()
    outer = [line for line in plan.split("\n") if "Exchange" in line and "ENSURE_REQUIREMENTS" in line]
    assert outer and state.count() == 6
    assert out.where("side = 0").agg(F.sum("n")).first()[0] == d1.selectExpr(
        "sum(if((item % 104729 * 7919 % 104729 % 3 - user % 104729 * 7919 % 104729 % 3 + 3) % 3 = 1, 1, 0))").first()[0]
    strata.release()


def test_gradient_models_learn(d1):
    curve = []
    gradient.fit_sgd(d1, k=4, epochs=4, on_sweep=lambda e, m: curve.append(rmse(m, d1)))
    assert curve[-1] < curve[0]
    literal = gradient.fit_sgd2(d1, k=2, epochs=1, compat=True, batches=3)
    assert np.isfinite(rmse(literal, d1))
    clipped = gradient.fit_ssvd(d1, k=3, epochs=2).predict(d1)
    assert clipped.where("prediction < 1 or prediction > 5").count() == 0


def brute_cosine(ratings):
    m, _ = dense(ratings)
    norm = np.linalg.norm(m, axis=1)
    norm[norm == 0] = 1
    return np.round(m @ m.T / np.outer(norm, norm), 9), m


@pytest.mark.parametrize("block", [16, 64, 1024])
def test_neighbours_equal_brute_force(d1, block):
    from affinis.operators.similarity import top_neighbours

    sim, _ = brute_cosine(d1)
    got = top_neighbours(d1, 7, block=block).toPandas().sort_values(["user", "rank"])
    users = sorted(set(d1.toPandas().user))
    for u in users[::10]:
        want = sorted(((-sim[u, o], o) for o in users if o != u))[:7]
        part = got[got.user == u]
        assert list(part.neighbor) == [o for _, o in want]
        assert np.allclose(part.sim, [-s for s, _ in want], atol=2e-9)
    some = d1.where("user < 9").select("user").distinct()
    part = top_neighbours(d1, 7, queries=some, block=block).toPandas().sort_values(["user", "rank"])
    assert part.neighbor.tolist() == got[got.user < 9].neighbor.tolist()


@pytest.mark.parametrize("block", [8, 1024])
def test_nearest_raters_equal_brute_force(d3, block):
    from affinis.operators.similarity import nearest_raters

    sim, m = brute_cosine(d3)
    pairs = d3.select("user", "item")
    got = nearest_raters(pairs, d3, 3, block=block).toPandas()
    raters = d3.toPandas().groupby("item").user.apply(list)
    for (u, i), part in list(got.groupby(["user", "item"]))[::40]:
        want = [o for _, o in sorted((-sim[u, o], o) for o in raters[i])[:3]]
        assert part.sort_values("rank").rater.tolist() == want


def test_hot_item_and_hot_user(spark):
    """One item rated by everyone and one user rating everything."""
    rows = [(u, 0, float(1 + u % 5)) for u in range(300)] + [(0, i, float(1 + i % 3)) for i in range(1, 900)]
    rows += [(u, u, 2.0) for u in range(1, 300)]
    df = spark.createDataFrame(rows, "user bigint, item bigint, rating double")
    from affinis.operators.similarity import top_neighbours

    sim, _ = brute_cosine(df)
    got = top_neighbours(df, 4, block=64).toPandas().sort_values(["user", "rank"])
    assert len(got) == 1200
    for u in (0, 1, 150, 299):
        want = sorted(((-sim[u, o], o) for o in range(300) if o != u))[:4]
        assert got[got.user == u].neighbor.tolist() == [o for _, o in want]
    assert rmse(als.fit_als(df, k=2, iterations=2), df) < 2


def test_knn_cold_pairs(spark, d3):
    model = neighbours.fit_knn(d3, k=5)
    pairs = spark.createDataFrame([(0, 999_999), (0, 1)], "user bigint, item bigint")
    got = model.predict(pairs).toPandas().set_index("item").prediction
    assert got[999_999] == 0.0 and len(got) == 2
    assert neighbours.fit_knn2(d3).predict(pairs).where("item = 999999").first()["prediction"] is None


def test_cold_users_and_items_fall_back(spark, d1):
    pairs = spark.createDataFrame([(10**9, 0), (0, 10**9), (10**9, 10**9)], "user bigint, item bigint")
    model = als.fit_als(d1, k=3, iterations=1)
    got = model.predict(pairs).toPandas()
    mean0 = d1.where("user = 0").agg(F.avg("rating")).first()[0]
    assert len(got) == 3
    assert got.prediction.tolist().count(0.0) == 2 and any(abs(p - mean0) < 1e-12 for p in got.prediction)
    assert abs(als.fit_als3(d1, k=2, iterations=1).predict(pairs).toPandas().prediction.iloc[-1]) > 0


def test_degenerate_training_sets(spark):
    one = spark.createDataFrame([(0, 0, 3.0)], "user bigint, item bigint, rating double")
    same = spark.createDataFrame([(u, i, 2.0) for u in range(3) for i in range(3)], "user bigint, item bigint, rating double")
    for df in (one, same):
        for fit in (als.fit_als, als.fit_als_biased, spectral.fit_svd2, gradient.fit_sgd):
            kw = {"epochs": 1} if fit is gradient.fit_sgd else {"iterations": 1}
            out = fit(df, k=2, **kw).predict(df)
            assert out.where("prediction is null or isnan(prediction)").count() == 0
    with pytest.raises(ValueError):
        als.fit_als(one.where("user = 5"), k=2, iterations=1)


def test_every_model_survives_save_and_load(spark, d1, d3, tags, tmp_path):
    pairs = d1.select("user", "item")
    fitted = [
        als.fit_als(d1, k=2, iterations=1), als.fit_xals(d1, tags, N_TAGS, k=2, iterations=1),
        spectral.fit_svdknn(d1, k=2, iterations=1), tagged.fit_lasso(d1, tags, N_TAGS),
        tagged.fit_balse(d1, tags, N_TAGS, k=2, iterations=1, gamma=25), neighbours.fit_knn(d3, k=4), means.fit_zero()]
    for model in fitted:
        path = str(tmp_path / model.name)
        model.save(path)
        back = load(spark, path)
        assert type(back) is type(model)
        a = model.predict(pairs).agg(F.sum("prediction")).first()[0]
        b = back.predict(pairs).agg(F.sum("prediction")).first()[0]
        assert abs(a - b) < 1e-6
        delete_snapshot(spark, path)
        with pytest.raises(FileNotFoundError):
            load(spark, path)


def test_saving_a_loaded_model_to_its_own_path(spark, d1, tags, tmp_path):
    path = str(tmp_path / "model")
    model = tagged.fit_balse(d1, tags, N_TAGS, k=2, iterations=1, gamma=25)
    pairs = d1.select("user", "item")
    want = model.predict(pairs).agg(F.sum("prediction")).first()[0]
    model.save(path)
    for _ in range(2):
        back = load(spark, path)
        back.save(path)
        assert abs(back.predict(pairs).agg(F.sum("prediction")).first()[0] - want) < 1e-6
    assert abs(load(spark, path).predict(pairs).agg(F.sum("prediction")).first()[0] - want) < 1e-6
    assert len([x for x in (tmp_path / "model").iterdir() if x.is_dir()]) == 1


def test_curves_of_the_tag_models(d1, tags):
    seen = []
    als.fit_xals(d1, tags, N_TAGS, k=2, iterations=2, on_sweep=lambda e, m: seen.append((e, rmse(m, d1))))
    tagged.fit_fma(d1, tags, N_TAGS, k=2, iterations=2, on_sweep=lambda e, m: seen.append((e, rmse(m, d1))))
    assert [e for e, _ in seen] == [0, 1, 0, 1] and all(np.isfinite(r) for _, r in seen)


def test_fold_in_reproduces_a_trained_user(d1):
    """Solving a known user again against the final items of another sweep."""
    model = als.fit_als(d1, k=3, iterations=3)
    rows = foldin.fold_in_als(model, d1)
    again = als.fit_als(d1, k=3, iterations=4)
    # Users of the next sweep are exactly the fold-in against these items.
    store = layout.RatingStore(stats.center_by_user(d1))
    want = normal.half_sweep(store, "user", 3, normal.ridge(3, 0.1), model.items.select("item", F.lit(0.0).alias("v"), "f"))
    a, _ = vectors(rows, "user")
    b = {r["user"]: np.array(r["f"]) for r in want.collect()}
    assert all(np.allclose(a[u], b[u]) for u in b)
    assert rmse(again, d1) <= rmse(model, d1) + 0.05


def test_registry(d1, tmp_path, spark):
    with pytest.raises(KeyError, match="nothing"):
        registry.fit_named("nothing", d1)
    assert {"als", "svdknn", "lasso0", "fma"} <= set(registry.available())
    path = tmp_path / "experiments.json"
    path.write_text('{"configurations": [["svd"], ["svdknn", 30, 5, true]]}')
    got = registry.load_experiments(spark, str(path))
    assert got == [("svd", "svd", {}), ("svdknn-30-5-true", "svdknn", {"k": 30, "neighbors": 5, "weighted": True})]


def test_third_of_all_rows_on_one_key(spark):
    """A user and an item that each hold about a third of the ratings."""
    rows = [(0, i, float(1 + (i * 7) % 5)) for i in range(600)] + [(u, 0, float(1 + u % 5)) for u in range(1, 600)]
    rows += [(u, 1 + (u * 13) % 599, float(1 + (u * 3) % 5)) for u in range(1, 600)]
    df = layout.materialise(spark.createDataFrame(rows, "user bigint, item bigint, rating double"), "skew")
    plain = als.fit_als_biased(df, k=2, iterations=2).predict(df).toPandas().sort_values(["user", "item"]).prediction
    saved = layout.RatingStore.__init__.__defaults__
    try:
        layout.RatingStore.__init__.__defaults__ = (50,)
        split = als.fit_als_biased(df, k=2, iterations=2).predict(df).toPandas().sort_values(["user", "item"]).prediction
    finally:
        layout.RatingStore.__init__.__defaults__ = saved
    assert np.allclose(plain.values, split.values, atol=1e-9)


def test_wide_predictions_move_no_vectors(spark, monkeypatch):
    """Long vectors of many items: the same predictions, bit by bit, as by joins, and an exchange carries ids only."""
    from affinis.models.base import FactorModel
    from affinis.operators import scoring

    k = 9
    vec = lambda key, off: F.array(*[F.sin(F.col(key) * (j + off)) for j in range(k)])
    users = spark.range(60).select(F.col("id").alias("user"), (F.col("id") / 7).alias("bias"), vec("id", 1).alias("f"))
    items = spark.range(0, 90, 2).select(
        F.col("id").alias("item"), F.when(F.col("id") != 4, F.cos("id")).alias("bias"), F.when(F.col("id") != 6, vec("id", 3)).alias("f"))
    pairs = spark.range(4000).select(
        F.when(F.col("id") % 97 != 0, F.col("id") * 7 % 70).alias("user"), F.when(F.col("id") % 89 != 0, F.col("id") * 5 % 95).alias("item"),
        (F.col("id") % 3).cast("string").alias("more"))
    tables = {"user_factors": users, "item_factors": items}
    for model in (FactorModel("any", tables, {"k": k, "intercept": 0.3}),
                  tagged.LassoModel("lasso", tables, {"k": k, "intercept": 0.0, "strict": False, "low": -2.0, "high": 2.0}),
                  tagged.LassoModel("lasso", tables, {"k": k, "intercept": 0.0, "strict": True})):
        monkeypatch.setattr(scoring, "BROADCAST_BYTES", 1 << 30)
        joined = model.predict(pairs)
        monkeypatch.setattr(scoring, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(scoring, "CHUNK_ROWS", 700)
        shared = model.predict(pairs)
        plan = shared._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "MapInArrow" in plan
        assert shared.columns == joined.columns
        assert sorted(map(repr, shared.collect())) == sorted(map(repr, joined.collect()))


def test_a_part_holds_few_wide_vectors(spark):
    from affinis.operators.layout import PART_BYTES, task_count

    assert 8 * 34 * 200_000_000 / task_count(spark, 200_000_000, 32) <= PART_BYTES
    assert task_count(spark, 1000, 32) == task_count(spark, 1000)
