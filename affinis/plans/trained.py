"""Gradient-trained and tag-based models, and machines on pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.models import als, boosted, gradient, tagged
from affinis.plans.least_squares import SEED, als_chain, grid
from affinis.plans.registry import query, r, rs
from affinis.plans.spectral import NEW_BUYERS
from affinis.sources import fixtures as fx


def implicit_sql(sums: str, mine: str, key: str, rate, lam, bias: bool = True) -> str:
    """One implicit step at rank 1: a division, or with a bias a system of two equations.

    ``sums`` has n, sx, sxx, sy, sxy per key; ``mine`` the key's b and f before the step.
    """
    a, d, c = f"(1 + {rate} * (sxx + {lam} * n))", f"(1 + {rate} * (n + {lam} * n))", f"({rate} * sx)"
    p, q = f"(f + {rate} * sxy)", f"(b + {rate} * sy)"
    if not bias:
        nb, nf = "0.0::DOUBLE", f"{p} / {a}"
    else:
        nb, nf = f"({a} * {q} - {c} * {p}) / ({a} * {d} - {c} * {c})", f"({d} * {p} - {c} * {q}) / ({a} * {d} - {c} * {c})"
    return f"SELECT {key}, {nb} AS b, {nf} AS f FROM {mine} JOIN ({sums}) USING ({key})"


def _sums(key: str, other: str, theirs: str, w: str, rows: str = "d") -> str:
    return f"""SELECT {key}, count(*) AS n, sum(o.f) AS sx, sum(o.f * o.f) AS sxx, sum(rating - w - o.b) AS sy, sum((rating - w - o.b) * o.f) AS sxy
          FROM {rows} JOIN {other} o USING ({theirs}), {w} GROUP BY {key}"""


def sgd_chain(epochs: int, rate=0.01, lam=0.1, start_w="0.5", bias=True, learn_w=True, compat=False,
              scale="1", zero_bias=False) -> str:
    user = '"user"'
    b0 = lambda c: grid(c, 1) if bias and not zero_bias else "0.0::DOUBLE"
    ctes = [f"d AS MATERIALIZED ({fx.D1})", "nn AS (SELECT count(*) AS total FROM d)",
            f"g0 AS (SELECT {start_w} AS w{' FROM d' if 'avg' in start_w else ''})",
            f"u0 AS (SELECT DISTINCT {user}, {b0(user)} AS b, {scale} * {grid(user)} AS f FROM d)",
            f"v0 AS (SELECT DISTINCT item, {b0('item')} AS b, {scale} * {grid('item')} AS f FROM d)"]
    if not compat:
        return "WITH RECURSIVE " + ",\n".join(ctes + _strata_chain(epochs, rate, lam, bias, learn_w))
    for t in range(1, epochs + 1):
        for key, mine, fixed in ((user, "u", "v.f"), ("item", "v", "u.f")):
            ctes.append(f"""{mine}{t} AS MATERIALIZED (SELECT {key}, b - {rate} * (e / total + {lam} * b) AS b, f - {rate} * (1.0::DOUBLE / total + {lam}) * g AS f
              FROM {mine}{t - 1} JOIN (SELECT d.{key}, sum(w + u.b + v.b + u.f * v.f - rating) AS e, sum((w + u.b + v.b + u.f * v.f - rating) * {fixed}) AS g
                FROM d JOIN u{t - 1} u USING ({user}) JOIN v{t - 1} v USING (item), g{t - 1} GROUP BY d.{key}) USING ({key}), nn)""")
        ctes.append(f"g{t} AS (SELECT w FROM g{t - 1})")
    return "WITH " + ",\n".join(ctes)


# Blocks of users and of items in the queries that take serial steps.
BLOCKS = 4


def _strata_chain(epochs: int, rate, lam, bias: bool, learn_w: bool) -> list[str]:
    """Strata and rounds replayed at rank 1: a recursion over rounds whose state, keyed by
    (side, id), has users, items, a constant per user block, and the round."""
    ranked = lambda name, key: f"""{name} AS MATERIALIZED (SELECT {key}, blk, row_number() OVER (PARTITION BY blk ORDER BY {key}) - 1 AS k,
        count(*) OVER (PARTITION BY blk) AS n FROM (SELECT DISTINCT {key}, ({key} % 104729) * 7919 % 104729 % {BLOCKS} AS blk FROM d))"""  # noqa: E731
    step = lambda value, grad: f"{value} - {rate} * ({grad} + {lam} * {value})"
    moved_bias = lambda b: step(b, "err") if bias else b
    moved_user = step("uf", "err * vf")
    average = "(SELECT sum(n * b) / sum(n) FROM recurring.st JOIN nb ON id = ub WHERE side = 2)"
    constant = f"CASE WHEN r = 1 AND t > 1 THEN {average} ELSE c.b END" if learn_w else "c.b"
    moved_w = f"w - coalesce((1 - pow(1 - {rate}, m)) * e, 0)" if learn_w else "w"
    return [
        ranked("us", '"user"'), ranked("vs", "item"),
        f"""rounds AS MATERIALIZED (SELECT d."user", item, rating, us.blk AS ub,
            dense_rank() OVER (ORDER BY (vs.blk - us.blk + {BLOCKS}) % {BLOCKS}, (us.k + vs.k) % greatest(us.n, vs.n)) AS r
            FROM d JOIN us USING ("user") JOIN vs USING (item))""",
        "nb AS MATERIALIZED (SELECT ub, count(*) AS n FROM rounds GROUP BY ub)",
        "last AS MATERIALIZED (SELECT max(r) AS rounds FROM rounds)",
        f"""st(side, id, b, f, t) USING KEY (side, id) AS (
          (SELECT 0 AS side, "user" AS id, b, f, 0::BIGINT AS t FROM u0 UNION ALL SELECT 1, item, b, f, 0 FROM v0
            UNION ALL SELECT 2, ub, w::DOUBLE, 0.0::DOUBLE, 0 FROM nb, g0 UNION ALL SELECT 3, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0)
          UNION
          (WITH now AS (SELECT t + 1 AS t, t % rounds + 1 AS r FROM st, last WHERE side = 3 AND t < {epochs} * rounds),
            held AS (SELECT c.id AS ub, {constant} AS w, t, r FROM now, (SELECT id, b FROM recurring.st WHERE side = 2) c),
            x AS (SELECT a."user", a.item, a.ub, held.t AS t, u.b AS ub_, v.b AS vb, u.f AS uf, v.f AS vf, w + u.b + v.b + u.f * v.f - rating AS err
              FROM held JOIN rounds a USING (ub, r) JOIN recurring.st u ON u.side = 0 AND u.id = a."user" JOIN recurring.st v ON v.side = 1 AND v.id = a.item)
          SELECT 0, "user", {moved_bias("ub_")}, {moved_user}, t FROM x
          UNION ALL SELECT 1, item, {moved_bias("vb")}, {step("vf", f"err * ({moved_user})")}, t FROM x
          UNION ALL SELECT 2, ub, {moved_w}, 0.0, t FROM held LEFT JOIN (SELECT ub, count(*) AS m, avg(err) AS e FROM x GROUP BY ub) USING (ub)
          UNION ALL SELECT 3, 0, 0.0, 0.0, t FROM now))""",
        f"""u{epochs} AS MATERIALIZED (SELECT id AS "user", b, f FROM st WHERE side = 0)""",
        f"v{epochs} AS MATERIALIZED (SELECT id AS item, b, f FROM st WHERE side = 1)",
        f"g{epochs} AS MATERIALIZED (SELECT sum(n * b) / sum(n) AS w FROM st JOIN nb ON id = ub WHERE side = 2)"]


def _final(epochs: int, score="w + u.b + v.b + u.f * v.f") -> str:
    return f"""SELECT d."user", d.item, {rs(score)} AS prediction FROM d JOIN u{epochs} u USING ("user") JOIN v{epochs} v USING (item), g{epochs}"""


def _predict(model, ratings):
    return model.predict(ratings.select("user", "item")).withColumn("prediction", r("prediction"))


@query(f"{sgd_chain(2)} {_final(2)}")
def sgd_epoch(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return _predict(gradient.fit_sgd(d1, k=1, epochs=2, seed=SEED, init="grid", blocks=BLOCKS), d1)


@query(f"{sgd_chain(2, start_w='0.0::DOUBLE', bias=False, learn_w=False)} {_final(2)}")
def sgd0_epoch(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return _predict(gradient.fit_sgd0(d1, k=1, epochs=2, seed=SEED, init="grid", blocks=BLOCKS), d1)


@query(f"{sgd_chain(2, start_w='0.0::DOUBLE', learn_w=False)} {_final(2)}")
def sgd2_epoch(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return _predict(gradient.fit_sgd2(d1, k=1, epochs=2, seed=SEED, init="grid", blocks=BLOCKS), d1)


@query(f"{sgd_chain(2, start_w='0.0::DOUBLE', learn_w=False, compat=True)} {_final(2)}")
def sgd2_compat(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return _predict(gradient.fit_sgd2(d1, k=1, epochs=2, seed=SEED, init="grid", compat=True, batches=1), d1)


@query(f"""{sgd_chain(2, rate=0.005, lam=0.02, start_w='avg(rating)', learn_w=False, zero_bias=True, scale='0.1::DOUBLE')}
   {_final(2, 'greatest((SELECT min(rating) FROM d), least((SELECT max(rating) FROM d), w + u.b + v.b + u.f * v.f))')}""")
def ssvd_epoch(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return _predict(gradient.fit_ssvd(d1, k=1, epochs=2, seed=SEED, init="grid", blocks=BLOCKS), d1)


def _fold_chain(epochs: int) -> str:
    ctes = [f"nw AS MATERIALIZED ({NEW_BUYERS})",
            'p0 AS MATERIALIZED (SELECT "user", avg(rating) AS b, 0.5::DOUBLE AS f FROM nw GROUP BY "user")']
    for t in range(1, epochs + 1):
        sums = _sums('"user"', "v2", "item", "g2", "nw")
        ctes.append(f"""p{t} AS MATERIALIZED ({implicit_sql(sums, f'p{t - 1}', '"user"', 0.01, 0.1)})""")
    return ",\n".join(ctes)


@query(f"""{sgd_chain(2)}, {_fold_chain(2)} SELECT nw."user", nw.item, {rs('w + p.b + v.b + p.f * v.f')} AS prediction
   FROM nw JOIN p2 p USING ("user") JOIN v2 v USING (item), g2""")
def sgd_foldin(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    model = gradient.fit_sgd(d1, k=1, epochs=2, seed=SEED, init="grid", blocks=BLOCKS)
    new = d1.select((F.col("user") + 1_000_000_000).alias("user"), "item", (6 - F.col("rating")).alias("rating"))
    rows = gradient.fold_in_sgd(model, new, epochs=2, start=[0.5])
    return model.predict(new.select("user", "item"), rows).withColumn("prediction", r("prediction"))


@query(f"""{sgd_chain(2, start_w='0.0::DOUBLE', learn_w=False)}, {_fold_chain(2)}
   SELECT nw."user", nw.item, {rs('w + p.b + v.b + p.f * v.f')} AS prediction
   FROM nw JOIN p2 p USING ("user") JOIN v2 v USING (item), g2""")
def sgd2_foldin(spark, sf):
    """The same fold-in for the pair machine, whose intercept is 0."""
    d1 = fx.stored(fx.part_ratings(spark, sf))
    model = gradient.fit_sgd2(d1, k=1, epochs=2, seed=SEED, init="grid", blocks=BLOCKS)
    new = d1.select((F.col("user") + 1_000_000_000).alias("user"), "item", (6 - F.col("rating")).alias("rating"))
    rows = gradient.fold_in_sgd(model, new, epochs=2, start=[0.5])
    return model.predict(new.select("user", "item"), rows).withColumn("prediction", r("prediction"))


def lasso_chain(rounds: int, alpha: float = 0.01) -> str:
    """Proximal steps in long form: one row per user and tag."""
    ctes = [f"d AS MATERIALIZED ({fx.D1})", f"t AS MATERIALIZED ({fx.D4})",
            """x AS MATERIALIZED (SELECT d."user", item, tag, sum(weight) AS x, any_value(rating) AS y FROM d JOIN t USING (item) GROUP BY 1, 2, 3)""",
            'n AS MATERIALIZED (SELECT "user", count(*) AS n, avg(rating) AS my FROM d GROUP BY "user")',
            """xs AS MATERIALIZED (SELECT "user", tag, sum(x) AS sx, sum(x * x) AS sxx FROM x GROUP BY 1, 2)""",
            """size AS MATERIALIZED (SELECT "user", greatest(sum(sxx - sx * sx / n) / any_value(n), 1e-12) AS l FROM xs JOIN n USING ("user") GROUP BY "user")""",
            """c0 AS MATERIALIZED (SELECT "user", tag, 0.0::DOUBLE AS c FROM xs)"""]
    for t in range(1, rounds + 1):
        ctes.append(f"""q{t} AS MATERIALIZED (SELECT x."user", item, sum(x * c) AS q, any_value(y) AS y FROM x JOIN c{t - 1} USING ("user", tag) GROUP BY 1, 2)""")
        ctes.append(f"""r{t} AS MATERIALIZED (SELECT "user", item, q - y - avg(q - y) OVER (PARTITION BY "user") AS res FROM q{t})""")
        ctes.append(f"""c{t} AS MATERIALIZED (SELECT "user", tag, sign(z) * greatest(abs(z) - {alpha} / l, 0) AS c FROM (
          SELECT "user", tag, l, c - g / n / l AS z FROM (SELECT x."user", tag, sum(x * res) AS g FROM x JOIN r{t} USING ("user", item) GROUP BY 1, 2)
          JOIN c{t - 1} USING ("user", tag) JOIN n USING ("user") JOIN size USING ("user")))""")
    ctes.append(f"""b AS MATERIALIZED (SELECT "user", any_value(my) - sum(sx * c) / any_value(n) AS b FROM xs JOIN c{rounds} USING ("user", tag) JOIN n USING ("user") GROUP BY "user")""")
    ctes.append(f"""p AS MATERIALIZED (SELECT x."user", item, greatest(-2.0::DOUBLE, least(2.0::DOUBLE, any_value(b) + sum(x * c))) AS lasso,
       any_value(b) + sum(x * c) AS raw FROM x JOIN c{rounds} USING ("user", tag) JOIN b USING ("user") GROUP BY 1, 2)""")
    return ",\n".join(ctes)


@query(f"""WITH {lasso_chain(3)} SELECT "user", item, {rs('lasso')} AS prediction FROM p""")
def lasso_ista(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return _predict(tagged.fit_lasso(d1, fx.item_tags(spark, sf), fx.N_TAGS, method="ista", rounds=3), d1)


@query(f"""WITH {lasso_chain(3)} SELECT "user", item, {rs('raw')} AS prediction FROM p""")
def lasso0_ista(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    model = tagged.fit_lasso(d1, fx.item_tags(spark, sf), fx.N_TAGS, method="ista", rounds=3, clipped=False)
    return _predict(model, d1)


@query(f"""WITH {lasso_chain(3)} SELECT "user", item, {rs('lasso')} AS prediction FROM p
   UNION ALL SELECT "user" + 1000000000, item, 0.0::DOUBLE FROM p""")
def lasso_unknown_users(spark, sf):
    """Pairs of users without a regression score 0 beside those of known users."""
    d1 = fx.stored(fx.part_ratings(spark, sf))
    model = tagged.fit_lasso(d1, fx.item_tags(spark, sf), fx.N_TAGS, method="ista", rounds=3)
    return _predict(model, d1.unionByName(d1.withColumn("user", F.col("user") + 1_000_000_000)))


@query(f"""WITH {lasso_chain(3)} SELECT "user", CAST(count(*) FILTER (c <> 0) AS BIGINT) AS nonzero FROM c3 GROUP BY "user" """)
def lasso_sparsity(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return tagged.user_sparsity(tagged.fit_lasso(d1, fx.item_tags(spark, sf), fx.N_TAGS, method="ista", rounds=3))


@query()
def lasso_descent(spark, sf):
    """To convergence; the optimality conditions are tested."""
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return _predict(tagged.fit_lasso(d1, fx.item_tags(spark, sf), fx.N_TAGS), d1)


@query(f"""{als_chain(2)}, {lasso_chain(3).replace('d AS MATERIALIZED', 'd_again AS MATERIALIZED', 1).replace('n AS MATERIALIZED', 'n AS MATERIALIZED', 1)},
   k AS (SELECT item, count(*) AS cnt FROM d GROUP BY item)
   SELECT r."user", r.item, {rs('CASE WHEN cnt < 25 THEN lasso ELSE m + u * v END')} AS prediction
   FROM r JOIN m USING ("user") JOIN u2 USING ("user") JOIN v2 USING (item) JOIN k USING (item) JOIN p USING ("user", item)""")
def balse_switch(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    model = tagged.fit_balse(d1, fx.item_tags(spark, sf), fx.N_TAGS, k=1, iterations=2, gamma=25, seed=SEED, init="grid",
                             method="ista", rounds=3)
    return _predict(model, d1)


@query()
def cfm(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return _predict(als.fit_cfm(d1), d1)


@query()
def fma(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return _predict(tagged.fit_fma(d1, fx.item_tags(spark, sf), fx.N_TAGS, k=8, iterations=3), d1)


@query(f"""{als_chain(2)} SELECT r."user", r.item, {rs('u')} AS fu, {rs('v')} AS fi, {rs('u * v')} AS fui
   FROM r JOIN u2 USING ("user") JOIN v2 USING (item)""")
def gbr_features(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    model = als.fit_als(d1, k=1, iterations=2, seed=SEED, init="grid")
    x = boosted.interaction_features(d1.select("user", "item"), model)
    return x.select("user", "item", *[r(F.col("features")[j]).alias(n) for j, n in enumerate(["fu", "fi", "fui"])])


@query()
def gbr(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return _predict(boosted.fit_gbr(d1, k=20, iterations=10), d1)
