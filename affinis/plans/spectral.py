"""Singular-value and latent-variable models, checked at rank 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.models import als, foldin, latent, spectral
from affinis.operators import stats
from affinis.plans.least_squares import SEED, als_chain, grid
from affinis.plans.neighbourhood import NEWCOMERS, _newcomers
from affinis.plans.registry import query, r, rs
from affinis.sources import fixtures as fx

USER_CENTRED = f"""d AS MATERIALIZED ({fx.D3}), m AS MATERIALIZED (SELECT "user", avg(rating) AS m FROM d GROUP BY "user"),
  x AS MATERIALIZED (SELECT d."user", item, rating - m AS x FROM d JOIN m USING ("user"))"""
DOUBLE_CENTRED = f"""d AS MATERIALIZED ({fx.D3}), m AS MATERIALIZED (SELECT "user", avg(rating) AS m FROM d GROUP BY "user"),
  e AS MATERIALIZED (SELECT d."user", item, rating - m AS e FROM d JOIN m USING ("user")),
  c AS MATERIALIZED (SELECT item, sum(e) / (SELECT max("user") + 1 FROM d) AS c FROM e GROUP BY item),
  x AS MATERIALIZED (SELECT "user", item, e - c AS x FROM e JOIN c USING (item))"""


def power_chain(cells: str, rounds: int, center: bool = False) -> str:
    """v <- normalised A'(A v), then b = A v (A minus its column means if asked)."""
    ctes = [cells, f"""s0 AS (SELECT DISTINCT item, {grid('item')} AS v FROM x)""",
            "v0 AS MATERIALIZED (SELECT item, v / (SELECT sqrt(sum(v * v)) FROM s0) AS v FROM s0)"]
    if center:
        ctes.append('n AS (SELECT max("user") + 1 AS n FROM d)')
        ctes.append("mu AS MATERIALIZED (SELECT item, sum(x) / (SELECT n FROM n) AS mu FROM x GROUP BY item)")
    for t in range(1, rounds + 1):
        ctes.append(f'b{t} AS MATERIALIZED (SELECT "user", sum(x * v) AS b FROM x JOIN v{t - 1} USING (item) GROUP BY "user")')
        fix = ""
        if center:
            ctes.append(f"o{t} AS (SELECT sum(mu * v) AS o FROM mu JOIN v{t - 1} USING (item))")
            fix = f" - (SELECT n FROM n) * (SELECT o FROM o{t}) * any_value(mu)"
        ctes.append(f"""s{t} AS MATERIALIZED (SELECT item, sum(x * b){fix} AS v FROM x JOIN b{t} USING ("user")
           {'JOIN mu USING (item)' if center else ''} GROUP BY item)""")
        ctes.append(f"v{t} AS MATERIALIZED (SELECT item, v / (SELECT sqrt(sum(v * v)) FROM s{t}) AS v FROM s{t})")
    ctes.append(f'v AS (SELECT * FROM v{rounds})')
    ctes.append('b AS MATERIALIZED (SELECT "user", sum(x * v) AS b FROM x JOIN v USING (item) GROUP BY "user")')
    return "WITH " + ",\n".join(ctes)


def _predict(model, d3, digits=6):
    return model.predict(d3.select("user", "item")).withColumn("prediction", r("prediction", digits))


@query(f"""{power_chain(DOUBLE_CENTRED, 2)} SELECT d."user", d.item, {rs('b * v + m + c')} AS prediction
   FROM d JOIN b USING ("user") JOIN m USING ("user") JOIN v USING (item) JOIN c USING (item)""")
def svd_power1(spark, sf):
    d3 = fx.stored(fx.event_ratings(spark, sf))
    return _predict(spectral.fit_svd(d3, k=1, iterations=2, seed=SEED, init="grid", oversample=0), d3)


@query(f"""{power_chain(USER_CENTRED, 2)} SELECT d."user", d.item, {rs('b * v + m')} AS prediction
   FROM d JOIN b USING ("user") JOIN m USING ("user") JOIN v USING (item)""")
def svd2_power1(spark, sf):
    d3 = fx.stored(fx.event_ratings(spark, sf))
    return _predict(spectral.fit_svd2(d3, k=1, iterations=2, seed=SEED, init="grid", oversample=0), d3)


@query(f"""{power_chain(USER_CENTRED.replace(fx.D3, 'SELECT * FROM (' + fx.D3 + ') WHERE rating <> 0'), 3)}
   SELECT d."user", d.item, {rs('b * v + m')} AS prediction
   FROM d JOIN b USING ("user") JOIN m USING ("user") JOIN v USING (item)""")
def svd1_power1(spark, sf):
    d3 = fx.stored(fx.event_ratings(spark, sf))
    return _predict(spectral.fit_svd1(d3, k=1, iterations=3, seed=SEED, init="grid", oversample=0), d3)


@query()
def svd_k20(spark, sf):
    """Full rank on the wide ratings; orthonormality and A v = sigma u are tested."""
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return spectral.fit_svd(d1, k=20, iterations=4).predict(d1.select("user", "item"))


KNN_1D = """near AS (SELECT u, b, w FROM (SELECT p."user" AS u, q.b,
     CASE WHEN round(abs(p.b - q.b), 9) > 0 THEN 1 / round(abs(p.b - q.b), 9) ELSE 0 END AS w,
     row_number() OVER (PARTITION BY p."user" ORDER BY round(abs(p.b - q.b), 9), q."user") AS rank
     FROM b p JOIN b q ON p."user" <> q."user") WHERE rank <= 5),
   q AS (SELECT u AS "user", sum(w * b) / sum(w) AS q FROM near GROUP BY u)"""


@query(f"""{power_chain(DOUBLE_CENTRED, 2)}, {KNN_1D} SELECT d."user", d.item, {rs('q * v + m + c')} AS prediction
   FROM d JOIN q USING ("user") JOIN m USING ("user") JOIN v USING (item) JOIN c USING (item)""")
def svdknn(spark, sf):
    d3 = fx.stored(fx.event_ratings(spark, sf))
    return _predict(spectral.fit_svdknn(d3, k=1, iterations=2, seed=SEED, init="grid", oversample=0), d3)


@query(f"""{power_chain(DOUBLE_CENTRED, 2)}, w AS MATERIALIZED ({NEWCOMERS}),
   wm AS (SELECT "user", avg(rating) AS wm FROM w GROUP BY "user"),
   f AS (SELECT w."user", sum((rating - wm - c) * v) AS f FROM w JOIN wm USING ("user") JOIN c USING (item) JOIN v USING (item) GROUP BY w."user")
   SELECT w."user", w.item, {rs('wm + f * v + c')} AS prediction FROM w JOIN wm USING ("user") JOIN f USING ("user")
   JOIN v USING (item) JOIN c USING (item)""")
def svd_foldin(spark, sf):
    d3, new = fx.stored(fx.event_ratings(spark, sf)), _newcomers(spark, sf)
    model = spectral.fit_svd(d3, k=1, iterations=2, seed=SEED, init="grid", oversample=0)
    rows = foldin.fold_in_svd(model, new)
    return model.predict(new.select("user", "item"), rows).withColumn("prediction", r("prediction"))


@query(f"""{power_chain(DOUBLE_CENTRED, 2)}, w AS MATERIALIZED ({NEWCOMERS}),
   wm AS MATERIALIZED (SELECT "user", avg(rating) AS wm FROM w GROUP BY "user"),
   f AS MATERIALIZED (SELECT w."user", sum((rating - wm - c) * v) AS f FROM w JOIN wm USING ("user") JOIN c USING (item) JOIN v USING (item) GROUP BY w."user"),
   near AS (SELECT u, b, w FROM (SELECT p."user" AS u, q.b,
     CASE WHEN round(abs(p.f - q.b), 9) > 0 THEN 1 / round(abs(p.f - q.b), 9) ELSE 0 END AS w,
     row_number() OVER (PARTITION BY p."user" ORDER BY round(abs(p.f - q.b), 9), q."user") AS rank FROM f p CROSS JOIN b q) WHERE rank <= 5),
   q AS (SELECT u AS "user", sum(w * b) / sum(w) AS q FROM near GROUP BY u)
   SELECT w."user", w.item, {rs('wm + q * v + c')} AS prediction FROM w JOIN wm USING ("user") JOIN q USING ("user")
   JOIN v USING (item) JOIN c USING (item)""")
def svdknn_foldin(spark, sf):
    d3, new = fx.stored(fx.event_ratings(spark, sf)), _newcomers(spark, sf)
    model = spectral.fit_svdknn(d3, k=1, iterations=2, seed=SEED, init="grid", oversample=0)
    rows = foldin.fold_in_svd(model, new)
    return model.predict(new.select("user", "item"), rows).withColumn("prediction", r("prediction"))


@query(f"""{power_chain(USER_CENTRED, 2)}, w AS MATERIALIZED ({NEWCOMERS}), s AS (SELECT sqrt(sum(b * b)) AS s FROM b),
   wm AS MATERIALIZED (SELECT "user", avg(rating) AS wm FROM w GROUP BY "user"),
   f AS (SELECT w."user", sum((rating - wm) * v * s) / (sum(v * v * s * s) + 0.1 * count(*)) AS f
     FROM w JOIN wm USING ("user") JOIN v USING (item), s GROUP BY w."user")
   SELECT w."user", w.item, {rs('wm + f * s * v')} AS prediction FROM w JOIN wm USING ("user") JOIN f USING ("user")
   JOIN v USING (item), s""")
def svd2_foldin(spark, sf):
    d3, new = fx.stored(fx.event_ratings(spark, sf)), _newcomers(spark, sf)
    model = spectral.fit_svd2(d3, k=1, iterations=2, seed=SEED, init="grid", oversample=0)
    rows = foldin.fold_in_svd_ridge(model, new)
    return model.predict(new.select("user", "item"), rows).withColumn("prediction", r("prediction"))


NEW_BUYERS = f"""SELECT "user" + 1000000000 AS "user", item, 6 - rating AS rating FROM ({fx.D1})"""


@query(f"""{als_chain(2)}, w AS ({NEW_BUYERS}), wm AS (SELECT "user", avg(rating) AS wm FROM w GROUP BY "user"),
   f AS (SELECT w."user", sum((rating - wm) * v) / (sum(v * v) + 0.1 * count(*)) AS f
     FROM w JOIN wm USING ("user") JOIN v2 USING (item) GROUP BY w."user")
   SELECT w."user", w.item, {rs('wm + f * v')} AS prediction FROM w JOIN wm USING ("user") JOIN f USING ("user") JOIN v2 USING (item)""")
def als_foldin(spark, sf):
    """Every customer again as a newcomer with the opposite taste."""
    d1 = fx.stored(fx.part_ratings(spark, sf))
    new = d1.select((F.col("user") + 1_000_000_000).alias("user"), "item", (6 - F.col("rating")).alias("rating"))
    model = als.fit_als(d1, k=1, iterations=2, seed=SEED, init="grid")
    rows = foldin.fold_in_als(model, new)
    return model.predict(new.select("user", "item"), rows).withColumn("prediction", r("prediction"))


PCA = f"""{power_chain(USER_CENTRED.replace(fx.D3, 'SELECT * FROM (' + fx.D3 + ') WHERE rating <> 0'), 2, center=True)},
  o AS (SELECT sum(mu * v) AS o FROM mu JOIN v USING (item))"""


@query(f"""{PCA} SELECT d."user", d.item, {rs('(b - o) * v + mu + m')} AS prediction
   FROM d JOIN b USING ("user") JOIN m USING ("user") JOIN v USING (item) JOIN mu USING (item), o""")
def pca_power1(spark, sf):
    d3 = fx.stored(fx.event_ratings(spark, sf))
    return _predict(spectral.fit_pca(d3, k=1, iterations=2, seed=SEED, init="grid", oversample=0), d3)


@query(f"""{PCA}, lam AS (SELECT sum(b * b) - any_value(n.n) * any_value(o) * any_value(o) AS l FROM b, o, n)
   SELECT d."user", d.item, {rs('(b - o) * sqrt(l / (n - 1) / n) * v + m')} AS prediction
   FROM d JOIN b USING ("user") JOIN m USING ("user") JOIN v USING (item), o, n, lam""")
def pca_compat(spark, sf):
    d3 = fx.stored(fx.event_ratings(spark, sf))
    return _predict(spectral.fit_pca(d3, k=1, iterations=2, seed=SEED, init="grid", oversample=0, compat=True), d3)


def nmf_chain(rounds: int) -> str:
    ctes = [f"x AS MATERIALIZED ({fx.D1})", f'w0 AS (SELECT DISTINCT "user", {grid(chr(34) + "user" + chr(34))} + 0.001 AS f FROM x)',
            f"h0 AS (SELECT DISTINCT item, {grid('item')} + 0.001 AS f FROM x)"]
    for t in range(1, rounds + 1):
        ctes.append(f"""w{t} AS MATERIALIZED (SELECT "user", w.f * num / greatest(w.f * (SELECT sum(f * f) FROM h{t - 1}), 1e-12) AS f
          FROM w{t - 1} w JOIN (SELECT "user", sum(rating * f) AS num FROM x JOIN h{t - 1} USING (item) GROUP BY "user") USING ("user"))""")
        ctes.append(f"""h{t} AS MATERIALIZED (SELECT item, h.f * num / greatest(h.f * (SELECT sum(f * f) FROM w{t}), 1e-12) AS f
          FROM h{t - 1} h JOIN (SELECT item, sum(rating * f) AS num FROM x JOIN w{t} USING ("user") GROUP BY item) USING (item))""")
    return "WITH " + ",\n".join(ctes)


@query(f"""{nmf_chain(2)} SELECT "user", item, {rs('w2.f * h2.f')} AS prediction FROM x JOIN w2 USING ("user") JOIN h2 USING (item)""")
def nmf_rank1(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return _predict(latent.fit_nmf(d1, k=1, iterations=2, seed=SEED, init="grid"), d1)


@query()
def nmf_k10(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return latent.fit_nmf(d1, k=10, iterations=5).predict(d1.select("user", "item"))


@query(f"""WITH p AS (SELECT p_partkey AS item, tag, sum(weight) AS weight FROM (SELECT item AS p_partkey, tag, weight FROM ({fx.D4})) GROUP BY 1, 2),
   s AS (SELECT d."user", tag, sum(weight) AS w FROM ({fx.D1}) d JOIN p USING (item) GROUP BY 1, 2)
   SELECT "user", CAST(tag AS INTEGER) AS component, {rs('w * 100 / sum(w) OVER (PARTITION BY "user")', 9)} AS share FROM s WHERE w <> 0""")
def component_share(spark, sf):
    """Share of every tag in a customer's purchases, as component shares of a profile."""
    d1 = fx.stored(fx.part_ratings(spark, sf))
    tags = als.tag_vectors(fx.item_tags(spark, sf), fx.N_TAGS)
    profile = d1.join(tags, "item").groupBy("user").agg(
        F.array(*[F.sum(F.get("t", F.lit(j))) for j in range(fx.N_TAGS)]).alias("f"))
    return stats.component_share(profile, digits=9)


def efa_chain(rounds: int) -> str:
    ctes = [f"d AS MATERIALIZED ({fx.D3})", 'n AS (SELECT max("user") + 1 AS n, count(DISTINCT "user") AS active FROM d)',
            "st AS MATERIALIZED (SELECT item, sum(rating) / any_value(n) AS mu, sum(rating * rating) - any_value(n) * (sum(rating) / any_value(n)) * (sum(rating) / any_value(n)) AS ss FROM d, n GROUP BY item)",
            f"i0 AS MATERIALIZED (SELECT item, mu, ss, greatest(ss / n, 1e-12) AS psi, {grid('item')} AS f FROM st, n)"]
    for t in range(rounds + 1):
        ctes.append(f"p{t} AS MATERIALIZED (SELECT 1 / (1 + sum(f * f / psi)) AS inv, sum(mu * f / psi) AS s FROM i{t})")
        ctes.append(f"""z{t} AS MATERIALIZED (SELECT "user", (sum(rating * f / psi) - any_value(s)) * any_value(inv) AS z
          FROM d JOIN i{t} USING (item), p{t} GROUP BY "user")""")
        if t < rounds:
            ctes.append(f"""q{t} AS MATERIALIZED (SELECT n * inv + (SELECT sum(z * z) FROM z{t}) + (n - active) * (inv * s) * (inv * s) AS szz FROM n, p{t})""")
            ctes.append(f"""i{t + 1} AS MATERIALIZED (SELECT item, mu, ss, greatest((ss - c * c / szz) / n, 1e-12) AS psi, c / szz AS f FROM
              (SELECT item, any_value(mu) AS mu, any_value(ss) AS ss, sum(rating * z) AS c FROM d JOIN z{t} USING ("user") JOIN i{t} USING (item) GROUP BY item), q{t}, n)""")
    return "WITH " + ",\n".join(ctes)


@query(f"""{efa_chain(2)} SELECT "user", item, {rs('z * f + mu')} AS prediction FROM d JOIN z2 USING ("user") JOIN i2 USING (item)""")
def efa_rank1(spark, sf):
    d3 = fx.stored(fx.event_ratings(spark, sf))
    return _predict(latent.fit_efa(d3, k=1, iterations=2, seed=SEED, init="grid"), d3)
