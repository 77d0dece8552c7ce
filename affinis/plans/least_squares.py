"""Alternating least squares, checked at rank 1 against unrolled SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.models import als
from affinis.plans.registry import query, r, rs
from affinis.sources import fixtures as fx

SEED = 7


def grid(ident: str, j: int = 0, seed: int = SEED) -> str:
    return f"((({ident} % 1000) * 7919 + {j * 104729 + seed}) % 1000 / 1000.0::DOUBLE)"


CENTRED = f"""d AS ({fx.D1}), m AS (SELECT "user", avg(rating) AS m FROM d GROUP BY "user"),
  r AS (SELECT d."user", item, rating - m AS e FROM d JOIN m USING ("user"))"""


def als_chain(sweeps: int, lam: float = 0.1) -> str:
    ctes = [CENTRED, f"v0 AS (SELECT DISTINCT item, {grid('item')} AS v FROM r)"]
    for s in range(sweeps):
        ctes.append(f"""u{s + 1} AS (SELECT "user", sum(e * v) / (sum(v * v) + {lam} * count(*)) AS u
           FROM r JOIN v{s} USING (item) GROUP BY "user")""")
        ctes.append(f"""v{s + 1} AS (SELECT item, sum(e * u) / (sum(u * u) + {lam} * count(*)) AS v
           FROM r JOIN u{s + 1} USING ("user") GROUP BY item)""")
    return "WITH " + ",\n".join(ctes)


@query(f"""{als_chain(2)} SELECT r."user", r.item, {rs('m + u * v')} AS prediction
   FROM r JOIN m USING ("user") JOIN u2 USING ("user") JOIN v2 USING (item)""")
def als_rank1(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    model = als.fit_als(d1, k=1, iterations=2, seed=SEED, init="grid")
    return model.predict(d1.select("user", "item")).withColumn("prediction", r("prediction"))


def biased_chain(sweeps: int, w: str, lam: float = 0.1) -> str:
    ctes = [f"d AS ({fx.D1})", f"g AS (SELECT {w} AS w FROM d)",
            f"""ub0 AS (SELECT DISTINCT "user", {grid('"user"', 1)} AS b FROM d)""",
            f"v0 AS (SELECT DISTINCT item, {grid('item')} AS f, {grid('item', 1)} AS b FROM d)"]
    prior_u, prior_v = "ub0", "v0"
    for s in range(1, sweeps + 1):
        for key, other, mine, prior, fixed in (
            ('"user"', "item", f"u{s}", prior_u, prior_v), ("item", '"user"', f"v{s}", f"v{s - 1}", f"u{s}"),
        ):
            ctes.append(f"""{mine} AS (SELECT {key}, f, (sy - f * sx) / n / (1 + {lam}) - w AS b FROM (
               SELECT q.{key}, n, sx, sy, w, (sxy - (w + p.b) * sx) / (sxx + {lam} * n) AS f FROM (
                 SELECT d.{key}, count(*) AS n, sum(f) AS sx, sum(f * f) AS sxx, sum(rating - b) AS sy,
                   sum((rating - b) * f) AS sxy FROM d JOIN {fixed} o USING ({other}) GROUP BY d.{key}) q
               JOIN {prior} p USING ({key}), g))""")
        prior_u, prior_v = f"u{s}", f"v{s}"
    return "WITH " + ",\n".join(ctes)


def _biased_sql(w: str) -> str:
    return f"""{biased_chain(2, w)} SELECT d."user", d.item, {rs('w + u2.b + v2.b + u2.f * v2.f')} AS prediction
      FROM d JOIN u2 USING ("user") JOIN v2 USING (item), g"""


@query(_biased_sql("0.0::DOUBLE * count(*)"))
def als2_rank1(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    model = als.fit_als_biased(d1, k=1, iterations=2, seed=SEED, init="grid")
    return model.predict(d1.select("user", "item")).withColumn("prediction", r("prediction"))


@query(_biased_sql("avg(rating)"))
def als3_rank1(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    model = als.fit_als3(d1, k=1, iterations=2, seed=SEED, init="grid")
    return model.predict(d1.select("user", "item")).withColumn("prediction", r("prediction"))


def wals_chain(sweeps: int, reg: float = 0.001) -> str:
    ctes = [CENTRED, f"v0 AS (SELECT DISTINCT item, {grid('item')} AS v FROM r)"]
    for s in range(1, sweeps + 1):
        ctes.append(f"""u{s} AS (SELECT "user", sum(e * v) / ((SELECT sum(v * v) FROM v{s - 1}) + {reg}) AS u
           FROM r JOIN v{s - 1} USING (item) GROUP BY "user")""")
        ctes.append(f"""v{s} AS (SELECT item, sum(e * u) / ((SELECT sum(u * u) FROM u{s}) + {reg}) AS v
           FROM r JOIN u{s} USING ("user") GROUP BY item)""")
    return "WITH " + ",\n".join(ctes)


@query(f"""{wals_chain(2)} SELECT r."user", r.item, {rs('m + u * v')} AS prediction
   FROM r JOIN m USING ("user") JOIN u2 USING ("user") JOIN v2 USING (item)""")
def wals_rank1(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    model = als.fit_wals(d1, k=1, iterations=2, seed=SEED, init="grid")
    return model.predict(d1.select("user", "item")).withColumn("prediction", r("prediction"))


SIZE_TAG = "t AS (SELECT p_partkey AS item, p_size / 50.0::DOUBLE AS t FROM part)"


def xals_chain(sweeps: int, lam: float = 0.1) -> str:
    """One free factor and one tag: the user solve is 2 x 2, by Cramer's rule."""
    ctes = [CENTRED, SIZE_TAG, f"v0 AS (SELECT DISTINCT item, {grid('item')} AS v FROM r)"]
    for s in range(1, sweeps + 1):
        ctes.append(f"""u{s} AS (SELECT "user", (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS p,
             (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS q FROM (
             SELECT "user", sum(v * v) + {lam} * count(*) AS a11, sum(v * t) AS a12, sum(t * t) + {lam} * count(*) AS a22,
               sum(e * v) AS b1, sum(e * t) AS b2 FROM r JOIN v{s - 1} USING (item) JOIN t USING (item) GROUP BY "user"))""")
        ctes.append(f"""v{s} AS (SELECT item, sum((e - t * q) * p) / (sum(p * p) + {lam} * count(*)) AS v
           FROM r JOIN u{s} USING ("user") JOIN t USING (item) GROUP BY item)""")
    return "WITH " + ",\n".join(ctes)


@query(f"""{xals_chain(2)} SELECT r."user", r.item, {rs('m + p * v + q * t')} AS prediction
   FROM r JOIN m USING ("user") JOIN u2 USING ("user") JOIN v2 USING (item) JOIN t USING (item)""")
def xals_rank1_tag1(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    size = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item"), F.lit(0).alias("tag"), (F.col("p_size") / 50.0).alias("weight"))
    model = als.fit_xals(d1, size, 1, k=1, iterations=2, seed=SEED, init="grid")
    return model.predict(d1.select("user", "item")).withColumn("prediction", r("prediction"))


def cfm_chain(sweeps: int, reg: float = 0.1, scale: float = 0.1) -> str:
    ctes = [f"d AS ({fx.D1})", "g AS (SELECT avg(rating) AS w FROM d)",
            f"v0 AS (SELECT DISTINCT item, {scale} * {grid('item')} AS f, 0.0::DOUBLE AS b FROM d)"]
    for s in range(1, sweeps + 1):
        for key, other, mine, fixed in (('"user"', "item", f"u{s}", f"v{s - 1}"), ("item", '"user"', f"v{s}", f"u{s}")):
            ctes.append(f"""{mine} AS (SELECT {key}, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS f,
               (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS b FROM (
               SELECT {key}, sum(f * f) + {reg} AS a11, sum(f) AS a12, count(*) + {reg} AS a22,
                 sum((rating - w - b) * f) AS b1, sum(rating - w - b) AS b2
               FROM d JOIN {fixed} o USING ({other}), g GROUP BY {key}))""")
    return "WITH " + ",\n".join(ctes)


@query(f"""{cfm_chain(2)} SELECT d."user", d.item, {rs('w + u2.b + v2.b + u2.f * v2.f')} AS prediction
   FROM d JOIN u2 USING ("user") JOIN v2 USING (item), g""")
def cfm_rank1(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    model = als.fit_cfm(d1, k=1, iterations=2, seed=SEED, init="grid")
    return model.predict(d1.select("user", "item")).withColumn("prediction", r("prediction"))


@query()
def als_k20(spark, sf):
    """Full rank and sweeps; the objective is checked in the tests."""
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return als.fit_als(d1, k=20, iterations=10).predict(d1.select("user", "item"))


@query()
def als_ml(spark, sf):
    d1 = fx.stored(fx.part_ratings(spark, sf))
    return als.fit_als_mllib(d1, k=20, iterations=10).predict(d1.select("user", "item"))
