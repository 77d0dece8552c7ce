"""Sums of per-user vectors and the checks around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.operators import vectorsum as vs
from affinis.plans.registry import query
from affinis.sources import fixtures as fx

LENGTH = 64
BIG = (1 << 63) - 1


def wrap_sql(expr: str) -> str:
    two64, two63 = "18446744073709551616::HUGEINT", "9223372036854775808::HUGEINT"
    return f"CAST((({expr}) + {two63}) % {two64} + CASE WHEN (({expr}) + {two63}) % {two64} < 0 THEN {two64} ELSE 0 END - {two63} AS BIGINT)"


def _long(df, *keys):
    return df.select(*keys, F.posexplode("vec").alias("pos", "total"))


UNNESTED = """SELECT {keys}, CAST(unnest(range(len(vec))) AS INTEGER) AS pos, unnest(vec) AS x FROM ({source})"""


def _unnest(keys: str, source: str) -> str:
    return UNNESTED.format(keys=keys, source=source)


OVERFLOW = f"""{fx.D5} UNION ALL SELECT 1000000 + label * 3 + j, label, list_transform(range({LENGTH}), lambda x: {BIG}::BIGINT)
   FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest([0, 1, 2]) AS j)"""


def _with_overflow(spark, sf):
    """Three extra vectors of the largest value per cohort."""
    v = fx.user_vectors(spark, sf)
    extra = v.select("cohort").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        (1_000_000 + F.col("cohort") * 3 + F.col("j")).cast("bigint").alias("user"), "cohort",
        F.array_repeat(F.lit(BIG), LENGTH).alias("vec"))
    return v.unionByName(extra)


@query(f"""SELECT cohort, pos, {wrap_sql('sum(CAST(x AS HUGEINT))')} AS total FROM ({_unnest('cohort', OVERFLOW)}) GROUP BY cohort, pos""")
def vector_sum_wrap(spark, sf):
    return _long(vs.wrapping_sum(_with_overflow(spark, sf), ["cohort"], LENGTH), "cohort")


@query(f"""SELECT "user", pos, {wrap_sql('CAST(x AS HUGEINT) * 4611686018427387905::HUGEINT')} AS total FROM ({_unnest('"user"', fx.D5)})""")
def vector_scale(spark, sf):
    return _long(vs.scale_vectors(fx.user_vectors(spark, sf), 4611686018427387905), "user")


QUORUM = 47


@query(f"""WITH v AS ({OVERFLOW}), q AS (SELECT cohort, CAST(count(DISTINCT "user") AS BIGINT) AS senders FROM v GROUP BY cohort HAVING count(DISTINCT "user") >= {QUORUM + 3})
   SELECT cohort, senders, pos, {wrap_sql('sum(CAST(x AS HUGEINT))')} AS total FROM ({_unnest('cohort', 'SELECT * FROM v')}) JOIN q USING (cohort) GROUP BY cohort, senders, pos""")
def quorum_sum(spark, sf):
    return _long(vs.quorum_sum(_with_overflow(spark, sf), ["cohort"], QUORUM + 3), "cohort", "senders")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS round, user_id AS "user", event_id AS payload FROM events
   QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_messages(spark, sf):
    """One message per user and day: the last one sent."""
    log = fx.table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("round"), F.col("user_id").alias("user"), F.col("event_id").alias("payload"),
        F.struct("ts", "event_id").alias("arrived"))
    return vs.latest_messages(log).select("round", "user", "payload")


def _staying(df):
    """The drop-out scenario: every seventh id is lost after sharing."""
    return df.where(F.col("user") % 7 != 0)


@query(f"""SELECT "user" FROM ({fx.D5}) WHERE "user" % 7 = 0""")
def dropouts(spark, sf):
    v = fx.user_vectors(spark, sf)
    return vs.dropped(v, _staying(v))


def _masks(spark, sf):
    """Own masks, and pair masks with the neighbours at distance 1 and 2 by id."""
    users = fx.user_vectors(spark, sf).select("user")
    pos = F.sequence(F.lit(0), F.lit(LENGTH - 1))
    own = users.select("user", F.col("user").alias("peer"), F.lit("own").alias("kind"), F.transform(
        pos, lambda j: (F.col("user") * 7919 + j * 104729 + 1) % 1_000_003 * 998_244_353_000).alias("vec"))
    near = users.select("user", F.explode(F.array(*[F.col("user") + d for d in (-2, -1, 1, 2)])).alias("peer"))
    near = near.join(users.withColumnRenamed("user", "peer"), "peer", "left_semi")
    low, high = F.least("user", "peer"), F.greatest("user", "peer")
    pair = near.select("user", "peer", F.lit("pair").alias("kind"), F.transform(
        pos, lambda j: (low * 31 + high * 17 + j * 13 + 1) % 1_000_003 * 9_007_199_254_741).alias("vec"))
    return own.unionByName(pair)


@query(f"""SELECT pos, {wrap_sql('sum(CAST(x AS HUGEINT))')} AS total FROM ({_unnest('"user"', fx.D5)}) WHERE "user" % 7 <> 0 GROUP BY pos""")
def mask_roundtrip(spark, sf):
    """Masked vectors of those who stayed, unmasked: the plain sum comes back."""
    v, masks = fx.user_vectors(spark, sf), _masks(spark, sf)
    arrived = _staying(vs.apply_masks(v, masks))
    return vs.remove_masks(arrived, masks, v)


@query(f"""WITH u AS (SELECT vec_id AS u FROM embeddings), p AS (SELECT a.u, b.u AS v FROM u a JOIN u b ON abs(a.u - b.u) IN (1, 2)),
   j AS (SELECT CAST(unnest(range({LENGTH})) AS INTEGER) AS pos), parts AS (
     SELECT "user", pos, CAST(x AS HUGEINT) AS x FROM ({_unnest('"user"', fx.D5)})
     UNION ALL SELECT u, pos, CAST((u * 7919 + pos * 104729 + 1) % 1000003 AS HUGEINT) * 998244353000 FROM u, j
     UNION ALL SELECT u, pos, CASE WHEN v < u THEN 1 ELSE -1 END * CAST((least(u, v) * 31 + greatest(u, v) * 17 + pos * 13 + 1) % 1000003 AS HUGEINT) * 9007199254741 FROM p, j)
   SELECT "user", pos, {wrap_sql('sum(x)')} AS total FROM parts GROUP BY "user", pos""")
def masked_vectors(spark, sf):
    return _long(vs.apply_masks(fx.user_vectors(spark, sf), _masks(spark, sf)), "user")


def _ring(spark, sf):
    users = fx.user_vectors(spark, sf).select(F.col("user").alias("holder"))
    near = users.select("holder", F.explode(F.array(*[F.col("holder") + d for d in (-2, -1, 1, 2)])).alias("sender"))
    kind = F.when(F.col("sender") % 7 != 0, "seed").otherwise("key")
    return near.join(users.withColumnRenamed("holder", "sender"), "sender", "left_semi").withColumn("kind", kind)


@query("""WITH u AS (SELECT vec_id AS u FROM embeddings)
   SELECT a.u AS holder, b.u AS sender, CASE WHEN b.u % 7 <> 0 THEN 'seed' ELSE 'key' END AS kind
   FROM u a JOIN u b ON abs(a.u - b.u) IN (1, 2) WHERE (a.u + 3 * b.u) % 11 = 0""")
def completeness(spark, sf):
    """Shares that were expected from the neighbours and never came."""
    expected = _ring(spark, sf)
    came = expected.where((F.col("holder") + 3 * F.col("sender")) % 11 != 0)
    return vs.incomplete(came, None, expected)


@query("""WITH m AS (SELECT DISTINCT user_id AS holder, CAST(props->>'$.k' AS BIGINT) AS sender FROM events),
   h AS (SELECT DISTINCT holder FROM m)
   SELECT holder, missing FROM (SELECT h.holder, CAST((SELECT count(*) FROM h) - 1 - count(m.sender) AS BIGINT) AS missing
     FROM h LEFT JOIN m ON m.holder = h.holder AND m.sender <> h.holder AND m.sender IN (SELECT holder FROM h)
     GROUP BY h.holder) WHERE missing > 0""")
def completeness_counts(spark, sf):
    """How many of all other participants each holder never heard from."""
    log = fx.event_log(spark, sf)
    return vs.incomplete(log.select(F.col("user").alias("holder"), F.col("item").alias("sender")), None)


@query("""WITH u AS (SELECT vec_id AS u FROM embeddings)
   SELECT a.u AS holder, b.u AS sender, CASE WHEN b.u % 7 <> 0 THEN 'seed' ELSE 'key' END AS kind
   FROM u a JOIN u b ON abs(a.u - b.u) IN (1, 2) WHERE (b.u % 7 = 0) <> (b.u % 5 = 0)""")
def share_kinds(spark, sf):
    """Shares whose kind contradicts who is alive (here: every fifth id is lost instead)."""
    alive = fx.user_vectors(spark, sf).where(F.col("user") % 5 != 0)
    return vs.wrong_kind(_ring(spark, sf), alive)


@query("""SELECT o_orderkey AS holder, o_custkey AS sender FROM orders
   WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def roster(spark, sf):
    """Orders sent by customers outside the registered segment."""
    sent = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("holder"), F.col("o_custkey").alias("sender"))
    members = fx.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user"))
    return vs.outside_roster(sent, members).select("holder", "sender")
