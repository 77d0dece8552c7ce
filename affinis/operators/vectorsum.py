"""Sums of per-user integer vectors modulo 2^64, with quorums and masks.

Plain ``sum`` raises on overflow under ANSI rules. A 64-bit value is summed as
four 16-bit limbs in BIGINT (exact up to 2^47 rows per group, all in generated
code) and put together again with shifts, which wrap by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LIMBS = range(4)
_MASK = (1 << 16) - 1
_LOWEST = -(1 << 63)


def _limb_sums(value: Column) -> list[Column]:
    return [
        F.sum((F.shiftrightunsigned(value, 16 * j)).bitwiseAND(F.lit(_MASK).cast("bigint"))).alias(f"l{j}")
        for j in _LIMBS
    ]


def _join_limbs(prefix: str = "l") -> Column:
    """Carry from limb to limb, then pack the low 16 bits of each."""
    carry, total = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for j in _LIMBS:
        limb = F.coalesce(F.col(f"{prefix}{j}"), F.lit(0).cast("bigint")) + carry
        total = total.bitwiseOR(F.shiftleft(limb.bitwiseAND(F.lit(_MASK).cast("bigint")), 16 * j))
        carry = F.shiftright(limb, 16)
    return total


def wrapping_sum_rows(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Long form: sum of ``value`` modulo 2^64 per group, as ``total``."""
    return cells.groupBy(*by).agg(*_limb_sums(F.col(value))).select(*by, _join_limbs().alias("total"))


def elements(vectors: DataFrame, keep: list[str]) -> DataFrame:
    return vectors.select(*keep, F.posexplode("vec").alias("pos", "value"))


def wrapping_sum(vectors: DataFrame, by: list[str], length: int | None = None) -> DataFrame:
    """Element-wise wrapping sum of ``vec`` per group, back as one vector.

    As in a fold that zips, the result is as long as the shortest vector of the
    group, and no longer than ``length``. ``by`` names at least one column.
    """
    sums = wrapping_sum_rows(elements(vectors, by), [*by, "pos"])
    limit = vectors.groupBy(*by).agg(F.min(F.size("vec")).alias("shortest"))
    if length is not None:
        limit = limit.withColumn("shortest", F.least("shortest", F.lit(length)))
    packed = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "total"))).alias("cells"))
    empty = F.array().cast("array<struct<pos:int,total:bigint>>")
    cells = F.coalesce(F.slice("cells", F.lit(1), F.col("shortest")), empty)
    return limit.join(packed, by, "left").select(*by, F.transform(cells, lambda c: c["total"]).alias("vec"))


def wrap_multiply(value: Column, factor: Column) -> Column:
    """value * factor modulo 2^64."""
    wide = "decimal(38,0)"
    two64, two63 = F.lit(str(1 << 64)).cast(wide), F.lit(str(1 << 63)).cast(wide)
    product = (value.cast("decimal(20,0)") * factor.cast("decimal(19,0)")).cast(wide)
    low = F.pmod(product, two64)
    return F.when(low >= two63, low - two64).otherwise(low).cast("bigint")


def signed(value: Column, sign: Column) -> Column:
    """value times -1, 0 or 1; the lowest number is its own negative."""
    negative = F.when(value == F.lit(_LOWEST), value).otherwise(-F.when(value != F.lit(_LOWEST), value))
    return F.when(sign == 0, F.lit(0).cast("bigint")).when(sign > 0, value).otherwise(negative)


def scale_vectors(vectors: DataFrame, factor: int) -> DataFrame:
    return vectors.withColumn("vec", F.transform("vec", lambda x: wrap_multiply(x, F.lit(factor).cast("bigint"))))


def latest_messages(messages: DataFrame) -> DataFrame:
    """Last message of each user in each round; re-sending overwrites."""
    return messages.groupBy("round", "user").agg(
        F.max_by("payload", "arrived").alias("payload"), F.max("arrived").alias("arrived"))


def quorum(vectors: DataFrame, by: list[str], threshold: int, strict: bool = False) -> DataFrame:
    """Groups with at least ``threshold`` distinct senders, with the count.

    ``strict`` makes a group below the threshold an error instead of leaving it out.
    """
    counted = vectors.groupBy(*by, "user").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("one").alias("senders"))
    if strict:
        bad = F.raise_error(F.concat(F.lit("below quorum: "), F.col("senders").cast("string")))
        return counted.withColumn("senders", F.when(F.col("senders") >= threshold, F.col("senders")).otherwise(bad.cast("bigint")))
    return counted.where(F.col("senders") >= threshold)


def quorum_sum(vectors: DataFrame, by: list[str], threshold: int, strict: bool = False) -> DataFrame:
    """Wrapping sum of every group that reached its quorum."""
    return wrapping_sum(vectors, by).join(quorum(vectors, by, threshold, strict), by)


def dropped(sharing: DataFrame, alive: DataFrame) -> DataFrame:
    return sharing.select("user").distinct().join(alive.select("user"), "user", "left_anti")


def pair_sign(user: Column, peer: Column) -> Column:
    """+1 for a peer with a smaller id, -1 for a larger one, 0 for oneself."""
    return F.when(peer < user, 1).when(peer > user, -1).otherwise(0)


def apply_masks(vectors: DataFrame, masks: DataFrame) -> DataFrame:
    """vec + own mask + signed pair masks, per user.

    ``masks``: user, peer, kind ('own' or 'pair'), vec.
    """
    signs = F.when(F.col("kind") == "own", 1).otherwise(pair_sign(F.col("user"), F.col("peer")))
    return wrapping_sum(vectors.select("user", "vec").unionByName(_signed_vectors(masks, signs)), ["user"])


def _signed_vectors(masks: DataFrame, sign: Column) -> DataFrame:
    return masks.withColumn("__s", sign).select("user", F.transform("vec", lambda x: signed(x, F.col("__s"))).alias("vec"))


def remove_masks(masked: DataFrame, masks: DataFrame, sharing: DataFrame) -> DataFrame:
    """Sum of the plain vectors of the users who stayed.

    ``masked``: masked vectors that arrived. Own masks of those senders are
    subtracted; for every user of ``sharing`` who dropped out, the signed pair
    masks towards the senders are added, which cancels what the senders added.
    """
    alive = masked.select("user").distinct()
    gone = dropped(sharing, alive)
    own = masks.where("kind = 'own'").join(alive, "user", "left_semi")
    pair = (
        masks.where("kind = 'pair'").join(gone, "user", "left_semi")
        .join(alive.withColumnRenamed("user", "peer"), "peer", "left_semi")
    )
    parts = (
        masked.select("user", "vec")
        .unionByName(_signed_vectors(own, F.lit(-1)))
        .unionByName(_signed_vectors(pair, pair_sign(F.col("user"), F.col("peer"))))
    )
    return wrapping_sum_rows(elements(parts, []), ["pos"])


def incomplete(messages: DataFrame, alive: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Where the collected shares are not complete; empty when all is well.

    ``messages``: holder, sender, kind. Every responder must hold one message
    per other responder: that is checked by counting, without listing pairs, and
    gives holder, missing. With ``expected`` (holder, sender, kind), the missing
    rows themselves are returned.
    """
    if expected is not None:
        return expected.select("holder", "sender", "kind").join(messages, ["holder", "sender", "kind"], "left_anti")
    responders = messages.select(F.col("holder")).distinct()
    total = responders.agg(F.count(F.lit(1)).alias("n"))
    hit = (
        messages.where("holder != sender")
        .join(responders.withColumnRenamed("holder", "sender"), "sender", "left_semi")
        .groupBy("holder").agg(F.countDistinct("sender").alias("got"))
    )
    n = total.first()["n"]
    missing = F.lit(n - 1) - F.coalesce("got", F.lit(0))
    return responders.join(hit, "holder", "left").select("holder", missing.alias("missing")).where("missing > 0")


def wrong_kind(messages: DataFrame, alive: DataFrame) -> DataFrame:
    """Shares of the wrong kind: seeds belong to senders alive, keys to dropped ones."""
    flagged = messages.join(alive.select(F.col("user").alias("sender"), F.lit(True).alias("up")), "sender", "left")
    right = F.when(F.coalesce("up", F.lit(False)), F.lit("seed")).otherwise(F.lit("key"))
    return flagged.where(F.col("kind") != right).select("holder", "sender", "kind")


def outside_roster(messages: DataFrame, roster: DataFrame) -> DataFrame:
    """Messages whose sender is not registered."""
    return messages.join(roster.select(F.col("user").alias("sender")), "sender", "left_anti")
