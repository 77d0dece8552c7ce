"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.operators.layout import Sweeps, shuffles_dropped


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (columns ``a`` and ``b``, any comparable type).

    The label is the smallest node reachable. Alternates two steps until nothing
    changes: every node links its larger neighbours to its smallest one, then its
    smaller neighbours to the smallest of them. Both keep the components and halve
    paths, so rounds grow with the logarithm of the longest path. Each round is
    written, which cuts the lineage and survives lost executors; rounds before the last two
    are deleted, and so are a round's shuffles. An edge from a node
    to itself, or with a null end, is ignored.
    """
    with shuffles_dropped(edges.sparkSession):
        return _rounds(edges)


def _rounds(edges: DataFrame) -> DataFrame:
    rounds = Sweeps()
    now = rounds.write(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        following = rounds.write(small.select("e.a", "e.b").where("a != b").distinct(), "edges")
        before, state = state, _state(following)
        now = following
        if state == before:
            break
    # Stars now: every larger node has exactly the smallest one of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
