"""Splits, metrics and model comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.operators.layout import materialise
from affinis.operators.prepare import split_column

RANKED = 100

# Aggregates over (rating, prediction); add to it to define a metric.
METRICS: dict[str, Column] = {}
RANKED_METRICS = ("dcg", "ndcg")


def register_metric(name: str, aggregate) -> None:
    """``aggregate``: a function returning an aggregate Column over rating and prediction."""
    METRICS[name] = aggregate


def _error() -> Column:
    return F.col("rating") - F.col("prediction")


register_metric("rmse", lambda: F.sqrt(F.avg(_error() * _error())))
register_metric("mae", lambda: F.avg(F.abs(_error())))


def available_metrics() -> list[str]:
    return [*METRICS, *RANKED_METRICS]


def _ranked_gain(scored: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """DCG of the first 100 rows of one ranking per group.

    The rank limit is applied in every task before the shuffle (Spark's window
    group limit), so a group's ranking never gathers more than 100 rows per task.
    """
    gain = (F.pow(F.lit(2.0), F.col("rating")) - 1) / F.log2(F.col("rank") + 1)
    if by:
        at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return scored.withColumn("rank", at).where(F.col("rank") <= RANKED).groupBy(*by).agg(F.sum(gain).alias(name))
    first = scored.orderBy(*order).limit(RANKED).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return first.agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias(name))


def ranked_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """dcg and ndcg per group, over one global ranking of all its pairs.

    Gains are 2^rating - 1 with the raw rating; ndcg is 0 when the ideal is 0.
    Pairs without a prediction are not ranked.
    """
    by = by or []
    scored = predictions.where(F.col("prediction").isNotNull()).select(*by, "user", "item", "rating", "prediction")
    got = _ranked_gain(scored, by, [F.desc("prediction"), F.col("user"), F.col("item")], "dcg")
    best = _ranked_gain(scored, by, [F.desc("rating"), F.col("user"), F.col("item")], "ideal")
    if by:
        both = got.join(best, by)
    else:  # one row each: stack them instead of joining
        none = F.lit(None).cast("double")
        both = got.select("dcg", none.alias("ideal")).unionByName(best.select(none.alias("dcg"), "ideal")).agg(
            F.max("dcg").alias("dcg"), F.max("ideal").alias("ideal"))
    return both.select(*by, "dcg", F.coalesce(F.try_divide("dcg", F.col("ideal")), F.lit(0.0)).alias("ndcg"))


def metrics(predictions: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Long table ``[by], metric, value``. NULL predictions are skipped."""
    by, names = by or [], list(dict.fromkeys(names))
    unknown = set(names) - set(available_metrics())
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    parts = []
    plain = [n for n in names if n in METRICS]
    if plain:
        wide = predictions.where(F.col("prediction").isNotNull()).groupBy(*by).agg(*[METRICS[n]().alias(n) for n in plain])
        parts.append(wide.unpivot(by, plain, "metric", "value"))
    ranked = [n for n in names if n in RANKED_METRICS]
    if ranked:
        parts.append(ranked_metrics(predictions, by).unpivot(by, ranked, "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def coverage(predictions: DataFrame) -> DataFrame:
    return predictions.agg((F.count("prediction") / F.count(F.lit(1))).alias("coverage"))


class MetricHistory:
    """Per-sweep curves: give an instance as ``on_sweep`` to an iterative fit."""

    def __init__(self, train: DataFrame, test: DataFrame, names: list[str]):
        self.sets = {"train": train, "test": test}
        self.names = names
        self.rows: list[tuple] = []

    def __call__(self, epoch: int, model) -> None:
        for mode, ratings in self.sets.items():
            for row in metrics(model.predict(ratings), self.names).collect():
                self.rows.append((model.name, mode, epoch, row["metric"], row["value"]))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "model string, mode string, epoch int, metric string, value double")


def compare_models(
    ratings: DataFrame, experiments: list[tuple], names: list[str], splits: int = 1, seed: int = 42,
    is_test=None, fit=None,
) -> DataFrame:
    """model, split, metric, value for every experiment on every random split.

    ``experiments``: (label, algorithm, parameters). A split is drawn by hash of
    the pair, so it is reproducible and needs no shuffle; splits are independent
    draws, not a partition. The loop is over models, not over data.
    """
    from affinis.models.registry import fit_named

    fit = fit or fit_named
    ratings = ratings.persist()
    scored = []
    for split in range(splits):
        flag = split_column(split, seed) if is_test is None else is_test
        train, test = ratings.where(~flag), ratings.where(flag)
        for label, algorithm, parameters in experiments:
            model = fit(algorithm, train, **parameters)
            # NaN would sort above every number; a missing prediction is NULL here.
            out = model.predict(test).select(
                F.lit(label).alias("model"), F.lit(split).alias("split"), "user", "item", "rating",
                F.nullif("prediction", F.lit(float("nan"))).alias("prediction"))
            scored.append(materialise(out, "scored"))
    ratings.unpersist()
    return metrics(reduce(DataFrame.unionByName, scored), names, ["model", "split"])


def save_metrics(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per model; by default those of the models in ``table`` are replaced."""
    table.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)
