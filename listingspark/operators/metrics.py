"""Error metrics of held-out predictions, overall and by subgroup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import price_band
from ..functions.text import family_name
from .ranking import grouped_medians, join_null_safe

ACTUAL, PREDICTED = "actual_pkr", "predicted_pkr"
METRICS = ("count", "mae_pkr", "median_ae_pkr", "median_ape_pct", "rmse_pkr", "nonpositive_predictions")


def _unfit(actual: str, predicted: str) -> Column:
    finite = lambda name: F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")) & (
        F.abs(F.col(name).cast("double")) < F.lit(float("inf"))
    )
    return ~F.coalesce(finite(actual) & finite(predicted) & (F.col(actual) > 0), F.lit(False))


def metric_violations(predictions: DataFrame, actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    """Rows no metric may be computed from: absent, not finite, or without a positive target."""
    return predictions.where(_unfit(actual, predicted))


def regression_metrics(
    predictions: DataFrame, keys: Sequence[str] = (), *, actual: str = ACTUAL, predicted: str = PREDICTED,
) -> DataFrame:
    """Count, mean and median errors, RMSE and non-positive predictions per group.

    Null keys form a group. Exact medians come from the two-pass grouped median. A group with
    a row that no metric may be computed from is refused: it keeps its count, its metrics are
    null.
    """
    target, estimate = F.col(actual).cast("double"), F.col(predicted).cast("double")
    error = F.abs(estimate - target)
    errors = predictions.select(
        *keys, *([] if keys else [F.lit("all").alias("__all")]),
        error.alias("__ae"), F.try_divide(100 * error, target).alias("__ape"), (estimate <= 0).alias("__low"), _unfit(actual, predicted).alias("__unfit"),
    )
    by = list(keys) or ["__all"]
    moments = errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg("__ae").alias("mae_pkr"),
        F.sqrt(F.avg(F.col("__ae") * F.col("__ae"))).alias("rmse_pkr"),
        F.count_if("__low").alias("nonpositive_predictions"), F.bool_or("__unfit").alias("__refused"),
    )
    medians = grouped_medians(errors, by, ["__ae", "__ape"])
    allowed = lambda name, out: F.when(~F.col("__refused"), F.col(name)).alias(out)
    return join_null_safe(moments, medians, by, "left").select(
        *keys, "count", allowed("mae_pkr", "mae_pkr"), allowed("__ae", "median_ae_pkr"), allowed("__ape", "median_ape_pct"),
        allowed("rmse_pkr", "rmse_pkr"), allowed("nonpositive_predictions", "nonpositive_predictions"),
    )


def subgroup_dimensions(city: str = "listing_city") -> dict[str, Column]:
    """The eight reporting dimensions and the value each row takes in them."""
    seen = lambda name: F.when(F.col(name), F.lit("unseen")).otherwise(F.lit("seen"))
    return {
        "overall": F.lit("all"),
        "family": F.col("family"),
        "variant": F.concat("family", F.lit(" / "), "variant"),
        "year": F.col("year").cast("string"),
        "city": F.col(city),
        "price_band": price_band(F.col(ACTUAL)),
        "variant_seen": seen("unseen_variant"),
        "city_seen": seen("unseen_city"),
    }


def summarize_predictions(
    predictions: DataFrame, dimensions: dict[str, Column] | None = None, experiment: str = "experiment",
) -> DataFrame:
    """Metrics of every experiment in every value of every dimension."""
    pairs = [
        F.struct(F.lit(name).alias("dimension"), F.coalesce(value, F.lit("<missing>")).alias("value"))
        for name, value in (dimensions or subgroup_dimensions()).items()
    ]
    long = predictions.select(experiment, ACTUAL, PREDICTED, F.explode(F.array(*pairs)).alias("__d")).select(
        experiment, "__d.*", ACTUAL, PREDICTED
    )
    return regression_metrics(long, [experiment, "dimension", "value"])


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row tables with different columns, as one row."""
    stacked = rows[0]
    for other in rows[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def with_family(df: DataFrame) -> DataFrame:
    return df.withColumn("family", family_name(F.col("make"), F.col("model")))


# Share of the baseline's error by which a fold must be better: sums of the same numbers in another
# order differ by less, so that equal predictions are never better than themselves.
ROUNDING = 1e-9


def experiment_summary(predictions: DataFrame, folds: DataFrame, baseline: str = "median_F0") -> DataFrame:
    """Overall metrics per experiment, its fold range and how it compares with the baseline.

    ``folds`` holds (experiment, fold, mae_pkr). A fold is better than the baseline's if its mean error
    is smaller by more than the rounding of sums.
    """
    overall = regression_metrics(predictions, ["experiment"])
    fold_base = folds.where(F.col("experiment") == baseline).select("fold", F.col("mae_pkr").alias("__fold_base"))
    spread = folds.select("experiment", "fold", "mae_pkr").join(fold_base, "fold", "left").groupBy("experiment").agg(
        F.min("mae_pkr").alias("fold_mae_min_pkr"), F.max("mae_pkr").alias("fold_mae_max_pkr"),
        F.count_if(F.col("mae_pkr") < F.col("__fold_base") * (1 - ROUNDING)).alias("folds_better_than_baseline"),
    )
    # One row per experiment is left here, so a window over all of them stays tiny.
    base = F.max(F.when(F.col("experiment") == baseline, F.col("mae_pkr"))).over(W.partitionBy(F.lit(0)))
    based = overall.withColumn("__base", base)
    improved = F.when(F.col("__base") != 0, 100 * (F.col("__base") - F.col("mae_pkr")) / F.col("__base"))
    return based.join(spread, "experiment").select(
        "experiment", *METRICS, "fold_mae_min_pkr", "fold_mae_max_pkr",
        improved.alias("baseline_improvement_pct"), "folds_better_than_baseline",
    )


def worst_errors(predictions: DataFrame, summary: DataFrame, limit: int = 10) -> DataFrame:
    """Largest held-out errors of the experiment with the least mean error."""
    best = summary.agg(F.min(F.struct("mae_pkr", "experiment")).alias("b")).select(F.col("b.experiment"))
    error = F.abs(F.col(PREDICTED) - F.col(ACTUAL)).alias("absolute_error_pkr")
    return (
        predictions.join(best, "experiment", "left_semi")
        .select("experiment", "listing_id", ACTUAL, PREDICTED, error)
        .orderBy(F.desc("absolute_error_pkr"), "listing_id").limit(limit)
    )


def unseen_flags(
    rows: DataFrame, values: dict[str, Sequence[str]], *, fold: str = "validation_fold",
) -> DataFrame:
    """For each named value, whether no other fold has it, i.e. training never saw it.

    A value is unseen by its own fold's training rows exactly when all its rows share one
    fold, so two combinable aggregates per value replace a list of training values per fold.
    """
    result = rows
    for flag, columns in values.items():
        exclusive = (
            rows.groupBy(*columns).agg(F.min(fold).alias("__low"), F.max(fold).alias("__high"))
            .where(F.col("__low") == F.col("__high"))
            .select(*columns, F.lit(True).alias(flag))
        )
        result = join_null_safe(result, exclusive, list(columns), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return result
