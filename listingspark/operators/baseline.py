"""Comparable-median baseline with progressively broader fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import DEVELOPMENT
from ..session import StageTables
from .ranking import grouped_median, join_null_safe

# Fallback levels, narrowest first.
LEVELS = (("make", "model", "year"), ("make", "model"), ("make",), ())
_SEPARATOR = "\x1f"


def _level_key(fields: Sequence[str]) -> Column:
    return F.concat_ws(_SEPARATOR, *[F.coalesce(F.col(name).cast("string"), F.lit("\x00")) for name in fields])


def _cells(rows: DataFrame, extra: Sequence[str], target: str, levels) -> DataFrame:
    """Counted distinct (narrowest level, target) pairs: all that any level's median needs.

    Written once, as every round of the medians and the look-up start from them.
    """
    pairs = rows.groupBy(*extra, *levels[0], target).agg(F.count(F.lit(1)).alias("__w"))
    return StageTables(rows.sparkSession, "counted-pairs").write(pairs)


def _level_medians(weighted: DataFrame, extra: Sequence[str], target: str, minimum: int, levels) -> DataFrame:
    long = weighted.select(
        *extra, target, "__w",
        F.explode(F.array(*[
            F.struct(F.lit(depth).alias("level"), _level_key(fields).alias("key")) for depth, fields in enumerate(levels)
        ])).alias("__l"),
    ).select(*extra, target, "__w", "__l.*")
    medians = grouped_median(long, [*extra, "level", "key"], target, weight="__w")
    return medians.where((F.col("level") == len(levels) - 1) | (F.col("group_count") >= minimum))


def _look_up(places: DataFrame, medians: DataFrame, extra: Sequence[str], levels) -> DataFrame:
    """The narrowest available median of every distinct place.

    Written, so that its size is known before it meets rows: while it is small these are not shuffled.
    """
    tried = places.select(
        *extra, *levels[0],
        F.explode(F.array(*[
            F.struct(F.lit(depth).alias("level"), _level_key(fields).alias("key")) for depth, fields in enumerate(levels)
        ])).alias("__l"),
    ).select(*extra, *levels[0], "__l.*")
    found = tried.join(medians, [*extra, "level", "key"])
    best = F.min(F.struct("level", "median"))
    looked_up = found.groupBy(*extra, *levels[0]).agg(best.alias("__b")).select(
        *extra, *levels[0], F.col("__b.median").alias("predicted_pkr"), F.col("__b.level").alias("median_level")
    )
    return StageTables(places.sparkSession, "looked-up").write(looked_up)


def fit_medians(
    training: DataFrame, *, target: str = "price_pkr", min_group_size: int = 5, levels=LEVELS, by: Sequence[str] = (),
) -> DataFrame:
    """Training medians as (level, key, median, group_count), broadest level always kept."""
    return _level_medians(_cells(training, by, target, levels), list(by), target, min_group_size, levels)


def predict_medians(rows: DataFrame, medians: DataFrame, *, levels=LEVELS) -> DataFrame:
    """Add ``predicted_pkr`` and the level that supplied it."""
    places = rows.select(*levels[0]).distinct()
    return join_null_safe(rows, _look_up(places, medians, [], levels), levels[0])


def out_of_fold_medians(
    rows: DataFrame, folds: int, *, target: str = "price_pkr", fold: str = "validation_fold",
    min_group_size: int = 5, levels=LEVELS,
) -> DataFrame:
    """Predict each development row from the rows of all other folds.

    Rows are first reduced to counted (place, target) pairs. Only those pairs are repeated
    for the folds they train, so the listing rows themselves are never multiplied.
    """
    pairs = _cells(rows, [fold], target, levels)
    others = F.filter(F.array(*[F.lit(i) for i in range(folds)]), lambda i: i != F.col(fold))
    weighted = pairs.withColumn("__fold", F.explode(others)).drop(fold).withColumnRenamed("__fold", fold)
    medians = _level_medians(weighted, [fold], target, min_group_size, levels)
    places = pairs.select(fold, *levels[0]).distinct()
    return join_null_safe(rows, _look_up(places, medians, [fold], levels), [fold, *levels[0]])


def development_rows(rows: DataFrame, assignments: DataFrame, partition: str = DEVELOPMENT) -> DataFrame:
    """Rows of one partition with their group and fold; test only on explicit request."""
    if partition not in (DEVELOPMENT, "demo_test"):
        raise ValueError("Unknown evaluation partition")
    chosen = assignments.where(F.col("partition") == partition).select("listing_id", "group_id", "validation_fold")
    return rows.drop("group_id", "validation_fold").join(chosen, "listing_id")
