"""Deterministic, family-stratified test and fold assignment of whole groups.

Only identities and group sizes are read, never targets, so neither the order of the input
nor a changed price can move a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import DEVELOPMENT, TEST_PARTITION
from ..functions import digests
from ..session import StageTables
from .consolidate import NEW, QUARANTINED
from .ranking import join_null_safe, rank_by_digest

# Phases that salt the ordering digest.
TEST_PHASE = "test"
DEVELOPMENT_PHASE = "development"
REVIEWED_PHASE = "reviewed-development"
FAMILY = ("make", "model")


def check_config(seed: int, test_fraction: float, folds: int) -> None:
    if type(seed) is not int:
        raise ValueError("seed must be an integer")
    if type(folds) is not int or folds < 2:
        raise ValueError("folds must be an integer of at least two")
    if type(test_fraction) not in (int, float) or not 0 < test_fraction < 1:
        raise ValueError("test_fraction must lie between zero and one")


def group_table(rows: DataFrame) -> DataFrame:
    """One row per split group: its family and its number of rows.

    A group that spans two families is reported by ``split_violations``; here it takes its
    smallest family.
    """
    return rows.groupBy("group_id").agg(
        F.min(F.struct(*FAMILY)).alias("__family"), F.count(F.lit(1)).alias("rows")
    ).select("group_id", *[f"__family.{name}" for name in FAMILY], "rows")


def reserve_test(groups: DataFrame, seed: int, test_fraction: float) -> DataFrame:
    """Mark the first groups of each family, in digest order, as reserved test groups."""
    keyed = groups.withColumn("__digest", digests.sha256_text(seed, TEST_PHASE, F.col("group_id")))
    ranked = rank_by_digest(keyed, FAMILY, "__digest", "group_id", rank="test_rank", size="family_groups")
    quota = F.greatest(F.lit(1), F.floor(F.col("family_groups") * F.lit(test_fraction) + 0.5))
    partition = F.when(F.col("test_rank") <= quota, F.lit(TEST_PARTITION)).otherwise(F.lit(DEVELOPMENT))
    return ranked.withColumn("partition", partition).drop("__digest")


def start_offset(folds: int) -> Column:
    """Where a family starts to deal, so that the first fold does not win every remainder."""
    return digests.hash_slot(F.sha2(F.concat_ws(":", *FAMILY), 256), folds)


def deal_folds(
    groups: DataFrame, seed: int, folds: int, phase: str = DEVELOPMENT_PHASE, within: Sequence[str] = FAMILY,
) -> DataFrame:
    """Deal each family's groups over the folds, largest first, back and forth."""
    keyed = groups.withColumn("__digest", digests.sha256_text(seed, phase, F.col("group_id")))
    ranked = rank_by_digest(keyed, within, "__digest", "group_id", lead=["rows"], rank="__rank", size="__size")
    place = F.col("__rank") - 1
    turn = F.pmod(place, F.lit(folds))
    forward = F.pmod(F.floor(place / folds), F.lit(2)) == 0
    fold = F.when(forward, turn).otherwise(folds - 1 - turn)
    shifted = F.pmod(fold + start_offset(folds), F.lit(folds)).cast("int")
    return ranked.withColumn("validation_fold", shifted).drop("__digest", "__rank", "__size")


def _level_segments(loads: list[int], taken: list[bool], size: int, count: int, offset: int):
    """Order in which ``count`` equal groups fill the least loaded folds.

    Equal groups visit the folds in the order of the sorted values load + j * size. Between
    two points at which another fold joins, that order repeats, so a few
    (first rank, last rank, repeating folds) segments describe any number of groups.
    """
    folds = len(loads)
    key = lambda fold: (taken[fold], loads[fold], (fold - offset) % folds)
    placed, segments = 0, []
    while placed < count:
        order = sorted(range(folds), key=key)
        if not all(taken):
            cycle, steps = [order[0]], 1
        else:
            low, high = loads[order[0]], loads[order[-1]]
            joined = [fold for fold in order if loads[fold] < low + size]
            waiting = [loads[fold] for fold in order if loads[fold] >= low + size]
            rounds = max(1, (min(waiting) - max(loads[fold] for fold in joined)) // size) if waiting else count
            cycle, steps = joined, len(joined) * rounds
        steps = min(steps, count - placed)
        segments.append((placed + 1, placed + steps, cycle))
        for position, fold in enumerate(cycle):
            visits = steps // len(cycle) + (position < steps % len(cycle))
            loads[fold] += visits * size
            taken[fold] = taken[fold] or visits > 0
        placed += steps
    return segments


SEGMENTS = (
    "make string, model string, rows bigint, __first bigint, __last bigint, __cycle array<int>, __loads array<bigint>"
)


def _family_segments(folds: int, fresh: bool):
    """One family's (group size, number of groups) as segments, in folds or, for a fresh split, in turns.

    The last segment also carries what each fold holds in the end.
    """

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        loads, offset = [0] * folds, int(frame["offset"].iloc[0])
        for fold, rows in zip(frame["fold"], frame["rows"]):
            if fold >= 0:
                loads[int(fold)] += int(rows)
        taken, records = [not fresh] * folds, []
        family = [frame[name].iloc[0] for name in FAMILY]
        new = frame[frame["fold"] < 0].sort_values("rows", ascending=False)
        for rows, count in zip(new["rows"], new["groups"]):
            for first, last, cycle in _level_segments(loads, taken, int(rows), int(count), offset):
                records.append([*family, int(rows), first, last, cycle, None])
        if records:
            records[-1][-1] = loads
        return pd.DataFrame(records, columns=[*FAMILY, "rows", "__first", "__last", "__cycle", "__loads"])

    return place


def _family_turns(folds: int):
    """Which fold takes each turn of a family: the one with the fewest rows of all families before it, then the first."""

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [0] * folds
        for batch in batches:
            orders = []
            for loads in batch["__loads"]:
                order = sorted(range(folds), key=lambda fold: (held[fold], fold))
                for turn, fold in enumerate(order):
                    held[fold] += int(loads[turn])
                orders.append(order)
            yield batch[list(FAMILY)].assign(__order=orders)

    return follow


def greedy_folds(
    groups: DataFrame, seed: int, folds: int, phase: str = DEVELOPMENT_PHASE, loads: DataFrame | None = None,
) -> DataFrame:
    """Give each group, largest first, to the family's least loaded fold.

    Empty folds come first. Ties go to the fold with the fewest rows of all families so far, in
    family order, then to the first fold. While folds of a family are level, their order by all rows
    is that of the families before it; so each family is dealt on its own in turns, and a running sum over
    one row per family says which fold takes each turn. That sum is a sequence by nature: one task
    follows it, holding a number per fold.

    ``loads`` holds rows already in each fold (family columns, ``validation_fold``, ``rows``); families
    then start from uneven folds, and ties follow an offset taken from the family's name.

    Only the table of (family, group size, number of groups) reaches the rule; groups are placed by
    joining their rank to its segments. Null families are families like any other.
    """
    keyed = groups.withColumn("__digest", digests.sha256_text(seed, phase, F.col("group_id")))
    ranked = rank_by_digest(keyed, [*FAMILY, "rows"], "__digest", "group_id", rank="__rank", size="__size")
    runs = groups.groupBy(*FAMILY, "rows").agg(F.count(F.lit(1)).alias("groups")).withColumn("fold", F.lit(-1))
    fresh = loads is None
    if not fresh:
        old = loads.select(*FAMILY, "rows", F.lit(0).cast("bigint").alias("groups"), F.col("validation_fold").alias("fold"))
        runs = runs.unionByName(old)
    runs = runs.withColumn("offset", F.lit(0) if fresh else start_offset(folds))
    segments = runs.groupBy(*FAMILY).applyInPandas(_family_segments(folds, fresh), SEGMENTS)
    if fresh:
        segments = StageTables(groups.sparkSession, "fold-segments").write(segments)
        families = segments.where("__loads IS NOT NULL").select(*FAMILY, "__loads")
        in_order = families.repartition(1).sortWithinPartitions(*FAMILY)
        turns = in_order.mapInPandas(_family_turns(folds), "make string, model string, __order array<int>")
        segments = join_null_safe(segments, turns, FAMILY)
    else:
        segments = segments.withColumn("__order", F.sequence(F.lit(0), F.lit(folds - 1)))
    inside = F.col("__rank").between(F.col("__first"), F.col("__last"))
    turn = F.get("__cycle", F.pmod(F.col("__rank") - F.col("__first"), F.size("__cycle")).cast("int"))
    placed = join_null_safe(ranked, segments, [*FAMILY, "rows"]).where(inside)
    return placed.withColumn("validation_fold", F.get("__order", turn)).drop(
        "__digest", "__rank", "__size", "__first", "__last", "__cycle", "__loads", "__order"
    )


def build_splits(
    rows: DataFrame, *, seed: int = 42, test_fraction: float = 0.2, folds: int = 3, mode: str = "deal",
) -> DataFrame:
    """Assignment of every row: group, partition, and fold where it is development."""
    check_config(seed, test_fraction, folds)
    return assign_rows(rows, place_groups(group_table(rows), seed, test_fraction, folds, mode))


def place_groups(groups: DataFrame, seed: int, test_fraction: float, folds: int, mode: str = "deal") -> DataFrame:
    if mode not in ("deal", "greedy"):
        raise ValueError("mode must be deal or greedy")
    reserved = reserve_test(groups, seed, test_fraction).select("group_id", *FAMILY, "rows", "partition")
    if mode == "deal":
        # One ranking serves both partitions; test groups then drop their place in it.
        dealt = deal_folds(reserved, seed, folds, within=[*FAMILY, "partition"])
        kept = F.when(F.col("partition") == DEVELOPMENT, F.col("validation_fold"))
        return dealt.withColumn("validation_fold", kept)
    development = reserved.where(F.col("partition") == DEVELOPMENT)
    test = reserved.where(F.col("partition") == TEST_PARTITION)
    return greedy_folds(development, seed, folds).unionByName(test.withColumn("validation_fold", F.lit(None).cast("int")))


def assign_rows(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """The place of every row; rows without a group id share the place of their (null) group."""
    places = placed.select("group_id", "partition", "validation_fold")
    return join_null_safe(rows.select("listing_id", "group_id"), places, ["group_id"]).select(
        "listing_id", "group_id", "partition", "validation_fold"
    )


def splittable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of groups that can keep or get one place, and the refused groups with a reason.

    A group is refused for a quarantined member, for several families, for several historical
    places, or for having no id. Nothing is dropped: every group is on one of the two sides.
    """
    family, place = F.struct(*FAMILY), F.concat_ws(":", "historical_partition", "historical_validation_fold")
    groups = rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_or(F.col("historical_partition") == QUARANTINED).alias("__quarantined"),
        (F.min(family) != F.max(family)).alias("__families"), (F.min(place) != F.max(place)).alias("__places"),
    )
    reason = F.when(F.col("group_id").isNull(), F.lit("no_group")).when(F.col("__quarantined"), F.lit("quarantined_history")).when(F.col("__families"), F.lit("several_families")).when(
        F.col("__places"), F.lit("several_locations"))
    judged = groups.select("group_id", "rows", reason.alias("reason"))
    return rows.join(judged.where("reason IS NULL"), "group_id", "left_semi"), judged.where("reason IS NOT NULL")


def continued_splits(
    rows: DataFrame, *, seed: int = 42, test_fraction: float = 0.2, folds: int = 3,
    policy: str = "reserve_by_family", mode: str = "deal",
) -> DataFrame:
    """Keep every historical location and place only new groups.

    ``reserve_by_family`` splits the new groups like a fresh population;
    ``development_only`` adds them to the folds and never to the test. Rows need
    ``historical_partition`` and ``historical_validation_fold``; quarantined rows are left
    to ``history_violations``.
    """
    check_config(seed, test_fraction, folds)
    if policy not in ("reserve_by_family", "development_only"):
        raise ValueError("Unknown policy for new groups")
    new = rows.where(F.col("historical_partition") == NEW)
    old = rows.where(~F.col("historical_partition").isin(NEW, QUARANTINED)).select(
        "listing_id", "group_id", F.col("historical_partition").alias("partition"),
        F.col("historical_validation_fold").cast("int").alias("validation_fold"), *FAMILY,
    )
    if policy == "reserve_by_family":
        placed = place_groups(group_table(new), seed, test_fraction, folds, mode)
    else:
        groups = group_table(new)
        if mode == "deal":
            placed = deal_folds(groups, seed, folds, REVIEWED_PHASE)
        else:
            loads = old.where(F.col("partition") == DEVELOPMENT).groupBy(*FAMILY, "validation_fold").agg(
                F.count(F.lit(1)).alias("rows")
            )
            placed = greedy_folds(groups, seed, folds, REVIEWED_PHASE, loads)
        placed = placed.withColumn("partition", F.lit(DEVELOPMENT))
    return old.drop(*FAMILY).unionByName(assign_rows(new, placed))


def history_violations(rows: DataFrame) -> DataFrame:
    """Groups whose rows remember two locations, and rows still in quarantine."""
    old = rows.where(F.col("historical_partition") != NEW)
    located = F.struct("historical_partition", F.coalesce("historical_validation_fold", F.lit(-1)))
    mixed = (
        old.groupBy("group_id").agg((F.min(located) != F.max(located)).alias("mixed"))
        .where("mixed").select("group_id", F.lit("conflicting_historical_locations").alias("violation"))
    )
    held = old.where(F.col("historical_partition") == QUARANTINED).select(
        "group_id", F.lit("quarantined_history").alias("violation")
    ).distinct()
    return mixed.unionByName(held)


def split_violations(rows: DataFrame, assignments: DataFrame, folds: int) -> DataFrame:
    """Every breach of the split contract as (violation, item); empty for a sound split."""
    def breach(df: DataFrame, name: str, item: Column | str) -> DataFrame:
        column = F.col(item) if isinstance(item, str) else item
        return df.select(F.lit(name).alias("violation"), column.cast("string").alias("item"))

    located = F.concat_ws(":", "partition", F.col("validation_fold").cast("string"))
    fold_valid = F.coalesce(F.col("validation_fold").between(0, folds - 1), F.lit(False))
    partition_valid = F.when(F.col("partition") == TEST_PARTITION, F.col("validation_fold").isNull()).when(
        F.col("partition") == DEVELOPMENT, fold_valid
    ).otherwise(False)
    expected = rows.select("listing_id", F.col("group_id").alias("__group"), *FAMILY)
    joined = assignments.join(expected, "listing_id")
    family = F.concat_ws(" ", *FAMILY)
    repeated = lambda df: df.groupBy("listing_id").count().where("count > 1")
    places = joined.select(family.alias("family"), located.alias("place")).distinct()
    parts = [
        breach(repeated(rows), "duplicate_row", "listing_id"),
        breach(repeated(assignments), "duplicate_assignment", "listing_id"),
        breach(rows.join(assignments, "listing_id", "left_anti"), "omitted_row", "listing_id"),
        breach(assignments.join(rows, "listing_id", "left_anti"), "unknown_row", "listing_id"),
        breach(joined.where(F.col("group_id") != F.col("__group")), "regrouped_row", "listing_id"),
        breach(assignments.where(~F.coalesce(partition_valid, F.lit(False))), "invalid_location", "listing_id"),
        breach(
            assignments.groupBy("group_id").agg((F.min(located) != F.max(located)).alias("b")).where("b"),
            "group_leakage", "group_id",
        ),
        breach(
            rows.groupBy("group_id").agg((F.min(F.struct(*FAMILY)) != F.max(F.struct(*FAMILY))).alias("b")).where("b"),
            "cross_family_group", "group_id",
        ),
        breach(places.groupBy("family").count().where(F.col("count") != folds + 1), "family_missing_location", "family"),
    ]
    return reduce(DataFrame.unionByName, parts)


def split_counts(rows: DataFrame, assignments: DataFrame) -> DataFrame:
    """Rows and groups by family, partition and fold."""
    return (
        assignments.join(rows.select("listing_id", *FAMILY), "listing_id")
        .groupBy(F.concat_ws(" ", *FAMILY).alias("family"), "partition", "validation_fold")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("group_id").alias("groups"))
    )


def partition_overlap(assignments: DataFrame) -> DataFrame:
    """Ids and groups that appear in both test and development; must be empty."""
    def shared(column: str) -> DataFrame:
        test = assignments.where(F.col("partition") == TEST_PARTITION).select(F.col(column).cast("string").alias("item"))
        kept = assignments.where(F.col("partition") == DEVELOPMENT).select(F.col(column).cast("string").alias("item"))
        return test.intersect(kept).select(F.lit(column).alias("kind"), "item")

    return shared("listing_id").unionByName(shared("group_id"))


def fold_roles(assignments: DataFrame, folds: int) -> DataFrame:
    """Each development row once per fold, as training or validation row of that fold."""
    every = F.array(*[F.lit(fold) for fold in range(folds)])
    development = assignments.where(F.col("partition") == DEVELOPMENT)
    role = F.when(F.col("validation_fold") == F.col("fold"), F.lit("validation")).otherwise(F.lit("train"))
    return development.withColumn("fold", F.explode(every)).select(
        "fold", role.alias("role"), "listing_id", "group_id"
    )


def fold_leaks(assignments: DataFrame) -> DataFrame:
    """Groups with rows in more than one fold would sit on both sides of a fit."""
    return (
        assignments.where(F.col("partition") == DEVELOPMENT)
        .groupBy("group_id").agg(F.min("validation_fold").alias("low"), F.max("validation_fold").alias("high"))
        .where("low <> high").select("group_id")
    )
