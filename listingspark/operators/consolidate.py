"""One row per listing out of repeated observations, without losing evaluation history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import DEVELOPMENT, SPEC_FIELDS
from ..functions import reasons
from ..session import StageTables
from .components import component_labels

# Reasons and partition names of consolidated rows.
HISTORY_CONFLICT = "historical_development_test_group_conflict"
TIE_CONFLICT = "newest_observations_disagree"
FAMILY_CONFLICT = "cross_batch_family_conflict"
QUARANTINED = "quarantined"
NEW = "new"

# What tied newest observations must agree on.
COMPARED_FIELDS = (*SPEC_FIELDS, "price_pkr", "source_checked_candidate")
_SEPARATOR = "\x1f"


def link_key(fields: Sequence[str]) -> Column:
    """Digest of all fields, or null where one of them is missing."""
    complete = F.lit(True)
    for name in fields:
        complete = complete & F.col(name).isNotNull()
    joined = F.concat_ws(_SEPARATOR, *[F.col(name).cast("string") for name in fields])
    return F.when(complete, F.sha2(joined, 256))


def with_batch(batches: dict[str, DataFrame], batch: str = "source_batch") -> DataFrame:
    """Stack batches by column name and remember where each row came from."""
    stacked = None
    for name, rows in batches.items():
        marked = rows.withColumn(batch, F.lit(name))
        stacked = marked if stacked is None else stacked.unionByName(marked)
    if stacked is None:
        raise ValueError("No batches to combine")
    return stacked


def latest_observations(
    observations: DataFrame, *, id: str = "listing_id", time: str = "collected_at",
    batch: str = "source_batch", family: Sequence[str] = ("make", "model"),
    compared: Sequence[str] = COMPARED_FIELDS, within: Sequence[str] = (),
) -> DataFrame:
    """The newest row of every id; the smallest batch wins a tie.

    ``within`` names columns that the id determines: rows that already lie together by these are not
    sent anew.

    One aggregation with map-side combining yields the chosen row together with the number
    of observations, their batches, whether the family changed between versions and whether
    tied newest rows disagree, so an id with very many versions costs no sort.
    """
    newest_first = -F.unix_micros(F.col(time).cast("timestamp"))
    rest = [name for name in observations.columns if name not in (id, time, batch)]
    compared = [name for name in compared if name in observations.columns]
    differing = [F.col(name) for name in compared]
    grouped = observations.groupBy(id, *within).agg(
        F.min(F.struct(newest_first.alias("__age"), batch, time, *[name for name in rest if name not in within])).alias("__row"),
        F.count(F.lit(1)).alias("observation_count"),
        F.array_join(F.array_sort(F.collect_set(batch)), ";").alias("observation_batches"),
        (F.min(F.struct(*family)) != F.max(F.struct(*family))).alias("family_changed"),
        F.min(F.struct(newest_first.alias("a"), *differing)).alias("__least"),
        F.max(F.struct((-newest_first).alias("a"), *differing)).alias("__most"),
    )
    agree = F.lit(True)
    for name in compared:
        agree = agree & F.col(f"__least.{name}").eqNullSafe(F.col(f"__most.{name}"))
    return grouped.select(
        id, f"__row.{time}", f"__row.{batch}", *[name if name in within else f"__row.{name}" for name in rest],
        "observation_count", "observation_batches", "family_changed", (~agree).alias("tie_conflict"),
    )


def tie_conflicts(latest: DataFrame, id: str = "listing_id") -> DataFrame:
    """Ids whose newest observations share a time and disagree; a dataset must have none."""
    return latest.where("tie_conflict").select(id, "collected_at", "observation_count")


def history_links(
    observations: DataFrame, history: DataFrame, *, id: str = "listing_id", fields: Sequence[str] = SPEC_FIELDS,
    within: Sequence[str] = (),
) -> DataFrame:
    """Link keys of every version of every id, and of its historical group.

    Observations are read once: their ids and keys are written, and known ids come from those.
    Keys are the first 16 bytes of digests. ``within`` is that of ``latest_observations``.
    """
    stages = StageTables(observations.sparkSession, "versions")
    short = lambda digest: F.unhex(F.left(digest, F.lit(32)))
    specs = stages.write(observations.select(*within, id, short(link_key(fields)).alias("link")).distinct().drop(*within))
    group = short(F.sha2(F.concat(F.lit("history:"), "group_id"), 256))
    groups = stages.write(history.join(specs.select(id), id, "left_semi").select(id, group.alias("link")))
    return specs.unionByName(groups)


def _group_id() -> Column:
    """The group of a component: its smallest member and the number of all."""
    return F.when(F.col("members") == 1, F.concat(F.lit("listing_"), "component")).otherwise(
        F.concat(F.lit("linked_"), F.sha2(F.concat_ws(":", "component", "members"), 256))
    )


def component_verdicts(labels: DataFrame, history: DataFrame, *, id: str = "listing_id") -> DataFrame:
    """Per component: members, group id, historical partition and fold.

    A component whose members were seen in two partitions is quarantined.
    """
    placed = labels.join(history.select(id, "partition", "validation_fold"), id, "left")
    development = F.when(F.col("partition") == DEVELOPMENT, F.col("validation_fold"))
    grouped = placed.groupBy("component").agg(
        F.count(F.lit(1)).alias("members"),
        F.min("partition").alias("__first"),
        F.max("partition").alias("__last"),
        F.min(development).alias("__fold"),
    )
    conflict = F.coalesce(F.col("__first") != F.col("__last"), F.lit(False))
    return grouped.select(
        "component", "members", _group_id().alias("group_id"),
        F.when(conflict, F.lit(QUARANTINED)).otherwise(F.coalesce("__first", F.lit(NEW))).alias("historical_partition"),
        F.when(~conflict, F.col("__fold")).alias("historical_validation_fold"),
    )


def consolidate_observations(
    observations: DataFrame, history: DataFrame, *, id: str = "listing_id",
    fields: Sequence[str] = SPEC_FIELDS, compared: Sequence[str] = COMPARED_FIELDS, within: Sequence[str] = (),
) -> DataFrame:
    """Latest row per id with its component's group, history and added exclusion reasons.

    Links are drawn over all versions before the latest row is chosen, so a changed mileage
    cannot cut a listing off from its earlier group. An id whose newest observations disagree
    is no candidate. ``within`` is that of ``latest_observations``.
    """
    labels = component_labels(history_links(observations, history, id=id, fields=fields, within=within), id, "link", written=True)
    labels = StageTables(observations.sparkSession, "labels").write(labels)
    # The long names of groups are made where the rows are, not sent there.
    placed = labels.join(component_verdicts(labels, history, id=id).drop("group_id"), "component")
    rows = latest_observations(observations, id=id, compared=compared, within=within).drop("group_id").join(placed, id)
    rows = rows.withColumn("group_id", _group_id()).drop("component", "members")
    combined = reasons.add(
        F.col("exclusion_reasons"),
        F.when(F.col("historical_partition") == QUARANTINED, F.lit(HISTORY_CONFLICT)),
        F.when(F.col("family_changed"), F.lit(FAMILY_CONFLICT)),
        F.when(F.col("tie_conflict"), F.lit(TIE_CONFLICT)),
    )
    rows = rows.withColumn("exclusion_reasons", combined)
    clean = F.col("exclusion_reasons") == ""
    return rows.withColumns({
        "modeling_candidate": F.col("modeling_candidate") & clean,
        "source_checked_candidate": F.col("source_checked_candidate") & clean,
    })


def decision_ledger(rows: DataFrame, *, id: str = "listing_id") -> DataFrame:
    """What was selected for every id, and why it may be excluded."""
    return rows.select(
        id, F.col("source_batch").alias("selected_batch"), F.col("collected_at").alias("selected_collected_at"),
        F.col("observation_count").alias("observations"), "group_id", "historical_partition", "exclusion_reasons",
    )
