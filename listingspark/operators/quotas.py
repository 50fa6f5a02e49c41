"""Collection quotas: what a discovery run selects, and how far each group has come."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import digests
from ..functions.text import is_present, squash
from .metrics import side_by_side

# Selection outcomes and the group of rows no quota claims.
DUPLICATE, ALREADY_COMPLETE, REFRESH, NEW = "duplicate", "already_complete", "refresh", "new"
UNMATCHED = "unmatched"


# Positions of one range of a search queue.
QUEUE_RANGE = 1024
# Ranges of candidates without a position, after every position.
_UNPLACED = 1 << 50


@dataclass(frozen=True)
class Quota:
    """A named group, the family it expects (or any), and its limits."""

    name: str
    target: int
    budget: int
    make: str | None = None
    model: str | None = None

    def __post_init__(self):
        if not re.fullmatch(r"[a-z][a-z0-9_]*", self.name):
            raise ValueError("Quota names are lower-case identifiers")
        if (self.make is None) != (self.model is None) or "" in ((self.make or "x").strip(), (self.model or "x").strip()):
            raise ValueError(f"{self.name}: give both make and model, or neither")
        if any(type(value) is not int or value < 1 for value in (self.target, self.budget)):
            raise ValueError(f"{self.name}: target and budget are positive integers")

    def matches(self) -> Column:
        """Whether a row's make and model are the expected ones, in any case."""
        if self.make is None:
            return F.lit(True)
        same = lambda name, value: F.coalesce(F.lower(squash(F.col(name))) == value.strip().lower(), F.lit(False))
        return same("make", self.make) & same("model", self.model)


def check_plan(quotas: Sequence[Quota]) -> Sequence[Quota]:
    if not quotas or len({quota.name for quota in quotas}) != len(quotas):
        raise ValueError("A plan needs at least one quota, with unique names")
    return quotas


def _by_group(quotas: Sequence[Quota], value) -> Column:
    """Per-group constant of a row, by its ``search_group``."""
    chosen = F.lit(None)
    for quota in quotas:
        chosen = F.when(F.col("search_group") == quota.name, F.lit(value(quota))).otherwise(chosen)
    return chosen


def assign_groups(rows: DataFrame, quotas: Sequence[Quota]) -> DataFrame:
    """Add the first quota each stored row matches; the plan becomes one expression, not a join."""
    check_plan(quotas)
    group = F.coalesce(*[F.when(quota.matches(), F.lit(quota.name)) for quota in quotas], F.lit(UNMATCHED))
    return rows.withColumn("search_group", group)


def quota_progress(rows: DataFrame, quotas: Sequence[Quota]) -> DataFrame:
    """Complete, assigned and matching rows of every quota, beside its target."""
    counts = rows.agg(*[
        F.count_if(
            (F.col("parse_status") == "complete") & (F.col("search_group") == quota.name) & quota.matches()
        ).alias(quota.name) for quota in check_plan(quotas)
    ])
    entries = F.array(*[
        F.struct(
            F.lit(quota.name).alias("search_group"), F.col(quota.name).alias("complete_rows"),
            F.lit(quota.target).cast("bigint").alias("target"), (F.col(quota.name) >= quota.target).alias("reached"),
        ) for quota in quotas
    ])
    return counts.select(F.explode(entries).alias("e")).select("e.*")


def discovery_outcomes(discovered: DataFrame, saved: DataFrame, *, refresh: bool = False) -> DataFrame:
    """Outcome of each discovered URL; only an id's first appearance can be fetched.

    ``discovered`` holds (listing_id, url, position, ...) with unique positions; ``saved``
    holds (listing_id, url, parse_status), one row per id. ``replaces_url`` names the saved
    address an id moved away from.
    """
    first = discovered.groupBy("listing_id").agg(F.min("position").alias("__first"))
    stored = saved.select("listing_id", F.col("url").alias("__url"), F.col("parse_status").alias("__status"))
    joined = discovered.join(first.join(stored, "listing_id", "left"), "listing_id")
    known = F.col("__status").isNotNull()
    skip = (F.col("__status") == "complete") & F.lit(not refresh)
    outcome = (
        F.when(F.col("position") != F.col("__first"), F.lit(DUPLICATE)).when(known & skip, F.lit(ALREADY_COMPLETE))
        .when(known, F.lit(REFRESH)).otherwise(F.lit(NEW))
    )
    moved = F.when(known & (F.col("__url") != F.col("url")) & (F.col("position") == F.col("__first")), F.col("__url"))
    return joined.withColumns({"outcome": outcome, "replaces_url": moved}).drop("__first", "__url", "__status")


def select_for_quotas(candidates: DataFrame, quotas: Sequence[Quota], total_budget: int, already: dict[str, int] | None = None) -> DataFrame:
    """Which candidates a round-robin run fetches, and in which round.

    Groups take turns in plan order, each in discovery order, until the group's target of
    complete matching rows or its budget is reached, and until the total budget is spent.
    ``candidates`` hold (search_group, position, listing_id, complete, matches), one row per
    id. A group's queue is cut into ranges of positions whose rows are counted first, so
    ranges beyond the largest budget are never moved and no budget makes one task order a
    whole group. Candidates without a position come last, in the order of their id's digest.
    """
    check_plan(quotas)
    if total_budget < 1:
        raise ValueError("total_budget must be positive")
    most = max(quota.budget for quota in quotas)
    hit = (F.col("complete") & F.col("matches")).cast("int")
    digest = F.md5(F.col("listing_id").cast("string"))
    unplaced = _UNPLACED + F.conv(F.substring(digest, 1, 3), 16, 10).cast("bigint")
    known = candidates.where(F.col("search_group").isin(*[quota.name for quota in quotas])).withColumns({
        "__range": F.coalesce(F.floor(F.col("position") / QUEUE_RANGE), unplaced), "__digest": digest})
    ahead = W.partitionBy("search_group").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    counted = known.groupBy("search_group", "__range").agg(F.count(F.lit(1)).alias("__n"), F.sum(hit).alias("__hits"))
    ranges = counted.select(
        "search_group", "__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__rows"),
        F.coalesce(F.sum("__hits").over(ahead), F.lit(0)).alias("__done"),
    ).where(F.col("__rows") < most)
    queue = W.partitionBy("search_group", "__range").orderBy(F.asc_nulls_last("position"), "__digest")
    before = queue.rowsBetween(W.unboundedPreceding, -1)
    joined = known.join(ranges, ["search_group", "__range"])
    ranked = joined.withColumn("round", (F.col("__rows") + F.row_number().over(queue)).cast("int")).where(F.col("round") <= most)
    fulfilled = F.col("__done") + F.coalesce(F.sum(hit).over(before), F.lit(0))
    start = _by_group(quotas, lambda quota: (already or {}).get(quota.name, 0))
    open_ = (F.col("round") <= _by_group(quotas, lambda quota: quota.budget)) & (
        start + F.col("__fulfilled") < _by_group(quotas, lambda quota: quota.target)
    )
    taken = ranked.withColumn("__fulfilled", fulfilled).where(open_)
    order = {quota.name: place for place, quota in enumerate(quotas)}
    turn = _by_group(quotas, lambda quota: order[quota.name])
    return taken.withColumn("__turn", turn).orderBy("round", "__turn").limit(total_budget).drop(
        "__fulfilled", "__turn", "__range", "__rows", "__done", "__digest")


def batch_summary(rows: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """Rows, complete rows, distinct ids and present values of a stored batch."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("parse_status") == "complete").alias("complete_rows"),
        *[F.count_if(is_present(F.col(name))).alias(f"present_{name}") for name in fields],
    )
    ids = rows.where(is_present(F.col("listing_id"))).agg(F.count_distinct("listing_id").alias("unique_listing_ids"))
    return side_by_side(counts, ids)


RUN_LOG_SCHEMA = (
    "run_id string, requests array<struct<kind:string,outcome:string>>, selections array<struct<url:string,outcome:string>>"
)


def run_log_counts(logs: DataFrame) -> DataFrame:
    """Requests by kind and by outcome, and selections by outcome, over all run logs."""
    entry = lambda measure, value: F.struct(F.lit(measure).alias("measure"), value.alias("value"))
    requests = F.flatten(F.transform(
        F.coalesce("requests", F.array().cast("array<struct<kind:string,outcome:string>>")),
        lambda r: F.array(entry("request_kind", r["kind"]), entry("request_outcome", r["outcome"])),
    ))
    selections = F.transform(
        F.coalesce("selections", F.array().cast("array<struct<url:string,outcome:string>>")),
        lambda s: entry("selection_outcome", s["outcome"]),
    )
    return logs.select(F.explode(F.concat(requests, selections)).alias("e")).select("e.*").groupBy("measure", "value").agg(
        F.count(F.lit(1)).alias("count")
    )


def retained_pages(pages: DataFrame, *, first: int = 50) -> DataFrame:
    """Pages worth keeping: flagged ones, the first complete ones of a run, and a 1 in 10 sample.

    ``pages`` hold (run_id, listing_id, position, complete, flagged) with positions unique in
    a run. Only the bounded head of each run is ranked; it yields one cut-off per run.
    """
    head = W.partitionBy("run_id").orderBy("position")
    ranked = pages.where("complete").select("run_id", "position").withColumn("__rank", F.row_number().over(head))
    cutoff = ranked.where(F.col("__rank") <= first).groupBy("run_id").agg(F.max("position").alias("__cutoff"))
    joined = pages.join(cutoff, "run_id", "left")
    sampled = digests.digest_mod_10(digests.sha256_text(F.col("run_id"), F.col("listing_id"))) == 0
    early = F.coalesce(F.col("complete") & (F.col("position") <= F.col("__cutoff")), F.lit(False))
    flagged = F.col("flagged") | ~F.col("complete")
    reason = F.when(flagged, F.lit("flagged")).when(early, F.lit("early")).when(sampled, F.lit("sampled"))
    return joined.withColumn("kept_because", reason).where("kept_because IS NOT NULL").drop("__cutoff")
