"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import StageTables

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the checkpoint folder and read back."""
    return StageTables(df.sparkSession, name).write(df)


def digest(column: str | Column) -> list[Column]:
    """Two 64-bit hashes of one value, seeded apart: a 128-bit name for equal values."""
    c = F.col(column) if isinstance(column, str) else column
    return [F.xxhash64(c), F.xxhash64(F.lit(7), c)]


def ranked(distinct: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """``distinct`` rows with a number that follows the order of ``keys``, without a global sort in one task.

    A range shuffle puts smaller keys into earlier partitions, and row numbers that begin with
    the partition's number rise from one partition to the next.
    """
    ordered = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.withColumn(rank, F.monotonically_increasing_id())


def numbered(df: DataFrame, keys: Sequence[str], number: str, name: str) -> DataFrame:
    """``df`` with gapless row numbers in the order of ``keys``.

    Only the row counts of the partitions reach the driver, one number each.
    """
    placed = staged(ranked(df, keys, "__place"), name)
    part = F.shiftright("__place", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    if not offsets:
        return placed.withColumn(number, F.lit(0).cast("long")).drop("__place")
    shift = F.create_map(*[F.lit(x).cast("long") for pair in offsets for x in pair])
    index = F.element_at(shift, part.cast("long")) + F.col("__place") - F.shiftleft(part, 33)
    return placed.withColumn(number, index).drop("__place")
