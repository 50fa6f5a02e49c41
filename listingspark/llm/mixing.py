"""Mixing sources to target weights with hash thresholds.

Every document has a place between 0 and 1 from a hash of its id. The words of each source are
summed by hash bucket; the bucket in which the budget ends is found from running sums and only that
one is summed again by finer bits, until the threshold is exact to 48 bits. Documents below the
threshold are taken: a filter, without sorting documents. Thresholds are nested, so a larger
budget keeps every document of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import StageTables
from .base import WORD

LEVELS, LEVEL_BITS = 4, 12
MOST_REPEATS = 2


def words(text: str | Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """source, source_size, target for a table of source and its words.

    Sources in the order of their code points, null last, weigh ``weights`` in turn and share
    ``share`` times all words. A target above twice its source is cut there and the excess is
    shared again by weight, which ends where target = min(weight * level, 2 * size); the level is
    found from running sums over the sources in the order in which they fill up.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    place = F.row_number().over(order) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * float(MOST_REPEATS)
    full = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = (
        weighed.withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
    )
    # The first source in this order that does not fill up sets the level for itself and all after it.
    level = F.first(F.when(F.col("level") * F.col("weight") <= cap, F.col("level")), ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, 0))
    return filled.withColumn("final", level).select("source", "source_size", F.coalesce(F.col("final") * F.col("weight"), cap).alias("target"))


def _place(doc_id: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col(doc_id)), 64 - LEVELS * LEVEL_BITS)


def _repeats(rows: DataFrame, limits: DataFrame, source: str) -> tuple[DataFrame, Column]:
    joined = rows.join(limits, F.col(source).eqNullSafe(F.col("__s")))
    return joined, F.least(F.lit(MOST_REPEATS), F.col("__whole") + (F.col("__place") < F.col("__limit")).cast("int"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, repeats, taken.

    See ``thresholds`` for the rule.
    """
    narrow, limits = thresholds(docs, doc_id=doc_id, text=text, source=source)
    out, repeats = _repeats(narrow, limits, "source")
    return out.withColumn("repeats", repeats).select(
        "doc_id", "source", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "repeats",
        (F.col("size") * F.col("repeats")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with the column ``repeats`` (an own column of that name is replaced); all rows stay."""
    _, limits = thresholds(docs, doc_id=doc_id, text=text, source=source)
    out, repeats = _repeats(docs.withColumn("__place", _place(doc_id)), limits, source)
    return out.withColumn("repeats", repeats).select(*[c for c in docs.columns if c != "repeats"], "repeats")


def thresholds(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Narrow document rows (doc_id, source, size, __place) and, by source, __whole repeats and the __limit of one more.

    A source whose target is k times its size and a rest has every document k times, and those
    below the threshold of the rest once more. Rows of one id share their place, so repeated
    rows are taken alike; rows without words cost nothing and follow the same rule. Null ids
    share one place.
    """
    stages = StageTables(docs.sparkSession, "mixing")
    narrow = stages.write(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), _place(doc_id).alias("__place")))
    targets = stages.write(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"))))
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size > 0, F.least(F.lit(MOST_REPEATS), F.floor(target / F.greatest(size, F.lit(1)) + 1e-12))).otherwise(0).cast("int")
    open_ = stages.write(targets.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), target - F.col("whole") * size)).withColumn("prefix", F.lit(0).cast("long")))
    for level in range(LEVELS):
        below = (LEVELS - level) * LEVEL_BITS
        fine = below - LEVEL_BITS
        there = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("__place", below) == F.col("prefix"))
        inside = narrow.join(open_.select(F.col("source").alias("s"), "prefix"), there)
        summed = inside.groupBy("s", F.shiftright("__place", fine).alias("bucket")).agg(F.sum("size").alias("n"))
        order = Window.partitionBy("s").orderBy("bucket")
        running = summed.withColumn("upto", F.sum("n").over(order)).withColumn("from", F.col("upto") - F.col("n"))
        joined = running.join(open_, F.col("s").eqNullSafe(F.col("source")))
        # The bucket in which the rest ends, and what is left for it.
        chosen = joined.where(F.col("upto") > F.col("rest")).groupBy("s").agg(F.min(F.struct("bucket", "from")).alias("b"))
        moved = open_.join(chosen.withColumnRenamed("s", "t"), F.col("source").eqNullSafe(F.col("t")), "left")
        # Where nothing reaches beyond the rest, everything below the next prefix is taken.
        past = F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)
        open_ = stages.write(
            moved.select(
                "source", "source_size", "target", "whole",
                F.greatest(F.lit(0.0), F.col("rest") - F.coalesce(F.col("b.from"), F.lit(0).cast("long"))).alias("rest"),
                F.coalesce(F.col("b.bucket"), past).alias("prefix"), F.col("b").isNotNull().alias("cut"),
            )
        )
    # What is left goes to the documents at the threshold itself when most of them fits.
    at = narrow.join(open_.select(F.col("source").alias("s"), "prefix"), (F.col("source").eqNullSafe(F.col("s"))) & (F.col("__place") == F.col("prefix")))
    edge = at.groupBy("s").agg(F.sum("size").alias("edge"))
    limits = stages.write(open_.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"),
        (F.col("prefix") + F.when(F.col("rest") * 2 >= F.coalesce("edge", F.lit(0)), 1).otherwise(0)).alias("__limit"),
    ))
    return narrow, limits
