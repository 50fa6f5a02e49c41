"""CSV records with line breaks inside quoted values, read in blocks instead of whole files.

Whether a line begins a record depends on all quotes before it in its file. Only a sum per block
has to be known of what lies before the block, so large files stay split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import StageTables


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the block), place (rises within a block), value and quotes of every line below ``path``."""
    value = F.regexp_replace("value", "\r$", "")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"), value.alias("value"),
    )
    return lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))


def quoted_blocks(lines: DataFrame) -> DataFrame:
    """file, start, opened: whether each block begins inside a quoted value; ``header`` of a file's first block.

    ``closed`` is false for every block of a file that ends inside a quoted value.
    """
    first = F.min_by("value", F.when(F.col("start") == 0, F.col("place")))
    blocks = lines.groupBy("file", "start").agg(F.sum("quotes").alias("quotes"), first.alias("header"))
    file = W.partitionBy("file")
    before = file.orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return blocks.select(
        "file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("opened"),
        F.when(F.col("start") == 0, F.regexp_replace("header", "^﻿", "")).alias("header"),
        (F.sum("quotes").over(file) % 2 == 0).alias("closed"),
    )


def _labelled(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines after each header with ``begins`` and ``ends`` of a record, and the record's first place in the block."""
    block = W.partitionBy("file", "start").orderBy("place")
    joined = lines.join(blocks.select("file", "start", "opened"), ["file", "start"])
    seen = F.col("opened").cast("int") + F.sum("quotes").over(block.rowsBetween(W.unboundedPreceding, 0))
    marked = joined.withColumns({
        "ends": seen % 2 == 0, "begins": (seen - F.col("quotes")) % 2 == 0, "header": (F.col("start") == 0) & (F.row_number().over(block) == 1)})
    begun = F.last(F.when(F.col("begins"), F.col("place")), ignorenulls=True).over(block.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("begun", begun).where(~F.col("header")).select("file", "start", "place", "value", "begins", "ends", "begun")


def quoted_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Text of each record below ``path``, headers left out, as ``record``; and the blocks of the files.

    Quotes stand around values only and are doubled inside them. Lines that are whole records,
    most of them, are never grouped; the others are joined by their record, across blocks too. Blank
    lines between records do not count. The text is read twice: for one sum a block, and for the
    labelled lines, which are written once.
    """
    stages = StageTables(spark, "quoted")
    lines = text_lines(spark, path)
    blocks = stages.write(quoted_blocks(lines))
    labelled = stages.write(_labelled(lines, blocks))
    single = F.col("begins") & F.col("ends")
    whole = labelled.where(single & (F.trim("value") != "")).select(F.col("value").alias("record"))
    parts = labelled.where(~single)
    # The last record begun in a block goes on into the next blocks, up to the one that begins another.
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    begun = F.struct(F.col("start").alias("b"), F.col("last").alias("p"))
    lasts = labelled.groupBy("file", "start").agg(F.max("begun").alias("last"))
    carried = lasts.select("file", "start", F.last(F.when(F.col("last").isNotNull(), begun), ignorenulls=True).over(before).alias("carried"))
    keyed = parts.join(carried, ["file", "start"]).withColumn("key", F.when(F.col("begun").isNotNull(), _key("start", "begun")).otherwise(F.col("carried")))
    joined = F.array_sort(F.collect_list(F.struct("start", "place", "value")))
    text = F.array_join(F.transform(joined, lambda line: line["value"]), "\n")
    return whole.unionByName(keyed.groupBy("file", "key").agg(text.alias("record")).select("record")), blocks


def _key(start: str, begun: str) -> Column:
    return F.struct(F.col(start).alias("b"), F.col(begun).alias("p"))
