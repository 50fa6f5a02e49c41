"""Repeated line runs, found with a suffix array over line ids and deleted in later copies.

The corpus is read as sequences of line ids. Prefix doubling names the suffixes by their first
1, 2, 4, ... lines: the name of a longer prefix is the rank of the pair of names of its halves, and
only suffixes whose prefix occurs twice stay in the next round. Suffixes of one name are one
interval of the suffix array with at least that common prefix, so a run of any length is named by
two overlapping prefixes. Doubling ends at the shortest length that makes every run of
``min_words`` words: each deeper interval lies inside one of those, and the union of their
windows is the union of all maximal repeated runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import StageTables
from .base import digest, ranked

DOC = ["__doc", "__dig"]


def _words(line: Column) -> Column:
    """Words of a trimmed line, counted by the blanks between them."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def line_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The lines of each text that are not blank: document, place among them, place in the text, id, words."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("at")))
    per_doc = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("__doc"), F.xxhash64(F.col(text)).alias("__dig"),
        F.filter(lines, lambda x: x["line"] != "").alias("lines"),
    )
    each = per_doc.select(*DOC, F.posexplode("lines").alias("seq", "l"))
    h1, h2 = digest(F.col("l.line"))
    return each.select(*DOC, "seq", F.col("l.at").alias("at"), h1.alias("h1"), h2.alias("h2"), _words(F.col("l.line")).alias("words"))


def _names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Suffixes whose ``keys`` occur in more than one place, with the rank of the keys as their name."""
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys)
    return rows.join(ranked(repeated, keys, "name"), keys).drop(*keys)


def _windows(names: DataFrame, min_words: int) -> DataFrame:
    """Shortest runs of named lines with ``min_words`` words from every start and to every end.

    Lines are laid along the number of words before and after them, so that the first line that
    completes a run is the smallest one at or beyond a mark.
    """
    by_doc = Window.partitionBy(*DOC).orderBy("seq")
    island = names.withColumn("isle", F.col("seq") - F.row_number().over(by_doc))
    so_far = Window.partitionBy(*DOC, "isle").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = island.withColumn("after", F.sum("words").over(so_far)).withColumn("before", F.col("after") - F.col("words"))
    own = [*DOC, "isle", "seq"]
    marks = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("after").alias("key")),
        F.struct(F.lit(1).alias("kind"), (F.col("before") + min_words).alias("key")),
        F.struct(F.lit(2).alias("kind"), F.col("before").alias("key")),
        F.struct(F.lit(3).alias("kind"), (F.col("after") - min_words).alias("key")),
    )
    events = placed.select(*own, F.explode(marks).alias("m")).select(*own, "m.kind", "m.key")
    isle = Window.partitionBy(*DOC, "isle")
    running = (Window.unboundedPreceding, 0)
    ends = F.min(F.when(F.col("kind") == 0, F.col("seq"))).over(isle.orderBy(F.desc("key"), "kind", "seq").rowsBetween(*running))
    starts = F.max(F.when(F.col("kind") == 2, F.col("seq"))).over(isle.orderBy("key", "kind", "seq").rowsBetween(*running))
    forward = events.where("kind < 2").withColumn("end", ends).where("kind = 1 AND end IS NOT NULL").select(*DOC, F.col("seq").alias("start"), "end")
    backward = events.where("kind > 1").withColumn("start", starts).where("kind = 3 AND start IS NOT NULL").select(*DOC, "start", F.col("seq").alias("end"))
    return forward.unionByName(backward).distinct().select(*DOC, "start", (F.col("end") - F.col("start") + 1).alias("size"))


def repeated_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = 10) -> DataFrame:
    """Maximal line runs that occur earlier: __doc, __dig (hash of the text), first, last line of the text.

    A run holds at least ``min_words`` words in lines that are equal after trimming; blank lines
    neither count nor break it. The earliest copy is the one with the smallest id (null last),
    then the smallest text hash, then the first place in the text. Rows with the same id and the
    same text are one document. Null and empty texts have no runs.
    """
    stages = StageTables(docs.sparkSession, "line-runs")
    lines = line_table(docs, doc_id, text).dropDuplicates([*DOC, "seq"])
    names = stages.write(_names(lines, ["h1", "h2"]))
    windows = stages.write(_windows(names, min_words))
    levels = [names.select(*DOC, "seq", "name", F.lit(0).alias("level"))]
    level = 0
    while 2 ** (level + 1) <= min_words:  # no run of min_words words has more lines
        reach = 2**level
        ahead = Window.partitionBy(*DOC).orderBy("seq").rangeBetween(reach, reach)
        halves = levels[-1].withColumn("second", F.max("name").over(ahead)).where("second IS NOT NULL").withColumnRenamed("name", "first")
        level += 1
        levels.append(stages.write(_names(halves.select(*DOC, "seq", "first", "second"), ["first", "second"]).select(*DOC, "seq", "name", F.lit(level).alias("level"))))
    named = levels[0]
    for further in levels[1:]:
        named = named.unionByName(further)
    depth = F.floor(F.log2(F.col("size").cast("double")) + 1e-9).cast("int")
    ends = F.array(F.struct(F.lit(1).alias("half"), F.col("start").alias("seq")), F.struct(F.lit(2).alias("half"), (F.col("start") + F.col("size") - F.pow(F.lit(2), F.col("level")).cast("int")).alias("seq")))
    sides = windows.withColumn("level", depth).select(*DOC, "start", "size", "level", F.explode(ends).alias("e")).select(*DOC, "start", "size", "level", "e.half", "e.seq")
    key = (
        _same_doc_join(sides, named, ["level", "seq"])
        .groupBy(*DOC, "start", "size")
        .agg(F.max(F.when(F.col("half") == 1, F.col("name"))).alias("n1"), F.max(F.when(F.col("half") == 2, F.col("name"))).alias("n2"))
        .where("n1 IS NOT NULL AND n2 IS NOT NULL")
    )
    key = stages.write(key)
    place = F.struct(F.col("__doc").isNull().alias("a"), F.col("__doc").alias("b"), F.col("__dig").alias("c"), F.col("start").alias("d"))
    firsts = key.groupBy("size", "n1", "n2").agg(F.count("*").alias("copies"), F.min(place).alias("earliest")).where("copies > 1")
    later = key.join(firsts, ["size", "n1", "n2"]).where(place > F.col("earliest")).select(*DOC, "start", (F.col("start") + F.col("size") - 1).alias("end"))
    order = Window.partitionBy(*DOC).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        later.withColumn("opens", F.coalesce(F.col("start") > reached + 1, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*DOC, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    sides = merged.select(*DOC, "run", F.explode(F.array("start", "end")).alias("seq"))
    at = _same_doc_join(sides, names.select(*DOC, "seq", "at"), ["seq"])
    return at.groupBy(*DOC, "run").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("run")


def _same_doc_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on the document (a null id equals a null id) and further keys."""
    right = right.select(F.col("__doc").alias("__rdoc"), F.col("__dig").alias("__rdig"), *[F.col(k).alias(f"__r{k}") for k in keys], *[c for c in right.columns if c not in (*DOC, *keys)])
    on = F.col("__doc").eqNullSafe(F.col("__rdoc")) & (F.col("__dig") == F.col("__rdig"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r{k}"))
    return left.join(right, on).drop("__rdoc", "__rdig", *[f"__r{k}" for k in keys])


def without_repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = 10) -> DataFrame:
    """``docs`` with repeated runs cut from the text, and the column ``line_runs`` with what was cut.

    ``line_runs`` lists the first and last line cut (from 0, in the original text) and is empty
    where nothing was; a column of that name is replaced. All other columns stay as they are.
    """
    runs = repeated_runs(docs, doc_id=doc_id, text=text, min_words=min_words)
    per_doc = runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__runs"))
    per_doc = per_doc.select(F.col("__doc").alias("__rdoc"), F.col("__dig").alias("__rdig"), "__runs")
    on = F.col(doc_id).eqNullSafe(F.col("__rdoc")) & (F.xxhash64(F.col(text)) == F.col("__rdig"))
    joined = docs.join(per_doc, on, "left")
    stays = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.exists("__runs", lambda r: i.between(r["first"], r["last"])))
    kept = F.when(F.col("__runs").isNull(), F.col(text)).otherwise(F.array_join(stays, "\n"))
    none = F.array().cast("array<struct<first: int, last: int>>")
    out = joined.withColumn(text, kept).withColumn("line_runs", F.coalesce("__runs", none))
    return out.drop("__rdoc", "__rdig", "__runs")
