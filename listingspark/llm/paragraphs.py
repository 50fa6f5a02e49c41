"""Substring dedup by hashing units of text and keeping the earliest copy of each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import digest, staged

# A unit ends at a line end, or after a sentence mark that white space follows.
_UNIT_END = r"(?<=[.!?])(?=\s)|(?<=\n)"


def units(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = 8) -> DataFrame:
    """Units of each text: document, place, where its window begins, hashes of the normalised window.

    Texts are cut after line ends and sentence marks; the pieces join to the text again. A unit
    is normalised to lower case, letters and digits, with single blanks. A unit of ``min_words`` words
    or more is a window of its own. A shorter one is hashed together with the two before it, so that
    it goes with a repeated passage and stays elsewhere; where these hold too few words, as in lists
    and verse, with as many before it as make ``min_words`` words. A text with fewer words up to
    the unit gives no candidate.
    """
    pieces = F.split(F.col(text), _UNIT_END)
    per_doc = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("__doc"), F.xxhash64(F.col(text)).alias("__dig"), pieces.alias("pieces"))
    plain = per_doc.withColumn("pieces", F.transform("pieces", lambda p: F.trim(F.regexp_replace(F.lower(p), r"[^\p{L}\p{N}]+", " "))))
    context = F.transform("pieces", lambda p, i: F.when(_count(p) >= min_words, p).otherwise(F.trim(F.array_join(F.slice("pieces", F.greatest(i - 1, F.lit(1)), F.least(i + 1, F.lit(3))), " "))))
    both = F.transform(F.arrays_zip(F.col("pieces").alias("own"), context.alias("key")), lambda u, i: F.struct(
        i.alias("at"), u["own"].alias("own"), u["key"].alias("key"), _count(u["own"]).alias("n"), (_count(u["key"]) < min_words).alias("short")))
    filled = plain.select("__doc", "__dig", F.filter(both, lambda u: u["own"] != "").alias("us"))

    def window(u: Column, i: Column) -> Column:
        """The unit with the units before it, back to ``min_words`` words; each holds a word at least."""
        before = F.reverse(F.slice(F.col("us"), F.greatest(i + 2 - min_words, F.lit(1)), F.least(i + 1, F.lit(min_words))))
        none = F.struct(F.lit("").alias("key"), F.lit(0).alias("n"), u["at"].alias("first"))
        return F.reduce(before, none, lambda w, v: F.when(w["n"] >= min_words, w).otherwise(F.struct(
            F.concat(v["own"], F.lit(" "), w["key"]).alias("key"), (w["n"] + v["n"]).alias("n"), v["at"].alias("first"))))

    def widened(u: Column, i: Column) -> Column:
        first = F.when(u["n"] >= min_words, u["at"]).otherwise(F.greatest(u["at"] - 2, F.lit(0)))
        own = F.struct(u["key"].alias("key"), F.lit(min_words).alias("n"), first.alias("first"))
        return F.struct(u["at"].alias("at"), F.when(u["short"], window(u, i)).otherwise(own).alias("w"))

    each = filled.select("__doc", "__dig", F.explode(F.transform("us", widened)).alias("u")).where(F.col("u.w.n") >= min_words)
    h1, h2 = digest(F.col("u.w.key"))
    return each.select("__doc", "__dig", "u.at", F.col("u.w.first").alias("first"), h1.alias("h1"), h2.alias("h2"))


def _count(plain: Column) -> Column:
    return F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1


def repeated_units(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = 8) -> DataFrame:
    """__doc, __dig and ``cut``: the sorted numbers of a document's units that occur earlier.

    All units of a repeated window are cut, but none of its earliest copy where both overlap; further
    places in the same document are cut as well. Counts and the earliest place combine before the
    shuffle, so a unit that stands in a third of all documents is a group of partial results only.
    Rows with the same id and text name the same places, of which the set of cuts keeps one.
    """
    found = staged(units(docs, doc_id=doc_id, text=text, min_words=min_words), "units")
    place = F.struct(F.col("__doc").isNull().alias("a"), F.col("__doc").alias("b"), F.col("__dig").alias("c"), F.col("at").alias("d"))
    firsts = found.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min(place).alias("earliest")).where("copies > 1").drop("copies")
    later = found.join(firsts, ["h1", "h2"]).where(place > F.col("earliest"))
    same = F.col("__doc").eqNullSafe(F.col("earliest.b")) & (F.col("__dig") == F.col("earliest.c"))
    begin = F.when(same, F.greatest("first", F.col("earliest.d") + 1)).otherwise(F.col("first"))
    cut = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(begin, "at")))))
    return later.groupBy("__doc", "__dig").agg(cut.alias("cut"))


def without_repeated_units(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = 8) -> DataFrame:
    """``docs`` without the units that occur earlier, and the character ranges cut.

    The earliest copy is that of the smallest id (null last), then the smallest text hash, then
    the first in the text. Rows with the same id and text are one document. ``cuts`` holds first
    and last (exclusive) characters in the original text, neighbours joined; it is empty where
    nothing was cut and replaces a column of that name. Null texts stay null.
    """
    cut = repeated_units(docs, doc_id=doc_id, text=text, min_words=min_words)
    cut = cut.select(F.col("__doc").alias("__rdoc"), F.col("__dig").alias("__rdig"), F.col("cut").alias("__cut"))
    on = F.col(doc_id).eqNullSafe(F.col("__rdoc")) & (F.xxhash64(F.col(text)) == F.col("__rdig"))
    apply = _cut_pieces()
    joined = docs.join(cut, on, "left").withColumn("__done", F.when(F.col("__cut").isNotNull(), apply(F.when(F.col("__cut").isNotNull(), F.split(F.col(text), _UNIT_END)), F.col("__cut"))))
    none = F.array().cast("array<struct<first: int, last: int>>")
    out = joined.withColumn(text, F.coalesce("__done.text", text)).withColumn("cuts", F.coalesce("__done.cuts", none))
    return out.drop("__rdoc", "__rdig", "__cut", "__done")


def _cut_pieces():
    @F.pandas_udf("text string, cuts array<struct<first: int, last: int>>")
    def apply(pieces: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        texts, ranges = [], []
        for parts, cut in zip(pieces, cuts, strict=True):
            if parts is None or cut is None:
                texts.append(None)
                ranges.append(None)
                continue
            gone, kept, spans, at = set(cut), [], [], 0
            for number, part in enumerate(parts):
                if number not in gone:
                    kept.append(part)
                elif spans and spans[-1]["last"] == at:
                    spans[-1]["last"] = at + len(part)
                else:
                    spans.append({"first": at, "last": at + len(part)})
                at += len(part)
            texts.append("".join(kept))
            ranges.append(spans)
        return pd.DataFrame({"text": texts, "cuts": ranges})

    return apply
