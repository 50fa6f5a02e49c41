"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max pruning.

Test items are the indexed collection and every passage of every training text is a query. Document
frequencies and lengths are counted over all items first, so scores do not depend on how items are
shared out among indexes. Scores are divided by each item's threshold (a share of the score it gives
itself), so 1 is the bar for all. Items are dealt into blocks; for each term the index holds the largest score within each
block. A text, then each of its passages, sums those upper bounds first and only blocks that can
reach 1 are scored. Hits are verified by the words of the item's question and answer.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import staged

_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
BLOCK = 32
# Characters of items indexed at once; a larger test set takes several passes over the texts.
INDEX_CHARS = 32_000_000
HITS = "array<struct<item_id: {}, score: double, first: int, last: int, question: double, answer: double>>"


def words(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: all but the last sentence or line, and that; halves of a single one."""
    parts = [w for w in map(words, _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for part in parts[:-1] for w in part], parts[-1]
    only = parts[0] if parts else []
    return only[: (len(only) + 1) // 2], only[(len(only) + 1) // 2 :]


@dataclass(frozen=True)
class Statistics:
    """Number of items, their mean and greatest number of words, and in how many items each word stands."""

    items: int
    average: float
    longest: int
    frequencies: dict[str, int]


@dataclass(frozen=True)
class Index:
    """Inverted index of one shard of items; its size is bounded by the shard's text."""

    ids: list
    id_type: str
    vocabulary: dict[str, int]
    start: np.ndarray  # postings of term t: start[t] .. start[t + 1]
    item: np.ndarray
    score: np.ndarray
    block_start: np.ndarray  # blocks of term t: block_start[t] .. block_start[t + 1]
    block: np.ndarray
    block_max: np.ndarray  # largest score of the term within the block
    sides: list[tuple[Counter, Counter]]
    shingles: list[set]
    passage: int

    @classmethod
    def build(cls, items: list[tuple[object, str]], id_type: str, threshold: float, known: Statistics, k1: float = 1.2, b: float = 0.75) -> Index:
        split = [split_item(t) for _, t in items]
        texts = [q + a for q, a in split]
        vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        idf = {w: np.log1p((known.items - n + 0.5) / (n + 0.5)) for w, n in known.frequencies.items()}
        postings: list[tuple[int, int, float]] = []
        for i, t in enumerate(texts):
            tf = Counter(t)
            norm = k1 * (1 - b + b * len(t) / known.average)
            scores = {w: idf[w] * n * (k1 + 1) / (n + norm) for w, n in tf.items()}
            bar = threshold * sum(scores.values())
            postings += [(vocabulary[w], i, s / bar) for w, s in scores.items()]
        postings.sort()
        term, item, score = (np.array(x) for x in zip(*postings, strict=True))
        start = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        # Postings are in the order of term and item, so each term's blocks are runs.
        blocks = item // BLOCK
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (blocks[1:] != blocks[:-1])])
        block_start = np.searchsorted(term[first], np.arange(len(vocabulary) + 1))
        shingles = [{tuple(t[j : j + 3]) for j in range(max(1, len(t) - 2))} for t in texts]
        sides = [(Counter(q), Counter(a)) for q, a in split]
        return cls(
            [i for i, _ in items], id_type, vocabulary, start, item, score, block_start, blocks[first], np.maximum.reduceat(score, first),
            sides, shingles, max(128, 2 * known.longest),
        )

    @staticmethod
    def _places(start: np.ndarray, terms: np.ndarray) -> np.ndarray:
        lengths = start[terms + 1] - start[terms]
        return np.repeat(start[terms] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())

    def above(self, terms: np.ndarray) -> dict[int, float]:
        """Items that score 1 or more for a set of terms, by blocks whose upper bound reaches 1."""
        tops = self._places(self.block_start, terms)
        open_ = np.bincount(self.block[tops], self.block_max[tops], (len(self.ids) + BLOCK - 1) // BLOCK) >= 0.999
        if not open_.any():
            return {}
        places = self._places(self.start, terms)
        item, score = self.item[places], self.score[places]
        if not open_.all():
            inside = open_[item // BLOCK]
            item, score = item[inside], score[inside]
        total = np.bincount(item, score, len(self.ids))
        return {int(i): float(total[i]) for i in np.flatnonzero(total >= 0.999999)}

    def search(self, text: str | None, overlap: float) -> list[dict]:
        """Verified items of one text, each with its best passage (word numbers, end exclusive)."""
        tokens = words(text)
        if not tokens:
            return []
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in tokens], np.int64)
        known = np.unique(ids[ids >= 0])
        candidates = self.above(known) if len(known) else {}
        if not candidates:
            return []
        best: dict[int, dict] = {}
        for first in range(0, max(1, len(tokens) - self.passage // 2), self.passage // 2):
            inside = ids[first : first + self.passage]
            terms = np.unique(inside[inside >= 0])
            if not len(terms):
                continue
            for i, score in self.above(terms).items():
                if i in candidates and (i not in best or score > best[i]["score"]):
                    hit = self.verify(i, tokens[first : first + self.passage], overlap)
                    if hit:
                        best[i] = {"item_id": self.ids[i], "score": score, "first": first, "last": min(len(tokens), first + self.passage), **hit}
        return [best[i] for i in sorted(best)]

    def verify(self, i: int, passage: list[str], overlap: float) -> dict | None:
        """Shares of question and answer words in the passage, if both suffice and their order agrees."""
        found = Counter(passage)
        shares = [sum((side & found).values()) / max(1, side.total()) if side else 1.0 for side in self.sides[i]]
        if min(shares) < overlap:
            return None
        shingles = {tuple(passage[j : j + 3]) for j in range(max(1, len(passage) - 2))}
        if len(self.shingles[i] & shingles) < 0.5 * len(self.shingles[i]):
            return None
        return {"question": shares[0], "answer": shares[1]}


def indexes(
    items: DataFrame, *, item_id: str = "item_id", text: str = "text", threshold: float = 0.5, chars: int = INDEX_CHARS,
) -> Iterator[tuple[Index, bool]]:
    """Indexes of all items with words, in shards of about ``chars`` characters each, and whether more follow.

    Statistics are counted over all items; each shard then gets those of its own words. One
    shard at a time is collected.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(words)

    used = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("id"), F.col(text).alias("t")).distinct()
    used = staged(used.withColumn("w", cut("t")).where(F.size("w") > 0), "items")
    whole = used.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("mean"), F.max(F.size("w")).alias("most"), F.sum(F.length("t")).alias("chars")).first()
    shards = -(-(whole["chars"] or 0) // chars)
    if not shards:
        return
    frequencies = staged(used.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "item-words")
    placed = used.withColumn("shard", F.pmod(F.xxhash64("id", "t"), F.lit(shards)))
    kind = items.schema[item_id].dataType.simpleString()
    for shard in range(shards):
        part = placed.where(F.col("shard") == shard)
        rows = [(r["id"], r["t"]) for r in part.select("id", "t").collect()]
        if rows:
            own = frequencies.join(part.select(F.explode("w").alias("word")).distinct(), "word", "left_semi")
            known = Statistics(whole["n"], whole["mean"], whole["most"], {r["word"]: r["n"] for r in own.collect()})
            rows.sort(key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1]))
            yield Index.build(rows, kind, threshold, known), shard + 1 < shards


def matches(text: str | Column, index: Index, *, overlap: float = 0.7) -> Column:
    """Verified items of each text; an empty array for null, empty and clean texts."""

    @F.pandas_udf(HITS.format(index.id_type))
    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([index.search(t, overlap) for t in texts])

    return search(F.col(text) if isinstance(text, str) else text)


def contaminated(docs: DataFrame, items: DataFrame, *, threshold: float = 0.5, overlap: float = 0.7, chars: int = INDEX_CHARS) -> DataFrame:
    """doc_id, item_id, score, first, last, question, answer for each document row and verified item.

    ``score`` is a multiple of the item's threshold; first and last are word numbers of the best
    passage. Rows with the same id are judged one by one; null and empty texts match nothing, long
    ones are searched passage by passage to their end. Items without words match nothing; items
    that repeat are matched each.
    """
    found = None
    for index, more in indexes(items, threshold=threshold, chars=chars):
        part = docs.select("doc_id", F.explode(matches("text", index, overlap=overlap)).alias("h")).select("doc_id", "h.*")
        part = staged(part, "hits") if more else part  # an index that is done with need not be kept
        found = part if found is None else found.unionByName(part)
    if found is None:
        none = F.array().cast(HITS.format(items.schema["item_id"].dataType.simpleString()))
        found = docs.select("doc_id", F.explode(none).alias("h")).select("doc_id", "h.*")
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, *, threshold: float = 0.5, overlap: float = 0.7, chars: int = INDEX_CHARS) -> DataFrame:
    """``docs`` without the rows in which an item was verified; all columns stay.

    Null and empty texts stay; rows that repeat go or stay each for itself.
    """
    for index, more in indexes(items, threshold=threshold, chars=chars):
        docs = docs.where(F.size(matches("text", index, overlap=overlap)) == 0)
        docs = staged(docs, "clean") if more else docs
    return docs
