"""Approximate nearest neighbours by cosine with balanced posting lists.

Centroids are learned on a bounded sample and linked into a small graph. Every vector goes to the
posting list of its nearest centroid, and boundary vectors to a few more lists as well. A query
walks the graph to its nearest centroids, keeps those whose distance is within a ratio of the
nearest, and is compared exactly with the vectors of their lists. Lists are dealt into blocks of
bounded size, so a list that holds a third of all vectors is many small tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import StageTables

SAMPLE = 20_000  # vectors that centroids are learned on
CENTROIDS = 256
NEIGHBOURS = 16  # links of a centroid in the graph
PROBES = 64  # most lists that a query searches
LEAST = 16  # lists that a query searches whatever their distance
BLOCK = 4096  # most vectors or queries that meet at once


@dataclass(frozen=True)
class Graph:
    """Unit centroids and, for each, its nearest others.

    Lists of under half the mean size are moved to where lists hold more than 1.5 times the mean, so a
    dense region gets as many lists as its share of the vectors asks for.
    """

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> Graph:
        random = np.random.default_rng(seed)
        distinct = np.unique(sample, axis=0)
        lists = max(1, min(lists, len(distinct) // 8 or 1))
        centroids = distinct[random.permutation(len(distinct))[:lists]]
        mean = len(distinct) / lists
        for turn in range(rounds):
            near = centroids @ distinct.T
            owner = near.argmax(axis=0)
            counts = np.bincount(owner, minlength=lists)
            sums = np.zeros_like(centroids)
            np.add.at(sums, owner, distinct)
            # Keep lists balanced: the smallest give up their place to split the largest. The last rounds settle.
            small = np.argsort(counts, kind="stable")
            for least, most in zip(small, small[::-1], strict=True):
                uneven = turn < rounds - 2 and counts[least] < mean / 2 and counts[most] > 1.5 * mean
                if counts[least] and not uneven:
                    break
                members = np.flatnonzero(owner == most)
                sums[least] = distinct[members[random.integers(len(members))]]
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
        near = centroids @ centroids.T
        np.fill_diagonal(near, -np.inf)
        links = np.argsort(-near, axis=1, kind="stable")[:, : min(NEIGHBOURS, max(1, lists - 1))]
        return cls(centroids, links, random.permutation(lists)[: max(1, min(8, lists))])

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walk for a batch: the nearest centroids of each vector and their cosines."""
        n, beam = len(vectors), min(beam, len(self.centroids))
        ids = np.tile(self.entries, (n, 1))
        while True:
            wider = np.concatenate([ids, self.links[ids].reshape(n, -1)], axis=1)
            wider.sort(axis=1)
            cosines = np.einsum("nd,nkd->nk", vectors, self.centroids[wider])
            cosines[:, 1:][wider[:, 1:] == wider[:, :-1]] = -np.inf
            order = np.argsort(-cosines, axis=1, kind="stable")[:, :beam]
            best = np.take_along_axis(wider, order, axis=1)
            if best.shape == ids.shape and (best == ids).all():
                return best, np.take_along_axis(cosines, order, axis=1)
            ids = best


def usable(embedding: str = "embedding"):
    """Neither null nor empty nor zero, with finite components only."""
    c = F.col(embedding).cast("array<double>")
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def _units(column: pd.Series) -> np.ndarray:
    raw = np.array(column.tolist(), dtype=np.float64)
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def learn(vectors: DataFrame, *, lists: int = CENTROIDS, sample: int = SAMPLE) -> Graph | None:
    """Centroids of at most ``sample`` vectors, those with the smallest id hashes."""
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()
    return Graph.fit(_units(chosen["embedding"]), lists) if len(chosen) else None


def _placed(graph: Graph, ratio: float, most: int, least: int = 1):
    """Rows with the lists they belong to, one row each: ``least`` nearest lists and those within the ratio."""

    def place(batches):
        for batch in batches:
            for low in range(0, len(batch), 1024):
                part = batch.iloc[low : low + 1024]
                ids, cosines = graph.search(_units(part["embedding"]), most + 8)
                apart = np.sqrt(np.maximum(0, 2 - 2 * cosines[:, :most]))
                # A vector that is its own centroid has a nearest distance of zero, which prunes all other lists.
                reach = np.maximum(ratio * apart[:, :1], apart[:, min(least, apart.shape[1]) - 1, None])
                row, at = np.nonzero(apart <= reach + 1e-9)
                yield part.iloc[row].assign(list=ids[row, at].astype(np.int32))

    return place


def _compare(k: int):
    """Exact cosines of one block of queries with one block of vectors: the best of each query."""

    def compare(_, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(vectors):
            vectors = vectors.drop_duplicates("vec_id").sort_values("vec_id", kind="stable")
            ids, theirs = vectors["vec_id"].to_numpy(), _units(vectors["embedding"])
            for low in range(0, len(queries), 256):
                part = queries.iloc[low : low + 256]
                scores = np.einsum("qd,vd->qv", _units(part["embedding"]), theirs)
                own = part["vec_id"].to_numpy()
                scores[own[:, None] == ids[None, :]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                row, at = np.nonzero(np.take_along_axis(scores, best, axis=1) > -np.inf)
                out["query_id"] += own[row].tolist()
                out["vec_id"] += ids[best[row, at]].tolist()
                out["score"] += scores[row, best[row, at]].tolist()
        return pd.DataFrame(out)

    return compare


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, lists: int = CENTROIDS, reach: float = 2.2, probes: int = PROBES, overlap: float = 1.15, copies: int = 6) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest cosines found for each query.

    Vectors within ``overlap`` times the distance of their nearest centroid stand in up to
    ``copies`` lists; queries search up to ``probes`` lists within ``reach`` times that
    distance, and the nearest ``LEAST`` lists in any case. Ties go to the smaller id, a query never finds its own id. Null ids and vectors
    that are null, zero or not finite take no part, on either side; of repeated ids one counts.
    Vectors with another number of components than most are left out as well.
    """
    stages = StageTables(vectors.sparkSession, "posting-lists")
    empty = vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")

    def clean(df: DataFrame) -> DataFrame:
        return df.where(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    usual = clean(vectors).groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if usual is None:
        return empty
    indexed, asked = (clean(df).where(F.size("embedding") == usual["n"]) for df in (vectors, queries))
    graph = learn(indexed, lists=lists)
    schema = "vec_id long, embedding array<double>, list int"
    blocks = lambda df, name: df.withColumn(name, F.pmod(F.xxhash64("vec_id", "list"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))).cast("int"))

    def sized(df: DataFrame) -> DataFrame:
        return df.groupBy("list").agg(F.count("*").alias("n"))

    postings = stages.write(indexed.mapInPandas(_placed(graph, overlap, copies), schema))
    probing = stages.write(asked.mapInPandas(_placed(graph, reach, probes, LEAST), schema))
    held, want = sized(postings), sized(probing)
    posted = blocks(postings.join(held, "list"), "vb").select("list", "vb", "vec_id", "embedding")
    asking = blocks(probing.join(want, "list"), "qb").select("list", "qb", "vec_id", "embedding")
    counts = lambda df, name: df.select("list", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int").alias(name))
    # Each block of queries meets each block of vectors of the same list, whole blocks only.
    posted = posted.join(counts(want, "qn"), "list").select("list", "vb", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("qb"), "vec_id", "embedding")
    asking = asking.join(counts(held, "vn"), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("vn") - 1)).alias("vb"), "qb", "vec_id", "embedding")
    keys = ["list", "vb", "qb"]
    found = asking.groupBy(*keys).cogroup(posted.groupBy(*keys)).applyInPandas(_compare(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
