"""Toxic passages by maximum-scoring segments of token log-odds.

Every listed token carries the log-odds of standing in a toxic text, with a Dirichlet prior taken
from the pooled counts; every other token carries a small negative drift. All maximal segments of
a text are found in one linear scan, extreme-value statistics turn their scores into expected
numbers of chance hits, and a logistic curve fitted on the training rows turns the evidence of all
significant segments into a score between 0 and 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import staged

_TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (6, 5, 4)
# Bounds of what is learned: labelled rows fitted on, and features listed by the model.
MAX_TRAINING_ROWS = 40_000
MAX_FEATURES = 50_000
PRIOR_SHARE = 0.1
MIN_Z = 3.0
SIGNIFICANT = 0.05
_CACHE = 400_000
_LOW, _HIGH, _STEP = -20.0, 30.0, 0.25


def held_out(doc_id: str | Column) -> Column:
    """Whether a row's label is kept for testing; null ids are never trained on."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(False))


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def _features(token: str) -> list[str]:
    """The token itself and its longer beginnings, marked with their length."""
    return [token, *(f"{n}:{token[:n]}" for n in PREFIXES if len(token) > n)]


class _Scores(dict):
    """Token to score; unseen tokens fall back on their longest listed beginning."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) > _CACHE:
            self.clear()
        listed = (self.weights.get(f) for f in _features(token))
        self[token] = found = next((w for w in listed if w is not None), 0.0)
        return found


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (first token, last token, score), in linear time.

    ``hits`` are positions with a positive score; every other position scores ``-drift``.
    Candidates are kept with the running total before and after them, and a new one is merged
    with earlier ones as long as that makes a larger total.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, earlier candidate
    gained = 0.0
    for n, (position, score) in enumerate(hits):
        before = gained - drift * (position - n)
        gained += score
        first, last, left, right = position, position, before, before + score
        k = len(kept) - 1
        while True:
            while k >= 0 and kept[k][2] >= left:
                k = kept[k][4]
            if k < 0 or kept[k][3] >= right:
                kept.append((first, last, left, right, k))
                break
            first, left, back = kept[k][0], kept[k][2], kept[k][4]
            del kept[k:]
            k = back
    return [(first, last, right - left) for first, last, left, right, _ in kept]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    drift: float
    decay: float  # scale of the extreme-value distribution
    rate: float  # its expected number of segments for each token
    slope: float
    offset: float

    def expected(self, score: float, length: int) -> float:
        """How many segments of at least this score chance gives a text of this length."""
        return self.rate * max(1, length) * math.exp(-min(700.0, self.decay * score))

    def evidence(self, words: list[str], scores: _Scores) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Summed evidence of the significant segments, or that of the best one; and the significant ones."""
        hits = [(i, s) for i, w in enumerate(words) if (s := scores[w])]
        if not hits:
            return -math.log1p(len(words)), []
        found = [(a, b, s, self.expected(s, len(words))) for a, b, s in maximal_segments(hits, self.drift)]
        passages = [x for x in found if x[3] < SIGNIFICANT]
        if not passages:
            return -math.log(max(min(x[3] for x in found), 1e-300)), []
        return sum(-math.log(max(x[3], 1e-300)) for x in passages), passages

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * min(_HIGH, evidence) + self.offset))))


def training_rows(docs: DataFrame, labels: DataFrame, *, limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Distinct labelled texts to learn from, at most ``limit`` labels in the order of their hash.

    Labels of one document that disagree count as toxic. The bound is what allows the broadcast.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    once = rows.select("text", "toxic", F.xxhash64("text").alias("digest")).dropDuplicates(["digest", "toxic"])
    return staged(once.select("text", "toxic"), "toxic-training")


def _count_features(batches):
    """Documents with each feature, by label; counts leave a task in bounded portions."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        names = list(counts[0].keys() | counts[1].keys())
        out = pd.DataFrame({"feature": names, "toxic": [counts[1][f] for f in names], "clean": [counts[0][f] for f in names]})
        counts[0].clear(), counts[1].clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            counts[int(toxic > 0)].update({f for w in set(tokens(text)) for f in _features(w)})
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield flush()
    yield flush()


def fit(docs: DataFrame, labels: DataFrame, *, limit: int = MAX_TRAINING_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Learn the model from labelled rows that are not held out.

    Nothing but the listed features, a few sums and a histogram of fixed size reaches the
    driver. Without toxic or without clean rows every text gets the share of toxic rows.
    """
    rows = training_rows(docs, labels, limit=limit)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        return Model({}, 0.1, 1.0, 1.0, 0.0, math.log(share / (1 - share)))

    counted = rows.mapInPandas(_count_features, "feature string, toxic long, clean long")
    t, c = F.col("t"), F.col("c")
    prior = PRIOR_SHARE * (t + c)
    everything = PRIOR_SHARE * (n_toxic + n_clean)

    def logit(count, size):
        return F.log((count + prior) / (F.greatest(F.lit(1e-9), F.lit(float(size)) + everything - count - prior)))

    listed = (
        counted.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(t >= 3)
        .withColumn("weight", logit(t, n_toxic) - logit(c, n_clean))
        .withColumn("z", F.col("weight") / F.sqrt(1 / (t + prior) + 1 / (c + prior)))
        .where((F.col("z") >= MIN_Z) & (F.col("weight") > 1))
        .orderBy(F.desc("z"), "feature").limit(max_features)
    )
    weights = {r["feature"]: float(r["weight"]) for r in listed.select("feature", "weight").collect()}
    if not weights:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        return Model({}, 0.1, 1.0, 1.0, 0.0, math.log(share / (1 - share)))

    def tallies(batches):
        """By label: listed tokens in steps of weight (step -1: all tokens)."""
        scores = _Scores(weights)
        for batch in batches:
            found: Counter = Counter()
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words, kind = tokens(text), int(toxic > 0)
                found[kind, -1] += len(words)
                found.update((kind, int(s * 8)) for w in words if (s := scores[w]))
            yield pd.DataFrame([(k, b, n) for (k, b), n in found.items()], columns=["toxic", "step", "n"])

    seen = {(r["toxic"], r["step"]): r["n"] for r in rows.mapInPandas(tallies, "toxic int, step int, n long").groupBy("toxic", "step").agg(F.sum("n").alias("n")).collect()}
    total = [max(1, seen.get((k, -1), 0)) for k in (0, 1)]
    share = [(sum(n for (k, b), n in seen.items() if k == kind and b >= 0) + 0.5) / (total[kind] + 1) for kind in (0, 1)]
    drift = max(1e-3, math.log((1 - min(share[0], 0.5)) / (1 - min(max(share[1], share[0] * 2), 0.9))))
    steps = {b for _, b in seen if b >= 0}
    odds = [((b + 0.5) / 8, (seen.get((0, b), 0) + 0.5) / (total[0] + 1)) for b in steps]
    low, high = 1e-3, 50.0
    for _ in range(80):  # the positive root of sum(p * exp(decay * score)) = 1
        middle = (low + high) / 2
        value = sum(p * math.exp(min(700.0, middle * s)) for s, p in odds) + (1 - sum(p for _, p in odds)) * math.exp(-middle * drift)
        low, high = (middle, high) if value < 1 else (low, middle)
    decay = low
    least = min(weights.values())
    rate = min(1.0, (sum(seen.get((0, b), 0) for b in steps) + 0.5) / total[0] * math.exp(min(50.0, decay * least)))
    model = Model(weights, drift, decay, rate, 1.0, 0.0)

    def histogram(batches):
        scores = _Scores(weights)
        for batch in batches:
            bins = [
                (int(toxic > 0), int((min(_HIGH, max(_LOW, model.evidence(tokens(text), scores)[0])) - _LOW) / _STEP))
                for text, toxic in zip(batch["text"], batch["toxic"], strict=True)
            ]
            yield pd.DataFrame([(k, b, n) for (k, b), n in Counter(bins).items()], columns=["toxic", "bin", "n"])

    bins = rows.mapInPandas(histogram, "toxic int, bin int, n long").groupBy("toxic", "bin").agg(F.sum("n").alias("n")).collect()
    slope, offset = _logistic([(r["toxic"], _LOW + (r["bin"] + 0.5) * _STEP, r["n"]) for r in bins])
    return Model(weights, drift, decay, rate, slope, offset)


def _logistic(rows: list[tuple[int, float, int]]) -> tuple[float, float]:
    """Slope (never negative) and offset of a logistic curve, with a light ridge, by damped Newton steps."""
    y, x, n = (np.array(v, dtype=float) for v in zip(*rows, strict=True))
    features = np.stack([x / 10, np.ones_like(x)], axis=1)
    beta, ridge = np.zeros(2), np.array([0.002, 1e-6])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -40, 40)))
        gradient = features.T @ (n * (p - y)) + ridge * beta
        hessian = (features * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ features + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 2 / max(1e-12, float(np.abs(step).max())))
    return max(0.0, float(beta[0]) / 10), float(beta[1])


PASSAGES = "struct<score: double, passages: array<struct<first: int, last: int, score: double, expected: double>>>"


def toxicity(text: str | Column, model: Model) -> Column:
    """Score of a text and its significant toxic passages as character ranges (end exclusive).

    Null and empty texts hold no evidence and get the score of a text without hits. A text may
    be of any length; the scan is linear in it.
    """

    @F.pandas_udf(PASSAGES)
    def judge(texts: pd.Series) -> pd.DataFrame:
        scores = _Scores(model.weights)
        out, found = [], []
        for value in texts:
            evidence, passages = model.evidence(tokens(value), scores)
            out.append(model.score(evidence))
            if passages:  # lower() may change lengths, so offsets hold for the lower-cased text
                spots = [m.span() for m in _TOKEN.finditer(value.lower())]
                passages = [{"first": spots[a][0], "last": spots[b][1], "score": s, "expected": e} for a, b, s, e in passages]
            found.append(passages)
        return pd.DataFrame({"score": out, "passages": found})

    return judge(F.col(text) if isinstance(text, str) else text)


def score_documents(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted, passages.

    Rows with the same id are scored one by one; a null id stays null. Other columns of
    ``docs`` are not read.
    """
    scored = docs.select("doc_id", toxicity("text", model).alias("t"))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("t.score").alias("score"),
        (F.col("t.score") >= threshold).cast("int").alias("predicted"), F.col("t.passages").alias("passages"),
    )
