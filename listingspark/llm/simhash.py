"""SimHash fingerprints of word shingles, linked by bit-sliced comparison.

Distinct fingerprints meet in buckets of equal bit positions. A bucket is turned into bit planes
(one 64-bit word holds the same bit of 64 fingerprints); one fingerprint is compared with 64 others
at once by adding its differing planes into carry-save counters, and words whose 64 distances all
exceed the radius are abandoned. Buckets above a size limit are split without loss: those of
pigeonhole tables by further bits, level by level, those of sampled tables into blocks of which each
meets each. A bucket returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import component_labels
from ..session import StageTables
from .base import staged

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_CHECK_EVERY = 8
_WORDS_AT_ONCE = 1 << 16


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of the word shingles of one UTF-8 text, in order; none for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - shingle]] if len(words) > shingle else [0]
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    return np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def simhash(text: bytes | None, shingle: int, width: int) -> bytes:
    """Fingerprint of one UTF-8 text; zero for a text without words."""
    return of_hashes(shingles(text, shingle), width)


def of_hashes(hashes: np.ndarray, width: int) -> bytes:
    if not len(hashes):
        return bytes(width // 8)
    parts = [hashes]
    for _ in range(width // 64 - 1):
        mixed = (parts[-1] ^ (parts[-1] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        parts.append(mixed ^ (mixed >> np.uint64(29)))
    out = b""
    for part in parts:
        octets = part.astype(">u8").view(np.uint8).reshape(-1, 8)
        spread = octets.astype(np.intp) + 256 * np.arange(8)
        counts = np.bincount(spread.ravel(), minlength=2048).reshape(8, 256) @ _BITS
        out += np.packbits(counts.ravel() * 2 > len(part)).tobytes()
    return out


def fingerprint(text: str | Column, *, shingle: int = 3, width: int = 64) -> Column:
    """Binary fingerprint of the whole text: lower-cased A-Z, words between ASCII white space.

    Repeated shingles count; a text with fewer words is one shingle. Null texts have no words.
    """

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle, width) for t in texts])

    return of((F.col(text) if isinstance(text, str) else text).cast("binary"))


def shingle_set(text: str, *, shingle: int, width: int) -> Column:
    """The set of a text's shingles: struct of its fingerprint ``fp``, digest ``set`` and size ``held``."""

    @F.pandas_udf("fp binary, set binary, held long")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingles(t, shingle)) for t in texts]
        return pd.DataFrame({"fp": [of_hashes(x, width) for x in sets], "set": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], "held": [len(x) for x in sets]})

    return of(F.col(text).cast("binary"))


def similar_sets(sets: list[np.ndarray], share: tuple[int, int]) -> np.ndarray:
    """For each set of unlike numbers the first of its group, by links of a Jaccard similarity of ``share`` or more.

    Exact: each set is compared with all that hang on no group yet, which are none but the others of its group.
    """
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    held, owner, marked = ids, np.repeat(np.arange(len(sets)), sizes), np.zeros(len(known), bool)
    label = np.full(len(sets), -1)
    left = among = len(sets)
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], left, queue = first, left - 1, [first]
        while queue and left:
            at = queue.pop()
            own = ids[ends[at] - sizes[at] : ends[at]]
            marked[own] = True
            common = np.bincount(owner[marked[held]], minlength=len(sets))
            marked[own] = False
            found = np.flatnonzero((label < 0) & (share[1] * common >= share[0] * (sizes + sizes[at] - common)))
            label[found] = first
            queue.extend(found)
            left -= len(found)
            if 2 * left < among:
                open_ = label[owner] < 0
                held, owner, among = held[open_], owner[open_], left
    return label


@dataclass(frozen=True)
class Blocking:
    """Bit positions whose equality puts fingerprints into one bucket, level by level.

    Without ``refine`` there are no further levels and crowded buckets are dealt into blocks.
    """

    tables: tuple[tuple[int, ...], ...]
    refine: object = field(default=None, compare=False)

    def next_level(self) -> Blocking:
        return Blocking(tuple(further for t in self.tables for further in self.refine(t)), self.refine)


def pigeonhole(width: int, radius: int) -> Blocking:
    """Exact: of ``radius + 2`` bands two at least are equal; the rest splits likewise at each level."""

    def refine(used: tuple[int, ...]) -> list[tuple[int, ...]]:
        rest = [p for p in range(width) if p not in set(used)]
        if len(rest) < radius + 2:
            return [used]
        bands = [tuple(int(p) for p in band) for band in np.array_split(rest, radius + 2)]
        return [used + a + b for a, b in combinations(bands, 2)]

    return Blocking(tuple(refine(())), refine)


def sampled(width: int, bits: int, tables: int, seed: int = 42) -> Blocking:
    """Random positions: a pair that differs in a share d of bits meets with 1-(1-(1-d)^bits)^tables."""
    random = np.random.default_rng(seed)
    return Blocking(tuple(tuple(int(p) for p in random.permutation(width)[:bits]) for _ in range(tables)))


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _keys(tables: tuple[tuple[int, ...], ...]):
    def make(batches):
        for batch in batches:
            for begin in range(0, len(batch), 4096):
                part = batch.iloc[begin : begin + 4096]
                bits = np.unpackbits(_matrix(list(part["fp"])), axis=1)
                paths = part["path"].to_numpy() if "path" in part else None
                for number, positions in enumerate(tables):
                    mine = slice(None) if paths is None else np.flatnonzero(paths == number)
                    if paths is not None and not len(mine):
                        continue
                    packed = np.packbits(bits[mine][:, positions], axis=1)
                    yield pd.DataFrame({"path": np.full(len(packed), number, np.int32), "key": [k.tobytes() for k in packed], "fp": part["fp"].to_numpy()[mine]})

    return make


def near_pairs(fps: np.ndarray, sizes: np.ndarray, radius: int):
    """Pairs of positions (a < b) within ``radius`` bits inside each bucket, in portions.

    ``fps`` holds the buckets' fingerprints one bucket after another, ``sizes`` their lengths.
    """
    n, width = len(fps), fps.shape[1] * 8
    words = (sizes + 63) // 64
    first_word = np.concatenate([[0], np.cumsum(words)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    lane = (np.arange(n) - first[bucket]) + first_word[bucket] * 64
    bits = np.unpackbits(fps, axis=1)
    wide = np.zeros((first_word[-1] * 64, width), np.uint8)
    wide[lane] = bits
    planes = np.ascontiguousarray(np.packbits(wide.T.reshape(width, -1, 64), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]
    used = np.zeros(first_word[-1] * 64, np.uint8)
    used[lane] = 1
    valid = np.ascontiguousarray(np.packbits(used.reshape(-1, 64), axis=1, bitorder="little")).view(np.uint64)[:, 0]
    back = np.full(len(used), -1, np.int64)
    back[lane] = np.arange(n)
    to_compare = first_word[bucket + 1] - lane // 64  # words from the own one to the bucket's last
    total = np.concatenate([[0], np.cumsum(to_compare)])
    counters = (radius + _CHECK_EVERY).bit_length()
    for low in range(0, int(total[-1]), _WORDS_AT_ONCE):
        pair = np.arange(low, min(low + _WORDS_AT_ONCE, int(total[-1])))
        q = np.searchsorted(total, pair, side="right") - 1
        w = lane[q] // 64 + (pair - total[q])
        own = lane[q] // 64 == w
        alive = valid[w] & np.where(own, ~((np.uint64(2) << (lane[q] % 64).astype(np.uint64)) - np.uint64(1)), _ALL)
        count = [np.zeros(len(q), np.uint64) for _ in range(counters)]
        for p in range(width):
            carry = planes[p, w] ^ (np.uint64(0) - bits[q, p].astype(np.uint64))
            for c in count:
                both = c & carry
                c ^= carry
                carry = both
            if p % _CHECK_EVERY == _CHECK_EVERY - 1 or p == width - 1:
                above, equal = np.zeros(len(q), np.uint64), np.full(len(q), _ALL)
                for b in range(counters - 1, -1, -1):
                    if radius >> b & 1:
                        equal &= count[b]
                    else:
                        above |= equal & count[b]
                        equal &= ~count[b]
                alive &= ~above
                keep = np.flatnonzero(alive)
                if len(keep) < len(q):
                    q, w, alive, count = q[keep], w[keep], alive[keep], [c[keep] for c in count]
                if not len(q):
                    break
        if len(q):
            row, at = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[row], back[w[row] * 64 + at]


def _forest(radius: int):
    """Turn buckets into (fingerprint, smallest fingerprint it hangs on within the bucket)."""

    def link(batches):
        for batch in batches:
            lists, at = list(batch["fps"]), 0
            while at < len(lists):
                taken, held = [], 0
                while at < len(lists) and (not taken or held + len(lists[at]) <= 8192):
                    taken.append(lists[at])
                    held += len(lists[at])
                    at += 1
                flat = [bytes(x) for part in taken for x in part]
                fps, sizes = _matrix(flat), np.array([len(x) for x in taken])
                label = np.arange(len(flat))
                for a, b in near_pairs(fps, sizes, radius):
                    while (label[a] != label[b]).any():
                        least = np.minimum(label[a], label[b])
                        np.minimum.at(label, label[a], least)
                        np.minimum.at(label, label[b], least)
                        label = label[label]
                while (label[label] != label).any():
                    label = label[label]
                many = np.bincount(label, minlength=len(flat))[label] > 1
                chosen = np.flatnonzero(many)
                yield pd.DataFrame({"fp": [flat[i] for i in chosen], "root": [flat[label[i]] for i in chosen]})

    return link


def block_pairs(rows: DataFrame, place: Column, blocks: Column) -> DataFrame:
    """Each row once for each pair of blocks (``low``, ``high``) its own takes part in.

    A single block makes the pair (0, 0); of more, each meets each other one.
    """
    own = F.pmod(place, blocks).cast("int")
    dealt = rows.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    dealt = dealt.where((F.col("__own") != F.col("__other")) | (blocks == 1))
    return dealt.withColumn("low", F.least("__own", "__other")).withColumn("high", F.greatest("__own", "__other")).drop("__own", "__other")


def links(fps: DataFrame, *, radius: int, blocking: Blocking, limit: int = 16_384) -> DataFrame:
    """Spanning links of distinct fingerprints (column ``fp``): fp, root; both ends share a component.

    A bucket with more than ``limit`` fingerprints is never gathered: its members are dealt to the
    smaller buckets of the next level, until none is left, or into blocks of half the limit where
    there is no next level, and each two blocks are compared.
    """
    stages = StageTables(fps.sparkSession, "simhash")
    found, rows = None, fps
    while True:
        keyed = stages.write(rows.mapInPandas(_keys(blocking.tables), "path int, key binary, fp binary"))
        crowded = stages.write(keyed.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit))
        bucket = keyed.join(crowded, ["path", "key"], "left_anti").groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        pairs = stages.write(bucket.select("fps").mapInPandas(_forest(radius), "fp binary, root binary"))
        found = pairs if found is None else found.unionByName(pairs)
        if crowded.isEmpty():
            return found
        if blocking.refine is None:
            blocks = block_pairs(keyed.join(crowded, ["path", "key"]), F.xxhash64("fp"), F.ceil(F.col("n") * 2 / limit))
            pairs = blocks.groupBy("path", "key", "low", "high").agg(F.collect_list("fp").alias("fps"))
            return found.unionByName(stages.write(pairs.select("fps").mapInPandas(_forest(radius), "fp binary, root binary")))
        deeper = blocking.next_level()
        if deeper.tables == blocking.tables:
            raise ValueError("fingerprints are not distinct")
        each = len(deeper.tables) // len(blocking.tables)
        ways = F.explode(F.array(*[F.lit(i) for i in range(each)]))
        inside = keyed.join(crowded, ["path", "key"], "left_semi").select("fp", "path", ways.alias("way"))
        rows = inside.select("fp", (F.col("path") * each + F.col("way")).alias("path"))
        blocking = deeper


def components(fps: DataFrame, *, radius: int = 2, blocking: Blocking | None = None) -> DataFrame:
    """Component of every fingerprint that has a link: node (hash of the fingerprint), component."""
    distinct = fps.select("fp").distinct()
    pairs = links(distinct, radius=radius, blocking=blocking or pigeonhole(64, radius))
    ids = pairs.select(F.xxhash64("fp").alias("node"), F.xxhash64("root").alias("key")).distinct()
    return component_labels(ids, "node", "key")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, width: int = 64, radius: int = 2, blocking: Blocking | None = None) -> DataFrame:
    """One row per document row: doc_id, fingerprint (hex), component_id (smallest doc_id of its group).

    Equal fingerprints are one group; texts without words share the zero fingerprint. Null ids
    get a row but never name a group that has an id. The hash of a 64-bit fingerprint is one to
    one, so nodes of that width never collide.
    """
    marked = staged(docs.select("doc_id", fingerprint("text", shingle=shingle, width=width).alias("fp")), "fingerprints")
    grouped = grouped_fingerprints(marked, radius=radius, blocking=blocking)
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "component").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def grouped_fingerprints(marked: DataFrame, *, radius: int, blocking: Blocking | None) -> DataFrame:
    """``marked`` (with a column ``fp``) and the number of each row's component."""
    found = components(marked, radius=radius, blocking=blocking)
    keyed = marked.withColumn("node", F.xxhash64("fp"))
    return keyed.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def _verified(shingle: int, share: tuple[int, int]):
    """Turn rows that stand group by group into (set, first set it hangs on within the group)."""

    def link(batches):
        group, sets, nodes, roots = None, {}, [], []

        def close():
            if len(sets) > 1:
                names = list(sets)
                label = similar_sets(list(sets.values()), share)
                chosen = np.flatnonzero(np.bincount(label, minlength=len(names))[label] > 1)
                nodes.extend(names[i] for i in chosen)
                roots.extend(names[label[i]] for i in chosen)
            sets.clear()

        for batch in batches:
            for component, low, high, name, text in batch.itertuples(index=False, name=None):
                if (component, low, high) != group:
                    close()
                    group = component, low, high
                if name not in sets:
                    sets[name] = np.unique(shingles(text, shingle))
            if len(nodes) > 1024:
                yield pd.DataFrame({"set": nodes, "root": roots})
                nodes, roots = [], []
        close()
        yield pd.DataFrame({"set": nodes, "root": roots})

    return link


def one_of_each_group(
    docs: DataFrame, *, shingle: int = 5, share: tuple[int, int] = (4, 5), width: int = 256, radius: int = 64, blocking: Blocking | None = None,
    block: int = 2048, block_shingles: int = 2_000_000,
) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest id, then the smallest text hash.

    Near copies are texts whose five-word shingle sets (each shingle once) have a Jaccard similarity of
    ``share`` (4/5) or more. Fingerprints only say which texts are compared: sets of that
    resemblance differ in 38.8 of 256 bits on average, with a deviation of 5.7, and 48 tables of 10
    bits miss one such pair in 2,000. Texts joined by fingerprints are then compared by their
    shingles, each with each; components of more than ``block`` texts or ``block_shingles`` shingles
    in blocks. All columns are kept. A null id is used only where a group has no other; texts
    without words are one group.
    """
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64(F.col("text")).alias("c"))
    marked = docs.select(place.alias("p"), shingle_set("text", shingle=shingle, width=width).alias("s"))
    sets = staged(marked.groupBy("s.fp", "s.set").agg(F.min("p").alias("p"), F.max("s.held").alias("held")), "shingle-sets")
    grouped = staged(grouped_fingerprints(sets, radius=radius, blocking=blocking or sampled(width, 10, 48)), "fingerprint-groups")
    crowds = grouped.groupBy("component").agg(F.count("*").alias("n"), F.sum("held").alias("all")).where("n > 1")
    blocks = F.least(F.col("n"), F.greatest(F.lit(1).cast("long"), F.when(F.col("n") > block, F.ceil(F.col("n") * 2 / block)), F.when(F.col("all") > block_shingles, F.ceil(F.col("all") * 2 / block_shingles))))
    placed = block_pairs(grouped.join(crowds, "component"), F.xxhash64("set"), blocks)
    placed = placed.select("component", "low", "high", "set", F.col("p.b").alias("__id"), F.col("p.c").alias("__dig"))
    texts = docs.select(F.col("doc_id").alias("__doc"), F.xxhash64(F.col("text")).alias("__text_dig"), F.col("text").cast("binary").alias("text"))
    read = placed.join(texts, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__dig") == F.col("__text_dig"))).select("component", "low", "high", "set", "text")
    keys = ["component", "low", "high"]
    pairs = staged(read.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_verified(shingle, share), "set binary, root binary"), "verified-links")
    found = component_labels(pairs.distinct(), "set", "root", label="group")
    best = grouped.select("set", "p").join(found, "set", "left").groupBy(F.coalesce("group", "set").alias("group")).agg(F.min("p").alias("p"))
    kept = best.select(F.col("p.b").alias("__kept_id"), F.col("p.c").alias("__kept_dig"))
    on = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.xxhash64(F.col("text")) == F.col("__kept_dig"))
    return docs.join(kept, on, "inner").dropDuplicates(["__kept_id", "__kept_dig"]).drop("__kept_id", "__kept_dig")
