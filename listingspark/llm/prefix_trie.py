"""The trie of conversation prefixes, from sorted conversations and the prefixes that neighbours share.

Conversations are sorted by their turns, so the members of every prefix are neighbours, and the
number of turns a row shares with the row before tells where an interval ends. Blocks of rows are
worked on side by side: a sparse table of range minima over these numbers lets each candidate prefix
search its left and right extent on its own. Only prefixes that reach over the edge of a block are
put together afterwards, from one piece per block.

Rows carry two hashes and a size for each turn; texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .base import digest, numbered, staged

BLOCK = 1024  # conversations whose extents are searched together
NO_MEMBERS = hashlib.sha256().hexdigest()

NODE = (
    "depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, block long, edge string, parent_edge string, parent_depth int, "
    "name binary, parent_name binary, starts boolean, shared_before long, bytes_before long, ends string"
)
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its ordered turns: two hashes of role and text, and the bytes of the text.

    Null roles and texts are empty, null turn numbers come first; turns of one number follow the
    order of their hashes. Rows without a conv_id belong to no conversation. One conversation is one
    row of 24 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    a, b = digest(name)
    turn = F.struct(F.col("turn").alias("at"), a.alias("a"), b.alias("b"), F.octet_length(text).cast("long").alias("bytes"))
    rows = turns.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
    return rows.agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def rebuilt(convs: DataFrame, *, period: int = 5, most: int = 9) -> DataFrame:
    """Every conversation with its first turns taken from the one that begins its group of ``period`` ids.

    How many, below ``most``, follows from the checksum of the id. At most ``period`` rows meet
    each leading conversation.
    """
    heads = convs.where(F.col("conv_id") % period == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most).alias("head"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    own = convs.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % period).withColumn("taken", taken)
    joined = own.join(heads, "head_id", "left")
    first = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("taken"))
    rest = F.slice("turns", F.col("taken") + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(first, rest).alias("turns"))


class Ranges:
    """Range minima over a row of numbers from a sparse table: level k holds the minima of 2**k neighbours."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of values[low..high], both included."""
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), dtype=self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << k) + 1])
        return out

    def right(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last position from which values[start+1..position] are all at least ``bound``."""
        at = start.copy()
        for k in reversed(range(len(self.levels))):
            table = self.levels[k]
            fits = at + 1 < len(table)
            fits[fits] = table[at[fits] + 1] >= bound[fits]
            at[fits] += 1 << k
        return at

    def left(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first position from which values[position+1..start] are all at least ``bound``."""
        at = start.copy()
        for k in reversed(range(len(self.levels))):
            low = at - (1 << k) + 1
            fits = low >= 1
            fits[fits] = self.levels[k][low[fits]] >= bound[fits]
            at[fits] -= 1 << k
        return at


def _counts(keys: np.ndarray, positions: np.ndarray, rows: int, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many ``positions`` within low..high carry the wanted key."""
    order = np.sort(keys * rows + positions)
    return np.searchsorted(order, wanted * rows + high, "right") - np.searchsorted(order, wanted * rows + low, "left")


def _names(row: bytes, deepest: int) -> list[bytes]:
    """Names of the prefixes of a row of hashed turns, by depth from 0."""
    state, found = hashlib.blake2b(digest_size=16), []
    for depth in range(deepest + 1):
        found.append(state.copy().digest())
        state.update(row[16 * depth : 16 * depth + 16])
    return found


class Block:
    """Neighbouring conversations in sorted order, with the row before and the row after where there are such."""

    def __init__(self, rows: pa.Table, block: int, size: int):
        rows = rows.sort_by("number")
        home = np.array(rows["number"]) // size
        hashes = rows["hashes"].combine_chunks()
        sizes = rows["bytes"].combine_chunks()
        bounds = np.array(hashes.offsets)
        keys = np.array(hashes.values)
        lengths = np.diff(bounds) // 2
        shared = np.full(len(home) + 1, -1, dtype=np.int64)  # turns in common with the row before
        for i in range(1, len(home)):
            n = 2 * min(lengths[i - 1], lengths[i])
            differs = np.flatnonzero(keys[bounds[i - 1] : bounds[i - 1] + n] != keys[bounds[i] : bounds[i] + n])
            shared[i] = (differs[0] if len(differs) else n) // 2
        mine = np.flatnonzero(home == block)
        low, high = mine[0], mine[-1]
        self.block, self.rows = block, high - low + 1
        self.ids = np.array(rows["conv_id"])[low : high + 1]
        self.shared = shared[low : high + 2]
        self.lengths = lengths[low : high + 1]
        self.raw = [keys[bounds[i] : bounds[i + 1]].tobytes() for i in (low, high)]
        inside = np.array(sizes.values)[bounds[low] // 2 : bounds[high + 1] // 2]
        self.totals = np.r_[0, np.cumsum(inside)]
        self.at = (bounds[low : high + 1] - bounds[low]) // 2
        self.ranges = Ranges(self.shared[:-1])
        self.least = Ranges(self.ids)
        self.saved = np.r_[0, np.cumsum(self.bytes(np.arange(self.rows), np.maximum(self.shared[:-1], 0)))]
        self.leaves = np.r_[0, np.cumsum((self.shared[1:] < self.lengths) & (self.lengths > 0))]

    def bytes(self, row: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Text bytes of the first ``turns`` of each row."""
        return self.totals[self.at[row] + turns] - self.totals[self.at[row]]

    def described(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> dict[str, np.ndarray]:
        """What the members within this block tell about prefixes."""
        rows = np.arange(self.rows)
        starts = self.shared[low] < depth
        branch = self.shared[:-1]
        deeper = np.flatnonzero(self.lengths > branch)
        first = np.where(starts, 1, 0)
        return {
            "conv_id": self.least.least(low, high), "n_convs": high - low + 1, "n_leaves": self.leaves[high + 1] - self.leaves[low],
            "n_children": _counts(branch[deeper], deeper, self.rows, depth, low + first, high) + (starts & (self.lengths[low] > depth)),
            "saved": self.saved[high + 1] - self.saved[low], "starts": starts, "shared_before": np.where(starts, self.saved[low + 1] - self.saved[low], 0),
            "bytes_before": self.bytes(low, np.maximum(depth - 1, 0)), "ended": _counts(self.lengths, rows, self.rows, depth, low, high),
        }

    def ends(self, low: int, count: int) -> str:
        return ",".join(map(str, self.ids[low : low + count].tolist()))

    def edges(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """L for prefixes that go on before the block, R for those that only go on after it."""
        before = (low == 0) & (self.shared[0] >= depth)
        after = (high == self.rows - 1) & (self.shared[-1] >= depth)
        return np.where(before | (depth == 0), "L", np.where(after, "R", ""))

    def pieces(self) -> pd.DataFrame:
        """The part in this block of each prefix that reaches over an edge, and of the root."""
        before = np.arange(max(self.shared[0], 0) + 1)
        after = np.arange(1, self.shared[-1] + 1)
        row = np.r_[np.zeros(len(before), dtype=np.int64), np.full(len(after), self.rows - 1)]
        depth = np.r_[before, after]
        low, high = self.ranges.left(row, depth), self.ranges.right(row, depth)
        once = np.r_[np.ones(len(before), dtype=bool), (low[len(before) :] > 0) | (self.shared[0] < after)]
        low, high, depth = low[once], high[once], depth[once]
        found = self.described(low, high, depth)
        edge = self.edges(low, high, depth)
        names = [_names(raw, len(raw) // 16) for raw in self.raw]
        of = [names[0] if e == "L" else names[1] for e in edge]
        return pd.DataFrame({
            "depth": depth, "conv_id": found["conv_id"], "parent_conv_id": None, "n_convs": found["n_convs"], "n_children": found["n_children"],
            "n_leaves": found["n_leaves"], "saved_tokens": found["saved"], "ends_sha256": None, "block": self.block, "edge": edge,
            "parent_edge": None, "parent_depth": None, "name": [n[d] for n, d in zip(of, depth, strict=True)],
            "parent_name": [n[d - 1] if d else None for n, d in zip(of, depth, strict=True)], "starts": found["starts"],
            "shared_before": found["shared_before"], "bytes_before": found["bytes_before"],
            "ends": [self.ends(at, n) for at, n in zip(low, found["ended"], strict=True)],
        })

    def nodes(self) -> pd.DataFrame:
        """Prefixes whose members all stand in this block.

        Candidates are what a row shares with the row before, and whole rows. Prefixes between a
        candidate and the next shorter one have the same members and follow from it.
        """
        row = np.r_[np.arange(1, self.rows), np.arange(self.rows)]
        depth = np.r_[self.shared[1:-1], self.lengths]
        row, depth = row[depth > 0], depth[depth > 0]
        low, high = self.ranges.left(row, depth), self.ranges.right(row, depth)
        _, once = np.unique(np.stack([low, depth]), axis=1, return_index=True)
        whole = once[self.edges(low[once], high[once], depth[once]) == ""]
        low, high, depth = low[whole], high[whole], depth[whole]
        found = self.described(low, high, depth)
        above = np.maximum(np.maximum(self.shared[low], self.shared[high + 1]), 0)
        around = self.ranges.left(low, above), self.ranges.right(low, above)
        edge = self.edges(*around, above)
        parent = self.least.least(*around)
        run = depth - above  # this prefix and those above it with the same members
        of = np.repeat(np.arange(len(run)), run)
        at = np.arange(len(of)) - np.repeat(np.cumsum(run) - run, run) + 1 + above[of]
        deepest, top = at == depth[of], at == above[of] + 1
        before = self.bytes(low[of], at - 1)
        saved = found["saved"] - found["shared_before"]
        ids = np.array([hashlib.sha256(self.ends(a, n).encode()).hexdigest() if n else NO_MEMBERS for a, n in zip(low, found["ended"], strict=True)], dtype=object)
        own = top & (edge[of] == "")
        return pd.DataFrame({
            "depth": at, "conv_id": found["conv_id"][of],
            "parent_conv_id": pd.array(np.where(own, parent[of], found["conv_id"][of]), dtype="Int64"),
            "n_convs": found["n_convs"][of], "n_children": np.where(deepest, found["n_children"][of], 1), "n_leaves": found["n_leaves"][of],
            "saved_tokens": saved[of] - (found["n_convs"][of] - 1) * before,
            "ends_sha256": np.where(deepest, ids[of] if len(ids) else NO_MEMBERS, NO_MEMBERS), "block": self.block, "edge": None,
            "parent_edge": np.where(top & (edge[of] != ""), edge[of], None), "parent_depth": pd.array(above[of], dtype="Int64"),
            "name": None, "parent_name": None, "starts": None, "shared_before": None, "bytes_before": None, "ends": None,
        })


def _searched(schema: pa.Schema, size: int):
    def search(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        block = Block(rows, key[0].as_py(), size)
        parts = [pa.Table.from_pandas(part, schema=schema, preserve_index=False) for part in (block.nodes(), block.pieces())]
        return pa.concat_tables(parts)

    return search


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest per name from parts in order; holds one part at a time, however many there are."""
    name, state = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for this, part in zip(batch["name"], batch["ends"], strict=True):
            if this == name:
                state.update(b",")
            else:
                if name is not None:
                    done.append((name, state.hexdigest()))
                name, state = this, hashlib.sha256()
            state.update(part.encode())
        yield pd.DataFrame(done, columns=["name", "ends_sha256"])
    if name is not None:
        yield pd.DataFrame([(name, state.hexdigest())], columns=["name", "ends_sha256"])


def trie(sequences: DataFrame, *, size: int = BLOCK) -> DataFrame:
    """Nodes of the trie over ``conv_id`` and ``turns`` as :func:`rebuilt` gives them.

    One row per distinct prefix and the root: its smallest member, depth, parent's smallest member,
    members, children, leaves below, bytes saved below when every prefix is stored once, and the digest
    of the members that end there. Repeated conversations share all their nodes; conversations without
    turns are members of the root alone. No conversations, no nodes. The digest of one node is by its
    definition one sequence, so the parts of a node that ends very many conversations are hashed in
    order in one task, which holds one part of at most ``size`` ids.
    """
    spark = sequences.sparkSession
    hashes = F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"])))
    rows = sequences.select("conv_id", hashes.alias("hashes"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"))
    ordered = numbered(rows, ["hashes", "conv_id"], "number", "trie-order")
    block, place = F.expr(f"number div {size}"), F.col("number") % size
    # Each block also sees the row before it and the row after it.
    homes = F.array_compact(F.array(block, F.when(place == 0, block - 1), F.when(place == size - 1, block + 1)))
    placed = ordered.withColumn("block", F.explode(homes))
    # The row before the first block has no home; the block after the last has only a neighbour's row.
    count = ordered.count()
    placed = placed.where((F.col("block") >= 0) & (F.col("block") * size < count))
    schema = spark.createDataFrame([], NODE).schema
    names = [f.name for f in schema]
    found = staged(placed.groupBy("block").applyInArrow(_searched(to_arrow_schema(schema), size), schema), "trie-nodes").select(*names)
    whole, pieces = found.where("edge IS NULL"), found.where("edge IS NOT NULL")
    parts = pieces.where("ends <> ''").repartition("name").sortWithinPartitions("name", "block")
    ends = parts.select("name", "ends").mapInPandas(_digests, "name binary, ends_sha256 string")
    sums = pieces.groupBy("name").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("parent_name").alias("parent_name"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "shared_before")], F.max("bytes_before").alias("bytes_before"),
    )
    united = staged(sums.join(ends, "name", "left"), "trie-united")
    parents = united.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("parent_conv_id"))
    saved = F.col("saved_tokens") - F.col("shared_before") - (F.col("n_convs") - 1) * F.col("bytes_before")
    leaves = F.when((F.col("depth") == 0) & (F.col("n_leaves") == 0), F.lit(1)).otherwise(F.col("n_leaves"))
    across = united.join(parents, "parent_name", "left").withColumns({
        "saved_tokens": saved, "n_leaves": leaves, "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_MEMBERS)),
    })
    # Parents that reach over an edge: looked up by block, so that no frequent prefix is one key.
    above = pieces.select("block", F.col("edge").alias("parent_edge"), F.col("depth").alias("parent_depth"), "name")
    above = above.join(united.select("name", F.col("conv_id").alias("above")), "name").drop("name")
    below = whole.join(above, ["block", "parent_edge", "parent_depth"], "left")
    below = below.withColumn("parent_conv_id", F.when(F.col("parent_edge").isNotNull(), F.col("above")).otherwise(F.col("parent_conv_id")))
    out: list[Column] = [F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in COLUMNS]
    return below.select(*out).unionByName(across.select(*out))
