"""Byte-level byte-pair encoding and decoding with a public tokenizer file.

The words of a slice of texts become one flat array of symbols. Every round finds the lowest-ranked
pair of each word by binary search over the sorted keys of all pairs, merges it throughout the word
and drops the words in which no pair is left, so a round costs as much as the words still at work.
Nothing is shuffled: rows are encoded where they are scanned.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how the byte-level scheme cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)  # the rank of a pair that never merges
SLICE = 1 << 20  # bytes or tokens worked on at once, unless one text is longer
KEPT = 1 << 22  # bytes of encoded words that a worker remembers


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary file: itself where printable, else the next free one from 256."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """Tokens and merges of one file, read once on the driver; its size does not depend on the data."""

    tokens: list[bytes | None]  # by id
    byte_ids: np.ndarray  # the id of each single byte
    keys: np.ndarray  # sorted pairs, the left id in the upper 32 bits
    ranks: np.ndarray  # the rank of each of these pairs
    merged: np.ndarray  # by rank, the id of the union
    added: dict[str, int]  # whole strings that are one token wherever they stand

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, cut = content["model"], content["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or content["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError(f"Not a plain byte-level vocabulary: {path}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in content["added_tokens"]):
            raise ValueError(f"Added tokens that take in their surroundings are not supported: {path}")
        ids, letters = model["vocab"], byte_letters()
        to_byte = {letter: b for b, letter in enumerate(letters)}
        added = {t["content"]: t["id"] for t in content["added_tokens"]}
        tokens: list[bytes | None] = [None] * (1 + max([*ids.values(), *added.values()]))
        for token, i in ids.items():
            tokens[i] = bytes(to_byte[letter] for letter in token)
        for token, i in added.items():
            tokens[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(
            tokens, np.array([ids[letter] for letter in letters], dtype=np.int32), keys[order], order.astype(np.int32),
            np.array([ids[a + b] for a, b in pairs], dtype=np.int32), added,
        )

    @cached_property
    def decoding(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens as one run of bytes, with the start and length of each."""
        parts = [token or b"" for token in self.tokens]
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as 32-bit integers in bytes. No word is empty."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbols), NONE)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            best = np.minimum.reduceat(rank, starts)
            working = np.repeat(best < NONE, sizes)
            if not working.all():
                finished.append((owner[~working], symbols[~working]))
                lowest = np.repeat(best, sizes)[working]
                symbols, owner, rank = symbols[working], owner[working], rank[working]
            else:
                lowest = np.repeat(best, sizes)
            if not len(symbols):
                break
            hit = np.flatnonzero(rank == lowest)
            # In a run such as "aaaa" the pairs overlap: every other one merges, from the left.
            first = np.r_[True, np.diff(hit) != 1]
            hit = hit[(hit - hit[first][np.cumsum(first) - 1]) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            rank[hit] = rank[hit + 1]
            kept = np.ones(len(symbols), dtype=bool)
            kept[hit + 1] = False
            changed = hit - np.arange(len(hit))
            symbols, owner, rank = symbols[kept], owner[kept], rank[kept]
            near = np.r_[changed, changed[changed > 0] - 1]
            near = near[near < len(symbols) - 1]
            near = near[owner[near] == owner[near + 1]]
            rank[near] = self.rank(symbols[near], symbols[near + 1])
        where = np.concatenate([o for o, _ in finished]) if finished else np.empty(0, dtype=np.int64)
        order = np.argsort(where, kind="stable")
        flat = np.concatenate([s for _, s in finished])[order].tobytes() if finished else b""
        ends = (4 * np.cumsum(np.bincount(where, minlength=len(words)))).tolist()
        return [flat[low:high] for low, high in zip([0, *ends], ends, strict=False)]


def _slices(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to at most SLICE, one row at least."""
    low = total = 0
    at = -1
    for at, size in enumerate(sizes):
        if total and total + size > SLICE:
            yield low, at
            low = at
            total = 0
        total += size
    if at >= low:
        yield low, at + 1


class Encoder:
    """Words encoded so far, in one worker; forgotten when they outgrow KEPT."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.cut = regex.compile(WORDS).findall
        names = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        # A word never equals an added token, as texts are cut at those first.
        self.special = {name: np.array([i], dtype=np.int32).tobytes() for name, i in vocabulary.added.items()}
        self.known, self.held = dict(self.special), 0

    def words(self, text: str) -> list[str]:
        if not self.added or not self.added.search(text):
            return self.cut(text)
        parts = self.added.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.cut(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers in bytes."""
        cut = [self.words(text) for text in texts]
        distinct = set().union(*cut)
        if self.held > KEPT:
            self.known, self.held = dict(self.special), 0
        if new := list(distinct - self.known.keys()):
            raw = [w.encode("utf-8", "replace") for w in new]
            found = self.vocabulary.merge(raw)
            self.known.update(zip(new, found, strict=True))
            self.held += sum(map(len, raw)) + sum(map(len, found))
        return [b"".join([self.known[w] for w in words]) for words in cut]


def encoded(text: str | Column, vocabulary: Vocabulary) -> Column:
    """Ids of every whole text as ``array<int>``.

    Null stays null and an empty text has no ids. Added tokens such as an end mark are found
    first, wherever they stand; texts are cut into words between them.
    """

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary)
        for texts in batches:
            parts: list[pa.Array] = []
            for low, high in _slices(pc.binary_length(texts).fill_null(0).to_numpy()):
                found = encoder.encode([t or "" for t in texts[low:high].to_pylist()])
                ends = np.cumsum([0, *(len(f) // 4 for f in found)], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(found), dtype=np.int32))
                parts.append(pa.ListArray.from_arrays(pa.array(ends), flat, mask=texts[low:high].is_null()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(encode, "array<int>")(text)


def decoded(ids: str | Column, vocabulary: Vocabulary) -> Column:
    """Text of every array of ids.

    Null stays null and no ids give an empty text. Ids that the vocabulary lacks and null ids
    stand for nothing; bytes that are no UTF-8 become U+FFFD.
    """

    def decode(column: pa.Array) -> pa.Array:
        letters, starts, lengths = vocabulary.decoding
        parts: list[pa.Array] = []
        bounds, absent = column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
        for low, high in _slices(np.diff(bounds)):
            flat = column.values[bounds[low] : bounds[high]].fill_null(-1).to_numpy(zero_copy_only=False)
            real = (flat >= 0) & (flat < len(lengths))
            flat = np.where(real, flat, 0)
            size = np.where(real, lengths[flat], 0)
            ends = np.r_[0, np.cumsum(size)]
            source = np.repeat(starts[flat] - ends[:-1], size) + np.arange(ends[-1])
            run = letters[source].tobytes()
            at = ends[bounds[low : high + 1] - bounds[low]].tolist()
            texts = [run[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
            parts.append(pa.array(texts, pa.string(), mask=absent[low:high]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(decode, "string")(ids)
