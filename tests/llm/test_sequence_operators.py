"""Prefix trie, byte-pair encoding and whitening on small tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from listingspark.llm import bpe, prefix_trie, queries, whitening

from .fixtures import frames

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows, period=5, most=9):
    convs: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    # Equal turn numbers occur only in rows that are equal throughout.
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        seqs[c] = tuple(own.get(c - c % period, [])[:h] + turns[h:])
    members: dict[tuple, list] = {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for prefix, ids in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in members) for p in below)
        ends = ",".join(str(c) for c in sorted(ids) if len(seqs[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(ids), len(prefix), parent, len(ids), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made_turns(seed, conversations, groups):
    """Conversations of which many share their beginnings, with copies, null and repeated turns."""
    r = random.Random(seed)
    words = ["", "ja", "çé", "nein und", "a" * 40]
    openings = [[(r.choice(["user", None]), r.choice(words)) for _ in range(r.randint(1, 7))] for _ in range(groups)]
    rows = []
    for c in r.sample(range(1, 4 * conversations), conversations):
        turns = list(r.choice(openings))[: r.randint(1, 7)] + [("assistant", r.choice([*words, None])) for _ in range(r.randint(0, 5))]
        rows += [(c, i if i else None, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(None, 1, "user", "nobody"), (rows[0][0], None, rows[0][2], rows[0][3])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "conversations", "groups", "size"), [(1, 60, 4, 8), (2, 40, 1, 3), (3, 25, 25, 1024), (4, 30, 2, 2)])
def test_trie_matches_brute_force_over_any_blocks(spark, seed, conversations, groups, size):
    rows = made_turns(seed, conversations, groups)
    table = spark.createDataFrame(rows, TURNS)
    out = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(table)), size=size)
    assert out.columns == list(prefix_trie.COLUMNS) and {kind for _, kind in out.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, out.collect()), key=repr) == brute_trie(rows)


def test_trie_of_copies_turnless_and_long_conversations(spark):
    # One conversation in 40 copies, ids whose turns all go, a single id without its leader, 300 turns.
    rows = [(5 * c, i, "user", f"t{i}") for c in range(40) for i in range(3)]
    rows += [(c, 0, "user", "gone") for c in (1001, 1002, 1003, 1004, 2006)]
    rows += [(3000, i, "user", "x" * 50 if i == 2 else "y") for i in range(300)]
    table = spark.createDataFrame(rows, TURNS).withColumns({"block": F.lit(1), "name": F.lit("n"), "depth": F.lit(0), "hashes": F.lit(0)})
    for size in (4, 1024):
        out = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(table)), size=size)
        assert sorted(map(tuple, out.collect()), key=repr) == brute_trie(rows)


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(table))).collect() == []
    alone = spark.createDataFrame([(8, 0, "user", "x")], TURNS)  # one turn, all of it replaced by an absent leader's
    rows = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(alone))).collect()
    assert sorted(map(tuple, rows), key=repr) == brute_trie([(8, 0, "user", "x")])


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")
def test_trie_query_agrees_with_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    want = con.execute(queries.SQL["op11_prefix_trie"])
    columns, rows = [c[0] for c in want.description], want.fetchall()
    got = queries.QUERIES["op11_prefix_trie"](spark, FOLDER).select(*columns).collect()
    assert rows and sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_extents_of_range_minima():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64):
        values = r.integers(0, 4, n)
        table = prefix_trie.Ranges(values)
        for start in range(n):
            for bound in range(5):
                right = start
                while right + 1 < n and values[right + 1] >= bound:
                    right += 1
                left = start
                while left > 0 and values[left] >= bound:
                    left -= 1
                one = np.array([start]), np.array([bound])
                assert (table.right(*one)[0], table.left(*one)[0]) == (right, left)
            for end in range(start, n):
                assert table.least(np.array([start]), np.array([end]))[0] == values[start : end + 1].min()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts():
    r = random.Random(5)
    signs = ["a", "ab", "the ", " ", "\n", "\t", "'s", "'", "é", "ß", "的", "😀", " ", "̀", "\x00", "\x1c", "0", "123", ".,", "<|endoftext|>", "<|end"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    return [*texts, "", "a" * 4001, "ab" * 1500, " " * 999, "x" * 70_000, "lorem ipsum " * 30_000, "<|endoftext|>" * 3]


def test_ids_equal_those_of_the_library(spark, vocabulary, tokenizer):
    texts = odd_texts()
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string")
    ids = table.select("i", "text", bpe.encoded("text", vocabulary).alias("ids"))
    rows = {r["i"]: r for r in ids.select("i", "ids", bpe.decoded("ids", vocabulary).alias("back")).collect()}
    assert rows[len(texts)]["ids"] is None and rows[len(texts)]["back"] is None
    for i, t in enumerate(texts):
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert rows[i]["ids"] == want and rows[i]["back"] == tokenizer.decode(want, skip_special_tokens=False) == t


def test_every_frame_of_documents_round_trips(spark, vocabulary):
    for frame in frames(spark):
        out = frame.select("text", bpe.decoded(bpe.encoded("text", vocabulary), vocabulary).alias("back")).collect()
        assert all(r["back"] == r["text"] for r in out)


def test_odd_ids_decode_as_in_the_library(spark, vocabulary, tokenizer):
    lists = [[220, 50256, 11], [50257, 0, 99999], [], [167], [167, 123, 31], [None, 0]]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<int>")
    out = [r["text"] for r in table.select("i", bpe.decoded("ids", vocabulary).alias("text")).orderBy("i").collect()]
    assert out == [tokenizer.decode([i for i in x if i is not None], skip_special_tokens=False) for x in lists]


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 5)
    for sizes in ([], [9], [0, 0], [1, 2, 3, 9, 0, 5, 5, 1]):
        spans = list(bpe._slices(sizes))
        assert [i for low, high in spans for i in range(low, high)] == list(range(len(sizes)))


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_whitening(vectors, most=32):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True)) for row in x]
    return n, deviation, (c @ basis[:, :k]) / np.sqrt(values[:k]), values[:k] / values.sum()


def vectors_of(seed, n, d):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, d)) * np.linspace(3, 0.2, d) + r.standard_normal(d)).astype(np.float32).tolist()


@pytest.mark.parametrize(("n", "d"), [(700, 40), (12, 20), (300, 1), (500, 5)])
def test_whitening_matches_eigenvectors(spark, n, d):
    vectors = vectors_of(n, n, d)
    odd = [(None, None, 0), (None, [1.0, None] + [0.0] * (d - 1), 0), (7001, [float("nan")] * d, 0), (7002, [float("inf")] * d, 0), (7003, [1.0] * (d + 1), 0), (7004, [], 0)]
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)] + odd, VECTORS).repartition(37)
    rows = whitening.whitened(table.withColumns({"n": F.lit(1), "part": F.lit(2), "whitened": F.lit("w")})).collect()
    count, deviation, white, explained = brute_whitening(vectors)
    k = white.shape[1]
    got = np.zeros((n, k))
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == count and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-10
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    assert len(rows) == n * k
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got - signs * white).max() < 1e-7


def test_whitening_of_repeats_nulls_and_nothing(spark):
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], VECTORS)
    assert whitening.whitened(same).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS)).collect() == []
    two = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [3.0, 2.0], 0), (4, [-0.3, 2.0], 0)], VECTORS)
    rows = whitening.whitened(two).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in rows) == [(0, 1), (1, 1), (1, 1), (4, 1)]
    assert abs(sum(r["whitened"] ** 2 for r in rows) / 4 - 1) < 1e-12 and all(abs(r["explained"] - 1) < 1e-12 for r in rows)
    huge = spark.createDataFrame([(1, [1e12, 0.0], 0), (2, [-1e12, 1.0], 0)], VECTORS)
    assert {r["deviation"] for r in whitening.whitened(huge).collect()} == {None}


def planted_triangles():
    r = np.random.default_rng(9)
    basis = np.linalg.qr(r.standard_normal((120, 24)))[0]
    yield basis  # all values equal
    yield basis @ np.diag(np.r_[5 * (1 + 1e-9 * np.arange(12)), np.linspace(1, 2, 12)]) @ np.linalg.qr(r.standard_normal((24, 24)))[0]
    yield basis @ np.diag(10.0 ** -np.linspace(0, 12, 24))
    yield np.repeat(r.standard_normal((3, 24)), 9, axis=0)
    yield np.diag(np.arange(1.0, 25))
    chain = np.diag(np.abs(np.arange(21) - 10.0) + 2) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield np.linalg.cholesky(chain).T  # pairs of values that agree to all digits


@pytest.mark.parametrize("case", range(6))
def test_directions_of_close_graded_and_missing_values(case):
    a = list(planted_triangles())[case]
    squares, basis = whitening.directions(np.linalg.qr(a, mode="r"), 32)
    real = np.linalg.svd(a, compute_uv=False) ** 2
    assert len(squares) == min(32, int((real > 1e-26 * real[0]).sum()))
    assert np.abs(squares / real[: len(squares)] - 1).max() < 1e-9
    assert np.abs(basis.T @ basis - np.eye(len(squares))).max() < 1e-12
    assert np.abs(a.T @ (a @ basis) - basis * squares).max() < 1e-13 * real[0]
