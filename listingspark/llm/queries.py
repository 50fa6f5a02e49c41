"""Queries over the driver's text tables, each through its operator, and the SQL they must agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, html_diff, line_dedup, mixing, paragraphs, pii, prefix_trie, simhash, toxicity, url_trust, whitening

QUERIES = {}
SQL: dict[str, str] = {}


def register(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the line runs that occur earlier, and the runs cut."""
    kept = line_dedup.without_repeated_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "text", F.size("line_runs").alias("n_runs"), "line_runs")


@register
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@register
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@register
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the benchmark items verified in them."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register
def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_diff.main_text(table(spark, folder, "pages"))


@register
def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with personal values replaced by pseudonyms."""
    return pii.pseudonymised(table(spark, folder, "documents")).select("doc_id", "text", F.size("pii").alias("n_values"), "pii")


@register
def op6_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the units that occur earlier, with the character ranges cut."""
    kept = paragraphs.without_repeated_units(table(spark, folder, "documents"))
    return kept.select("doc_id", "text", F.size("cuts").alias("n_cuts"), "cuts")


@register
def op7_url_trust(spark: SparkSession, folder: str) -> DataFrame:
    return url_trust.judge(table(spark, folder, "pages"))


@register
def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every row whose id is divisible by 50."""
    vectors = table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@register
def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again; the digests of its ids and of the decoded text."""
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id", bpe.encoded("text", vocabulary).alias("ids"))
    texts = ids.select("doc_id", "ids", bpe.decoded("ids", vocabulary).alias("text"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return texts.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@register
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie over conversations that share their first turns with the first of their five."""
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(table(spark, folder, "conversations"))))



@register
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


# The checksum of an id, bit by bit, then every prefix as a list of turns.
SQL["op11_prefix_trie"] = """WITH RECURSIVE conv AS MATERIALIZED (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
checked AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
      lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END))) % 9 AS h FROM conv),
seqs AS MATERIALIZED (SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM checked a LEFT JOIN conv b ON b.conv_id = a.conv_id - a.conv_id % 5),
named AS (SELECT conv_id, turns, 0::BIGINT AS depth, sha256('') AS name, NULL::VARCHAR AS above FROM seqs
  UNION ALL SELECT conv_id, turns, depth + 1,
    sha256(name || len(turns[depth + 1].r) || ':' || turns[depth + 1].r || turns[depth + 1].t), name
  FROM named WHERE depth < len(turns)),
node AS MATERIALIZED (SELECT name, min(above) AS above, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * coalesce(min(CASE WHEN depth > 0 THEN strlen(turns[depth].t) END), 0) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256
  FROM named GROUP BY name),
children AS (SELECT above AS name, count(*) AS n FROM node WHERE depth > 0 GROUP BY above),
counted AS MATERIALIZED (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN children USING (name)),
within AS (SELECT name AS top, above, name AS at, saved, n_children FROM counted
  UNION ALL SELECT up.name, up.above, w.at, w.saved, w.n_children FROM within w JOIN counted up ON up.name = w.above),
total AS (SELECT top, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM within GROUP BY top)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves,
  total.saved::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN total ON total.top = c.name LEFT JOIN counted p ON p.name = c.above"""
