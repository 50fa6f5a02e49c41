"""Judging urls by rules and by trust that spreads over the host graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import StageTables

# Rules as (verdict, host and path, parted at the first slash).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    c = F.col(url) if isinstance(url, str) else url
    rest = F.regexp_extract(c, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    Of rules of the same length the one listed first wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        longer = fits & (rule.isNull() | (F.length(rule) < len(text)))
        rule, verdict = F.when(longer, F.lit(text)).otherwise(rule), F.when(longer, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct links between different hosts: src, dst. Relative links stay on their host."""
    host, _ = split_url(url)
    hrefs = F.array_distinct(F.filter(F.regexp_extract_all(F.col(html), F.lit(_HREF), F.lit(1)), lambda h: F.contains(h, F.lit("//"))))
    links = pages.where(F.col(html).isNotNull()).select(host.alias("src"), F.explode(hrefs).alias("h"))
    absolute = F.when(F.startswith("h", F.lit("//")), F.concat(F.lit("http:"), "h")).otherwise(F.col("h"))
    target, _ = split_url(absolute)
    return links.select("src", target.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").distinct()


def personalised_rank(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-6, among: str = "src") -> DataFrame:
    """Rank of every host that seeds reach: host, rank. ``seeds`` has host and weight.

    Each round is a join and a combined sum over edges, written to the checkpoint folder. The
    weight still on its way shrinks by ``damping`` in each round, so the number of rounds follows
    from the tolerance and not from the data; a round in which nothing moves ends it. Weight
    that reaches a host without links returns to no one. Ranks are not divided by their sum, so a
    seed without links keeps its own weight. ``among`` "src" shares a host's amount among the hosts
    it passes it to; "dst" gives each receiver the mean of all that pass to it, which doesn't
    shrink with their number of receivers.
    """
    stages = StageTables(edges.sparkSession, "host-rank")
    degree = edges.groupBy(among).agg(F.count("*").alias("degree"))
    weighed = stages.write(edges.join(degree, among))
    moving = stages.write(seeds.where("weight > 0").select("host", F.col("weight").alias("amount")))
    done, left = moving.select("host", F.col("amount").alias("rank")), 1.0
    while left > tolerance:
        moved = weighed.join(moving.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("amount") / F.col("degree")) * damping).alias("amount"))
        moving = stages.write(moved)
        if moving.isEmpty():
            break
        grown = done.unionByName(moving.select("host", F.col("amount").alias("rank")))
        done = stages.write(grown.groupBy("host").agg(F.sum("rank").alias("rank")))
        left *= damping
    return done


def judge(pages: DataFrame, *, rules=RULES, threshold: float = -0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of ``pages``.

    Trust flows along links from hosts with allowed pages, distrust against links from hosts
    with blocked pages: who links to a blocked host is suspect by the share of its own links that
    go to such hosts, however many others link there too. A seed weighs the share of its
    pages that fit such rules. A page without a rule is blocked when its host's trust minus its distrust
    lies below ``threshold``, so hosts that nothing reaches are allowed. A rule always decides
    over the graph. Empty and null urls fit no rule and take no part in the graph.
    """
    host, path = split_url("url")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    stages = StageTables(pages.sparkSession, "url-trust")
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = stages.write(placed.withColumn("rule", rule).withColumn("ruled", verdict))
    edges = stages.write(host_edges(pages))
    share = lambda kind: F.avg(F.coalesce(F.col("ruled") == kind, F.lit(False)).cast("double")).alias(kind)
    seeds = stages.write(ruled.where("host <> ''").groupBy("host").agg(share("allow"), share("block")))
    trust = personalised_rank(edges, seeds.select("host", F.col("allow").alias("weight"))).select("host", F.col("rank").alias("trust"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = personalised_rank(back, seeds.select("host", F.col("block").alias("weight")), among="dst").select("host", F.col("rank").alias("distrust"))
    known = trust.join(distrust, "host", "full")
    joined = ruled.join(known, "host", "left")
    trusted, distrusted = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when(trusted - distrusted < threshold, "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_graph).alias("verdict"),
        trusted.alias("trust"), distrusted.alias("distrust"),
    )
