from __future__ import annotations

import math
import random
import struct
from statistics import median

from pyspark.sql import functions as F

from listingspark.operators.ranking import grouped_median, grouped_medians, middle_cells, ordered_bits, rank_by_digest


def test_grouped_median_is_exact_with_a_dominant_group(spark):
    rng = random.Random(7)
    rows = []
    for group in ("hot", "small", "ties", "negative", "single"):
        size = {"hot": 6001, "small": 8, "ties": 50, "negative": 301, "single": 1}[group]
        for _ in range(size):
            value = {"ties": 5.0, "negative": rng.uniform(-50, 10)}.get(group, rng.lognormvariate(8, 2))
            rows.append((group, value))
    rows.append(("small", None))
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r["g"]: (r["median"], r["group_count"]) for r in grouped_median(df, ["g"], "v").collect()}
    for group in found:
        values = [v for g, v in rows if g == group and v is not None]
        assert abs(found[group][0] - median(values)) <= 1e-9 * abs(median(values))
        assert found[group][1] == len(values)


def test_weighted_median_counts_repeats(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 9.0, 2), ("b", 4.0, 1), ("b", 8.0, 1)], "g string, v double, w bigint")
    found = {r["g"]: r["median"] for r in grouped_median(df, ["g"], "v", weight="w").collect()}
    assert found == {"a": 1.0, "b": 6.0}


def test_several_medians_at_once(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, None), ("a", 5.0, 30.0)], "g string, x double, y double")
    assert grouped_medians(df, ["g"], ["x", "y"]).collect() == [("a", 3.0, 20.0)]


def test_keys_may_have_any_name_when_cells_are_cut_again(spark):
    df = spark.createDataFrame([(1, 2, 3, 100.0 + i / 1000) for i in range(400)], "__all int, __base int, __outer int, v double")
    found = grouped_median(df, ["__all", "__base", "__outer"], "v", limit=10).collect()
    assert [(r["group_count"], round(r["median"], 6)) for r in found] == [(400, 100.1995)]


def test_rank_matches_a_plain_window(spark):
    rng = random.Random(3)
    rows = [("f%d" % (0 if i % 3 else i % 5), i, rng.choice([1, 1, 1, 2, 7])) for i in range(4000)]
    df = spark.createDataFrame(rows, "family string, id int, rows int").withColumn("digest", F.sha2(F.col("id").cast("string"), 256))
    got = rank_by_digest(df, ["family"], "digest", "id", lead=["rows"])
    expected = df.selectExpr("*", "row_number() OVER (PARTITION BY family ORDER BY rows DESC, digest, id) AS rank",
                             "count(*) OVER (PARTITION BY family) AS group_count")
    columns = ["family", "id", "rank", "group_count"]
    assert sorted(got.select(*columns).collect()) == sorted(expected.select(*columns).collect())


def test_bits_are_those_of_the_binary_format(spark):
    rng = random.Random(11)
    values = [0.0, -0.0, 1.0, 2.0, 0.5, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 1e-3, 3.0]
    values += [math.ldexp(1.0, e) for e in range(-1074, 1024, 7)] + [math.nextafter(math.ldexp(1.0, e), 0) for e in range(-1073, 1024, 7)]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", ordered_bits(F.col("v")).alias("b")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(row["v"])))[0]
        assert row["b"] == (-bits if row["v"] < 0 else bits), row
    nan = spark.createDataFrame([(math.nan,), (math.inf,)], "v double").select(ordered_bits(F.col("v")).alias("b")).collect()
    assert nan[0]["b"] > nan[1]["b"]


def test_a_dominant_group_of_close_values_is_cut_until_it_fits(spark):
    """Values between 0 and 0.001, half of them within one step of the first round, next to small and null groups."""
    rng = random.Random(5)
    rows = [("hot", rng.uniform(0, 0.001)) for _ in range(15000)] + [("hot", 0.0005 + rng.uniform(0, 1e-9)) for _ in range(25000)]
    rows += [("tied", 0.25)] * 9000 + [("small", v) for v in (3.0, 1.0, 2.0, 9.0)] + [(None, 4.0), (None, 6.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    limit = 400
    source = df.select("g", F.lit(1).cast("bigint").alias("__weight"), ordered_bits(F.col("v")).alias("__bits"))
    targets, shift = middle_cells(source, ["g"], limit)
    crowded = {r["g"] for r in targets.where(F.col("__rows") > limit).collect()}
    assert shift < 42 and crowded <= {"tied"}  # one value alone may be frequent: its repeats are combined before they move
    found = {r["g"]: (r["median"], r["group_count"]) for r in grouped_median(df, ["g"], "v", limit=limit).collect()}
    for group in ("hot", "tied", "small", None):
        values = [v for g, v in rows if g == group]
        assert found[group] == (median(values), len(values))


def test_the_median_of_nothing(spark):
    assert grouped_median(spark.createDataFrame([], "g string, v double"), ["g"], "v").collect() == []
    assert grouped_median(spark.createDataFrame([("a", None)], "g string, v double"), ["g"], "v").collect() == []


def test_rows_of_many_groups_combine_into_few_cells(spark):
    from listingspark.operators.ranking import CELL_SHIFTS

    rng = random.Random(5)
    numbers = [rng.uniform(0.0, 60_000.0) for _ in range(4000)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    cells = rows.select(F.shiftright(ordered_bits(F.col("x")), CELL_SHIFTS[0]).alias("c")).groupBy("c").count().collect()
    assert len(cells) < 400 and max(r["count"] for r in cells) < 400
    assert grouped_median(rows.withColumn("g", F.lit(1)), ["g"], "x", limit=10).first()["median"] == median(numbers)
