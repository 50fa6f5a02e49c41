from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from listingspark.operators import components, consolidate, splits

SPEC = ("make", "model", "variant", "year", "mileage_km", "engine_cc", "fuel", "transmission", "listing_city", "assembly")
SCHEMA = (
    "listing_id string, collected_at timestamp, source_batch string, make string, model string, variant string, year bigint, mileage_km bigint, "
    "engine_cc bigint, fuel string, transmission string, listing_city string, assembly string, price_pkr bigint, exclusion_reasons string, "
    "modeling_candidate boolean, source_checked_candidate boolean"
)


def observation(id, day, batch, mileage=10, price=100, checked=True, make="M", reasons="", variant="V"):
    from datetime import datetime, timezone

    return (id, datetime(2026, 1, day, tzinfo=timezone.utc), batch, make, "X", variant, 2015, mileage, 1300, "Petrol", "Manual", "Lahore", "Local",
            price, reasons, not reasons, checked and not reasons)


def history(spark, *rows):
    return spark.createDataFrame(list(rows), "listing_id string, group_id string, partition string, validation_fold int")


def consolidated(spark, observations, *assigned):
    rows = consolidate.consolidate_observations(spark.createDataFrame(observations, SCHEMA), history(spark, *assigned))
    return {r["listing_id"]: r for r in rows.collect()}


def test_newer_unchecked_row_beats_older_checked_row(spark):
    rows = consolidated(spark, [observation("1", 1, "a", price=90), observation("1", 2, "b", price=80, checked=False)])
    assert rows["1"]["price_pkr"] == 80 and not rows["1"]["source_checked_candidate"]
    assert rows["1"]["observation_count"] == 2 and rows["1"]["observation_batches"] == "a;b"


def test_old_specification_still_links_after_mileage_changes(spark):
    rows = consolidated(spark, [observation("1", 1, "a"), observation("1", 2, "b", mileage=99), observation("2", 1, "a"), observation("3", 1, "a", mileage=5)])
    assert rows["1"]["group_id"] == rows["2"]["group_id"] != rows["3"]["group_id"]
    assert rows["3"]["group_id"] == "listing_3"


def test_missing_specification_links_nothing(spark):
    rows = consolidated(spark, [observation("1", 1, "a", variant=None), observation("2", 1, "a", variant=None)])
    assert rows["1"]["group_id"] != rows["2"]["group_id"]


def test_development_and_test_collision_is_quarantined(spark):
    rows = consolidated(
        spark, [observation("1", 1, "a"), observation("2", 1, "a")], ("1", "g1", "development", 2), ("2", "g2", "demo_test", None))
    for row in rows.values():
        assert row["historical_partition"] == "quarantined" and row["historical_validation_fold"] is None
        assert consolidate.HISTORY_CONFLICT in row["exclusion_reasons"] and not row["modeling_candidate"]


def test_history_links_ids_and_keeps_the_smallest_fold(spark):
    rows = consolidated(
        spark, [observation("1", 1, "a", mileage=1), observation("2", 1, "a", mileage=2)], ("1", "g", "development", 2), ("2", "g", "development", 1))
    assert {(r["historical_partition"], r["historical_validation_fold"]) for r in rows.values()} == {("development", 1)}
    assert rows["1"]["group_id"] == rows["2"]["group_id"]


def test_family_change_is_excluded(spark):
    rows = consolidated(spark, [observation("1", 1, "a", make="M"), observation("1", 2, "b", make="N")])
    assert rows["1"]["exclusion_reasons"] == consolidate.FAMILY_CONFLICT


def test_tie_with_different_values_is_reported(spark):
    df = spark.createDataFrame([
        observation("1", 2, "b", price=1), observation("1", 2, "a", price=2), observation("2", 2, "a"), observation("2", 2, "b"),
        observation("3", 1, "a", price=5), observation("3", 2, "b"),
    ], SCHEMA)
    latest = consolidate.latest_observations(df)
    assert [r["listing_id"] for r in consolidate.tie_conflicts(latest).collect()] == ["1"]
    assert {r["listing_id"]: r["source_batch"] for r in latest.collect()} == {"1": "a", "2": "a", "3": "b"}


def test_components_of_chains_hubs_and_noise_match_union_find(spark):
    rng = random.Random(11)
    links = [(f"c{i:03d}", f"k{i}") for i in range(200)] + [(f"c{i + 1:03d}", f"k{i}") for i in range(200)]
    links += [(f"h{i}", "hub") for i in range(400)] + [(f"n{rng.randrange(300)}", f"r{rng.randrange(260)}") for _ in range(300)]
    links += [("alone", None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    first = {}
    for node, key in links:
        find(node)
        if key is not None:
            a, b = find(node), find(first.setdefault(key, node))
            parent[max(a, b)] = min(a, b)
    rng.shuffle(links)
    df = spark.createDataFrame(links, "id string, key string")
    found = {r["id"]: r["component"] for r in components.component_labels(df, "id", "key").collect()}
    assert found == {node: find(node) for node, _ in links}
    again = components.component_labels(
        spark.createDataFrame(list(found.items()), "id string, key string"), "id", "key")
    assert {r["id"]: r["component"] for r in again.collect()} == found


@pytest.mark.parametrize("names", [("set", "root", "group"), ("home", "key", "node"), ("root", "home", "least")])
def test_components_bear_columns_of_any_name(spark, names):
    node, key, label = names
    links = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", None)], [node, key])
    for table in (links, links.where(f"{node} IN ('a', 'b') AND {key} = '1'")):
        found = components.component_labels(table, node, key, label=label)
        assert found.columns == [node, label]
        assert {r[0]: r[1] for r in found.collect()} == {r[0]: "d" if r[0] == "d" else "a" for r in table.collect()}


def test_rounds_of_components_shrink(spark, monkeypatch):
    """All rounds over one long chain write a small multiple of its edges."""
    written = []

    class Counted(components.StageTables):
        def write(self, df):
            table = super().write(df)
            written.extend([table.count()] if "/components-" in self.root else [])
            return table

    monkeypatch.setattr(components, "StageTables", Counted)
    places = spark.range(3000)
    chain = places.selectExpr("id AS node", "id div 2 AS key").unionByName(places.selectExpr("id AS node", "-1 - (id + 1) div 2 AS key"))
    found = components.component_labels(chain, "node", "key").select("component").distinct().collect()
    assert [r["component"] for r in found] == [0] and sum(written) < 5 * written[0]


def population(spark, families=4, groups=8, price=lambda i: 1_000_000 + i):
    rows = [(f"l{f}_{g}", f"g{f}_{g}", f"make{f}", "m", price(g)) for f in range(families) for g in range(groups)]
    return spark.createDataFrame(rows, "listing_id string, group_id string, make string, model string, price_pkr bigint")


def as_set(assignments):
    return {tuple(r) for r in assignments.collect()}


def test_splits_ignore_order_and_target_but_not_seed(spark):
    rows = population(spark)
    base = as_set(splits.build_splits(rows))
    assert sum(p == "demo_test" for _, _, p, _ in base) == 8
    assert as_set(splits.build_splits(rows.orderBy(F.desc("listing_id")).repartition(7))) == base
    assert as_set(splits.build_splits(population(spark, price=lambda i: 7 * i + 1))) == base
    assert as_set(splits.build_splits(rows, seed=43)) != base
    for mode in ("deal", "greedy"):
        assert splits.split_violations(rows, splits.build_splits(rows, mode=mode), 3).isEmpty()


def sequential_greedy(groups, folds, phase, offsets=None, given=()):
    """Every group in turn: empty folds, least rows of the family, then all rows (or an offset), then the fold."""
    placed, everywhere = {}, [0] * folds
    for family in sorted({(g[1], g[2]) for g in groups}, key=lambda f: [(x is not None, x or "") for x in f]):
        load, seen = [0] * folds, [0] * folds
        for make, model, fold, rows in given:
            if (make, model) == family:
                load[fold] += rows
        mine = sorted((g for g in groups if (g[1], g[2]) == family), key=lambda g: (-g[3], hashlib.sha256(f"42:{phase}:{g[0]}".encode()).hexdigest()))
        for name, _, _, rows in mine:
            tie = (lambda i: (everywhere[i], i)) if offsets is None else (lambda i: (i - offsets[family[0]]) % folds)
            fold = min(range(folds), key=lambda i: (offsets is None and seen[i] > 0, load[i], tie(i)))
            placed[name] = fold
            load[fold] += rows
            everywhere[fold] += rows
            seen[fold] += 1
    return placed


def test_greedy_rule_matches_a_sequential_one(spark):
    rng = random.Random(5)
    families = [(f"f{i}" if i else None, "m" if i != 2 else None) for i in range(9)]
    groups = [(f"g{i}", *families[min(i // 70, 8) if i < 630 else i % 9], rng.choice([1, 1, 1, 1, 2, 3, 11, 40])) for i in range(800)]
    df = spark.createDataFrame(groups, "group_id string, make string, model string, rows bigint")
    for folds in (2, 3, 5):
        got = splits.greedy_folds(df, 42, folds)
        assert {r["group_id"]: r["validation_fold"] for r in got.collect()} == sequential_greedy(groups, folds, "development")
    old = [("f3", "m", 0, 70), ("f3", "m", 1, 3), ("f1", "m", 2, 9), (None, "m", 1, 5)]
    loads = spark.createDataFrame(old, "make string, model string, validation_fold int, rows bigint")
    offsets = {r["make"]: r["o"] for r in df.select("make", splits.start_offset(3).alias("o")).distinct().collect()}
    continued = splits.greedy_folds(df, 42, 3, splits.REVIEWED_PHASE, loads)
    expected = sequential_greedy(groups, 3, "reviewed-development", offsets, old)
    assert {r["group_id"]: r["validation_fold"] for r in continued.collect()} == expected


def test_rows_without_family_or_group_stay(spark):
    rows = population(spark)
    count = rows.count()
    nameless = rows.withColumns({"model": F.expr("CASE WHEN listing_id LIKE '%_1' THEN model END"), "group_id": F.col("listing_id")})
    for mode in ("deal", "greedy"):
        assert splits.build_splits(nameless, mode=mode).count() == count
    lost = rows.withColumns({
        "group_id": F.expr("CASE WHEN listing_id NOT LIKE '%_0' THEN group_id END"), "historical_partition": F.lit("new"),
        "historical_validation_fold": F.lit(None).cast("int"),
    })
    kept, refused = splits.splittable(lost)
    held = {r["reason"]: r["rows"] for r in refused.collect()}
    assert set(held) == {"no_group"} and kept.count() + held["no_group"] == count
    assert splits.build_splits(lost, mode="greedy").count() == count


def test_split_violations_name_every_breach(spark):
    rows = population(spark)
    good = splits.build_splits(rows)
    kinds = lambda df: {r["violation"] for r in splits.split_violations(rows, df, 3).collect()}
    assert kinds(good.where("listing_id <> 'l0_0'")) >= {"omitted_row"}
    assert "duplicate_assignment" in kinds(good.unionByName(good.limit(1)))
    assert "regrouped_row" in kinds(good.withColumn("group_id", F.when(F.col("listing_id") == "l1_1", F.lit("x")).otherwise(F.col("group_id"))))
    assert "invalid_location" in kinds(good.withColumn("validation_fold", F.lit(7)))
    crossed = rows.withColumn("group_id", F.when(F.col("group_id").isin("g0_1", "g1_1"), F.lit("both")).otherwise(F.col("group_id")))
    assert "cross_family_group" in {r["violation"] for r in splits.split_violations(crossed, splits.build_splits(crossed), 3).collect()}


def test_continued_splits_never_move_history(spark):
    rows = population(spark).withColumns({
        "historical_partition": F.expr("CASE WHEN listing_id LIKE '%_0' THEN 'demo_test' WHEN listing_id LIKE '%_1' THEN 'development' ELSE 'new' END"),
        "historical_validation_fold": F.expr("CASE WHEN listing_id LIKE '%_1' THEN 2 END"),
    })
    for mode in ("deal", "greedy"):
        kept = {r["listing_id"]: (r["partition"], r["validation_fold"]) for r in splits.continued_splits(rows, mode=mode).collect()}
        assert len(kept) == 32 and kept["l0_0"] == ("demo_test", None) and kept["l3_1"] == ("development", 2)
        only = {r["listing_id"]: (r["partition"], r["validation_fold"]) for r in splits.continued_splits(rows, policy="development_only", mode=mode).collect()}
        assert {p for i, (p, _) in only.items() if not i.endswith("_0")} == {"development"}
    mixed = rows.withColumn("group_id", F.when(F.col("listing_id").isin("l0_0", "l0_1"), F.lit("g")).otherwise(F.col("group_id")))
    assert {r["violation"] for r in splits.history_violations(mixed).collect()} == {"conflicting_historical_locations"}


def test_rows_that_lie_together_are_not_dealt_anew(spark):
    rows = spark.createDataFrame([(*observation(f"{order}-{line}", day, "a", price=day), order) for order in range(5) for line in range(2) for day in (1, 2)],
                                 SCHEMA + ", order_key bigint")
    together = rows.repartition(4, "order_key")
    latest = consolidate.latest_observations(together, within=["order_key"])
    assert latest.columns == consolidate.latest_observations(rows).columns
    assert latest._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(str, latest.collect())) == sorted(map(str, consolidate.latest_observations(rows).collect()))


def test_ids_are_dealt_once_for_their_roots_and_homes(spark):
    links = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", "y"), ("c", "y"), ("d", None), (None, "x")], "node string, key string")
    rooted = components._rooted(links)
    assert {tuple(r) for r in rooted.collect()} == {("a", "a", "a"), ("b", "a", "a"), ("b", "b", "a"), ("c", "b", "b"), ("d", "d", "d"), (None, "a", "a")}
    assert rooted._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [node") == 1
