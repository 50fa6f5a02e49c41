from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingspark.contracts import adopted_features, selected_features
from listingspark.operators import ablation, baseline, estimators, features, metrics, ridge, support

ROW = ("listing_id string, group_id string, validation_fold int, make string, model string, variant string, year bigint, mileage_km bigint, "
       "listing_city string, fuel string, transmission string, engine_cc bigint, assembly string, body_type string, price_pkr bigint")


def population(spark, families=2, rows=30, shift=0, fold_shift=None):
    rng = random.Random(2)
    data = []
    for family in range(families):
        for i in range(rows):
            price = 1_000_000 + 300_000 * family + 10_000 * i + (rng.randrange(5000))
            if fold_shift is not None and i % 3 == fold_shift:
                price += shift
            data.append((f"{family}-{i}", f"g{family}-{i}", i % 3, f"M{family}", "X", f"V{i % 4}", 2010 + i % 9, 1000 * i, f"C{i % 5}", "Petrol", "Manual",
                         1300 if i % 7 else None, "Local", "Sedan", price))
    return spark.createDataFrame(data, ROW)


def test_median_levels_and_fallbacks(spark):
    train = [("A", "X", 2018, 100.0), ("A", "X", 2018, 200.0), ("A", "X", 2019, 900.0), ("A", "Y", 2018, 2000.0), ("B", "Z", 2018, 3000.0)]
    df = spark.createDataFrame(train, "make string, model string, year int, price_pkr double")
    asked = [("A", "X", 2018), ("A", "X", 2019), ("A", "Y", 2018), ("B", "Z", 2018), ("C", "Q", 2000)]
    places = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, make string, model string, year int")
    predicted = baseline.predict_medians(places, baseline.fit_medians(df, min_group_size=2)).orderBy("i").collect()
    assert [r["predicted_pkr"] for r in predicted] == [150.0, 200.0, 550.0, 900.0, 900.0]
    refit = baseline.fit_medians(spark.createDataFrame([("A", "X", 2018, 50.0)], df.schema), min_group_size=2)
    assert {r["predicted_pkr"] for r in baseline.predict_medians(places, refit).collect()} == {50.0}


def test_fold_predictions_ignore_their_own_targets(spark):
    changed = baseline.out_of_fold_medians(population(spark, shift=500_000, fold_shift=0), 3, min_group_size=2)
    plain = baseline.out_of_fold_medians(population(spark), 3, min_group_size=2)
    pick = lambda df: {r["listing_id"]: r["predicted_pkr"] for r in df.where("validation_fold = 0").collect()}
    assert pick(changed) == pick(plain) and plain.count() == 60


def test_metrics_match_numpy_and_refuse_bad_rows(spark):
    rng = random.Random(4)
    data = [("e", float(rng.randrange(1, 900)), rng.uniform(-50, 900)) for _ in range(501)]
    df = spark.createDataFrame(data, "experiment string, actual_pkr double, predicted_pkr double")
    row = metrics.regression_metrics(df, ["experiment"]).first()
    actual, predicted = np.array([d[1] for d in data]), np.array([d[2] for d in data])
    error = abs(predicted - actual)
    assert math.isclose(row["mae_pkr"], error.mean()) and math.isclose(row["median_ae_pkr"], np.median(error))
    assert math.isclose(row["median_ape_pct"], np.median(100 * error / actual)) and math.isclose(row["rmse_pkr"], np.sqrt((error ** 2).mean()))
    assert row["nonpositive_predictions"] == (predicted <= 0).sum() and row["count"] == 501
    bad = spark.createDataFrame([(0.0, 1.0), (1.0, float("nan")), (1.0, float("inf")), (None, 1.0), (2.0, 1.0)], "actual_pkr double, predicted_pkr double")
    assert metrics.metric_violations(bad).count() == 4


def test_ridge_matches_the_closed_form(spark):
    rows = population(spark)
    columns = ("year", "mileage_km")
    model = estimators.fit_candidate("ridge", rows, columns)
    data = rows.select(*columns, "price_pkr", "listing_id").orderBy("listing_id").toPandas()
    x = data[list(columns)].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0)
    y = data["price_pkr"].to_numpy(float)
    weights = np.linalg.solve(x.T @ x + 10 * np.eye(2), x.T @ (y - y.mean()))
    got = [r["predicted_pkr"] for r in estimators.predict(model, rows).orderBy("listing_id").collect()]
    assert np.allclose(got, x @ weights + y.mean(), rtol=1e-7)


def brute_ridge(frame, columns, alpha, fold):
    """Imputed, scaled and one-hot inputs of one fold's training rows, solved by numpy."""
    train, held = frame[frame.validation_fold != fold], frame[frame.validation_fold == fold]
    parts = []
    for name in columns:
        if name in ("year", "mileage_km", "engine_cc"):
            known = train[name].astype(float)
            median = 0.0 if known.isna().all() else known.median()
            x, v = known.fillna(median), held[name].astype(float).fillna(median)
            parts.append(((x - x.mean()) / (x.std(ddof=0) or 1.0), (v - x.mean()) / (x.std(ddof=0) or 1.0)))
        else:
            x, v = train[name].fillna("__MISSING__"), held[name].fillna("__MISSING__")
            parts += [((x == k).astype(float), (v == k).astype(float)) for k in sorted(x.unique())]
    a, b = (np.stack([np.asarray(p[i], dtype=float) for p in parts], axis=1) for i in (0, 1))
    y = train.price_pkr.to_numpy(float)
    weights = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + alpha * np.eye(a.shape[1]), (a - a.mean(0)).T @ (y - y.mean()))
    return dict(zip(held.listing_id, y.mean() + (b - a.mean(0)) @ weights, strict=True))


def test_ridge_of_all_folds_and_inputs_from_one_scan(spark):
    odd = population(spark, rows=40).withColumns({
        "variant": F.expr("CASE WHEN listing_id LIKE '%7' THEN NULL WHEN listing_id = '0-3' THEN 'once' ELSE variant END"),
        "engine_cc": F.expr("CASE WHEN validation_fold <> 0 THEN NULL ELSE engine_cc END"),  # fold 0 trains without any
        "mileage_km": F.expr("CASE WHEN listing_id LIKE '1-%' THEN NULL ELSE mileage_km END"),
    })
    experiments = {"all": (selected_features("F2"), 10.0), "few": (("year", "listing_city"), 1.0), "numbers": (("mileage_km", "engine_cc"), 0.5)}
    frame = odd.toPandas()
    out = ridge.out_of_fold(odd.withColumn("predicted", F.lit("x")), experiments, 3).select("experiment", "listing_id", "predicted_pkr", "predicted").collect()
    assert len(out) == 3 * 80 and {r["predicted"] for r in out} == {"x"}
    for name, (columns, alpha) in experiments.items():
        want = {k: v for fold in range(3) for k, v in brute_ridge(frame, columns, alpha, fold).items()}
        got = {r["listing_id"]: r["predicted_pkr"] for r in out if r["experiment"] == name}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-8) for k in want)


def test_scalings_of_folds_are_those_of_their_training_rows(spark):
    rows = population(spark).withColumn("mileage_km", F.expr("CASE WHEN listing_id LIKE '%3' THEN NULL ELSE mileage_km END"))
    columns = ["year", "mileage_km", "engine_cc"]
    for fold, scalings in enumerate(ridge.fold_scalings(rows, columns, 3)):
        stats = estimators.numeric_stats(rows.where(F.col("validation_fold") != fold), columns)
        for name in columns:
            got = scalings[name]
            assert got.median == stats.medians[name] and got.least == stats.minima[name]
            assert math.isclose(got.mean, stats.means[name]) and math.isclose(got.deviation, stats.deviations[name])
    assert ridge.fold_scalings(rows, [], 3) == [{}, {}, {}]


def test_candidates_fitted_side_by_side_equal_single_fits(spark):
    rows = population(spark)
    experiments = {
        "r": ("ridge", ("make", "year"), {}), "s": ("ridge", ("year",), {"alpha": 1.0}),
        "t": ("random_forest", ("make", "year"), {"numTrees": 2, "maxDepth": 3}), "b": ("boosted_trees", ("make", "year"), {"maxIter": 2}),
    }
    together = {(r["experiment"], r["listing_id"]): r["predicted_pkr"] for r in estimators.compare_candidates(rows, experiments, 3).collect()}
    assert len(together) == 4 * 60
    alone = estimators.out_of_fold(rows, "ridge", ("year",), 3, parameters={"alpha": 1.0}, experiment="s").collect()
    assert all(math.isclose(together["s", r["listing_id"]], r["predicted_pkr"], rel_tol=1e-12) for r in alone)


def test_boosted_trees_take_more_categories_than_bins(spark):
    rows = population(spark, rows=120).withColumn("variant", F.col("listing_id"))  # 240 categories, each seen once
    model = estimators.fit_candidate("boosted_trees", rows, ("variant", "year"), parameters={"maxIter": 2})
    assert model.stages[-1].getMaxBins() == 32 and estimators.predict(model, rows).count() == 240


def test_preprocessing_belongs_to_training_rows(spark):
    train = spark.createDataFrame([(2020, 0, 1000), (2020, 100, 2000)], "year bigint, mileage_km bigint, engine_cc bigint")
    stats = estimators.numeric_stats(train, ["year", "mileage_km", "engine_cc"])
    assert [stats.means[n] for n in ("year", "mileage_km", "engine_cc")] == [2020, 50, 1500]
    empty = estimators.numeric_stats(train.withColumn("engine_cc", F.lit(None).cast("bigint")), ["engine_cc"])
    assert empty.medians["engine_cc"] == 0.0


@pytest.mark.parametrize("name, settings", [("random_forest", {"numTrees": 5, "maxDepth": 5}), ("boosted_trees", {"maxIter": 5, "stepSize": 0.3})])
def test_tree_candidates_beat_the_global_median(spark, name, settings):
    rows = population(spark)
    predictions = estimators.out_of_fold(rows, name, adopted_features(), 3, parameters=settings)
    assert predictions.count() == 60 and predictions.select("listing_id").distinct().count() == 60
    error = metrics.regression_metrics(predictions).first()["mae_pkr"]
    middle = rows.agg(F.expr("percentile(price_pkr, 0.5)")).first()[0]
    assert error < rows.agg(F.avg(F.abs(F.col("price_pkr") - middle))).first()[0]


def test_unseen_categories_and_saved_models(spark, tmp_path):
    rows = population(spark)
    model = estimators.fit_candidate("ridge", rows, selected_features("F2"))
    strange = rows.limit(1).withColumns({"variant": F.lit("never"), "listing_city": F.lit("nowhere"), "fuel": F.lit(None).cast("string")})
    assert math.isfinite(estimators.predict(model, strange).first()["predicted_pkr"])
    path = str(tmp_path / "model")
    estimators.save_model(model, path)
    examples = estimators.predict(model, rows, "e").withColumn("expected_price_pkr", F.bround("e", 0).cast("bigint")).drop("e")
    assert estimators.check_examples(path, examples).isEmpty()
    assert estimators.check_examples(path, examples.withColumn("expected_price_pkr", F.lit(1).cast("bigint"))).count() == 60
    with pytest.raises(Exception):
        estimators.save_model(model, path)
    shared = rows.withColumn("group_id", F.lit("g"))
    with pytest.raises(ValueError, match="overlap"):
        estimators.out_of_fold(shared, "ridge", ("year",), 3)
    flags = metrics.unseen_flags(rows.withColumn("variant", F.when(F.col("listing_id") == "0-4", F.lit("rare")).otherwise(F.col("variant"))), {"unseen": ["variant"]})
    assert [r["listing_id"] for r in flags.where("unseen").collect()] == ["0-4"]


def test_feature_contract(spark):
    assert adopted_features() == ("make", "model", "year", "mileage_km", "listing_city", "variant", "transmission", "engine_cc", "assembly")
    for bad in (("year", "make"), ("make", "make"), (), ("make", "price_pkr"), "make"):
        with pytest.raises(ValueError):
            selected_features("F2", bad)
    with pytest.raises(ValueError, match="missing columns"):
        features.select_features(population(spark).drop("fuel"), "F2")


def test_removal_limits_at_their_boundaries(spark):
    check = spark.createDataFrame([(101.0, 100.0), (101.0001, 100.0), (0.0, 0.0), (1.0, 0.0)], "a double, b double")
    got = check.select(ablation.within(F.col("a"), F.col("b"), 1.0).alias("w"), ablation.change_pct(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["w"] for r in got] == [True, False, True, False] and got[3]["c"] is None
    assert list(ablation.removal_columns(selected_features("F2"), ("fuel", "body_type"))) == ["full", "fuel_and_body_type"]
    assert len(ablation.removal_columns(selected_features("F2"))) == 10


def test_support_refusals_in_order(spark):
    rows = population(spark, families=1, rows=36)
    policy = support.Coverage(min_family_groups=20, min_family_year_groups=4, min_family_city_groups=8, min_variant_groups=2, required_folds=2)
    entries = support.build_support(rows, policy)
    assert entries.count() == 4
    judged = support.support_reasons(rows, entries)
    reasons = {r[0] for r in judged.select("support_reason").distinct().collect()}
    assert reasons == {None, support.NO_YEAR}
    served = judged.where("support_reason IS NULL").limit(1)
    change = lambda **c: support.support_reasons(served.select(*rows.columns).withColumns({k: F.lit(v) for k, v in c.items()}), entries).first()["support_reason"]
    assert change(variant="V9") == support.NO_VARIANT and change(year=1900) == support.NO_YEAR and change(listing_city="Z") == support.NO_CITY
    assert change(mileage_km=10 ** 9) == support.NO_MILEAGE and change(transmission="CVT") == support.NO_CONFIGURATION
    scored = support.score_batch(served.select(*rows.columns, F.lit(None).cast("string").alias("refusal"), F.lit(2.5).alias("prediction")), entries).first()
    assert scored["price_pkr"] == 2 and scored["refusal"] is None
    wild = support.score_batch(served.select(*rows.columns, F.lit(None).cast("string").alias("refusal"), F.lit(-1.0).alias("prediction")), entries).first()
    assert wild["price_pkr"] is None and wild["refusal"] == support.NOT_POSITIVE


def test_gate_and_release(spark):
    data = [(f"l{i}", "A X", 1_000_000.0, 1_000_000.0 + 1000 * (i % 5)) for i in range(20)]
    rows = spark.createDataFrame(data, "listing_id string, family string, actual_pkr double, predicted_pkr double")
    base = rows.select("listing_id", (F.col("actual_pkr") + 100_000).alias("predicted_pkr"))
    limits = support.ErrorLimits(5000.0, 1.0, 10.0, {"A X": 5000.0})
    assert support.gate_table(rows, base, limits).where("NOT passed").isEmpty()
    wild = rows.withColumn("predicted_pkr", F.when(F.col("listing_id") == "l3", -5.0).otherwise(F.col("predicted_pkr")))
    failed = {r["check"] for r in support.gate_table(wild, base, limits).where("NOT passed").collect()}
    assert {"overall: MAE PKR", "A X: positive predictions"} <= failed
    nothing = support.gate_table(rows.limit(0), base, limits).collect()
    assert {(r["check"], r["passed"]) for r in nothing} == {("overall: sufficient rows", False), ("A X: sufficient rows", False)}
    gates = spark.createDataFrame([("a", "s", "x", True), ("b", "s", "x", False), ("b", "s", "y", False)], "candidate_id string, split_id string, check string, passed boolean")
    scores = spark.createDataFrame([("a", "s", 1), ("b", "s", 2), ("a", "other", 3)], "candidate_id string, split_id string, price int")
    assert [r["price"] for r in support.release(scores, gates).collect()] == [1]
    assert support.failed_checks(gates).first()["failed_checks"] == "x; y"


def test_reference_check_notices_every_difference(spark):
    rows = spark.createDataFrame([("1", "g", 0, 10.0, 11.0), ("2", "h", 1, 20.0, 18.0)], "listing_id string, group_id string, fold int, actual_pkr double, predicted_pkr double")
    assert ablation.check_reference(rows, rows).first()["passed"]
    assert not ablation.check_reference(rows, rows.withColumn("predicted_pkr", F.col("predicted_pkr") + 0.02)).first()["passed"]
    assert ablation.check_reference(rows, rows.withColumn("fold", F.lit(0))).first()["location_differences"] == 1
    assert ablation.check_reference(rows, rows.limit(1)).first()["membership_differences"] == 1


def test_no_row_vanishes_for_a_null_key(spark):
    rows = spark.createDataFrame([(i, "m", "x", None if i % 5 == 0 else 2000 + i % 3, 100 + i, i % 3) for i in range(60)], "listing_id int, make string, model string, year int, price_pkr int, validation_fold int")
    assert baseline.out_of_fold_medians(rows, 3).count() == 60
    assert baseline.predict_medians(rows, baseline.fit_medians(rows)).count() == 60


def test_unfit_rows_refuse_their_group(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, float("nan")), ("b", 1.0, 2.0), (None, 2.0, 2.0), ("c", 0.0, 1.0)], "g string, actual_pkr double, predicted_pkr double")
    found = {r["g"]: (r["count"], r["mae_pkr"], r["median_ae_pkr"]) for r in metrics.regression_metrics(rows, ["g"]).collect()}
    assert found == {"a": (2, None, None), "b": (1, 1.0, 1.0), None: (1, 0.0, 0.0), "c": (1, None, None)}


def test_equal_errors_summed_in_another_order_are_not_better(spark):
    from listingspark.operators import metrics

    rows = [(name, "l", 0, 10.0, 9.7) for name in ("median_F0", "other", "least")]
    predictions = spark.createDataFrame(rows, "experiment string, listing_id string, fold int, actual_pkr double, predicted_pkr double")
    folds = spark.createDataFrame([("median_F0", 0, 0.1 + 0.2), ("other", 0, 0.3), ("least", 0, 0.2999)], "experiment string, fold int, mae_pkr double")
    found = {r["experiment"]: r["folds_better_than_baseline"] for r in metrics.experiment_summary(predictions, folds).collect()}
    assert found == {"median_F0": 0, "other": 0, "least": 1}


def test_rows_are_not_shuffled_to_meet_few_medians(spark):
    from listingspark.operators import baseline, support

    rows = spark.range(600).selectExpr(
        "concat('l', id) AS listing_id", "concat('M', id % 2) AS make", "'X' AS model", "1990 + id % 3 AS year", "cast(id % 3 AS int) AS validation_fold", "1000 + id AS price_pkr")
    predicted = baseline.out_of_fold_medians(rows, 3)
    assert "Exchange hashpartitioning" not in predicted._jdf.queryExecution().executedPlan().toString()
    assert predicted.count() == 600 and predicted.where("predicted_pkr IS NULL").isEmpty()
    scored = predicted.selectExpr("listing_id", "concat(make, ' ', model) AS family", "price_pkr AS actual_pkr", "predicted_pkr")
    gate = support.gate_table(scored, scored, support.ErrorLimits(1e6, 60.0, 0.0, {"M0 X": 1e6}))
    assert "listing_id" not in gate._jdf.queryExecution().optimizedPlan().toString()
    assert {r["check"]: r["actual"] for r in gate.collect()}["overall: sufficient rows"] == 600


def fitted_experiments(monkeypatch, build):
    """What a model query asks ``compare_candidates`` to fit; nothing is fitted."""
    from listingspark.plans import models

    asked = {}

    class Asked(Exception):
        pass

    def stop(rows, experiments, folds, **_):
        asked.update(experiments)
        raise Asked

    monkeypatch.setattr(models.estimators, "compare_candidates", stop)
    monkeypatch.setattr(models.c, "development", lambda t: None)
    monkeypatch.setattr(models.c, "stage", lambda t, name, written: written())
    with pytest.raises(Asked):
        getattr(models, build)(None)
    return asked


def test_boosted_trees_query_fits_the_whole_candidate(monkeypatch):
    ((name, columns, settings),) = fitted_experiments(monkeypatch, "boosted_trees").values()
    assert name == "boosted_trees" and columns == adopted_features()
    assert {**estimators.BOOSTED, **settings} == estimators.BOOSTED and estimators.BOOSTED["maxIter"] == 300


def test_boosting_does_not_keep_the_lineage_of_all_rounds(spark):
    model = estimators.fit_candidate("boosted_trees", population(spark), ("make", "year"), parameters={"maxIter": 21, "maxDepth": 2})
    assert spark.sparkContext.getCheckpointDir() and model.stages[-1].getNumTrees == 21


def test_matrix_query_fits_whole_candidates(monkeypatch):
    asked = fitted_experiments(monkeypatch, "matrix")
    assert len(asked) == 9 and {columns for _, columns, _ in asked.values()} == {selected_features(f) for f in ("F0", "F1", "F2")}
    whole = {"ridge": {}, "random_forest": estimators.FOREST, "boosted_trees": estimators.BOOSTED}
    assert all({**whole[name], **settings} == whole[name] for name, _, settings in asked.values())


def test_forest_rows_remember_their_nodes(spark):
    model = estimators.fit_candidate("random_forest", population(spark), ("make", "year"), parameters={"numTrees": 3, "maxDepth": 12})
    assert model.stages[-1].getCacheNodeIds() and spark.sparkContext.getCheckpointDir()
