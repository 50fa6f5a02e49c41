"""Queries on baseline predictions, metrics, ablation, support and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ablation, baseline, metrics, support
from . import common as c
from .registry import query


@query("g1_family_metrics", f"WITH {c.TO_PRED} SELECT family, {c.metric_sql()} FROM pred1 GROUP BY family")
def family_metrics(t):
    """Latest rows, group split, out-of-fold comparable medians, errors by family."""
    return c.rounded(metrics.regression_metrics(c.baseline_predictions(t), ["family"]))


@query("g1_overall_metrics", f"WITH {c.TO_PRED} SELECT {c.metric_sql()} FROM pred1")
def overall_metrics(t):
    return c.rounded(metrics.regression_metrics(c.baseline_predictions(t)))


@query("m4_out_of_fold_medians", f"WITH {c.TO_PRED} SELECT listing_id, fold, family, year, actual_pkr, {c.rounded_sql('predicted_pkr')} AS predicted_pkr FROM pred1")
def out_of_fold_medians(t):
    return c.baseline_predictions(t).select(
        "listing_id", "fold", "family", "year", "actual_pkr", F.round(F.col("predicted_pkr") + c.SHIFT, 4).alias("predicted_pkr")
    )


@query("m4_median_levels", f"WITH {c.TO_DEV}, {c.median_levels_sql('dev', fold=False)} " + " UNION ALL ".join(
    f"SELECT {depth} AS level, {key} AS key, {c.rounded_sql('md')} AS median, n AS group_count FROM m{depth}"
    for depth, key in enumerate(["concat_ws(chr(31), make, model, year)", "concat_ws(chr(31), make, model)", "make", "''"])))
def median_levels(t):
    return c.rounded(baseline.fit_medians(c.development(t), min_group_size=c.MINIMUM)).select("level", "key", "median", "group_count")


_GAPS = f"""{c.TO_DEV}, gaps AS (SELECT * REPLACE (CASE WHEN order_key % 5 = 0 THEN -1 ELSE year END AS year) FROM dev), {c.median_levels_sql('gaps', 'n')},
  gp AS ({c.median_lookup_sql('gaps', 'n')})"""


@query("m4_medians_without_year", f"WITH {_GAPS} SELECT listing_id, validation_fold AS fold, nullif(year, -1) AS year, {c.rounded_sql('predicted_pkr')} AS predicted_pkr, median_level FROM gp")
def medians_without_year(t):
    """Every row is predicted, also those that lack a year."""
    rows = c.development(t).withColumn("year", F.expr("CASE WHEN order_key % 5 <> 0 THEN year END"))
    predicted = baseline.out_of_fold_medians(rows, c.FOLDS, min_group_size=c.MINIMUM)
    return c.rounded(predicted.select("listing_id", F.col("validation_fold").alias("fold"), "year", "predicted_pkr", "median_level"))


@query("g1_refused_metrics", f"""WITH {c.TO_PRED}, faulty AS (SELECT * REPLACE (CASE WHEN year = 1996 AND family LIKE '%PROMO' THEN 'nan'::double WHEN year = 1997 AND family LIKE '%ECONOMY' THEN 'inf'::double ELSE predicted_pkr END AS predicted_pkr,
    CASE WHEN year = 1998 AND family LIKE '%SMALL' THEN 0 ELSE actual_pkr END AS actual_pkr) FROM pred1)
  SELECT family, count(*) AS count, CASE WHEN NOT bool_or(bad) THEN {c.rounded_sql('avg(e)')} END AS mae_pkr, CASE WHEN NOT bool_or(bad) THEN {c.rounded_sql('median(e)')} END AS median_ae_pkr,
    CASE WHEN NOT bool_or(bad) THEN {c.rounded_sql('median(p)')} END AS median_ape_pct, CASE WHEN NOT bool_or(bad) THEN {c.rounded_sql('sqrt(avg(e * e))')} END AS rmse_pkr,
    CASE WHEN NOT bool_or(bad) THEN count(*) FILTER (WHERE low) END AS nonpositive_predictions
  FROM (SELECT family, bad, CASE WHEN NOT bad THEN abs(predicted_pkr - actual_pkr) END AS e, CASE WHEN NOT bad THEN 100 * abs(predicted_pkr - actual_pkr) / actual_pkr END AS p, predicted_pkr <= 0 AS low
    FROM (SELECT *, NOT isfinite(predicted_pkr) OR actual_pkr <= 0 AS bad FROM faulty)) GROUP BY family""")
def refused_metrics(t):
    """Families with a prediction that is not finite or a target that is not positive are refused."""
    faulty = c.baseline_predictions(t).withColumns({
        "predicted_pkr": F.expr("CASE WHEN year = 1996 AND family LIKE '%PROMO' THEN double('NaN') WHEN year = 1997 AND family LIKE '%ECONOMY' THEN double('Infinity') ELSE predicted_pkr END"),
        "actual_pkr": F.expr("CASE WHEN year = 1998 AND family LIKE '%SMALL' THEN 0 ELSE actual_pkr END"),
    })
    return c.rounded(metrics.regression_metrics(faulty, ["family"]))


_UNSEEN = """seen AS (SELECT *, min(fold) OVER (PARTITION BY make, model, variant) = max(fold) OVER (PARTITION BY make, model, variant) AS unseen_variant,
    min(fold) OVER (PARTITION BY listing_city, year) = max(fold) OVER (PARTITION BY listing_city, year) AS unseen_city FROM pred1)"""


def flagged_predictions(t):
    """City here is city and year, so that some cells are met in one fold only."""
    return metrics.unseen_flags(
        c.baseline_predictions(t), {"unseen_variant": ["make", "model", "variant"], "unseen_city": ["listing_city", "year"]}, fold="fold",
    ).withColumn("experiment", F.lit("median_F0"))


@query("m10_unseen_categories", f"""WITH {c.TO_PRED}, train AS (SELECT f AS fold, p.* EXCLUDE (fold) FROM pred1 p, (SELECT unnest(range(3)) AS f) WHERE f <> p.fold),
  tv AS (SELECT DISTINCT fold, make, model, variant FROM train), tc AS (SELECT DISTINCT fold, listing_city, year FROM train)
  SELECT listing_id, p.fold, tv.make IS NULL AS unseen_variant, tc.year IS NULL AS unseen_city FROM pred1 p
  LEFT JOIN tv ON tv.fold = p.fold AND tv.make = p.make AND tv.model = p.model AND tv.variant = p.variant
  LEFT JOIN tc ON tc.fold = p.fold AND tc.listing_city = p.listing_city AND tc.year = p.year""")
def unseen_categories(t):
    return flagged_predictions(t).select("listing_id", "fold", "unseen_variant", "unseen_city")


_DIMENSIONS = {
    "overall": "'all'", "family": "family", "variant": "family || ' / ' || variant", "year": "cast(year AS varchar)", "city": "listing_city",
    "price_band": "CASE WHEN actual_pkr < 2000000 THEN 'under_2m' WHEN actual_pkr < 4000000 THEN '2m_to_under_4m' WHEN actual_pkr < 6000000 THEN '4m_to_under_6m' ELSE '6m_and_above' END",
    "variant_seen": "CASE WHEN unseen_variant THEN 'unseen' ELSE 'seen' END", "city_seen": "CASE WHEN unseen_city THEN 'unseen' ELSE 'seen' END",
}


def _subgroups_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT experiment, '{name}' AS dimension, {value} AS value, {c.metric_sql()} FROM {source} GROUP BY ALL" for name, value in _DIMENSIONS.items()
    )


@query("g2_subgroup_metrics", f"WITH {c.TO_PRED}, {_UNSEEN}, e AS (SELECT 'median_F0' AS experiment, * FROM seen) {_subgroups_sql('e')}")
def subgroup_metrics(t):
    return c.rounded(metrics.summarize_predictions(flagged_predictions(t)))


# Experiments: the full fallback levels, and levels without the year or without the model.
EXPERIMENTS = {
    "median_full": (("make", "model", "year"), ("make", "model"), ("make",), ()),
    "median_without_year": (("make", "model"), ("make",), ()),
    "median_without_model": (("make", "year"), ("make",), ()),
}


def _experiment_sql() -> str:
    parts, unions = [], []
    for name, levels in EXPERIMENTS.items():
        tag = name.replace("median_", "x_")
        for depth, fields in enumerate(levels):
            keys = "".join(f", {k}" for k in fields)
            parts.append(f"""{tag}{depth} AS (SELECT f{keys}, median(price_pkr) AS md FROM dev, (SELECT unnest(range(3)) AS f) WHERE validation_fold <> f
              GROUP BY f{keys} {'HAVING count(*) >= 5' if fields else ''})""")
        joins = " ".join(
            f"LEFT JOIN {tag}{d} ON {tag}{d}.f = dev.validation_fold" + "".join(f" AND {tag}{d}.{k} = dev.{k}" for k in fields)
            for d, fields in enumerate(levels)
        )
        unions.append(f"""SELECT '{name}' AS experiment, listing_id, group_id, validation_fold AS fold, dev.make || ' ' || dev.model AS family, dev.make, dev.model, variant, dev.year,
          listing_city, price_pkr AS actual_pkr, coalesce({', '.join(f'{tag}{d}.md' for d in range(len(levels)))}) AS predicted_pkr FROM dev {joins}""")
    return ",\n".join(parts) + ",\nexperiments AS MATERIALIZED (" + " UNION ALL ".join(unions) + ")"


_EXPERIMENTS = f"{c.TO_DEV}, {_experiment_sql()}"


def experiments(t):
    def build():
        rows = c.development(t)
        parts = []
        for name, levels in EXPERIMENTS.items():
            predicted = baseline.out_of_fold_medians(rows, c.FOLDS, min_group_size=c.MINIMUM, levels=levels)
            parts.append(metrics.with_family(predicted).select(
                F.lit(name).alias("experiment"), "listing_id", "group_id", F.col("validation_fold").alias("fold"), "family",
                "make", "model", "variant", "year", "listing_city", F.col("price_pkr").alias("actual_pkr"), "predicted_pkr",
            ))
        return reduce(DataFrame.unionByName, parts)

    return c.stage(t, "experiments", build)


def fold_metrics(t):
    return metrics.regression_metrics(experiments(t), ["experiment", "fold"])


def experiment_table(t):
    return t.spark.createDataFrame(
        [(name, "median", name.replace("median_without_", "").replace("median_", ""), "median_full") for name in EXPERIMENTS],
        "experiment string, model string, removed string, reference string",
    )


@query("m9_fold_metrics", f"WITH {_EXPERIMENTS} SELECT experiment, fold, {c.metric_sql()} FROM experiments GROUP BY ALL")
def out_of_fold_metrics(t):
    return c.rounded(fold_metrics(t))


@query("g3_experiment_summary", f"""WITH {_EXPERIMENTS}, fm AS (SELECT experiment, fold, avg(abs(predicted_pkr - actual_pkr)) AS mae FROM experiments GROUP BY ALL),
  om AS (SELECT experiment, {c.metric_sql()}, avg(abs(predicted_pkr - actual_pkr)) AS m FROM experiments GROUP BY ALL)
  SELECT om.* EXCLUDE (m), {c.rounded_sql('lo')} AS fold_mae_min_pkr, {c.rounded_sql('hi')} AS fold_mae_max_pkr,
  {c.rounded_sql('100 * (b.m - om.m) / b.m')} AS baseline_improvement_pct, better AS folds_better_than_baseline
  FROM om JOIN (SELECT f.experiment, min(f.mae) AS lo, max(f.mae) AS hi, count(*) FILTER (WHERE f.mae < g.mae * (1 - {metrics.ROUNDING!r})) AS better FROM fm f JOIN fm g ON g.fold = f.fold AND g.experiment = 'median_without_year' GROUP BY 1) USING (experiment),
  (SELECT m FROM om WHERE experiment = 'median_without_year') b""")
def experiment_summary(t):
    return c.rounded(metrics.experiment_summary(experiments(t), fold_metrics(t), "median_without_year"))


@query("g4_worst_errors", f"""WITH {_EXPERIMENTS}, best AS (SELECT experiment FROM experiments GROUP BY 1 ORDER BY avg(abs(predicted_pkr - actual_pkr)), experiment LIMIT 1)
  SELECT experiment, listing_id, {c.rounded_sql('actual_pkr')} AS actual_pkr, {c.rounded_sql('predicted_pkr')} AS predicted_pkr,
  {c.rounded_sql('abs(predicted_pkr - actual_pkr)')} AS absolute_error_pkr FROM experiments WHERE experiment IN (SELECT experiment FROM best)
  ORDER BY abs(predicted_pkr - actual_pkr) DESC, listing_id LIMIT 10""")
def worst_errors(t):
    rows = experiments(t)
    return c.rounded(metrics.worst_errors(rows, metrics.regression_metrics(rows, ["experiment"])))


_CHANGE_DIMENSIONS = {name: value for name, value in _DIMENSIONS.items() if name in ("overall", "family", "year", "city")}


def changes(t):
    dimensions = {k: v for k, v in metrics.subgroup_dimensions().items() if k in _CHANGE_DIMENSIONS}
    # A few rows a subgroup, read as candidate and as reference, and their changes by every verdict.
    table = c.stage(t, "change_subgroups", lambda: metrics.summarize_predictions(experiments(t), dimensions))
    return c.stage(t, "subgroup_changes", lambda: ablation.subgroup_changes(table, experiment_table(t)))


_MAE = {name: f"SELECT experiment, '{name}' AS dimension, {value} AS value, avg(abs(predicted_pkr - actual_pkr)) AS m, {c.metric_sql()} FROM experiments GROUP BY experiment, 3"
        for name, value in _CHANGE_DIMENSIONS.items()}
_CHANGES = f"""sub AS MATERIALIZED ({' UNION ALL '.join(_MAE.values())}),
  chg AS (SELECT s.experiment, 'median' AS model, replace(replace(s.experiment, 'median_without_', ''), 'median_', '') AS removed, s.dimension, s.value, s.* EXCLUDE (experiment, dimension, value, m),
    s.m AS m, r.m AS rm FROM sub s JOIN sub r ON r.experiment = 'median_full' AND r.dimension = s.dimension AND r.value = s.value)"""


@query("g5_subgroup_changes", f"""WITH {_EXPERIMENTS}, {_CHANGES} SELECT * EXCLUDE (m, rm), {c.rounded_sql('rm')} AS reference_mae_pkr, {c.rounded_sql('m - rm')} AS mae_change_pkr,
  {c.rounded_sql('100 * (m - rm) / rm')} AS mae_change_pct FROM chg""")
def subgroup_changes(t):
    return c.rounded(changes(t))


@query("g5_removal_verdicts", f"""WITH {_EXPERIMENTS}, {_CHANGES}, fm AS (SELECT experiment, fold, avg(abs(predicted_pkr - actual_pkr)) AS m FROM experiments GROUP BY ALL),
  fd AS (SELECT f.experiment, max(100 * (f.m - g.m) / g.m) AS worst, bool_and(f.m <= g.m * 1.03) AS ok FROM fm f JOIN fm g ON g.fold = f.fold AND g.experiment = 'median_full' GROUP BY 1),
  fa AS (SELECT experiment, max(100 * (m - rm) / rm) AS worst, bool_and(m <= rm * 1.05) AS ok FROM chg WHERE dimension = 'family' GROUP BY 1)
  SELECT chg.experiment, model, removed, chg.* EXCLUDE (experiment, model, removed, dimension, value, m, rm), {c.rounded_sql('m - rm')} AS mae_change_pkr,
  {c.rounded_sql('100 * (m - rm) / rm')} AS mae_change_pct, m <= rm * 1.01 AS overall_pass, {c.rounded_sql('fd.worst')} AS worst_fold_change_pct, fd.ok AS fold_pass,
  {c.rounded_sql('fa.worst')} AS worst_family_change_pct, fa.ok AS family_pass, removed <> 'full' AND m <= rm * 1.01 AND fd.ok AND fa.ok AS candidate_for_removal
  FROM chg JOIN fd USING (experiment) JOIN fa USING (experiment) WHERE dimension = 'overall'""")
def removal_verdicts(t):
    return c.rounded(ablation.removal_summary(changes(t), fold_metrics(t), experiment_table(t)))


@query("g6_reproducibility", f"""WITH {_EXPERIMENTS}, o AS (SELECT * FROM experiments WHERE experiment = 'median_full'), n AS (SELECT * FROM experiments WHERE experiment = 'median_without_year' AND year <> 1995),
  p AS (SELECT o.listing_id AS ol, n.listing_id AS nl, abs(o.predicted_pkr - n.predicted_pkr) AS d FROM o FULL JOIN n USING (listing_id)),
  s AS (SELECT avg(abs(predicted_pkr - actual_pkr)) AS a, median(abs(predicted_pkr - actual_pkr)) AS b, sqrt(avg((predicted_pkr - actual_pkr) * (predicted_pkr - actual_pkr))) AS e FROM o
    UNION ALL SELECT avg(abs(predicted_pkr - actual_pkr)), median(abs(predicted_pkr - actual_pkr)), sqrt(avg((predicted_pkr - actual_pkr) * (predicted_pkr - actual_pkr))) FROM n)
  SELECT (SELECT count(*) FROM p WHERE ol IS NULL OR nl IS NULL) AS membership_differences, 0::bigint AS location_differences, {c.rounded_sql('(SELECT max(d) FROM p)')} AS max_prediction_difference_pkr,
  {c.rounded_sql('(SELECT greatest(max(a) - min(a), max(b) - min(b), max(e) - min(e)) FROM s)')} AS max_metric_difference_pkr, false AS passed""")
def reproducibility(t):
    rows = experiments(t)
    current = rows.where("experiment = 'median_without_year' AND year <> 1995")
    return c.rounded(ablation.check_reference(current, rows.where("experiment = 'median_full'")))


COVERAGE = support.Coverage(min_family_groups=150, min_family_year_groups=30, min_family_city_groups=9, min_variant_groups=3, required_folds=3)


def inputs(t):
    """Development inputs with group and fold, the engine grouped so configurations repeat."""
    return c.development(t).withColumn("engine_cc", F.when(F.col("engine_cc") > 10, F.lit(1).cast("bigint")))


_INPUTS = f"{c.TO_DEV}, inp AS (SELECT * REPLACE (CASE WHEN engine_cc > 10 THEN 1::bigint END AS engine_cc) FROM dev)"
_SUPPORT = """sup0 AS (SELECT i.* FROM inp i
    WHERE (make, model) IN (SELECT (make, model) FROM inp GROUP BY make, model HAVING count(DISTINCT group_id) >= 150)
    AND (make, model, year) IN (SELECT (make, model, year) FROM inp GROUP BY make, model, year HAVING count(DISTINCT group_id) >= 30)
    AND (make, model, listing_city) IN (SELECT (make, model, listing_city) FROM inp GROUP BY make, model, listing_city HAVING count(DISTINCT group_id) >= 9)),
  sup AS (SELECT make, model, variant, count(*) AS development_rows, list_sort(list(DISTINCT year)) AS years, list_sort(list(DISTINCT listing_city)) AS cities,
    min(mileage_km) AS mileage_low, max(mileage_km) AS mileage_high, list(DISTINCT {'transmission': transmission, 'engine_cc': engine_cc, 'assembly': assembly}) AS configurations,
    count(DISTINCT group_id) AS development_groups FROM sup0 GROUP BY make, model, variant HAVING count(DISTINCT group_id) >= 3 AND count(DISTINCT validation_fold) = 3)"""


def _reason_sql(rows: str) -> str:
    return f"""CASE WHEN s.make IS NULL THEN '{support.NO_VARIANT}' WHEN NOT list_contains(s.years, {rows}.year) THEN '{support.NO_YEAR}'
    WHEN NOT list_contains(s.cities, {rows}.listing_city) THEN '{support.NO_CITY}' WHEN {rows}.mileage_km NOT BETWEEN s.mileage_low AND s.mileage_high THEN '{support.NO_MILEAGE}'
    WHEN len(list_filter(s.configurations, lambda x: x.transmission = {rows}.transmission AND x.engine_cc IS NOT DISTINCT FROM {rows}.engine_cc AND x.assembly = {rows}.assembly)) = 0
    THEN '{support.NO_CONFIGURATION}' END"""


_JOIN_SUPPORT = "LEFT JOIN sup s ON s.make = {r}.make AND s.model = {r}.model AND s.variant = {r}.variant"


def entries(t):
    return c.stage(t, "support", lambda: support.build_support(inputs(t), COVERAGE))


@query("g7_coverage_support", f"""WITH {_INPUTS}, {_SUPPORT} SELECT make, model, variant, development_rows, development_groups, array_to_string(years, ',') AS years, array_to_string(cities, ',') AS cities,
  mileage_low, mileage_high, len(configurations) AS configurations FROM sup""")
def coverage_support(t):
    return entries(t).select(
        "make", "model", "variant", "development_rows", "development_groups", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"),
        F.array_join("cities", ",").alias("cities"), "mileage_low", "mileage_high", F.size("configurations").cast("bigint").alias("configurations"),
    )


@query("g8_support_reasons", f"WITH {_INPUTS}, {_SUPPORT} SELECT listing_id, {_reason_sql('inp')} AS support_reason FROM inp {_JOIN_SUPPORT.format(r='inp')}")
def support_reasons(t):
    return support.support_reasons(inputs(t), entries(t)).select("listing_id", "support_reason")


_LEDGER = f"""ledger AS (SELECT listing_id, inp.make || ' ' || inp.model AS family, inp.variant, year, {_reason_sql('inp')} AS r FROM inp {_JOIN_SUPPORT.format(r='inp')})"""


@query("g10_coverage_ledger", f"WITH {_INPUTS}, {_SUPPORT}, {_LEDGER} SELECT listing_id, family, variant, year, r IS NULL AS supported, coalesce(r, '') AS reason FROM ledger")
def coverage_ledger(t):
    return support.coverage_ledger(inputs(t), entries(t))


@query("g13_first_supported_examples", f"""WITH {_INPUTS}, {_SUPPORT}, {_LEDGER} SELECT family, listing_id, year, price_pkr FROM (
  SELECT family, listing_id, inp.year, price_pkr, row_number() OVER (PARTITION BY family ORDER BY listing_id) AS rn FROM inp JOIN ledger USING (listing_id) WHERE r IS NULL) WHERE rn = 1""")
def first_supported(t):
    return support.first_supported(inputs(t), entries(t)).select("family", "listing_id", "year", "price_pkr")


FAMILIES = ("Brand#1 ECONOMY", "Brand#2 SMALL", "Brand#3 PROMO", "Brand#99 NONE")
LIMITS = support.ErrorLimits(25_000.0, 60.0, 0.01, {name: 24_000.0 + 500 * i for i, name in enumerate(FAMILIES)})


def _gate_sql(rows: str, least: int, family_least: int) -> str:
    """``rows`` holds family, actual_pkr, predicted_pkr and base_pkr."""
    policy = ", ".join(
        [f"('overall', {LIMITS.overall_mae}::double, {least}::double, {LIMITS.minimum_improvement_pct}::double)"]
        + [f"('{name}', {cap}::double, {family_least}::double, 0::double)" for name, cap in LIMITS.family_mae.items()]
    )
    return f"""pol(family, cap, least, gain) AS (VALUES {policy}),
  scoped AS (SELECT 'overall' AS family, actual_pkr, predicted_pkr, base_pkr FROM {rows} UNION ALL SELECT family, actual_pkr, predicted_pkr, base_pkr FROM {rows}),
  sc AS (SELECT family, count(*) AS n, avg(abs(predicted_pkr - actual_pkr)) AS mae, median(100 * abs(predicted_pkr - actual_pkr) / actual_pkr) AS ape,
    count(*) FILTER (WHERE predicted_pkr <= 0) AS neg, avg(abs(base_pkr - actual_pkr)) AS bm FROM scoped GROUP BY 1),
  g AS (SELECT pol.*, coalesce(n, 0) AS n, mae, ape, neg, bm, CASE WHEN bm <> 0 THEN 100 * (bm - mae) / bm END AS imp FROM pol LEFT JOIN sc USING (family)),
  gate AS (SELECT family || ': sufficient rows' AS "check", n::double AS actual, least AS "limit", n >= least AS passed FROM g
  UNION ALL SELECT family || ': MAE PKR', mae, cap, mae <= cap FROM g WHERE n > 0
  UNION ALL SELECT family || ': median percentage error', ape, {LIMITS.median_ape_pct}::double, ape <= {LIMITS.median_ape_pct} FROM g WHERE n > 0
  UNION ALL SELECT family || ': positive predictions', neg::double, 0::double, neg = 0 FROM g WHERE n > 0
  UNION ALL SELECT family || ': baseline improvement', imp, gain, coalesce(imp >= gain, false) FROM g WHERE n > 0)"""


_GATE_OUT = f'"check", {c.rounded_sql("actual")} AS actual, {c.rounded_sql(chr(34) + "limit" + chr(34))} AS "limit", passed'
_PAIRED = """paired AS (SELECT f.listing_id, f.family, f.actual_pkr, f.predicted_pkr, b.predicted_pkr AS base_pkr FROM experiments f JOIN experiments b ON b.listing_id = f.listing_id
  AND b.experiment = 'median_without_model' WHERE f.experiment = 'median_full')"""


@query("g9_gate_table", f"WITH {_EXPERIMENTS}, {_PAIRED}, {_gate_sql('paired', 1, 1)} SELECT {_GATE_OUT} FROM gate")
def gate_table(t):
    rows = experiments(t)
    return c.rounded(support.gate_table(
        rows.where("experiment = 'median_full'"), rows.where("experiment = 'median_without_model'"), LIMITS
    ))


_QUALIFIED = f"""{c.TO_DEV}, inp AS (SELECT * REPLACE (CASE WHEN engine_cc > 10 THEN 1::bigint END AS engine_cc) FROM dev), {_SUPPORT}, {_LEDGER}, {_experiment_sql()}, {_PAIRED},
  served AS (SELECT paired.* FROM paired JOIN ledger USING (listing_id) WHERE r IS NULL), {_gate_sql('served', 1, 1)},
  full_gate AS MATERIALIZED (SELECT * FROM gate UNION ALL SELECT pol.family || ': supported development groups', coalesce(n, 0)::double, 20::double, coalesce(n, 0) >= 20 FROM pol
    LEFT JOIN (SELECT family, count(DISTINCT group_id) AS n FROM ledger JOIN inp USING (listing_id) WHERE r IS NULL GROUP BY 1) USING (family) WHERE pol.family <> 'overall')"""


def qualification(t):
    rows = experiments(t)
    return support.qualify(
        inputs(t), rows.where("experiment = 'median_full'"), rows.where("experiment = 'median_without_model'"), COVERAGE, LIMITS, 20, entries(t),
    )


@query("g11_development_qualification", f"WITH {_QUALIFIED} SELECT {_GATE_OUT} FROM full_gate")
def development_qualification(t):
    return c.rounded(qualification(t))


_HOLDOUT = f"""{c.TO_DEV}, inp AS (SELECT * REPLACE (CASE WHEN engine_cc > 10 THEN 1::bigint END AS engine_cc) FROM dev), {_SUPPORT},
  tst AS (SELECT pop.* REPLACE (CASE WHEN engine_cc > 10 THEN 1::bigint END AS engine_cc) FROM pop JOIN asg USING (group_id) WHERE partition = 'demo_test'),
  {c.median_levels_sql('dev', 'h', fold=False)}, fitted AS ({c.median_lookup_sql('tst', 'h', fold=False)}),
  bm AS (SELECT make, median(price_pkr) AS md FROM dev GROUP BY 1 HAVING count(*) >= 5),
  hold AS (SELECT fitted.make || ' ' || fitted.model AS family, price_pkr AS actual_pkr, predicted_pkr, coalesce(bm.md, (SELECT median(price_pkr) FROM dev)) AS base_pkr,
    {_reason_sql('fitted')} AS r FROM fitted LEFT JOIN bm ON bm.make = fitted.make {_JOIN_SUPPORT.format(r='fitted')}),
  hserved AS (SELECT * FROM hold WHERE r IS NULL)"""


def holdout(t):
    development = c.development(t)
    test = c.located(t).where("partition = 'demo_test'").withColumn(
        "engine_cc", F.when(F.col("engine_cc") > 10, F.lit(1).cast("bigint"))
    )
    model = baseline.fit_medians(development, min_group_size=c.MINIMUM)
    scored = baseline.predict_medians(test, model).withColumnRenamed("price_pkr", "actual_pkr")
    coarse = (("make",), ())
    reference = baseline.predict_medians(test, baseline.fit_medians(development, min_group_size=c.MINIMUM, levels=coarse), levels=coarse)
    return support.evaluate_holdout(scored, entries(t), reference, LIMITS, minimum_rows=50, minimum_family_rows=5)


@query("g14_holdout_gate", f"WITH {_HOLDOUT}, {_gate_sql('hserved', 50, 5)} SELECT {_GATE_OUT} FROM gate")
def holdout_gate(t):
    return c.rounded(holdout(t)[0])


@query("g14_holdout_audit", f"WITH {_HOLDOUT} SELECT 'reserved' AS population, {c.metric_sql()} FROM hold UNION ALL SELECT 'supported', {c.metric_sql()} FROM hserved")
def holdout_audit(t):
    return c.rounded(holdout(t)[1])


# Two candidates: one whose gate is the qualification above, one judged only on family sizes.
_GATES = """gates AS (SELECT 'full' AS candidate_id, 'split_42' AS split_id, "check", passed FROM full_gate
  UNION ALL SELECT 'rows_only', 'split_42', "check", passed FROM full_gate WHERE "check" = 'overall: sufficient rows')"""


def gates(t):
    table = qualification(t)
    full = table.select(F.lit("full").alias("candidate_id"), F.lit("split_42").alias("split_id"), "check", "passed")
    rows_only = full.where(F.col("check") == "overall: sufficient rows").withColumn("candidate_id", F.lit("rows_only"))
    return c.stage(t, "gates", lambda: full.unionByName(rows_only))


@query("g15_released_scores", f"""WITH {_QUALIFIED}, {_GATES}, ok AS (SELECT candidate_id, split_id FROM gates GROUP BY ALL HAVING bool_and(passed)),
  scores AS (SELECT CASE WHEN fold = 0 THEN 'full' ELSE 'rows_only' END AS candidate_id, 'split_42' AS split_id, listing_id, predicted_pkr FROM experiments WHERE experiment = 'median_full')
  SELECT candidate_id, split_id, listing_id, {c.rounded_sql('predicted_pkr')} AS predicted_pkr FROM scores JOIN ok USING (candidate_id, split_id)""")
def released_scores(t):
    scores = experiments(t).where("experiment = 'median_full'").select(
        F.when(F.col("fold") == 0, F.lit("full")).otherwise(F.lit("rows_only")).alias("candidate_id"),
        F.lit("split_42").alias("split_id"), "listing_id", "predicted_pkr",
    )
    return c.rounded(support.release(scores, gates(t)))


@query("g15_failed_checks", f"""WITH {_QUALIFIED}, {_GATES} SELECT candidate_id, split_id, string_agg(DISTINCT "check", '; ' ORDER BY "check") AS failed_checks FROM gates WHERE NOT passed GROUP BY ALL""")
def failed_checks(t):
    return support.failed_checks(gates(t))


@query("g12_batch_scores", f"""WITH {_HOLDOUT}, scored AS (SELECT fitted.listing_id, CASE WHEN order_key % 9 = 0 THEN 'listing_city is required' END AS refusal0, {_reason_sql('fitted')} AS r, predicted_pkr
    FROM fitted {_JOIN_SUPPORT.format(r='fitted')})
  SELECT listing_id, coalesce(refusal0, r) AS refusal, CASE WHEN refusal0 IS NULL AND r IS NULL THEN cast(round_even(predicted_pkr, 0) AS bigint) END AS price_pkr FROM scored""")
def batch_scores(t):
    """The reserved rows as a batch to score, some refused by input preparation already."""
    test = c.located(t).where("partition = 'demo_test'").withColumn(
        "engine_cc", F.when(F.col("engine_cc") > 10, F.lit(1).cast("bigint"))
    )
    model = baseline.fit_medians(c.development(t), min_group_size=c.MINIMUM)
    estimated = baseline.predict_medians(test, model).withColumn("refusal", F.expr("CASE WHEN order_key % 9 = 0 THEN 'listing_city is required' END"))
    return support.score_batch(estimated, entries(t), "predicted_pkr").select("listing_id", "refusal", "price_pkr")
