"""Latest observations, components, history and continued splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, consolidate, splits
from . import common as c
from .bindings import OBS, WITHIN, observations
from .registry import query

LINK_FIELDS = ("make", "model", "year", "mileage_km", "engine_cc")
COMPARED = ("make", "model", "variant", "year", "mileage_km", "engine_cc", "fuel", "transmission", "listing_city", "assembly", "price_pkr")


@query("q16_latest_observation", f"""WITH {OBS}, {c.LATEST}, b AS (SELECT listing_id, string_agg(DISTINCT source_batch, ';' ORDER BY source_batch) AS observation_batches,
  count(DISTINCT (make, model)) > 1 AS family_changed FROM obs GROUP BY 1)
  SELECT listing_id, collected_at, source_batch, make, model, variant, year, mileage_km, price_pkr, observation_count, observation_batches, family_changed
  FROM latest JOIN b USING (listing_id)""")
def latest_observation(t):
    return consolidate.latest_observations(observations(t), within=WITHIN).select(
        "listing_id", "collected_at", "source_batch", "make", "model", "variant", "year", "mileage_km", "price_pkr",
        "observation_count", "observation_batches", "family_changed",
    )


@query("q17_tie_conflicts", f"""WITH {OBS}, newest AS (SELECT listing_id, max(collected_at) AS collected_at, count(*) AS observation_count FROM obs GROUP BY 1)
  SELECT listing_id, collected_at, any_value(observation_count) AS observation_count FROM obs JOIN newest USING (listing_id, collected_at)
  GROUP BY ALL HAVING count(DISTINCT ({', '.join(COMPARED)})) > 1""")
def tie_conflicts(t):
    return consolidate.tie_conflicts(consolidate.latest_observations(observations(t), compared=COMPARED, within=WITHIN))


# Historical assignments for some ids: groups of ids that shared an order, most in one place.
_HISTORY = """history AS (SELECT DISTINCT listing_id, concat('old_', order_key // 12) AS group_id,
  CASE WHEN (order_key // 12) % 5 = 0 THEN 'demo_test' ELSE 'development' END AS partition,
  CASE WHEN (order_key // 12) % 5 = 0 THEN NULL ELSE CAST((order_key // 12) % 3 AS INTEGER) END AS validation_fold
  FROM obs WHERE order_key % 4 = 3)"""


def history(t):
    return c.stage(t, "history", lambda: observations(t).where("order_key % 4 = 3").selectExpr(
        *WITHIN, "listing_id", "concat('old_', order_key div 12) AS group_id",
        "CASE WHEN (order_key div 12) % 5 = 0 THEN 'demo_test' ELSE 'development' END AS partition",
        "CASE WHEN (order_key div 12) % 5 <> 0 THEN cast((order_key div 12) % 3 AS int) END AS validation_fold",
    ).distinct().drop(*WITHIN))


_LINKS = f"""links AS (SELECT DISTINCT listing_id, sha256(concat_ws(chr(31), {', '.join(LINK_FIELDS)})) AS link FROM obs
  UNION ALL SELECT listing_id, 'history:' || group_id FROM history)"""
_LABELS = f"""roots AS (SELECT link, min(listing_id) AS root FROM links GROUP BY 1),
  star AS (SELECT DISTINCT listing_id AS u, root AS v FROM links JOIN roots USING (link) WHERE listing_id <> root),
  both_ways AS (SELECT u, v FROM star UNION ALL SELECT v, u FROM star),
  reach(id, lab) AS (SELECT DISTINCT listing_id, listing_id FROM links UNION SELECT e.v, r.lab FROM reach r JOIN both_ways e ON e.u = r.id),
  labels AS (SELECT id AS listing_id, min(lab) AS component FROM reach GROUP BY 1)"""
_REC = "WITH RECURSIVE "


def labels(t):
    """Component label of every id over all versions and historical groups."""
    def build():
        links = consolidate.history_links(observations(t), history(t), fields=LINK_FIELDS, within=WITHIN)
        return components.component_labels(links, "listing_id", "link", written=True)

    return c.stage(t, "labels", build)


@query("q18_components", f"{_REC}{OBS}, {_HISTORY}, {_LINKS}, {_LABELS} SELECT listing_id, component FROM labels")
def connected_components(t):
    return labels(t)


_VERDICTS = """placed_labels AS (SELECT component, l.listing_id, partition, validation_fold FROM labels l LEFT JOIN history USING (listing_id)),
  verdicts AS (SELECT component, count(*) AS members, CASE WHEN count(*) = 1 THEN 'listing_' || component
     ELSE 'linked_' || sha256(concat_ws(':', component, count(*))) END AS group_id,
   CASE WHEN count(DISTINCT partition) > 1 THEN 'quarantined' ELSE coalesce(min(partition), 'new') END AS historical_partition,
   CASE WHEN count(DISTINCT partition) <= 1 THEN min(validation_fold) FILTER (WHERE partition = 'development') END AS historical_validation_fold
   FROM placed_labels GROUP BY 1)"""


@query("q19_component_verdicts", f"{_REC}{OBS}, {_HISTORY}, {_LINKS}, {_LABELS}, {_VERDICTS} SELECT * FROM verdicts")
def component_verdicts(t):
    return consolidate.component_verdicts(labels(t), history(t))


_CONSOLIDATED = f"""{OBS}, {c.LATEST}, {_HISTORY}, {_LINKS}, {_LABELS}, {_VERDICTS},
  fam AS (SELECT listing_id, count(DISTINCT (make, model)) > 1 AS family_changed FROM obs GROUP BY 1),
  ties AS (SELECT DISTINCT listing_id, true AS tie FROM (SELECT *, max(collected_at) OVER (PARTITION BY listing_id) AS newest FROM obs) WHERE collected_at = newest
    GROUP BY listing_id HAVING count(DISTINCT ({', '.join(COMPARED)}, part_key % 13 <> 0 AND part_key % 11 <> 0)) > 1),
  cons0 AS (SELECT latest.*, v.group_id, v.historical_partition, v.historical_validation_fold,
    list_filter([CASE WHEN part_key % 13 = 0 THEN 'unresolved_variant' END, CASE WHEN v.historical_partition = 'quarantined' THEN 'historical_development_test_group_conflict' END,
      CASE WHEN family_changed THEN 'cross_batch_family_conflict' END, CASE WHEN tie THEN 'newest_observations_disagree' END], lambda x: x IS NOT NULL) AS rs
    FROM latest JOIN labels USING (listing_id) JOIN verdicts v USING (component) JOIN fam USING (listing_id) LEFT JOIN ties USING (listing_id)),
  cons AS (SELECT * EXCLUDE (rs), array_to_string(list_sort(rs), ';') AS exclusion_reasons, len(rs) = 0 AS modeling_candidate,
    len(rs) = 0 AND part_key % 11 <> 0 AS source_checked_candidate FROM cons0)"""


# Columns of consolidated rows that some query reads; others would be shuffled and written for nothing.
_READ = (
    "listing_id", "collected_at", "source_batch", "make", "model", "price_pkr", "observation_count", "group_id", "historical_partition",
    "historical_validation_fold", "exclusion_reasons", "modeling_candidate", "source_checked_candidate",
)


def consolidated(t):
    def build():
        flagged = observations(t).selectExpr(
            "*", "CASE WHEN part_key % 13 = 0 THEN 'unresolved_variant' ELSE '' END AS exclusion_reasons",
            "part_key % 13 <> 0 AS modeling_candidate", "part_key % 13 <> 0 AND part_key % 11 <> 0 AS source_checked_candidate",
        )
        # Ties between batches resolve by the same column order as the SQL.
        rows = consolidate.consolidate_observations(flagged, history(t), fields=LINK_FIELDS, compared=(*COMPARED, "source_checked_candidate"), within=WITHIN)
        return rows.select(*_READ)

    return c.stage(t, "consolidated", build)


@query("q19_consolidated_rows", f"""{_REC}{_CONSOLIDATED} SELECT listing_id, collected_at, source_batch, price_pkr, group_id, historical_partition, historical_validation_fold,
  exclusion_reasons, modeling_candidate, source_checked_candidate FROM cons""")
def consolidated_rows(t):
    return consolidated(t).select(
        "listing_id", "collected_at", "source_batch", "price_pkr", "group_id", "historical_partition", "historical_validation_fold",
        "exclusion_reasons", "modeling_candidate", "source_checked_candidate",
    )


@query("q20_decision_ledger", f"""{_REC}{_CONSOLIDATED} SELECT listing_id, source_batch AS selected_batch, collected_at AS selected_collected_at,
  observation_count AS observations, group_id, historical_partition, exclusion_reasons FROM cons""")
def decision_ledger(t):
    return consolidate.decision_ledger(consolidated(t))


# Rows fit to split: unquarantined groups that stay in one family.
_ELIGIBLE = """elig0 AS (SELECT * FROM cons WHERE historical_partition <> 'quarantined'),
  pure AS (SELECT group_id FROM elig0 GROUP BY 1 HAVING count(DISTINCT (make, model)) = 1 AND count(DISTINCT concat_ws(':', historical_partition, historical_validation_fold)) = 1),
  elig AS (SELECT * FROM elig0 WHERE group_id IN (SELECT group_id FROM pure)),
  fresh AS (SELECT * FROM elig WHERE historical_partition = 'new')"""


def eligible(t):
    return splits.splittable(consolidated(t))[0]


@query("p3_refused_groups", f"""{_REC}{_CONSOLIDATED} SELECT group_id, count(*) AS rows, CASE WHEN bool_or(historical_partition = 'quarantined') THEN 'quarantined_history'
  WHEN count(DISTINCT (make, model)) > 1 THEN 'several_families' ELSE 'several_locations' END AS reason FROM cons GROUP BY 1
  HAVING bool_or(historical_partition = 'quarantined') OR count(DISTINCT (make, model)) > 1 OR count(DISTINCT concat_ws(':', historical_partition, historical_validation_fold)) > 1""")
def refused_groups(t):
    """Every group that is not split, with the reason and its rows."""
    return splits.splittable(consolidated(t))[1]


@query("p3_missing_groups", f"""{_REC}{_CONSOLIDATED}, lost AS (SELECT * REPLACE (CASE WHEN ascii(right(listing_id, 1)) % 5 <> 0 THEN group_id END AS group_id) FROM cons),
  j AS (SELECT group_id, count(*) AS rows, CASE WHEN group_id IS NULL THEN 'no_group' WHEN bool_or(historical_partition = 'quarantined') THEN 'quarantined_history'
    WHEN count(DISTINCT (make, model)) > 1 THEN 'several_families' WHEN count(DISTINCT concat_ws(':', historical_partition, historical_validation_fold)) > 1 THEN 'several_locations' END AS reason FROM lost GROUP BY 1)
  SELECT reason, sum(rows)::BIGINT AS rows FROM j GROUP BY 1""")
def missing_groups(t):
    """Rows kept and refused, by reason, when some rows have no group: no row is on neither side."""
    rows = consolidated(t).withColumn("group_id", F.expr("CASE WHEN ascii(right(listing_id, 1)) % 5 <> 0 THEN group_id END"))
    kept, refused = splits.splittable(rows)
    sides = kept.select(F.lit(None).cast("string").alias("reason"), F.lit(1).cast("bigint").alias("rows")).unionByName(refused.select("reason", "rows"))
    return sides.groupBy("reason").agg(F.sum("rows").alias("rows"))


@query("p3_continued_splits", f"""{_REC}{_CONSOLIDATED}, {_ELIGIBLE}, {c.split_sql('fresh', 'n')}
  SELECT listing_id, group_id, partition, validation_fold FROM nassigned
  UNION ALL SELECT listing_id, group_id, historical_partition, historical_validation_fold FROM elig WHERE historical_partition <> 'new'""")
def continued_splits(t):
    return splits.continued_splits(eligible(t), seed=c.SEED, test_fraction=c.FRACTION, folds=c.FOLDS)


@query("p3_continued_development_only", f"""{_REC}{_CONSOLIDATED}, {_ELIGIBLE}, g AS (SELECT group_id, min(make) AS make, min(model) AS model, count(*) AS n FROM fresh GROUP BY 1),
  d AS (SELECT *, row_number() OVER (PARTITION BY make, model ORDER BY n DESC, sha256('42:reviewed-development:' || group_id), group_id) - 1 AS pos,
    CAST('0x' || substr(sha256(make || ':' || model), 1, 7) AS BIGINT) % 3 AS off FROM g)
  SELECT listing_id, group_id, 'development' AS partition, CAST(((CASE WHEN (pos // 3) % 2 = 0 THEN pos % 3 ELSE 2 - pos % 3 END) + off) % 3 AS INTEGER) AS validation_fold
  FROM fresh JOIN d USING (group_id)
  UNION ALL SELECT listing_id, group_id, historical_partition, historical_validation_fold FROM elig WHERE historical_partition <> 'new'""")
def continued_development_only(t):
    return splits.continued_splits(eligible(t), seed=c.SEED, test_fraction=c.FRACTION, folds=c.FOLDS, policy="development_only")


@query("p3_history_violations", f"""{_REC}{_CONSOLIDATED}
  SELECT group_id, 'conflicting_historical_locations' AS violation FROM cons WHERE historical_partition <> 'new' GROUP BY 1
    HAVING count(DISTINCT concat_ws(':', historical_partition, coalesce(historical_validation_fold, -1))) > 1
  UNION ALL SELECT DISTINCT group_id, 'quarantined_history' FROM cons WHERE historical_partition = 'quarantined'""")
def history_violations(t):
    return splits.history_violations(consolidated(t))
