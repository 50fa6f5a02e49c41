"""Quota, run-log, retention, source and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import RAW_COLUMNS
from ..operators import quotas, reviews
from ..session import StageTables
from ..sources import tables
from ..streaming import ingest
from . import common as c
from .auditing import FLAGGED, flagged, raw_listings
from .bindings import OBS, RAW, raw_export
from .registry import query

PLAN = (
    quotas.Quota("brand_one", 900, 1000, " brand#1 ", "Economy"), quotas.Quota("brand_two", 40, 60, "Brand#2", "SMALL"),
    quotas.Quota("anything", 30_000, 50_000),
)
_ASSIGN_SQL = """CASE WHEN lower(trim(make)) = 'brand#1' AND lower(trim(model)) = 'economy' THEN 'brand_one'
  WHEN lower(trim(make)) = 'brand#2' AND lower(trim(model)) = 'small' THEN 'brand_two' ELSE 'anything' END"""


@query("q27_quota_membership", f"WITH {RAW} SELECT listing_id, source_batch, make, model, {_ASSIGN_SQL} AS search_group FROM raw")
def quota_membership(t):
    rows = raw_export(t, "concat('batch_', l_suppkey % 3) AS source_batch")
    return quotas.assign_groups(rows, PLAN).select("listing_id", "source_batch", "make", "model", "search_group")


@query("q22_quota_progress", f"""WITH {RAW}, a AS (SELECT *, {_ASSIGN_SQL} AS g FROM raw WHERE parse_status = 'complete'), n AS (SELECT g, count(*) AS n FROM a GROUP BY 1),
  p(search_group, target) AS (VALUES ('brand_one', 900::bigint), ('brand_two', 40::bigint), ('anything', 30000::bigint))
  SELECT search_group, coalesce(n, 0) AS complete_rows, target, coalesce(n, 0) >= target AS reached FROM p LEFT JOIN n ON g = search_group""")
def quota_progress(t):
    return quotas.quota_progress(quotas.assign_groups(raw_export(t), PLAN), PLAN)


@query("q23_batch_summary", f"""WITH {RAW} SELECT count(*) AS total_rows, count(*) FILTER (WHERE parse_status = 'complete') AS complete_rows,
  count(*) FILTER (WHERE lower(trim(price_pkr)) NOT IN ('', 'nan')) AS present_price_pkr, count(*) FILTER (WHERE trim(fuel) <> '') AS present_fuel,
  count(DISTINCT listing_id) AS unique_listing_ids FROM raw""")
def batch_summary(t):
    return quotas.batch_summary(raw_export(t), ["price_pkr", "fuel"])


# Discovery: every event is a link; ids repeat, some are saved already, one kind dominates.
_DISCOVERED = """disc AS (SELECT concat('id', user_id, '-', event_id % 17) AS listing_id, concat('u/', event_id % 5, '/', user_id, '-', event_id % 17) AS url, event_id AS position,
    event_type AS search_group, value > 5 AS complete, event_id % 3 <> 0 AS matches FROM events),
  saved AS (SELECT listing_id, url, CASE WHEN s % 2 = 0 THEN 'complete' ELSE 'incomplete' END AS parse_status FROM (
    SELECT concat('id', user_id, '-', m) AS listing_id, concat('u/1/', user_id, '-', m) AS url, user_id + m AS s FROM (SELECT DISTINCT user_id, event_id % 17 AS m FROM events) WHERE (user_id + m) % 5 < 3))"""


def discovered(t):
    return t.events.selectExpr(
        "concat('id', user_id, '-', event_id % 17) AS listing_id", "concat('u/', event_id % 5, '/', user_id, '-', event_id % 17) AS url",
        "event_id AS position", "event_type AS search_group", "value > 5 AS complete", "event_id % 3 <> 0 AS matches",
    )


def saved(t):
    return t.events.selectExpr("user_id", "event_id % 17 AS m").distinct().where("(user_id + m) % 5 < 3").selectExpr(
        "concat('id', user_id, '-', m) AS listing_id", "concat('u/1/', user_id, '-', m) AS url",
        "CASE WHEN (user_id + m) % 2 = 0 THEN 'complete' ELSE 'incomplete' END AS parse_status",
    )


_OUTCOMES = f"""{_DISCOVERED}, outc AS (SELECT d.*, CASE WHEN row_number() OVER (PARTITION BY d.listing_id ORDER BY position) > 1 THEN 'duplicate'
    WHEN s.parse_status = 'complete' THEN 'already_complete' WHEN s.parse_status IS NOT NULL THEN 'refresh' ELSE 'new' END AS outcome, s.url AS s_url
  FROM disc d LEFT JOIN saved s ON s.listing_id = d.listing_id)"""


@query("q24_discovery_outcomes", f"WITH {_OUTCOMES} SELECT listing_id, position, outcome, CASE WHEN outcome <> 'duplicate' AND s_url <> url THEN s_url END AS replaces_url FROM outc")
def discovery_outcomes(t):
    return quotas.discovery_outcomes(discovered(t), saved(t)).select("listing_id", "position", "outcome", "replaces_url")


RUN = (quotas.Quota("view", 20, 60), quotas.Quota("click", 15, 40), quotas.Quota("error", 100, 25), quotas.Quota("purchase", 30, 90))
RUN_BUDGET = 120


@query("q21_quota_selection", f"""WITH {_OUTCOMES}, pl(search_group, ord, target, budget) AS (VALUES {', '.join(f"('{q.name}', {i}, {q.target}, {q.budget})" for i, q in enumerate(RUN))}),
  r AS (SELECT o.*, ord, target, budget, row_number() OVER (PARTITION BY o.search_group ORDER BY position) AS round,
    coalesce(sum(CASE WHEN complete AND matches THEN 1 ELSE 0 END) OVER (PARTITION BY o.search_group ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
    FROM outc o JOIN pl USING (search_group) WHERE outcome IN ('new', 'refresh'))
  SELECT search_group, listing_id, position, CAST(round AS INTEGER) AS round FROM r WHERE round <= budget AND done < target ORDER BY round, ord LIMIT {RUN_BUDGET}""")
def quota_selection(t):
    fetchable = quotas.discovery_outcomes(discovered(t), saved(t)).where("outcome IN ('new', 'refresh')")
    return quotas.select_for_quotas(fetchable, RUN, RUN_BUDGET).select("search_group", "listing_id", "position", "round")


@query("q21_missing_positions", f"""WITH {_OUTCOMES}, pl(search_group, ord, target, budget) AS (VALUES {', '.join(f"('{q.name}', {i}, {q.target}, {q.budget})" for i, q in enumerate(RUN))}),
  lost AS (SELECT * REPLACE (CASE WHEN position % 3 <> 0 THEN position END AS position) FROM outc WHERE outcome IN ('new', 'refresh')),
  r AS (SELECT o.*, ord, target, budget, row_number() OVER w AS round,
    coalesce(sum(CASE WHEN complete AND matches THEN 1 ELSE 0 END) OVER (PARTITION BY o.search_group ORDER BY position NULLS LAST, md5(listing_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
    FROM lost o JOIN pl USING (search_group) WINDOW w AS (PARTITION BY o.search_group ORDER BY position NULLS LAST, md5(listing_id::VARCHAR)))
  SELECT search_group, listing_id, position, CAST(round AS INTEGER) AS round FROM r WHERE round <= budget AND done < target ORDER BY round, ord LIMIT {RUN_BUDGET}""")
def missing_positions(t):
    """A third of the queue has lost its position and comes last."""
    fetchable = quotas.discovery_outcomes(discovered(t), saved(t)).where("outcome IN ('new', 'refresh')")
    lost = fetchable.withColumn("position", F.expr("CASE WHEN position % 3 <> 0 THEN position END"))
    return quotas.select_for_quotas(lost, RUN, RUN_BUDGET).select("search_group", "listing_id", "position", "round")


@query("q25_run_log_counts", """SELECT 'request_kind' AS measure, event_type AS value, count(*) AS count FROM events GROUP BY 2
  UNION ALL SELECT 'request_outcome', CASE WHEN value > 5 THEN 'success' ELSE 'failed' END, count(*) FROM events GROUP BY 2
  UNION ALL SELECT 'selection_outcome', CASE WHEN event_id % 3 = 0 THEN 'new_complete' ELSE 'duplicate' END, count(*) FROM events WHERE event_id % 2 = 0 GROUP BY 2""")
def run_log_counts(t):
    """Each event as a log document of one request and at most one selection."""
    logs = t.events.selectExpr("""to_json(named_struct('run_id', concat('run_', user_id), 'requests', array(named_struct('kind', event_type, 'outcome', CASE WHEN value > 5 THEN 'success' ELSE 'failed' END)),
      'selections', CASE WHEN event_id % 2 = 0 THEN array(named_struct('url', concat('u', event_id), 'outcome', CASE WHEN event_id % 3 = 0 THEN 'new_complete' ELSE 'duplicate' END)) END)) AS document""")
    parsed = logs.select(F.from_json("document", quotas.RUN_LOG_SCHEMA).alias("log")).select("log.*")
    return quotas.run_log_counts(parsed)


@query("s7_page_retention", """WITH p AS (SELECT event_type AS run_id, concat('id', event_id) AS listing_id, event_id AS position, value > 3 AS complete, user_id % 20 = 0 AS flagged FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY run_id, complete ORDER BY position) AS rk, sha256(run_id || ':' || listing_id) AS h FROM p),
  s AS (SELECT *, (6 * (SELECT sum(strpos('0123456789abcdef', x) - 1) FROM (SELECT unnest(string_split(substr(h, 1, 63), '')) AS x)) + strpos('0123456789abcdef', substr(h, 64, 1)) - 1) % 10 = 0 AS smp FROM r)
  SELECT run_id, listing_id, CASE WHEN flagged OR NOT complete THEN 'flagged' WHEN complete AND rk <= 50 THEN 'early' WHEN smp THEN 'sampled' END AS kept_because
  FROM s WHERE flagged OR NOT complete OR rk <= 50 OR smp""")
def page_retention(t):
    pages = t.events.selectExpr(
        "event_type AS run_id", "concat('id', event_id) AS listing_id", "event_id AS position", "value > 3 AS complete", "user_id % 20 = 0 AS flagged"
    )
    return quotas.retained_pages(pages).select("run_id", "listing_id", "kept_because")


def _folder(t, name: str) -> str:
    return StageTables(t.spark, name).root


@query("s1_strict_csv_scan", f"WITH {RAW} SELECT {', '.join(f'trim({n}) AS {n}' for n in RAW_COLUMNS)} FROM raw")
def strict_csv_scan(t):
    """The raw export written as CSV and read back under the header contract."""
    folder = _folder(t, "csv")
    tables.write_exports(raw_listings(t), folder)
    rows, broken = tables.read_strict_csv(t.spark, f"{folder}/raw", multiline=False)
    if not broken.isEmpty():
        raise ValueError("The export has malformed rows")
    return rows


@query("s1_refused_files", "SELECT 'o_orderstatus,o_custkey,o_orderkey' AS header, count(*) AS rows FROM orders WHERE o_orderkey % 3 = 0")
def refused_files(t):
    """Files of one folder whose header differs from the contract, with the rows they hold."""
    folder = _folder(t, "csv")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    for kept, order in (("o_orderkey % 3 <> 0", columns), ("o_orderkey % 3 = 0", columns[::-1])):
        t.orders.where(kept).select(*order).write.mode("append").option("header", True).csv(folder)
    found = tables.csv_header_violations(t.spark, folder, columns)
    return found.groupBy("header").agg(F.sum(F.col("lines") - 1).alias("rows"))


@query("s4_reference_tables", """SELECT p_brand AS make, p_type AS model, p_name AS variant FROM part GROUP BY ALL""")
def reference_tables(t):
    """Catalogue documents, one family each, written as JSON, flattened and validated."""
    folder = _folder(t, "catalogue")
    family = t.part.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set("p_name")).alias("variants"))
    documents = family.select(F.lit(1).alias("catalogue_version"), F.array(F.struct(
        F.col("p_brand").alias("make"), F.col("p_type").alias("model"), "variants")).alias("families"))
    documents.write.json(folder)
    families, variants = tables.load_catalogue(t.spark, folder, multiline=False)
    if not tables.catalogue_violations(families, variants).isEmpty():
        raise ValueError("The catalogue repeats a label")
    return variants.select("make", "model", "variant")


_NOTE = """concat(o_orderpriority, chr(10), '"', o_orderstatus, '", ', CASE WHEN o_orderkey % 3 = 0 THEN concat(chr(10), chr(10)) ELSE '' END, o_custkey)"""


@query("s1_quoted_line_breaks", f"SELECT cast(o_orderkey AS varchar) AS o_orderkey, {_NOTE} AS note FROM orders")
def quoted_line_breaks(t):
    """Orders with notes of several quoted lines, written as CSV and read in blocks."""
    folder = _folder(t, "csv")
    t.orders.selectExpr("o_orderkey", f"{_NOTE} AS note").write.option("header", True).option("escape", '"').csv(folder)
    rows, broken = tables.read_strict_csv(t.spark, folder, ["o_orderkey", "note"], multiline=True)
    if not broken.isEmpty():
        raise ValueError("The export has malformed rows")
    return rows


@query("s4_scope", """SELECT DISTINCT p_brand AS make, p_type AS model, (SELECT min(year(o_orderdate)) FROM orders) AS first_year, (SELECT max(year(o_orderdate)) FROM orders) AS last_year FROM part""")
def scope(t):
    """Scope documents, one brand each, with the years of all orders."""
    folder = _folder(t, "scope")
    years = t.orders.select(F.year("o_orderdate").alias("y")).agg(F.array(F.min("y"), F.max("y")).alias("year_range")).first()["year_range"]
    family = F.struct(F.col("p_brand").alias("make"), F.col("p_type").alias("model"))
    documents = t.part.groupBy("p_brand").agg(F.collect_set(family).alias("candidate_families"))
    documents.select("candidate_families", F.array(*[F.lit(y) for y in years]).alias("year_range")).write.json(folder)
    families, (low, high) = tables.load_scope(t.spark, folder, multiline=False)
    return families.select("make", "model", F.lit(low).cast("bigint").alias("first_year"), F.lit(high).cast("bigint").alias("last_year"))


# (expression, column) of a decision about an order; some are malformed or repeat an id.
_DECIDED = (
    ("CASE WHEN o_orderkey % 17 = 0 THEN concat('x', o_orderkey) WHEN o_orderkey % 100 = 1 THEN concat(o_orderkey - 1, '') ELSE concat(o_orderkey, '') END", "listing_id"),
    ("CASE o_orderkey % 7 WHEN 0 THEN 'exclude' WHEN 1 THEN 'drop' ELSE 'keep' END", "decision"),
    ("CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE o_orderpriority END", "reason"),
    ("CASE WHEN o_orderkey % 5 = 0 THEN o_custkey - o_orderkey % 3 * 1000000 END", "mileage_from"),
    ("CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0 THEN o_orderkey END", "mileage_to"),
    ("CASE WHEN o_orderkey % 9 = 0 THEN o_custkey END", "displayed_pkr"),
    ("CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 2 END", "structured_pkr"),
)
_DECIDED_SQL = "SELECT " + ", ".join(f"{expression} AS {name}" for expression, name in _DECIDED) + " FROM orders"


def _stored_decisions(t):
    """Decisions about orders, written as one document a customer and loaded again."""
    folder = _folder(t, "decisions")
    flat = t.orders.selectExpr("o_custkey", *[f"{expression} AS {name}" for expression, name in _DECIDED])
    decision = F.expr("""named_struct('listing_id', listing_id, 'decision', decision, 'reason', reason,
      'corrections', CASE WHEN mileage_from IS NOT NULL THEN named_struct('mileage_km', named_struct('from', mileage_from, 'to', mileage_to)) END,
      'accept_price_precision', CASE WHEN displayed_pkr IS NOT NULL THEN named_struct('displayed_pkr', displayed_pkr, 'structured_pkr', structured_pkr) END)""")
    documents = flat.groupBy("o_custkey").agg(F.collect_list(decision).alias("decisions"))
    documents.select(F.lit(1).alias("version"), "decisions").write.json(folder)
    return tables.load_decisions(t.spark, folder, multiline=False)


@query("s4_review_decisions", _DECIDED_SQL)
def review_decisions(t):
    return _stored_decisions(t)


@query("s4_decision_violations", f"""WITH d AS ({_DECIDED_SQL})
  SELECT listing_id, 'listing_id is not numeric' AS violation FROM d WHERE NOT regexp_full_match(listing_id, '[0-9]+')
  UNION ALL SELECT listing_id, 'unknown decision' FROM d WHERE decision NOT IN ('exclude', 'keep')
  UNION ALL SELECT listing_id, 'no reason given' FROM d WHERE reason = ''
  UNION ALL SELECT listing_id, 'invalid correction' FROM d WHERE mileage_from IS NOT NULL AND NOT (decision = 'keep' AND mileage_from >= 0 AND mileage_to IS NOT NULL)
  UNION ALL SELECT listing_id, 'invalid accepted price' FROM d WHERE displayed_pkr IS NOT NULL AND NOT (decision = 'keep' AND displayed_pkr >= 1 AND structured_pkr >= 1)
  UNION ALL SELECT listing_id, 'repeated decision' FROM d GROUP BY 1 HAVING count(*) > 1""")
def decision_violations(t):
    return reviews.decision_violations(_stored_decisions(t))


@query("s4_sampling_plan", """SELECT lower(n_name) AS name, count(*) AS target, 2 * count(*) AS budget, CASE WHEN n_nationkey % 2 = 0 THEN r_name END AS make, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS model
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, n_nationkey, r_name""")
def sampling_plan(t):
    """A plan with one search a nation, as large as its number of customers, written and loaded."""
    folder = _folder(t, "plan")
    customers = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    searches = customers.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("""named_struct('name', lower(n_name), 'expected_make', CASE WHEN n_nationkey % 2 = 0 THEN r_name END,
      'expected_model', CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'target_complete_rows', n, 'max_detail_requests', 2 * n) AS s""")
    searches.agg(F.lit(1).alias("plan_version"), F.collect_list("s").alias("searches")).write.json(folder)
    plan = tables.load_plan(t.spark, folder)
    return t.spark.createDataFrame([(q.name, q.target, q.budget, q.make, q.model) for q in plan], "name string, target long, budget long, make string, model string")


@query("s5_versioned_dataset", f"""WITH {OBS}, {FLAGGED} SELECT 'normalized_all' AS name, count(*) AS rows FROM flagged UNION ALL SELECT 'modeling_candidates', count(*) FROM flagged WHERE modeling_candidate
  UNION ALL SELECT 'source_checked_candidates', count(*) FROM flagged WHERE source_checked_candidate""")
def versioned_dataset(t):
    """Three populations written as one version; the manifest is read back and verified."""
    target = _folder(t, "dataset") + "/v1"
    manifest = tables.write_dataset(flagged(t), target, [t.folder])
    tables.verify_dataset(t.spark, target)
    return manifest.select("name", "rows")


@query("s6_split_id", f"""WITH {c.TO_SPLIT} SELECT 'split_' || sha256(concat_ws(':', rows, fingerprint)) AS split_id
  FROM ({c.fingerprint_sql(("listing_id", "group_id", "partition", "validation_fold"), "assigned")})""")
def split_identity(t):
    return tables.split_id(c.assignments(t))


@query("s6_manifest_differences", f"""SELECT 'orders' AS name, 'changed' AS problem UNION ALL SELECT 'part', 'missing' UNION ALL SELECT 'supplier', 'unrecorded' FROM (SELECT count(*) AS n FROM orders) WHERE n > 0""")
def manifest_differences(t):
    recorded = tables.manifest_of({"orders": t.orders, "part": t.part, "nation": t.nation})
    changed = t.orders.withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 100 = 7 THEN 'X' ELSE o_orderstatus END"))
    return tables.manifest_differences(recorded, tables.manifest_of({"orders": changed, "supplier": t.supplier, "nation": t.nation}))


_STREAMED = """SELECT user_id AS listing_id, collected_at, event_id, event_type, value, observation_count FROM (SELECT *, ts AS collected_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type, event_id, value) AS rn,
  count(*) OVER (PARTITION BY user_id) AS observation_count FROM events) WHERE rn = 1"""


@query("st1_incremental_ingest", _STREAMED)
def incremental_ingest(t):
    """Events delivered in four waves as a file stream, then the latest row per user.

    The state is compacted after the second wave and read with the later deltas on top.
    """
    folder = _folder(t, "stream")
    observations = t.events.select(
        F.col("user_id").alias("listing_id"), F.col("ts").alias("collected_at"), F.col("event_type").alias("source_batch"), "event_id", "value"
    )
    for wave in range(4):
        # Waves follow a hash, not the time, so that rows arrive late and early.
        delivered = observations.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == wave)
        delivered.write.mode("append").parquet(f"{folder}/arrivals")
        stream = t.spark.readStream.schema(observations.schema).parquet(f"{folder}/arrivals")
        ingest.start_ingest(stream, f"{folder}/state").awaitTermination()
        if wave == 1:
            ingest.compact(t.spark, f"{folder}/state")
            ingest.vacuum(t.spark, f"{folder}/state")
    return ingest.latest_state(t.spark, f"{folder}/state").select(
        "listing_id", "collected_at", "event_id", F.col("source_batch").alias("event_type"), "value", "observation_count"
    )
