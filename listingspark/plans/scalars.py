"""Scalar functions over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digests, numbers, reasons, text
from .bindings import RAW, raw_export
from . import common as c
from .registry import query

# Column expressions both engines evaluate, to give the functions varied input.
_SPACED = "concat('  ', p_brand, '   ', p_type, ' ', p_name, CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '' END)"
_LABEL = "CASE p_partkey % 9 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'Unknown' WHEN 2 THEN '-' WHEN 3 THEN 'not  available' WHEN 4 THEN '' WHEN 5 THEN 'NULL' ELSE concat(p_name, '  ', p_type) END"
_NUMBER = "CASE l_orderkey % 9 WHEN 0 THEN concat(l_partkey, ',', l_linenumber, '00') WHEN 1 THEN concat(l_partkey, '.5') WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN concat(l_suppkey, '.000') WHEN 5 THEN 'NaN' WHEN 6 THEN concat('-', l_suppkey) WHEN 7 THEN '2e3' ELSE concat(' ', l_partkey, ' ') END"
_UNIT = "CASE l_orderkey % 8 WHEN 0 THEN ' lacs' WHEN 1 THEN ' Lakh' WHEN 2 THEN ' crore' WHEN 3 THEN ' CR' WHEN 4 THEN ' million' WHEN 5 THEN 'mn' ELSE '' END"
_AMOUNT = "concat(l_partkey % 90 + 1, ',', 100 + l_suppkey % 800, '.', l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN '5' ELSE '' END)"
_SLUG = "concat(lower(replace(n_name, '_', '-')), CASE WHEN n_nationkey % 2 = 0 THEN '-d.i. khan' ELSE '-O''TOWN' END)"

_TITLE_SQL = (
    "array_to_string(list_transform(regexp_extract_all({c}, '\\p{{L}}+|[^\\p{{L}}]+'), "
    "lambda r: upper(r[1]) || lower(r[2:])), '')"
)
_LABEL_SQL = (
    "CASE WHEN lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) NOT IN "
    "('', 'n/a', 'na', 'unknown', 'none', 'null', '-', 'not available') THEN trim(regexp_replace({c}, '\\s+', ' ', 'g')) END"
)
_WHOLE_SQL = (
    "CASE WHEN regexp_full_match(trim(replace({c}, ',', '')), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
    "AND try_cast(replace({c}, ',', '') AS double) = floor(try_cast(replace({c}, ',', '') AS double)) "
    "THEN try_cast(try_cast(replace({c}, ',', '') AS double) AS bigint) END"
)


def title_sql(c: str) -> str:
    return _TITLE_SQL.format(c=c)


def label_sql(c: str) -> str:
    return _LABEL_SQL.format(c=c)


def whole_sql(c: str) -> str:
    return _WHOLE_SQL.format(c=c)


def category_sql(c: str) -> str:
    return f"CASE WHEN upper({c}) IN ('CNG', 'LPG', 'PHEV', 'CVT', 'SUV') THEN upper({c}) ELSE {title_sql(c)} END"


@query("f1_squash_whitespace", f"""SELECT p_partkey, trim(regexp_replace({_SPACED}, '\\s+', ' ', 'g')) AS text FROM part
UNION ALL SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g')) FROM documents""")
def squash_whitespace(t):
    parts = t.part.select("p_partkey", text.squash(F.expr(_SPACED)).alias("text"))
    return parts.unionByName(t.documents.select(F.col("doc_id").alias("p_partkey"), text.squash(F.col("text")).alias("text")))


@query("f2_null_token_label", f"SELECT p_partkey, {label_sql('raw')} AS label FROM (SELECT p_partkey, {_LABEL} AS raw FROM part)")
def null_token_label(t):
    return t.part.select("p_partkey", text.label(F.expr(_LABEL)).alias("label"))


@query("f3_whole_number", f"SELECT l_orderkey, l_linenumber, l_partkey, {whole_sql('raw')} AS number FROM (SELECT *, {_NUMBER} AS raw FROM lineitem)")
def whole_number(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", numbers.whole_number(F.expr(_NUMBER)).alias("number"))


@query("f4_first_number_in_text", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN hit <> '' AND try_cast(replace(hit, ',', '') AS double) % 1 = 0
  THEN cast(try_cast(replace(hit, ',', '') AS double) AS bigint) END AS number FROM (
  SELECT *, regexp_extract(concat('runs ', l_partkey, CASE WHEN l_orderkey % 3 = 0 THEN ',250' WHEN l_orderkey % 3 = 1 THEN '.5' ELSE '.0' END, ' km or ', l_suppkey), '\\d[\\d,]*(?:\\.\\d+)?') AS hit FROM lineitem)""")
def first_number(t):
    source = F.expr("concat('runs ', l_partkey, CASE WHEN l_orderkey % 3 = 0 THEN ',250' WHEN l_orderkey % 3 = 1 THEN '.5' ELSE '.0' END, ' km or ', l_suppkey)")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", numbers.first_number(source).alias("number"))


@query("f5_price_with_units", f"""SELECT l_orderkey, l_linenumber, l_partkey, cast(round_even(cast(replace(amount, ',', '') AS decimal(18,4)) *
  CASE WHEN lower(unit) LIKE ' la%' THEN 100000 WHEN lower(unit) LIKE ' cr%' THEN 10000000 WHEN unit <> '' THEN 1000000 ELSE 1 END, 0) AS bigint) AS price
  FROM (SELECT *, {_AMOUNT} AS amount, {_UNIT} AS unit FROM lineitem)""")
def price_with_units(t):
    shown = F.concat(F.lit("PKR "), F.expr(_AMOUNT), F.expr(_UNIT))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", numbers.displayed_price(shown).alias("price"))


@query("f6_category_and_city_case", f"""SELECT n_nationkey, {category_sql('kind')} AS kind, {title_sql("replace(slug, '-', ' ')")} AS city
  FROM (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'suv' WHEN 1 THEN 'Cng' WHEN 2 THEN 'pick-up TRUCK' ELSE lower(n_name) END AS kind, {_SLUG} AS slug FROM nation)""")
def category_case(t):
    kind = F.expr("CASE n_nationkey % 4 WHEN 0 THEN 'suv' WHEN 1 THEN 'Cng' WHEN 2 THEN 'pick-up TRUCK' ELSE lower(n_name) END")
    return t.nation.select("n_nationkey", text.category(kind).alias("kind"), text.city_from_slug(F.expr(_SLUG)).alias("city"))


@query("f7_url_identity_key", """SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) ||
  regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS url_key FROM pages""")
def url_identity_key(t):
    return t.pages.select("page_id", text.url_key(F.col("url")).alias("url_key"))


@query("f8_price_band", """SELECT CASE WHEN p < 2000000 THEN 'under_2m' WHEN p < 4000000 THEN '2m_to_under_4m' WHEN p < 6000000 THEN '4m_to_under_6m'
  ELSE '6m_and_above' END AS band, count(*) AS rows FROM (SELECT l_extendedprice * 100 AS p FROM lineitem) GROUP BY 1""")
def price_band(t):
    return t.lineitem.groupBy(numbers.price_band(F.col("l_extendedprice") * 100).alias("band")).agg(F.count(F.lit(1)).alias("rows"))


_VERDICT_SQL = """CASE WHEN lower({c}) IN ('nan', 'infinity') THEN 'Non-finite number'
  WHEN try_cast({c} AS double) IS NULL THEN 'Not a valid number'
  WHEN try_cast({c} AS double) <> floor(try_cast({c} AS double)) THEN 'Expected a whole-number value'
  WHEN {low} THEN '{message}' {year} END"""


def verdict_sql(c: str, field: str) -> str:
    low = f"try_cast({c} AS double) {'<' if field == 'mileage_km' else '<='} 0"
    message = "Mileage cannot be negative" if field == "mileage_km" else "Value must be positive"
    year = f"WHEN try_cast({c} AS double) NOT BETWEEN 1900 AND 2100 THEN 'Year is outside the audit sanity range; review source'"
    return _VERDICT_SQL.format(c=c, low=low, message=message, year=year if field == "year" else "")


@query("f9_numeric_verdict", f"WITH {RAW} SELECT listing_id, source_batch, " + ", ".join(
    f"CASE WHEN {n} <> '' THEN {verdict_sql(n, n)} END AS {n}_verdict" for n in ("year", "price_pkr", "mileage_km", "engine_cc")
) + " FROM raw")
def numeric_verdict(t):
    rows = raw_export(t, "concat('batch_', l_suppkey % 3) AS source_batch")
    return rows.select("listing_id", "source_batch", *[
        F.when(F.col(n) != "", numbers.numeric_verdict(F.col(n), n)).alias(f"{n}_verdict")
        for n in ("year", "price_pkr", "mileage_km", "engine_cc")
    ])


@query("f10_presence", """SELECT kind, count(*) FILTER (WHERE v IS NOT NULL AND lower(trim(v)) NOT IN ('', 'nan', '<na>')) AS present, count(*) AS rows
  FROM (SELECT event_type AS kind, CASE event_id % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN NULL WHEN 2 THEN '<NA>' WHEN 3 THEN ' ' ELSE props END AS v FROM events) GROUP BY kind""")
def presence(t):
    value = F.expr("CASE event_id % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN NULL WHEN 2 THEN '<NA>' WHEN 3 THEN ' ' ELSE props END")
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(
        F.count_if(text.is_present(value)).alias("present"), F.count(F.lit(1)).alias("rows")
    )


_REASONS = "concat_ws(';', CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'late' ELSE '' END, o_orderstatus)"


@query("f11_reason_sets", f"""SELECT o_orderkey,
  array_to_string(list_sort(list_distinct(list_filter(list_append(string_split(r, ';'), 'late'), lambda x: x <> ''))), ';') AS added,
  array_to_string(list_sort(list_distinct(list_filter(string_split(r, ';'), lambda x: x <> '' AND x <> 'late'))), ';') AS removed
  FROM (SELECT o_orderkey, {_REASONS} AS r FROM orders)""")
def reason_sets(t):
    source = F.expr(_REASONS)
    return t.orders.select("o_orderkey", reasons.add(source, "late").alias("added"), reasons.remove(source, "late").alias("removed"))


_PRINTED = {
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "lineitem": (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", "l_shipdate",
    ),
}


@query("s6_table_fingerprint", " UNION ALL ".join(
    f"SELECT '{name}' AS name, '{','.join(columns)}' AS columns, rows, fingerprint FROM ({c.fingerprint_sql(columns, name)})" for name, columns in _PRINTED.items()))
def table_fingerprints(t):
    parts = [
        digests.table_fingerprint(getattr(t, name), columns).select(F.lit(name).alias("name"), "columns", "rows", "fingerprint")
        for name, columns in _PRINTED.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
