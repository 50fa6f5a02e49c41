from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from listingspark.contracts import RAW_COLUMNS, require_columns
from listingspark.operators import audit, identity, prepare, reviews

FIELDS = (
    "listing_id", "car_title", "make", "model", "variant", "year", "price_pkr", "mileage_km", "engine_cc", "fuel", "transmission", "listing_city",
    "assembly", "body_type", "registration_year", "registration_year_meaning", "parse_status", "source_url",
)
BASE = dict(
    listing_id="1", car_title="Skoda Fabia 2016", make="Skoda", model="Fabia", variant="Ambition", year="2016.0", price_pkr="740000", mileage_km="0",
    engine_cc="1198.0", fuel="Lpg", transmission="Automatic", listing_city="Gotham", assembly="Imported", body_type="N/A", registration_year="2015",
    registration_year_meaning="unknown", parse_status="complete", source_url="page-1",
)


def table(spark, *rows):
    return spark.createDataFrame([tuple({**BASE, **row}[f] for f in FIELDS) for row in rows], ", ".join(f"{f} string" for f in FIELDS))


def catalogue(spark):
    return (
        spark.createDataFrame([("Skoda", "Fabia")], "make string, model string"),
        spark.createDataFrame([("Skoda", "Fabia", "Ambition"), ("Skoda", "Fabia", "Style")], "make string, model string, variant string"),
    )


def prepared(spark, *rows, evidence=None):
    families, variants = catalogue(spark)
    result = prepare.prepare_rows(table(spark, *rows), families, variants, families, (2010, 2026), evidence)
    return {r["listing_id"]: r for r in result.collect()}


def test_normalises_without_inventing_values(spark):
    rows = prepared(spark, {"make": "SKODA", "variant": "aMBITION"}, {"listing_id": "2", "variant": ""}, {"listing_id": "3", "variant": "Mystery"})
    first = rows["1"]
    assert (first["make"], first["variant"], first["fuel"], first["body_type"], first["mileage_km"]) == ("Skoda", "Ambition", "LPG", None, 0)
    assert first["modeling_candidate"] and not first["source_checked_candidate"]
    assert prepare.MEANING_UNKNOWN in first["quality_notes"] and prepare.REGISTERED_EARLY in first["quality_notes"]
    assert rows["2"]["variant"] is None and rows["2"]["identity_status"] == identity.UNSPECIFIED and rows["2"]["modeling_candidate"]
    assert rows["3"]["variant"] == "Mystery" and rows["3"]["exclusion_reasons"] == "unresolved_variant"


def test_exclusions_are_collected_and_sorted(spark):
    rows = prepared(spark, {"year": "2005"}, {"listing_id": "2", "price_pkr": "12.5"}, {"listing_id": "3", "model": "Octavia", "mileage_km": "-1"})
    assert rows["1"]["exclusion_reasons"] == "outside_candidate_year_range"
    assert rows["2"]["exclusion_reasons"] == "invalid_number:price_pkr;missing_or_invalid:price_pkr"
    assert rows["3"]["exclusion_reasons"] == "missing_or_invalid:mileage_km;outside_candidate_families"
    assert rows["3"]["identity_status"] == identity.OUTSIDE


def test_evidence_updates_and_disagreements(spark):
    evidence = spark.createDataFrame([
        ("1", {"price_pkr": "910000"}, [], True), ("2", {}, ["unresolved_source_disagreement:year"], True),
    ], "listing_id string, updates map<string,string>, flags array<string>, price_verified boolean")
    rows = prepared(spark, {"price_pkr": "190000"}, {"listing_id": "2"}, evidence=evidence)
    assert rows["1"]["price_pkr"] == 910_000 and rows["1"]["source_checked_candidate"]
    assert rows["2"]["exclusion_reasons"] == "unresolved_source_disagreement" and not rows["2"]["modeling_candidate"]


def test_reposts_share_a_group_whatever_their_price(spark):
    families, variants = catalogue(spark)
    rows = prepare.prepare_rows(table(spark, {}, {"listing_id": "2", "price_pkr": "5"}, {"listing_id": "3", "mileage_km": "7"}, {"listing_id": "4", "engine_cc": ""}, {"listing_id": "5", "engine_cc": ""}),
                                families, variants, families, (2010, 2026))
    grouped = {r["listing_id"]: r for r in prepare.group_reposts(rows).collect()}
    assert grouped["1"]["group_id"] == grouped["2"]["group_id"] and grouped["1"]["group_id"].startswith("suspected_")
    assert prepare.REPOST in grouped["2"]["quality_notes"] and grouped["3"]["group_id"] == "listing_3"
    assert grouped["4"]["group_id"] != grouped["5"]["group_id"] and len(grouped) == 5


def test_title_matching(spark):
    patterns = (
        ("Aero", "S 10", r"\bs\s*10\b"), ("Aero", "S 12F", r"\bs\s*12\s*f\b"), ("Bolt", "Z 9", r"\bz\s*9\b"), ("Crest", "XR 3", r"\bxr\s*3(?=\b|t\b)"),
    )
    cases = {
        "Aero S10 2019": ("Aero", "S 10", None, "matched"), "Aero S12 F 2011": ("Aero", "S 12F", None, "matched"),
        "Krest XR 3 2014": ("Crest", "XR 3", None, "matched"), "Crest XR3T 2014": ("Crest", "XR 3", "T", "matched_variant_review"),
        "Bolt Z9 LX 2020": ("Bolt", "Z 9", "LX", "matched_variant_review"), "XR 3 2014": (None, None, None, "unmatched"),
        "Aero S10 or S12F 2019": (None, None, None, "ambiguous"),
    }
    rows = spark.createDataFrame([(title,) for title in cases], "title string")
    found = identity.match_titles(rows, patterns, aliases=[("krest", "Crest")]).collect()
    assert {r["title"]: (r["make"], r["model"], r["variant_raw"], r["normalization_status"]) for r in found} == cases


def test_audit_flags_and_header_contract(spark):
    names = list(RAW_COLUMNS)
    good = dict(listing_id="1", car_title="t", year="2018", price_pkr="10", mileage_km="0", fuel="", transmission="", engine_cc="", listing_city="",
                source_url="u1", collected_at="now", parse_status="complete", missing_fields="")
    rows = [good, {**good, "year": "NaN"}, {**good, "listing_id": "2", "source_url": "u2", "price_pkr": "", "missing_fields": "price_pkr"},
            {**good, "listing_id": "", "source_url": "", "parse_status": "odd", "mileage_km": "-1", "engine_cc": "1.5"}]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))
    issues = {(r["listing_id"], r["field"], r["reason"]) for r in audit.integrity_issues(df).collect()}
    assert issues == {
        ("1", "year", "Non-finite number"), ("2", "price_pkr", audit.CORE_MISSING), ("2", "missing_fields", audit.DECLARED_MISSING),
        ("", "listing_id", audit.NO_PROVENANCE), ("", "source_url", audit.NO_PROVENANCE), ("", "parse_status", audit.UNKNOWN_STATUS),
        ("", "mileage_km", "Mileage cannot be negative"), ("", "engine_cc", "Expected a whole-number value"),
    }
    assert {(r["field"], r["value"], r["count"]) for r in audit.duplicate_values(df).collect()} == {("listing_id", "1", 2), ("source_url", "u1", 2)}
    clean = audit.complete_rows(df)
    assert audit.multiset_difference(audit.complete_rows(df), clean.repartition(3)).isEmpty()
    assert audit.multiset_difference(clean, clean.unionByName(clean.limit(1))).first()["side"] == "right"
    with pytest.raises(ValueError, match="missing columns: fuel"):
        audit.integrity_issues(df.drop("fuel"))
    with pytest.raises(ValueError, match="duplicate"):
        require_columns(df.select("*", F.lit(1).alias("year")), ["year"])


def test_reviews_propagate_correct_and_accept(spark):
    rows = spark.createDataFrame([
        ("1", "g1", "b", 10, 100, "", True, True), ("2", "g1", "b", 10, 100, "", True, True), ("3", "g3", "b", 50, 100, "", True, True),
        ("4", "g4", "b", 1, 500, "unresolved_source_disagreement", False, False), ("5", "g5", "b", 1, 500, "unresolved_source_disagreement;x", False, False),
    ], "listing_id string, group_id string, source_batch string, mileage_km bigint, price_pkr bigint, exclusion_reasons string, modeling_candidate boolean, source_checked_candidate boolean")
    decisions = spark.createDataFrame([
        ("1", "exclude", "r", None, None, None, None), ("3", "keep", "r", 50, 5000, None, None), ("4", "keep", "r", None, None, 500, 501), ("5", "keep", "r", None, None, 500, 501),
    ], "listing_id string, decision string, reason string, mileage_from bigint, mileage_to bigint, displayed_pkr bigint, structured_pkr bigint")
    evidence = spark.createDataFrame([("4", "b", 500, 501, False), ("5", "b", 500, 501, False)],
                                     "listing_id string, source_batch string, price_box_value bigint, structured_price bigint, other_disagreement boolean")
    once = reviews.apply_reviews(rows, decisions, evidence)
    found = {r["listing_id"]: r for r in once.collect()}
    assert found["1"]["exclusion_reasons"] == reviews.EXCLUDED and found["2"]["exclusion_reasons"] == reviews.LINKED
    assert not found["2"]["modeling_candidate"] and found["3"]["mileage_km"] == 5000
    assert found["4"]["manual_price_accepted"] and found["4"]["source_checked_candidate"]
    assert found["5"]["exclusion_reasons"] == "x" and not found["5"]["modeling_candidate"]
    again = reviews.apply_reviews(once.select(*rows.columns), decisions, evidence)
    assert {r["listing_id"]: (r["mileage_km"], r["exclusion_reasons"]) for r in again.collect()} == {
        k: (r["mileage_km"], r["exclusion_reasons"]) for k, r in found.items()}
    changed = reviews.apply_reviews(rows, decisions, evidence.withColumn("price_box_value", F.lit(7).cast("bigint"))).where("review_problem IS NOT NULL")
    assert {r["listing_id"] for r in changed.collect()} == {"4", "5"}
    stale = reviews.stale_rows(rows.withColumn("manual_price_accepted", F.col("listing_id") == "2"), decisions)
    assert {tuple(r) for r in stale.collect()} == {("1", "excluded_listing_present"), ("2", "unapproved_price_acceptance"), ("3", "missing_correction")}
    assert reviews.decision_violations(decisions).isEmpty()
    bad = decisions.unionByName(decisions.limit(1)).withColumn("mileage_from", F.lit(-1).cast("bigint"))
    assert {"repeated decision", "invalid correction"} <= {r["violation"] for r in reviews.decision_violations(bad).collect()}
