"""Apply human decisions to rows, and refuse populations that predate them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reasons
from .prepare import SOURCE_DISAGREEMENT

# Reasons added by review.
EXCLUDED = "manual_review_excluded"
LINKED = "group_linked_to_manual_review_exclusion"

# Decisions: listing_id, decision (exclude | keep), mileage_from, mileage_to,
# displayed_pkr, structured_pkr; the four numbers are null where not stated.
_NUMBERS = ("mileage_from", "mileage_to", "displayed_pkr", "structured_pkr")


def decision_violations(decisions: DataFrame, id_pattern: str = r"^[0-9]+$") -> DataFrame:
    """Malformed or repeated decisions as (listing_id, violation)."""
    keep = F.col("decision") == "keep"
    corrected = F.col("mileage_from").isNotNull() | F.col("mileage_to").isNotNull()
    accepted = F.col("displayed_pkr").isNotNull() | F.col("structured_pkr").isNotNull()
    number = lambda name, least: F.coalesce(F.col(name) >= least, F.lit(False))
    found = reasons.collect(
        F.when(~F.coalesce(F.col("listing_id").rlike(id_pattern), F.lit(False)), F.lit("listing_id is not numeric")),
        F.when(~F.coalesce(F.col("decision").isin("exclude", "keep"), F.lit(False)), F.lit("unknown decision")),
        F.when(F.coalesce(F.col("reason"), F.lit("")) == "", F.lit("no reason given")),
        F.when(corrected & ~(keep & number("mileage_from", 0) & number("mileage_to", 0)), F.lit("invalid correction")),
        F.when(accepted & ~(keep & number("displayed_pkr", 1) & number("structured_pkr", 1)), F.lit("invalid accepted price")),
    )
    malformed = decisions.select("listing_id", F.explode(found).alias("violation"))
    repeated = decisions.groupBy("listing_id").count().where("count > 1").select(
        "listing_id", F.lit("repeated decision").alias("violation")
    )
    return malformed.unionByName(repeated)


def apply_reviews(rows: DataFrame, decisions: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Every row with its review outcome; exclusions spread to the whole split group.

    ``evidence`` holds (listing_id, source_batch, price_box_value, structured_price,
    other_disagreement). A correction or accepted price that no longer fits the row is
    reported in ``review_problem`` and changes nothing.
    """
    chosen = decisions.select(
        "listing_id", F.col("decision").alias("__decision"), *[F.col(name).alias(f"__{name}") for name in _NUMBERS]
    )
    joined = rows.join(chosen, "listing_id", "left")
    if evidence is not None:
        joined = joined.join(
            evidence.select(
                "listing_id", "source_batch", F.col("price_box_value").alias("__box"),
                F.col("structured_price").alias("__structured"), F.col("other_disagreement").alias("__other"),
            ), ["listing_id", "source_batch"], "left",
        )
    else:
        joined = joined.withColumns({
            "__box": F.lit(None).cast("bigint"), "__structured": F.lit(None).cast("bigint"), "__other": F.lit(None).cast("boolean"),
        })
    excluded_groups = (
        rows.join(decisions.where(F.col("decision") == "exclude"), "listing_id", "left_semi")
        .select("group_id", F.lit(True).alias("__linked")).distinct()
    )
    joined = joined.join(excluded_groups, "group_id", "left")

    keep = F.coalesce(F.col("__decision") == "keep", F.lit(False))
    corrects = keep & F.col("__mileage_to").isNotNull()
    fits = F.coalesce(
        (F.col("mileage_km") == F.col("__mileage_from")) | (F.col("mileage_km") == F.col("__mileage_to")), F.lit(False)
    )
    accepts = keep & F.col("__displayed_pkr").isNotNull()
    exact = F.coalesce(
        (F.col("__box") == F.col("__displayed_pkr")) & (F.col("__structured") == F.col("__structured_pkr"))
        & (F.col("price_pkr") == F.col("__displayed_pkr")) & ~F.coalesce("__other", F.lit(False)), F.lit(False),
    )
    problem = F.when(corrects & ~fits, F.lit("correction_no_longer_matches")).when(
        accepts & ~exact, F.lit("accepted_price_no_longer_matches")
    )
    accepted = accepts & exact & (~corrects | fits)
    linked = F.coalesce("__linked", F.lit(False))
    spread = F.when(F.coalesce(F.col("__decision") == "exclude", F.lit(False)), F.lit(EXCLUDED)).otherwise(F.lit(LINKED))
    remaining = F.when(accepted, reasons.remove(F.col("exclusion_reasons"), SOURCE_DISAGREEMENT)).otherwise(
        F.col("exclusion_reasons")
    )
    updates = F.when(corrects & fits, F.to_json(F.struct(F.struct(
        F.col("__mileage_from").alias("from"), F.col("__mileage_to").alias("to")
    ).alias("mileage_km")))).otherwise(F.lit("{}"))
    judged = joined.withColumns({
        "manual_review_decision": F.coalesce("__decision", F.lit("")),
        "manual_updates": updates,
        "manual_price_accepted": accepted,
        "review_problem": problem,
        "exclusion_reasons": F.when(linked, reasons.add(remaining, spread)).otherwise(remaining),
        "mileage_km": F.when(corrects & fits, F.col("__mileage_to")).otherwise(F.col("mileage_km")),
    })
    clean = F.col("exclusion_reasons") == ""
    flagged = judged.withColumns({
        name: F.when(linked, F.lit(False)).when(accepted, clean).otherwise(F.col(name))
        for name in ("modeling_candidate", "source_checked_candidate")
    })
    return flagged.drop(*[name for name in flagged.columns if name.startswith("__")])


def stale_rows(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows that contradict the decisions, as (listing_id, violation); must be empty.

    Finds excluded ids, accepted prices without an approval, and uncorrected values.
    """
    joined = rows.join(decisions.select("listing_id", "decision", *_NUMBERS), "listing_id", "left")
    accepted = F.coalesce(F.col("manual_price_accepted"), F.lit(False))
    found = reasons.collect(
        F.when(F.col("decision") == "exclude", F.lit("excluded_listing_present")),
        F.when(accepted & ~F.coalesce(F.col("price_pkr") == F.col("displayed_pkr"), F.lit(False)), F.lit("unapproved_price_acceptance")),
        F.when(F.col("mileage_to").isNotNull() & ~F.coalesce(F.col("mileage_km") == F.col("mileage_to"), F.lit(False)), F.lit("missing_correction")),
    )
    return joined.select("listing_id", F.explode(found).alias("violation"))
