"""Normalise rows, collect notes and exclusion reasons, and mark candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import SPEC_FIELDS
from ..functions import reasons
from ..functions.numbers import whole_number
from ..functions.text import category, label
from .consolidate import link_key
from .identity import UNRESOLVED_VARIANT, resolve_identity

# Label fields beside make, model and variant, numbers, and the wording of notes
# and reasons.
LABEL_FIELDS = ("fuel", "transmission", "assembly", "body_type", "listing_city")
CASED_FIELDS = ("fuel", "transmission", "assembly", "body_type")
NUMBER_FIELDS = ("year", "price_pkr", "mileage_km", "engine_cc", "registration_year")
REQUIRED_NUMBERS = (("price_pkr", True), ("mileage_km", False), ("year", True))
OUTSIDE_FAMILIES = "outside_candidate_families"
OUTSIDE_YEARS = "outside_candidate_year_range"
SOURCE_DISAGREEMENT = "unresolved_source_disagreement"
NO_VARIANT = "variant_unspecified_not_base_trim"
BAD_ENGINE = "invalid_engine_displacement"
MEANING_UNKNOWN = "registration_meaning_unknown"
REGISTERED_EARLY = "registration_precedes_model_year"
PRICE_UNVERIFIED = "asking_price_not_verified_against_cached_main_price_box"
REPOST = "identical_specifications_possible_repost_not_proven"


def prepare_rows(
    rows: DataFrame, families: DataFrame, variants: DataFrame, allowed: DataFrame, years: tuple[int, int],
    evidence: DataFrame | None = None,
) -> DataFrame:
    """Normalised copy of each row with its notes, exclusions and candidate flags.

    ``allowed`` lists the (make, model) pairs in scope. ``evidence`` holds, per listing,
    ``updates`` (map of field to evidenced text), ``flags`` (array) and ``price_verified``.
    """
    source = rows.withColumns({
        name: F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
        for name in rows.columns if name not in ("listing_id", "source_batch")
    }).withColumns({name: label(F.col(name)) for name in LABEL_FIELDS})
    if evidence is None:
        none = F.lit(None)
        joined = source.withColumns({
            "__updates": none.cast("map<string,string>"), "__flags": none.cast("array<string>"),
            "__verified": none.cast("boolean"), "__seen": none.cast("boolean"),
        })
    else:
        reviews = evidence.select(
            "listing_id", F.col("updates").alias("__updates"), F.col("flags").alias("__flags"),
            F.col("price_verified").alias("__verified"), F.lit(True).alias("__seen"),
        )
        joined = source.join(reviews, "listing_id", "left")
    updated = joined.withColumns({
        name: F.coalesce(F.try_element_at("__updates", F.lit(name)), F.col(name)) for name in ("price_pkr", "fuel")
    })
    resolved = resolve_identity(updated, families, variants)
    scope = allowed.select("make", "model", F.lit(True).alias("__allowed")).distinct()
    scoped = resolved.join(scope, ["make", "model"], "left").withColumns({
        f"__{name}_text": F.col(name) for name in NUMBER_FIELDS
    }).withColumns({name: whole_number(F.col(name)) for name in NUMBER_FIELDS})

    invalid = lambda name: F.when(
        F.col(f"__{name}_text").isNotNull() & F.col(name).isNull(), F.lit(f"invalid_number:{name}")
    )
    missing = [
        F.when(F.coalesce(F.col(name) <= 0 if positive else F.col(name) < 0, F.lit(True)), F.lit(f"missing_or_invalid:{name}"))
        for name, positive in REQUIRED_NUMBERS
    ]
    flags = F.coalesce("__flags", F.array().cast("array<string>"))
    disagrees = F.exists(flags, lambda flag: F.startswith(flag, F.lit(f"{SOURCE_DISAGREEMENT}:")))
    exclusions = reasons.collect(
        invalid("year"), invalid("price_pkr"), invalid("mileage_km"), *missing,
        F.when(F.col("__allowed").isNull(), F.lit(OUTSIDE_FAMILIES)),
        F.when(~F.col("year").between(*years), F.lit(OUTSIDE_YEARS)),
        F.when(F.col("identity_status") == UNRESOLVED_VARIANT, F.lit(UNRESOLVED_VARIANT)),
        F.when(disagrees, F.lit(SOURCE_DISAGREEMENT)),
    )
    verified = F.coalesce("__verified", F.lit(False))
    notes = F.concat(
        reasons.collect(
            invalid("engine_cc"), invalid("registration_year"),
            F.when(F.col("variant").isNull(), F.lit(NO_VARIANT)),
            F.when(F.col("engine_cc") <= 0, F.lit(BAD_ENGINE)),
            F.when(F.col("registration_year").isNotNull() & (F.col("registration_year_meaning") == "unknown"), F.lit(MEANING_UNKNOWN)),
            F.when((F.col("year") != 0) & (F.col("registration_year") < F.col("year")), F.lit(REGISTERED_EARLY)),
        ),
        flags,
        reasons.collect(F.when(~verified, F.lit(PRICE_UNVERIFIED))),
    )
    judged = scoped.withColumns({
        "quality_notes": F.array_join(notes, ";"),
        "exclusion_reasons": reasons.render(exclusions),
        "source_price_verified": verified,
        "evidence_available": F.coalesce("__seen", F.lit(False)),
        "source_updates": F.to_json(F.coalesce("__updates", F.create_map().cast("map<string,string>"))),
    })
    clean = F.col("exclusion_reasons") == ""
    finished = judged.withColumns({
        "modeling_candidate": clean,
        "source_checked_candidate": clean & F.col("source_price_verified"),
        "engine_cc": F.when(F.col("engine_cc") > 0, F.col("engine_cc")),
        **{name: category(F.col(name)) for name in CASED_FIELDS},
    })
    return finished.drop(*[name for name in finished.columns if name.startswith("__")])


def group_reposts(rows: DataFrame, *, id: str = "listing_id", fields: Sequence[str] = SPEC_FIELDS) -> DataFrame:
    """Give rows with identical full specifications one group; nothing is deleted.

    Sizes come from a combinable count joined back on the specification digest, so one very
    common specification is not gathered into one task.
    """
    keyed = rows.withColumn("__link", link_key(fields))
    shared = (
        keyed.where(F.col("__link").isNotNull()).groupBy("__link").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    )
    joined = keyed.join(shared, "__link", "left")
    repeated = F.col("__n").isNotNull()
    group = F.when(repeated, F.concat(F.lit("suspected_"), "__link")).otherwise(
        F.concat(F.lit("listing_"), F.col(id).cast("string"))
    )
    noted: dict[str, Column] = {"group_id": group}
    if "quality_notes" in rows.columns:
        extended = F.concat_ws(";", F.col("quality_notes"), F.lit(REPOST))
        noted["quality_notes"] = F.when(repeated, extended).otherwise(F.col("quality_notes"))
    return joined.withColumns(noted).drop("__link", "__n")


def ineligible_rows(rows: DataFrame, *, id: str = "listing_id") -> DataFrame:
    """Rows of an evaluation population that are not checked candidates; must be empty."""
    bad = ~F.coalesce(F.col("modeling_candidate"), F.lit(False)) | ~F.coalesce(F.col("source_checked_candidate"), F.lit(False)) | (
        F.coalesce(F.col("exclusion_reasons"), F.lit("")) != ""
    )
    return rows.where(bad).select(id, "modeling_candidate", "source_checked_candidate", "exclusion_reasons")
