"""Model inputs and targets: typed, ordered, and refused by row with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import FEATURE_SETS, MISSING_CATEGORY, adopted_features, require_columns, selected_features
from ..functions.numbers import whole_number
from ..functions.text import category, label, title_case
from .identity import UNRESOLVED_VARIANT, resolve_identity

__all__ = ["adopted_features", "prepare_inputs", "with_target", "select_features"]

# Why a row cannot be a model input.
OUTSIDE_SCOPE = "Family is outside the candidate scope"
VARIANT_UNRESOLVED = "Variant is not resolved by the catalogue"
YEAR_OUTSIDE = "Model year is outside the candidate scope"
CITY_REQUIRED = "listing_city is required"


def _not_integer(field: str, least: int) -> str:
    return f"{field} must be an integer >= {least}"


def prepare_inputs(
    rows: DataFrame, feature_set: str, families: DataFrame, variants: DataFrame, allowed: DataFrame, years: tuple[int, int],
) -> DataFrame:
    """The feature set's columns of every row, or a ``refusal`` and nulls.

    Nothing is learned from the data and the price is never read, so the same job prepares
    training rows and rows to score.
    """
    columns = FEATURE_SETS[feature_set]
    optional = [name for name in columns if name in ("fuel", "transmission", "assembly", "body_type")]
    resolved = resolve_identity(rows, families, variants)
    scope = allowed.select("make", "model", F.lit(True).alias("__allowed")).distinct()
    typed = resolved.join(scope, ["make", "model"], "left").withColumns({
        "__year": whole_number(F.col("year")), "__mileage": whole_number(F.col("mileage_km")),
        "__city": label(F.col("listing_city")),
        **({"__engine_text": label(F.col("engine_cc").cast("string"))} if "engine_cc" in columns else {}),
    })
    below = lambda column, least: F.coalesce(column < least, F.lit(True))
    refusal = (
        F.when(F.col("__allowed").isNull(), F.lit(OUTSIDE_SCOPE))
        .when(F.col("identity_status") == UNRESOLVED_VARIANT, F.lit(VARIANT_UNRESOLVED))
        .when(below(F.col("__year"), 1), F.lit(_not_integer("year", 1)))
        .when(~F.col("__year").between(*years), F.lit(YEAR_OUTSIDE))
        .when(F.col("__city").isNull(), F.lit(CITY_REQUIRED))
        .when(below(F.col("__mileage"), 0), F.lit(_not_integer("mileage_km", 0)))
    )
    values = {
        "make": F.col("make"), "model": F.col("model"), "year": F.col("__year"), "mileage_km": F.col("__mileage"),
        "listing_city": title_case(F.col("__city")), "variant": F.coalesce("variant", F.lit(MISSING_CATEGORY)),
    }
    if "engine_cc" in columns:
        engine = whole_number(F.col("__engine_text"))
        refusal = refusal.when(F.col("__engine_text").isNotNull() & below(engine, 1), F.lit(_not_integer("engine_cc", 1)))
        values["engine_cc"] = engine
    for name in optional:
        values[name] = F.coalesce(category(label(F.col(name))), F.lit(MISSING_CATEGORY))
    judged = typed.withColumn("refusal", refusal)
    usable = F.col("refusal").isNull()
    kept = [name for name in rows.columns if name not in columns]
    return judged.select(*kept, "refusal", *[F.when(usable, values[name]).alias(name) for name in columns])


def with_target(rows: DataFrame, column: str = "price_pkr") -> DataFrame:
    """Add ``target``: a positive whole number, or null where the row cannot train."""
    number = whole_number(F.col(column))
    return rows.withColumn("target", F.when(number >= 1, number))


def select_features(
    rows: DataFrame, feature_set: str, columns: Sequence[str] | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Contract columns only, in contract order."""
    chosen = selected_features(feature_set, columns)
    require_columns(rows, [*keep, *chosen], "model inputs")
    return rows.select(*keep, *chosen)
