"""Whole numbers, prices and numeric verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = "decimal(38,18)"

# First letters of a price unit and what one unit is worth.
PRICE_UNITS = (("lac", 100_000), ("lakh", 100_000), ("cr", 10_000_000), ("million", 1_000_000), ("mn", 1_000_000))
# A displayed price with an optional unit word.
PRICE_PATTERN = (
    r"\bPKR\s*([\d,]+(?:\.\d+)?)\s*(crores?|cr|lakhs?|lacs?|millions?|mn)?\b"
)
PRICE_BOX_PATTERN = r"PKR\s*([\d,]+(?:\.\d+)?)\s*(lacs?|lakhs?|crores?|cr|millions?|mn)?"
# Upper bounds and names of the reporting price bands.
PRICE_BANDS = (
    (2_000_000, "under_2m"), (4_000_000, "2m_to_under_4m"), (6_000_000, "4m_to_under_6m"),
)
TOP_PRICE_BAND = "6m_and_above"
# Wording of the numeric verdicts.
NOT_A_NUMBER = "Not a valid number"
NOT_FINITE = "Non-finite number"
NOT_WHOLE = "Expected a whole-number value"
NEGATIVE = "Mileage cannot be negative"
NOT_POSITIVE = "Value must be positive"
YEAR_RANGE = "Year is outside the audit sanity range; review source"


def whole_number(c: Column) -> Column:
    """The bigint a text stands for, or null unless it is finite and whole."""
    text = F.trim(F.replace(c.cast("string"), F.lit(","), F.lit("")))
    exact = text.try_cast(_EXACT)
    # Plain digits need no decimal arithmetic.
    return F.coalesce(text.try_cast("bigint"), F.when(exact == F.floor(exact), exact.try_cast("bigint")))


def first_number(c: Column) -> Column:
    """The first number inside a text, if it is whole."""
    return whole_number(F.nullif(F.regexp_extract(c.cast("string"), r"\d[\d,]*(?:\.\d+)?", 0), F.lit("")))


def price_value(amount: Column, unit: Column) -> Column:
    """Amount text times its unit, rounded half to even."""
    word = F.lower(F.coalesce(unit, F.lit("")))
    worth = F.lit(1)
    for prefix, factor in reversed(PRICE_UNITS):
        worth = F.when(F.startswith(word, F.lit(prefix)), F.lit(factor)).otherwise(worth)
    number = F.replace(amount, F.lit(","), F.lit("")).try_cast("decimal(28,8)")
    return F.bround(number * worth, 0).try_cast("bigint")


def exact_price_value(amount: Column, unit: Column) -> Column:
    """Like ``price_value`` but null where the product is not a whole number."""
    word = F.lower(F.coalesce(unit, F.lit("")))
    worth = F.lit(1)
    for prefix, factor in reversed(PRICE_UNITS):
        worth = F.when(F.startswith(word, F.lit(prefix)), F.lit(factor)).otherwise(worth)
    product = F.replace(amount, F.lit(","), F.lit("")).try_cast("decimal(28,8)") * worth
    return F.when(product == F.floor(product), product.try_cast("bigint"))


def displayed_price(text: Column, pattern: str = PRICE_PATTERN) -> Column:
    """Price stated by the first match of a price pattern, or null."""
    insensitive = f"(?i){pattern}"
    amount = F.regexp_extract(text, insensitive, 1)
    return F.when(text.rlike(insensitive), price_value(amount, F.regexp_extract(text, insensitive, 2)))


def price_band(c: Column, bands: Sequence[tuple[float, str]] = PRICE_BANDS, top: str = TOP_PRICE_BAND) -> Column:
    """Half-open band of a price; bands are given by rising upper bounds."""
    band = F.lit(top)
    for bound, name in reversed(bands):
        band = F.when(c < F.lit(bound), F.lit(name)).otherwise(band)
    return band


def numeric_verdict(c: Column, field: str) -> Column:
    """The first integrity rule a number text breaks, or null."""
    text = F.trim(c)
    exact, approximate = text.try_cast(_EXACT), text.try_cast("double")
    number = F.coalesce(exact.cast("double"), approximate)
    whole = F.coalesce(exact == F.floor(exact), approximate == F.floor(approximate))
    rule = (
        F.when(text.rlike(r"(?i)^[+-]?(inf(inity)?|s?nan\d*)$"), F.lit(NOT_FINITE))
        .when(~text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit(NOT_A_NUMBER))
        .when(~whole, F.lit(NOT_WHOLE))
    )
    rule = rule.when(number < 0, F.lit(NEGATIVE)) if field == "mileage_km" else rule.when(number <= 0, F.lit(NOT_POSITIVE))
    if field == "year":
        rule = rule.when(~number.between(1900, 2100), F.lit(YEAR_RANGE))
    return rule
