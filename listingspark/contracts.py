"""Fixed column contracts of the listing data model, and the checks that enforce them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame

# Column names of a raw listing export.
RAW_COLUMNS = (
    "listing_id", "car_title", "year", "price_pkr", "mileage_km", "fuel", "transmission",
    "engine_cc", "listing_city", "source_url", "collected_at", "parse_status", "missing_fields",
)
CORE_FIELDS = ("car_title", "year", "price_pkr", "mileage_km")
NUMERIC_FIELDS = ("year", "price_pkr", "mileage_km", "engine_cc")

# The fields whose equality suggests a repeated advertisement.
SPEC_FIELDS = (
    "make", "model", "variant", "year", "mileage_km", "engine_cc",
    "fuel", "transmission", "listing_city", "assembly",
)

# Fields whose missing counts a coverage table reports.
COVERAGE_FIELDS = (
    "make", "model", "variant", "year", "price_pkr", "mileage_km", "fuel", "transmission",
    "engine_cc", "listing_city", "assembly", "body_type", "registration_year", "listing_date",
)

# Model input contracts, in order.
FEATURE_SETS = {
    "F0": ("make", "model", "year", "mileage_km", "listing_city"),
    "F1": ("make", "model", "year", "mileage_km", "listing_city", "variant"),
    "F2": (
        "make", "model", "year", "mileage_km", "listing_city", "variant",
        "fuel", "transmission", "engine_cc", "assembly", "body_type",
    ),
}
NUMERICAL_FEATURES = ("year", "mileage_km", "engine_cc")
ADOPTED_EXCLUSIONS = ("fuel", "body_type")
MISSING_CATEGORY = "__MISSING__"
MISSING_BUCKET = "<missing>"

TEST_PARTITION = "demo_test"
DEVELOPMENT = "development"


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "input") -> DataFrame:
    """Refuse a table that lacks a column or names one twice."""
    repeated = sorted(name for name, n in Counter(df.columns).items() if n > 1)
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing columns: {', '.join(missing)}")
    if repeated:
        raise ValueError(f"{what}: duplicate column names: {', '.join(repeated)}")
    return df


def selected_features(feature_set: str, columns: Sequence[str] | None = None) -> tuple[str, ...]:
    """An ordered subset of a feature contract."""
    contract = FEATURE_SETS[feature_set]
    if columns is None:
        return contract
    chosen = tuple(columns)
    if not chosen or isinstance(columns, str):
        raise ValueError("Feature columns must be a non-empty list")
    if chosen != tuple(name for name in contract if name in set(chosen)):
        raise ValueError("Feature columns must be unique, known and in contract order")
    return chosen


def adopted_features() -> tuple[str, ...]:
    """The nine inputs kept after the joint removal of two fields from F2."""
    return tuple(name for name in FEATURE_SETS["F2"] if name not in ADOPTED_EXCLUSIONS)


def feature_contract() -> list[tuple[str, int, str, str]]:
    """(feature set, position, column, kind) of every contract, adopted inputs included."""
    sets = {**FEATURE_SETS, "adopted": adopted_features()}
    return [
        (name, position, column, "numerical" if column in NUMERICAL_FEATURES else "categorical")
        for name, columns in sets.items()
        for position, column in enumerate(columns)
    ]
