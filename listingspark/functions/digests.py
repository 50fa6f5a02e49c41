"""SHA-256 keys and order-insensitive table fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256_text(*parts: Column | str | int, sep: str = ":") -> Column:
    columns = [part if isinstance(part, Column) else F.lit(str(part)) for part in parts]
    return F.sha2(F.concat_ws(sep, *[column.cast("string") for column in columns]), 256)


def digest_mod_10(digest: Column) -> Column:
    """Remainder by ten of the whole hexadecimal digest.

    16 to any power ends in 6, so digits other than the last weigh 6 each.
    """
    digits = F.transform(
        F.regexp_extract_all(digest, F.lit("(.)"), F.lit(1)), lambda digit: F.conv(digit, 16, 10).cast("int")
    )
    total = F.aggregate(digits, F.lit(0), lambda left, right: left + right)
    last = F.element_at(digits, -1)
    return F.pmod((total - last) * 6 + last, F.lit(10))


def hash_slot(digest: Column, slots: int) -> Column:
    """A slot below ``slots`` from the first seven digits of a digest."""
    return F.pmod(F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def row_digest(columns: Sequence[str]) -> Column:
    """MD5 of one row. Values are written with their length, so that no two different rows read
    alike, and a null differs from every text."""
    text = [F.col(name).cast("string") for name in columns]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")) for value in text]))


def fingerprint_of(digest: Column, among: Column | None = None) -> Column:
    """An aggregate of row digests that ignores row order: four sums that cover all their 128 bits.

    With ``among`` only rows for which it holds count.
    """
    quarter = [F.conv(F.substring(digest, place, 8), 16, 10).cast("decimal(20,0)") for place in (1, 9, 17, 25)]
    chosen = quarter if among is None else [F.when(among, part) for part in quarter]
    return F.concat_ws("-", *[F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)").cast("string") for part in chosen])


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: column list, row count and order-free fingerprint."""
    names = list(columns or df.columns)
    hashed = df.select(row_digest(names).alias("__digest"))
    return hashed.agg(
        F.lit(",".join(names)).alias("columns"), F.count(F.lit(1)).alias("rows"), fingerprint_of(F.col("__digest")).alias("fingerprint"),
    )
