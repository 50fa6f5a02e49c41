"""Text normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that mean "no value", compared in lower case.
NULL_TOKENS = ("", "n/a", "na", "unknown", "none", "null", "-", "not available")
# Categories kept in upper case.
UPPER_CATEGORIES = ("CNG", "LPG", "PHEV", "CVT", "SUV")
# Text written for an absent number by table exports.
ABSENT_TOKENS = ("", "nan", "<na>")

# Every character a Unicode-aware "\s" matches, as a pattern and one by one.
WHITESPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
_SPACES = "".join(chr(code) for code in (
    *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
))


def squash(c: Column) -> Column:
    """Collapse runs of white space to one blank and trim.

    Only a text with two blanks in a row, which is rare, pays for a regular expression.
    """
    blanks = F.translate(c, _SPACES, " " * len(_SPACES))
    return F.trim(F.when(F.contains(blanks, F.lit("  ")), F.regexp_replace(blanks, " {2,}", " ")).otherwise(blanks))


def label(c: Column) -> Column:
    """A squashed label, or null where it is one of the null tokens."""
    text = squash(c)
    return F.when(~F.lower(text).isin(*NULL_TOKENS), text)


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, wherever it starts."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    capitalised = F.transform(
        runs, lambda run: F.concat(F.upper(F.left(run, F.lit(1))), F.lower(F.substr(run, F.lit(2))))
    )
    # initcap starts words at blanks only; other boundaries need the letter runs.
    return F.when(c.rlike(r"[^\p{L} ]\p{L}"), F.array_join(capitalised, "")).otherwise(F.initcap(c))


def category(c: Column) -> Column:
    """Display casing of a category: known acronyms upper, everything else title case."""
    upper = F.upper(c)
    return F.when(upper.isin(*UPPER_CATEGORIES), upper).otherwise(title_case(c))


def city_from_slug(c: Column) -> Column:
    return title_case(F.replace(c, F.lit("-"), F.lit(" ")))


def is_present(c: Column) -> Column:
    """False for null, blank and exported not-a-number text."""
    return F.coalesce(~F.lower(squash(c.cast("string"))).isin(*ABSENT_TOKENS), F.lit(False))


def url_key(c: Column) -> Column:
    """Host and path of a URL without the trailing slash; query and fragment are ignored."""
    host = F.lower(F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit("")))
    path = F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
    return F.concat(host, F.regexp_replace(path, "/+$", ""))


def url_path(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), "/+$", "")


def family_name(make: Column, model: Column) -> Column:
    return F.concat_ws(" ", make, model)
