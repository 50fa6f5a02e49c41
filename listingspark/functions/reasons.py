"""Sets of reasons kept as ``;``-joined text at the edges and arrays inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(c: Column) -> Column:
    """Reasons in a joined text, without empties and repeats."""
    parts = F.split(F.coalesce(c, F.lit("")), ";")
    return F.array_distinct(F.filter(parts, lambda part: part != ""))


def render(c: Column) -> Column:
    """Sorted, de-duplicated joined text; the empty set is the empty text."""
    return F.array_join(F.array_sort(F.array_distinct(c)), ";")


def add(c: Column, *reasons: Column | str) -> Column:
    """Joined text with more reasons; null reasons add nothing."""
    extra = F.array(*[F.lit(reason) if isinstance(reason, str) else reason for reason in reasons])
    return render(F.array_union(parse(c), F.array_compact(extra)))


def remove(c: Column, *reasons: str) -> Column:
    return render(F.array_except(parse(c), F.array(*[F.lit(reason) for reason in reasons])))


def collect(*reasons: Column) -> Column:
    """Array of the reasons that hold, in the order given."""
    return F.array_compact(F.array(*reasons))
