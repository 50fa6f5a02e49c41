"""Order statistics that never gather one group into one task.

A plain ``row_number`` or ``percentile`` over a group pulls the whole group through a single
task. Here every group is cut into *cells* whose order is known from the row itself (the first
digits of a hash, or the leading bits of a number). Cell sizes are counted with map-side
combining, their running totals are taken over the short table of cells, and only then are
rows ordered, cell by cell. A middle cell that is still too large is cut again by its next bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import StageTables

# Leading hexadecimal digits of a digest that form a cell: 16**3 even cells per group.
DIGEST_CELL_DIGITS = 3
# Bits of an ordered number left out of its cell, round by round: first its sign, exponent and four
# more bits (steps of 6 per cent, so few cells that rows combine before they are shuffled, in many
# groups too), at last none, when a cell is a single number.
CELL_SHIFTS = (48, 36, 20, 0)
# Most rows of a middle cell that are put in order at once.
MIDDLE_ROWS = 1 << 20
# Parts of a crowded cell that are counted apart.
SALTS = 16

_CELL, _BEFORE, _TOTAL, _N = "__cell", "__before", "__total", "__n"
# The cell of the round before, and the rows before it and of its group.
_OUTER, _OUTER_BEFORE, _OUTER_TOTAL = "__outer_cell", "__outer_before", "__outer_total"


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which a null key equals a null key; keys come from the left."""
    renamed = right.withColumnsRenamed({name: f"__right_{name}" for name in keys})
    on = F.lit(True)
    for name in keys:
        on = on & F.col(name).eqNullSafe(F.col(f"__right_{name}"))
    return left.join(renamed, on, how).drop(*[f"__right_{name}" for name in keys])


def running_cells(cells: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add to each counted cell the rows before it and the rows of its whole group."""
    ahead = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return cells.withColumns({
        _BEFORE: F.coalesce(F.sum(_N).over(ahead), F.lit(0)),
        _TOTAL: F.sum(_N).over(W.partitionBy(*keys)),
    })


def rank_by_digest(
    df: DataFrame, keys: Sequence[str], digest: str, tie: str, *,
    lead: Sequence[str] = (), rank: str = "rank", size: str = "group_count",
) -> DataFrame:
    """Position of each row in its group by (lead descending, digest, tie), counted from 1.

    Null keys form groups like any other value. ``lead`` columns should take few values.
    """
    keyed = df.withColumn(_CELL, F.substring(digest, 1, DIGEST_CELL_DIGITS))
    cell_keys = [*keys, *lead, _CELL]
    counted = keyed.groupBy(*cell_keys).agg(F.count(F.lit(1)).alias(_N))
    cells = running_cells(counted, keys, [*[F.desc(name) for name in lead], F.asc(_CELL)]).drop(_N)
    within = W.partitionBy(*cell_keys).orderBy(digest, tie)
    ranked = join_null_safe(keyed, cells, cell_keys).withColumns({
        rank: F.col(_BEFORE) + F.row_number().over(within),
        size: F.col(_TOTAL),
    })
    return ranked.drop(_CELL, _BEFORE, _TOTAL)


def ordered_bits(value: Column) -> Column:
    """A double as a whole number of 64 bits in the same order; both zeros are 0, NaN is last.

    The digits are those of the binary format: scaling by powers of two loses nothing.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    over = size / F.pow(F.lit(2.0), guess)  # between 1 and 2 but for a rounded logarithm
    exponent = F.when(over >= 2, guess + 1).when(over < 1, guess - 1).otherwise(guess)
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)
    normal = (exponent + 1023) * F.lit(1 << 52) + fraction.cast("bigint")
    least = 2.0**-1022
    # The usual case comes first and repeats nothing: what a condition always reads is computed once.
    usual = (guess >= -1022) & (over >= 1) & (over < 2)
    bits = (
        F.when(usual, (guess + 1023) * F.lit(1 << 52) + ((over - 1) * float(1 << 52)).cast("bigint"))
        .when(F.isnan(value), F.lit((2047 << 52) + 1)).when(size == float("inf"), F.lit(2047 << 52))
        .when(size < least, (size * 2.0**537 * 2.0**537).cast("bigint")).otherwise(normal)
    )
    return F.when(value < 0, -bits).otherwise(bits).cast("bigint")


def _middle(before: str) -> tuple[Column, Column]:
    """Whether rows that begin at ``before`` hold the lower and the upper middle position of their group."""
    holds = lambda position: (F.col(before) <= position) & (position < F.col(before) + F.col(_N))
    return holds(F.expr(f"({_TOTAL} - 1) div 2")), holds(F.expr(f"{_TOTAL} div 2"))


def middle_cells(source: DataFrame, keys: Sequence[str], limit: int = MIDDLE_ROWS) -> tuple[DataFrame, int]:
    """The one or two cells of each group that hold its middle positions, and the bits they leave out.

    ``source`` has the keys, ``__bits`` and ``__weight``. Every round counts cells and keeps the middle
    ones; only their rows are counted by further bits, dealt over salts, until no cell has more than
    ``limit`` rows or a cell is one number. What a round keeps is a short written table.
    """
    stages = StageTables(source.sparkSession, "middle-cells")
    known = None
    count = (F.sum("__weight").alias(_N), F.count(F.lit(1)).alias("__rows"))
    for at, shift in enumerate(CELL_SHIFTS):
        cell = F.shiftright("__bits", shift)
        if known is None:
            cells = running_cells(source.groupBy(*keys, cell.alias(_CELL)).agg(*count), keys, [F.asc(_CELL)])
        else:
            dealt = known.select(*keys, F.col(_CELL).alias(_OUTER), F.col(_BEFORE).alias(_OUTER_BEFORE), F.col(_TOTAL).alias(_OUTER_TOTAL), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
            salted = source.withColumns({_OUTER: F.shiftright("__bits", CELL_SHIFTS[at - 1]), "__salt": F.pmod(F.xxhash64("__bits"), F.lit(SALTS)).cast("int")})
            inner = join_null_safe(salted, dealt, [*keys, _OUTER, "__salt"])
            counted = inner.groupBy(*keys, _OUTER, cell.alias(_CELL)).agg(*count, F.first(_OUTER_BEFORE).alias(_OUTER_BEFORE), F.first(_OUTER_TOTAL).alias(_OUTER_TOTAL))
            cells = running_cells(counted, [*keys, _OUTER], [F.asc(_CELL)])
            cells = cells.withColumns({_BEFORE: F.col(_BEFORE) + F.col(_OUTER_BEFORE), _TOTAL: F.col(_OUTER_TOTAL)})
        low, high = _middle(_BEFORE)
        known = stages.write(cells.where(low | high).select(*keys, _CELL, "__rows", _BEFORE, _TOTAL))
        if (known.agg(F.max("__rows")).first()[0] or 0) <= limit:
            break
    return known, shift


def grouped_median(
    df: DataFrame, keys: Sequence[str], value: str, *, weight: str | None = None,
    median: str = "median", size: str = "group_count", limit: int = MIDDLE_ROWS,
) -> DataFrame:
    """Exact interpolated median and size of every group; nulls are left out.

    Rounds of counting narrow each group to the cells of its middle positions. The last pass keeps
    only rows of those and orders the distinct values inside them: at most ``limit`` rows, or
    repeats of one value.
    """
    number = F.col(value).cast("double")
    amount = F.col(weight) if weight else F.lit(1).cast("bigint")
    source = df.where(F.col(value).isNotNull()).select(
        *keys, number.alias("__value"), amount.alias("__weight"), ordered_bits(number).alias("__bits")
    )
    targets, shift = middle_cells(source.drop("__value"), keys, limit)
    values = (
        join_null_safe(source.withColumn(_CELL, F.shiftright("__bits", shift)), targets, [*keys, _CELL])
        .groupBy(*keys, _CELL, "__value")
        .agg(F.sum("__weight").alias(_N), F.first(_BEFORE).alias(_BEFORE), F.first(_TOTAL).alias(_TOTAL))
    )
    inside = W.partitionBy(*keys, _CELL).orderBy("__value").rowsBetween(W.unboundedPreceding, -1)
    placed = values.withColumn("__start", F.col(_BEFORE) + F.coalesce(F.sum(_N).over(inside), F.lit(0)))
    low, high = _middle("__start")
    middle = placed.groupBy(*keys).agg(
        F.max(F.when(low, F.col("__value"))).alias("__low"), F.max(F.when(high, F.col("__value"))).alias("__high"),
        F.first(_TOTAL).alias(size),
    )
    return middle.select(*keys, ((F.col("__low") + F.col("__high")) / 2).alias(median), size)


def grouped_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Medians of several columns per group in one pair of passes, one column each."""
    long = df.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("__measure"), F.col(name).cast("double").alias("__number"))
            for name in values
        ])).alias("__m"),
    ).select(*keys, "__m.*")
    medians = grouped_median(long, [*keys, "__measure"], "__number")
    return medians.groupBy(*keys).agg(*[
        F.max(F.when(F.col("__measure") == name, F.col("median"))).alias(name) for name in values
    ])
