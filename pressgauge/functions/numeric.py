"""Rounding and order-independent sums.

Shares are sums of many fractions. A plain double sum depends on the order in which shuffle
blocks arrive, and one last-bit difference can flip a value that sits on a rounding tie. Terms
are therefore held as 64-bit integers on a fixed grid, which add up the same in any order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Published values sit on a grid of one ten-thousandth.
GRID = 10_000
#: Fixed-point scale of a share term. The terms of one bucket add up to at most 1, and
#: ``term * GRID`` must still fit 64 bits.
TERM_SCALE = 10**14
#: Fixed-point scale of a square-root weight.
WEIGHT_SCALE = 10**10


def grid_units(x: Column) -> Column:
    """``x`` in whole ten-thousandths, rounded on the exact value of the double.

    ``bround`` looks at the shortest decimal text of a double, so a value a hair above a tie
    can still count as the tie. Here the distance to the tie is computed exactly: the double is
    split in two halves whose products with 20000 carry no rounding error.
    """
    q = F.floor(x * F.lit(float(GRID)))
    wide = x * F.lit(134217729.0)  # 2**27 + 1
    high = wide - (wide - x)
    low = x - high
    past_tie = (high * F.lit(20000.0) - (q * 2 + 1)) + low * F.lit(20000.0)
    up = (past_tie > 0) | ((past_tie == 0) & (F.pmod(q, F.lit(2)) == 1))
    return (q + F.when(up, 1).otherwise(0)).cast("bigint")


def snapped(x: Column) -> Column:
    """``x`` on a grid of 1e-11: two routes to the same fraction become the same double."""
    return F.floor(x * F.lit(1e11) + 0.5) / F.lit(1e11)


def from_units(units: Column) -> Column:
    return units / F.lit(float(GRID))


def round4(x: Column) -> Column:
    """Four decimals, ties to even on the exact binary value."""
    return from_units(grid_units(x))


def round4_away(x: Column) -> Column:
    """Four decimals, halves away from zero."""
    scaled = F.abs(x) * F.lit(float(GRID))
    return F.signum(x) * F.floor(scaled + 0.5) / F.lit(float(GRID))


def round_pp1(x: Column) -> Column:
    """A difference of shares in percentage points with one decimal, halves away from zero."""
    scaled = x * F.lit(1000.0)
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / F.lit(10.0)


def compensated_sum(values: list[Column]) -> Column:
    """Add a short fixed list of doubles with the rounding error carried beside the total."""
    total, lost = values[0], F.lit(0.0)
    for value in values[1:]:
        grown = total + value
        lost = lost + F.when(
            F.abs(total) >= F.abs(value), (total - grown) + value
        ).otherwise((value - grown) + total)
        total = grown
    return total + lost


def sqrt_weight(articles: Column) -> Column:
    return F.round(F.sqrt(articles.cast("double")) * F.lit(float(WEIGHT_SCALE))).cast("bigint")


def share_term(weight: Column, weight_sum: Column, part: Column | None = None) -> Column:
    """A source's weight in its bucket, or ``part`` of that weight, on the fixed grid."""
    share = weight.cast("double") / weight_sum.cast("double")
    if part is not None:
        share = part * share
    return F.round(share * F.lit(float(TERM_SCALE))).cast("bigint")


def ratio_or_null(now: Column, usual: Column) -> Column:
    return F.when(usual > 0, now / usual)
