"""Numbers as the report shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts around formatted numbers.
RATIO_PREFIX = "1 : "
NO_RATIO = "—"
UNBOUNDED = "Infinity"
UNDEFINED = "NaN"
# The first double beyond a BIGINT; its negative is the least BIGINT.
BIGINT_END = 2.0**63


def without_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def is_whole(c: Column) -> Column:
    """Whether a double is whole and fits a BIGINT; NaN, a missing value, does not object."""
    value = c.cast("double")
    fits = (value >= -BIGINT_END) & (value < BIGINT_END)
    return F.isnan(value) | ((F.rint(value) == value) & fits)


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def fixed_decimals(c: Column, digits: int) -> Column:
    """Text of a non-negative number with ``digits`` decimals.

    Rounds the exact binary value, ties upwards. ``format_number`` does the
    former but sends ties to the even neighbour, so a tie is lifted by less
    than any other value could be.
    """
    is_tie = (c * 2 ** (digits + 1)) % 2 == 1
    lifted = F.when(is_tie, c + 10.0 ** -(digits + 2)).otherwise(c)
    return F.replace(F.format_number(lifted, digits), F.lit(","), F.lit(""))


def quotient(a: Column, b: Column) -> Column:
    """Division that gives infinity or NaN for a zero divisor, as doubles do."""
    over_zero = F.when(a == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return F.when(b == 0, over_zero).otherwise(a / b)


def share(part: Column, total: Column) -> Column:
    return quotient(part, total) * 100


def percent_text(part: Column, total: Column) -> Column:
    return F.concat(fixed_decimals(share(part, total), 1), F.lit("%"))


def ratio(first: Column, repeat: Column) -> Column:
    return quotient(repeat, first)


def ratio_text(first: Column, repeat: Column, digits: int = 1) -> Column:
    """``1 : x`` text, with x as a number even where it has no finite value."""
    shown = (
        F.when((first == 0) & (repeat == 0), F.lit(UNDEFINED))
        .when(first == 0, F.lit(UNBOUNDED))
        .otherwise(fixed_decimals(ratio(first, repeat), digits))
    )
    return F.concat(F.lit(RATIO_PREFIX), shown)


def ratio_or_dash(first: Column, repeat: Column) -> Column:
    """The same with one decimal, and a dash where there are no repeats."""
    return F.when(repeat == 0, F.lit(NO_RATIO)).otherwise(ratio_text(first, repeat))
