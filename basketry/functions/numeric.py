"""Exact decimal percentages and averages.

``ROUND(100.0 * a / b, d)`` in the reference is numeric arithmetic rounded
half away from zero.  Both operands here are integer counts, so the rounded
value is computed exactly in integers: ``floor((2*K*a + b) / (2*b)) / 10^d``
with ``K = 100 * 10^d`` (a >= 0, b > 0).  No intermediate decimal scale can
push a value across a rounding tie.  An empty group gives NULL, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pct_half_up(numerator, denominator, digits: int) -> Column:
    """100 * numerator / denominator rounded half-up to ``digits`` decimals, as double."""
    a = _c(numerator).cast("decimal(38,0)")
    b = _c(denominator).cast("decimal(38,0)")
    num = a * F.lit(2 * 100 * 10 ** digits) + b
    den = b * F.lit(2)
    # (num - num % den) / den is an exact integer quotient: no rounding step.
    q = ((num - num % den) / den).cast("decimal(38,0)")
    value = (q / F.lit(10 ** digits)).cast(f"decimal(38,{digits})")
    return F.when(b > 0, value.cast("double"))


def round_half_up(col, digits: int) -> Column:
    """ROUND(x::numeric, d): the double is cast to decimal first (Q18)."""
    return F.round(_c(col).cast("decimal(38,6)"), digits).cast("double")
