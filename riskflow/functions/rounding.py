"""Rounding that gives the same double in Spark and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAP = 9


def round_double(c: Column | str, digits: int) -> Column:
    """Engine-independent rounding of a double.

    Step 1 snaps to 9 decimals, which removes last-bit noise from summation
    order (sums of cents and means over groups of 2^k rows otherwise sit on
    exact ties). Step 2 is round-half-away on the binary product ``x * 10^d``,
    the same IEEE operations a C-library ``round(x * 10^d) / 10^d`` performs.
    """
    x = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.round(F.round(x, SNAP) * F.lit(scale), 0) / F.lit(scale)
