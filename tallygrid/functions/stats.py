"""Column expressions and driver-side formulas for rates and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 95 % point of the normal distribution as used for all intervals.
Z = 1.96


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Lower and upper end of the 95 % Wilson interval, clamped to [0, 1]; (0, 0) for n = 0."""
    p = hits / F.nullif(n, F.lit(0))
    d = 1 + Z * Z / n
    centre = (p + Z * Z / (2 * n)) / d
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / d
    zero = F.lit(0.0)
    lo = F.when(n == 0, zero).otherwise(F.greatest(zero, centre - half))
    hi = F.when(n == 0, zero).otherwise(F.least(F.lit(1.0), centre + half))
    return lo, hi


def rate(hits: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(hits / F.nullif(n, F.lit(0)))


def threshold_rank(n: int, target: float) -> int:
    """1-based rank, in descending order, of the clean score that becomes the threshold."""
    return int(n * target) + 1


def interval_area(points: list[tuple[float, float]], hi: float) -> float | None:
    """Mean recall over log10(fpr) for (fpr, recall) points with 0 < fpr <= hi."""
    pts = sorted(x for x in points if 0 < x[0] <= hi)
    if not pts:
        return None
    width = math.log10(pts[-1][0]) - math.log10(pts[0][0])
    if not width:
        return pts[-1][1]
    steps = zip(pts, pts[1:], strict=False)
    return sum((math.log10(b[0]) - math.log10(a[0])) * (a[1] + b[1]) / 2 for a, b in steps) / width
