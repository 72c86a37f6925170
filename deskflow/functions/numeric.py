"""Numeric helpers: risk score, threshold buckets."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def known(col: Column) -> Column:
    """NaN as NULL, so that a comparison with a missing value is never true."""
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def calibrated_prob(
    confidence: Column, retrieval: Column, w_conf: float, w_ret: float, intercept: float
) -> Column:
    """Logistic risk score, the exponent clipped to +-700."""
    z = F.lit(w_conf) * known(confidence) + F.lit(w_ret) * known(retrieval) + F.lit(intercept)
    limit = F.lit(fv.LOGIT_CLIP)
    # least/greatest skip NULLs, so a missing input is kept missing by hand.
    clipped = F.when(z.isNotNull(), F.greatest(F.least(z, limit), -limit))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))


def arange(grid: tuple[float, float, float]) -> list[float]:
    """Thresholds of a sweep as plain floats."""
    return [float(v) for v in np.arange(*grid)]


def reached(col: Column, thresholds: list[float], missing: int) -> Column:
    """How many of the ascending ``thresholds`` the value reaches (``>=``)."""
    value = known(col)
    falling = list(enumerate(thresholds, start=1))[::-1]
    case = reduce(
        lambda acc, t: acc.when(value >= F.lit(t[1]), t[0]),
        falling,
        F.when(value.isNull(), missing),
    )
    return case.otherwise(0)


def right_closed_bin(col: Column, edges: list[float]) -> Column:
    """Index of the bin (edge[i], edge[i+1]] holding the value; the first bin also
    holds its lower edge; NULL outside the edges."""
    value = known(col)
    case = F.when(value < F.lit(edges[0]), None)
    for i, upper in enumerate(edges[1:]):
        case = case.when(value <= F.lit(upper), i)
    return case


def ratio(num: Column, den: Column, if_zero: float | None = 0.0) -> Column:
    """num / den, with ``if_zero`` where the denominator is zero."""
    return F.when(den != 0, num / den).otherwise(F.lit(if_zero).cast("double"))
