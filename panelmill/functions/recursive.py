"""Exponentially weighted means without a row-by-row loop.

y[t] = a*x[t] + q*y[t-1] is a sum of q^k-weighted lags.  The sum over 4^m lags
is built from the sum over 4^(m-1) lags with three shifted copies, so a few
waves of lag() cover every lag whose weight is above 1e-17.  Nothing overflows,
no extra sort is needed, and the result depends on a bounded number of
preceding rows, which keeps it exact inside blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .axis import Axis, Wave
from .exprs import col

EPS = 1e-17


def reach(span: float) -> int:
    """Rows of history that still matter for a given span."""
    q = 1 - 2 / (span + 1)
    return max(1, math.ceil(math.log(EPS) / math.log(q))) if q > 0 else 1


def ewm(name: str, x: str | Column, axis: Axis, span: float, adjust: bool = False) -> list[Wave]:
    """Waves that add column ``name`` = ewm(span).mean() of ``x``.

    Leading missing values are skipped.  Missing values later in the series
    contribute nothing; fill them first where that matters.
    """
    a = 2 / (span + 1)
    q = 1 - a
    x, tmp = col(x), f"_t_{name}"
    seen = F.count(x).over(axis.upto())
    weighted = F.when(seen == 1, x).otherwise(x * a) if not adjust else x
    waves: list[Wave] = [{f"{tmp}_n": seen, tmp: F.coalesce(weighted, F.lit(0.0))}]
    covered = 1
    while covered < reach(span):
        acc = F.col(tmp)
        for k in (1, 2, 3):
            acc = acc + F.coalesce(axis.lag(tmp, k * covered), F.lit(0.0)) * (q ** (k * covered))
        waves.append({tmp: acc})  # the wider sum takes the place of the narrower one
        covered *= 4
    y = F.col(tmp)
    if adjust:
        y = y * (1 - q) / (1 - F.pow(F.lit(q), F.col(f"{tmp}_n")))
    waves.append({name: F.when(F.col(f"{tmp}_n") > 0, y)})
    return waves
