"""Standard normal distribution as Column expressions, and literal arrays."""

from __future__ import annotations

import json
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun, formula 26.2.17 (absolute error below 7.5e-8).
CDF_SCALE = 0.2316419
CDF_TERMS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INVERSE_ROOT_TWO_PI = 0.3989422804014327

# Acklam's rational approximation of the quantile (relative error 1.2e-9).
CENTRAL_NUMERATOR = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
CENTRAL_DENOMINATOR = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
TAIL_NUMERATOR = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
TAIL_DENOMINATOR = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)
TAIL_START = 0.02425


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_cdf(z: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_SCALE) * F.abs(z))
    density = F.lit(INVERSE_ROOT_TWO_PI) * F.exp(F.lit(-0.5) * z * z)
    tail = density * t * _polynomial(t, tuple(reversed(CDF_TERMS)))
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)


def normal_quantile(u: Column) -> Column:
    def tail(p: Column) -> Column:
        q = F.sqrt(F.lit(-2.0) * F.log(p))
        return _polynomial(q, TAIL_NUMERATOR) / _polynomial(q, TAIL_DENOMINATOR)

    q = u - F.lit(0.5)
    r = q * q
    central = q * _polynomial(r, CENTRAL_NUMERATOR) / _polynomial(r, CENTRAL_DENOMINATOR)
    return (
        F.when(u < TAIL_START, tail(u))
        .when(u > 1.0 - TAIL_START, -tail(F.lit(1.0) - u))
        .otherwise(central)
    )


def normal_level(u: float) -> float:
    """Normal quantile on the driver, for the few levels a plan carries as literals."""
    return NormalDist().inv_cdf(u)


def literal_array(values: Sequence, element_type: str) -> Column:
    """Array literal in one expression; the optimizer folds it to a constant."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{element_type}>")
