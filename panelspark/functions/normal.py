"""Normal distribution in column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cody's rational approximations (1969) of erf up to 0.46875, of erfc up to 4 and of erfc beyond.
# Highest power first; numerators, then denominators.
NEAR = ((1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
        (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
MIDDLE = ((2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
           8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
          (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
           3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3))
FAR = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
        1.60837851487422766e-2, 6.58749161529837803e-4),
       (1.0, 2.56852019228982242e0, 1.87295284992347047e0, 5.27905102951428412e-1, 6.05183413124413191e-2,
        2.33520497626869185e-3))


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def _ratio(x: Column, tables: tuple[Sequence[float], Sequence[float]]) -> Column:
    return _polynomial(x, tables[0]) / _polynomial(x, tables[1])


def _exp_minus_square(x: Column) -> Column:
    """exp(-x^2), with x cut in two so that the rounding of the square does not grow with it."""
    head = F.floor(x * 16) / 16
    return F.exp(-head * head) * F.exp(-(x - head) * (x + head))


def erfc(x: Column) -> Column:
    """Complementary error function, to a relative error of some 1e-15 in both tails. NULL and NaN stay."""
    x = x.cast("double")
    y = F.abs(x)
    near = 1 - x * _ratio(y * y, NEAR)
    middle = _exp_minus_square(y) * _ratio(y, MIDDLE)
    inverse = 1 / (y * y)
    far = _exp_minus_square(y) / y * (1 / math.sqrt(math.pi) - inverse * _ratio(inverse, FAR))
    tail = F.when(y <= 4, middle).when(y < 27, far).otherwise(0.0)
    return F.when(x.isNull() | F.isnan(x), x).when(y <= 0.46875, near).when(x < 0, 2 - tail).otherwise(tail)


def normal_cdf(z: Column) -> Column:
    """Probability of a standard normal value up to ``z``."""
    return erfc(-z / math.sqrt(2.0)) / 2


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
