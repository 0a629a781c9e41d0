"""Normal distribution as column expressions that stay in generated code.

Spark SQL has no ``erf``.  The cumulative distribution follows the rational
approximation published by J. F. Hart (1968) in the form given by G. West,
"Better approximations to cumulative normal functions" (2005); its error is
below 1e-14, so no Python function is needed.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (published coefficients, highest power first).
NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
SWITCH = 7.07106781186547
FAR = 37.0
SQRT_TWO_PI = 2.506628274631


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    head, *rest = coefficients
    return reduce(lambda acc, c: acc * x + F.lit(c), rest, F.lit(head))


def normal_cdf(x: Column) -> Column:
    """P(Z <= x) for a standard normal Z; NULL stays NULL."""
    a = F.abs(x)
    bell = F.exp(-a * a / F.lit(2.0))
    near = bell * _horner(NUMERATOR, a) / _horner(DENOMINATOR, a)
    tail = a + F.lit(0.65)
    for step in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(step) / tail
    upper = (
        F.when(a > F.lit(FAR), F.lit(0.0))
        .when(a < F.lit(SWITCH), near)
        .otherwise(bell / tail / F.lit(SQRT_TWO_PI))
    )
    return F.when(x.isNull(), None).when(x > 0, F.lit(1.0) - upper).otherwise(upper)


def z_score_of(probability: float) -> float:
    """The z with P(Z <= z) = probability; a plan-time constant."""
    return NormalDist().inv_cdf(probability)
