"""Small numeric functions Spark does not ship, as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(z: Column) -> Column:
    """``ln Gamma(z)`` for z >= 1: Stirling's series after shifting the argument up by eight."""
    z = z.cast("double")
    shift = 8
    rising = reduce(lambda acc, i: acc * (z + F.lit(float(i))), range(1, shift), z)
    w = z + F.lit(float(shift))
    inv = F.lit(1.0) / w
    inv2 = inv * inv
    series = inv * (
        F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (F.lit(1 / 1260) - inv2 * (F.lit(1 / 1680) - inv2 * F.lit(1 / 1188))))
    )
    stirling = (w - F.lit(0.5)) * F.log(w) - w + F.lit(0.5 * math.log(2 * math.pi)) + series
    return stirling - F.log(rising)


def log_gamma_step(y: Column, k: Column) -> Column:
    """``ln Gamma(y + k) - ln Gamma(y)`` for y and y + k >= 1, with an error that grows with k and not with y.

    Two values of ``log_gamma`` near 10^7 are about 10^8 and lose what tells them apart. Here the large parts of both
    Stirling series are taken against each other on paper; the shifts by eight give a product of ratios.
    """
    y, k = y.cast("double"), k.cast("double")
    shift = 8
    ratio = reduce(lambda acc, i: acc * ((y + k + F.lit(float(i))) / (y + F.lit(float(i)))), range(1, shift), (y + k) / y)
    w = y + F.lit(float(shift))

    def series(z: Column) -> Column:
        inv2 = F.lit(1.0) / (z * z)
        return (F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (F.lit(1 / 1260) - inv2 * (F.lit(1 / 1680) - inv2 * F.lit(1 / 1188))))) / z

    return (w - F.lit(0.5)) * F.log1p(k / w) + k * F.log(w + k) - k + (series(w + k) - series(w)) - F.log(ratio)


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value ``erfc(|z|/sqrt 2)``.

    Below 3 the Maclaurin-type series of the normal integral is used, above it
    the continued fraction of the tail; both are good to about 1e-12.
    """
    a = F.abs(z)
    a2 = a * a
    density = F.exp(-a2 / 2) * F.lit(1 / math.sqrt(2 * math.pi))
    term_count = 40
    # sum a^(2k+1) / (1*3*5*...*(2k+1)), nested from the far end
    series = reduce(
        lambda acc, k: F.lit(1.0) + acc * a2 / F.lit(float(2 * k + 1)),
        range(term_count, 0, -1),
        F.lit(1.0),
    )
    centre = F.lit(1.0) - F.lit(2.0) * density * a * series
    far = F.greatest(a, F.lit(1.0))
    fraction = reduce(lambda acc, k: far + F.lit(float(k)) / acc, range(60, 0, -1), far)
    tail = F.lit(2.0) * density / fraction
    return F.when(a < 3.0, centre).otherwise(tail)
