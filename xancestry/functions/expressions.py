"""Column expressions on alleles and statistics; all run in the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BASES, COMPLEMENTS

LN10 = math.log(10)


def complement(allele: Column) -> Column:
    """The other strand's base; anything but a single base stays as it is."""
    return F.when(F.length(allele) == 1, F.translate(allele, BASES, COMPLEMENTS)).otherwise(allele)


def same_alleles(a1: Column, a2: Column, r1: Column, r2: Column) -> Column:
    """The reference's alleles in order, on either strand."""
    return ((a1 == r1) & (a2 == r2)) | ((a1 == complement(r1)) & (a2 == complement(r2)))


def swapped_alleles(a1: Column, a2: Column, r1: Column, r2: Column) -> Column:
    return same_alleles(a1, a2, r2, r1)


def z_score(beta: Column, se: Column) -> Column:
    return beta / se


def unit_scale(freq: Column) -> Column:
    """Standard deviation of a genotype of this frequency."""
    return F.sqrt(2 * freq * (1 - freq))


def effective_n(n: Column, sigma_pp: Column, se: Column) -> Column:
    return n * sigma_pp / (se * se)


# Numerators and denominators, highest power first, of the rational approximations of erf(x) / x in x^2 up to
# NEAR, of exp(x^2) erfc(x) in x up to MIDDLE, and of what 1 / sqrt(pi) has to be lessened by in 1 / x^2 beyond it.
NEAR, MIDDLE = 0.46875, 4.0
ERF_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(of: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    top, bottom = (reduce(lambda s, k: s * x + F.lit(k), part[1:], F.lit(part[0])) for part in of)
    return top / bottom


def log10_p(z: Column | str) -> Column:
    """log10 of the two-sided normal tail of z, beyond what a double can hold as a probability; null for null and NaN.

    The tail is erfc(x) with x = |z| / sqrt(2), as exp(-x^2) times a ratio whose logarithm doesn't underflow. z occurs in it
    many times, and so does what comes out in p_parts(): each should be a column of a projection of its own, or code grows large.
    """
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z) * math.sqrt(0.5)
    near = F.log10(1 - x * _ratio(ERF_NEAR, x * x))
    middle = (F.log(_ratio(ERFC_MIDDLE, x)) - x * x) / LN10
    y = 1 / (x * x)
    far = (F.log((1 / math.sqrt(math.pi) - y * _ratio(ERFC_FAR, y)) / x) - x * x) / LN10
    tail = F.when(x <= NEAR, near).when(x <= MIDDLE, middle).when(x == math.inf, F.lit(-math.inf)).otherwise(far)
    return F.when(z.isNotNull() & ~F.isnan(z), tail)


def p_parts(log10p: Column) -> tuple[Column, Column]:
    """Mantissa and exponent; a P-value of 1 is 1.0 and 0, others are cut at their whole decades."""
    whole = F.when(log10p < 0, F.ceil(log10p)).otherwise(F.floor(log10p)).cast("long")
    one = log10p == 0
    return F.when(one, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), log10p - whole + 1)), F.when(one, F.lit(0)).otherwise(whole - 1)


def p_text(log10p: Column) -> Column:
    """A P-value as text, which doesn't underflow."""
    mantissa, exponent = p_parts(log10p)
    return F.when(log10p.isNull(), None).otherwise(F.concat(mantissa.cast("string"), F.lit("e"), exponent.cast("string")))
