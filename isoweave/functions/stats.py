"""Scalar statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The divisor that turns a median absolute deviation into the spread used for the fudge factor.
MAD_SCALE = 0.64


def path_ratio(a: Column, b: Column) -> Column:
    """a / (a + b), a half where both are zero."""
    return F.coalesce(F.try_divide(a, a + b), F.lit(0.5))


def reported_ratio(a: Column, b: Column) -> Column:
    """As path_ratio, but a half wherever the second path is zero: what the list of significant paths holds."""
    return F.when(b > 0, a / (a + b)).otherwise(0.5)


def kl_term(p: Column, q: Column) -> Column:
    """p log2(p / q), zero where either is zero."""
    return F.when((p > 0) & (q > 0), p * F.log2(p / q)).otherwise(0.0)


def jsd_term(p: Column, q: Column) -> Column:
    """A path's share of the Jensen-Shannon divergence of two distributions, in bits."""
    m = (p + q) / 2
    return (kl_term(p, m) + kl_term(q, m)) / 2


def dropout_probability(mean: Column, b0: float, b1: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(b0) + b1 * F.log(mean + 1))))


def cv2_curve(mean: Column, a0: float, a1: float) -> Column:
    """Squared coefficient of variation that technical noise gives."""
    return F.lit(a0) + a1 / mean


def gamma_parameters(mean: Column, cv2: Column, p: Column) -> tuple[Column, Column]:
    """(shape, scale) of the expressed cells' gamma; null where its variance isn't positive."""
    rest = cv2 * mean * mean * (1 - p) - p * mean * mean
    ok = (rest > 0) & (mean > 0) & (p < 1)
    return F.when(ok, mean * mean / rest), F.when(ok, rest / (mean * (1 - p)))


def saturation(expression: Column) -> Column:
    """Logistic penalty of low expression: 1 up to 1, then falling to 0."""
    return F.when(expression <= 1, F.lit(1.0)).otherwise(2 * (1 - 1 / (1 + F.exp(-expression / 3))))
