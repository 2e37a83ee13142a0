"""Link functions, likelihoods and conjugates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def soft_link(x: Column) -> Column:
    """exp below 0, 1 + x above."""
    return F.when(x < 0, F.exp(x)).otherwise(1 + x)


def logexp_link(x: Column) -> Column:
    return F.log1p(F.exp(x))


def stable_log_exp(x: Column) -> Column:
    """log(1 + exp(x)); x itself above 5 and exp(x) below -5."""
    return F.when(x > 5, x).when(x < -5, F.exp(x)).otherwise(F.log1p(F.exp(x)))


def stable_loglog_exp(x: Column) -> Column:
    """Logarithm of stable_log_exp."""
    return F.when(x > 5, F.ln(x)).when(x < -5, x).otherwise(F.ln(F.log1p(F.exp(x))))


def poisson_like(y: Column, m: Column, v: Column) -> Column:
    """-y m + exp(m + v / 2): expected negative log-likelihood without the base measure."""
    return -y * m + F.exp(m + v / 2)


def poisson_dual(lam: Column) -> Column:
    """lam (log lam - 1), infinite outside lam > 0."""
    return F.when(lam > 0, lam * (F.ln(lam) - 1)).otherwise(F.lit(float("inf")))


def bernoulli_dual(lam: Column) -> Column:
    """Conjugate of the logistic likelihood on [0, 1]; infinite outside."""
    part = lambda p: F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))
    return F.when((lam >= 0) & (lam <= 1), part(lam) + part(1 - lam)).otherwise(F.lit(float("inf")))


def log_factorial(y: Column) -> Column:
    """log Gamma(y + 1) of a whole number."""
    return F.when(y < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), y.cast("long")), F.lit(0.0), lambda a, k: a + F.ln(k.cast("double"))))


def in_domain(lam: Column) -> Column:
    return (lam >= 0) & ~F.isnan(lam) & (lam < float("inf"))


def mixture_dual(lam: Column, weight: float) -> Column:
    """Conjugate of a likelihood that counts with ``weight``: weight times the dual of lam / weight, scaled to lam."""
    return F.when(lam > 0, weight * lam * (F.ln(lam / weight) - 1)).otherwise(F.lit(float("inf")))
