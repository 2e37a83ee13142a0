"""Variational inference of latent paths behind counts, by the dual problem.

For a Gaussian posterior with mean m and covariance V of a trial's path, the evidence is at least
sum(y h - exp(h + v / 2) - log y!) - KL, with h = C m + d and v the variances of C x. By convex duality (Khan, Aravkin, Friedlander and Seeger,
2013) the largest such bound is the least value of a convex function of one positive number a seen cell, whose gradient costs
two block-tridiagonal solves. Trials are independent and go to tasks as groups.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.jobs import poisson
from tessera.operators.kalman import Model, matrix
from tessera.sources.store import shared_out

Value = Callable[[np.ndarray], tuple[float, np.ndarray]]


def wolfe(value: Value, x: np.ndarray, way: np.ndarray, f: float, slope: float, *, low: float = 1e-4, high: float = 0.9, turns: int = 60) -> tuple[np.ndarray, float, np.ndarray] | None:
    """A point along ``way`` with enough decrease and a flatter slope (weak Wolfe conditions), by bisection; None if there is none.

    Points at which the value is infinite lie outside the domain.
    """
    a, b, t = 0.0, np.inf, 1.0
    for _ in range(turns):
        new, grad = value(at := x + t * way)
        if not new <= f + low * t * slope:
            b = t
        elif grad @ way < high * slope:
            a = t
        else:
            return at, new, grad
        t = (a + b) / 2 if np.isfinite(b) else 2 * a
    return None


def minimised(value: Value, x: np.ndarray, scale: Callable[[np.ndarray], np.ndarray], *, memory: int = 10, rounds: int = 1000, tolerance: float = 1e-14) -> np.ndarray:
    """The least point of a smooth function by limited-memory BFGS; scale(x): the diagonal of a first guess at the inverse Hessian."""
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, weights = g.copy(), []
        for s, y, rho in reversed(past):
            weights.append(rho * (s @ q))
            q -= weights[-1] * y
        q *= scale(x)
        for (s, y, rho), w in zip(past, reversed(weights), strict=True):
            q += s * (w - rho * (y @ q))
        slope = -(g @ q)
        if slope > -tolerance * max(1.0, abs(f)):
            break
        step = wolfe(value, x, -q, f, slope)
        if step is None:
            if not past:
                break
            past.clear()
            continue
        new, f, grad = step
        s, y = new - x, grad - g
        if s @ y > 1e-14 * np.sqrt((s @ s) * (y @ y)):
            past = [*past[-memory + 1 :], (s, y, 1 / (s @ y))]
        x, g = new, grad
    return x


class Dual:
    """The dual function of one trial's counts [steps, p], NaN unseen."""

    def __init__(self, model: Model, y: np.ndarray):
        self.model, self.on = model, np.isfinite(y)
        self.y = y[self.on]
        self.step, self.var = np.nonzero(self.on)
        self.diag, self.off, self.mean = poisson.prior_blocks(model, len(y))
        pivots, self.multipliers = poisson._factored(self.diag, self.off)
        self.inverses, self.log_prior = np.linalg.inv(pivots), self.log_det(pivots)
        self.loadings = model.C[self.var]
        self.squares = np.einsum("pi,pj->pij", model.C, model.C)
        self.constant = -sum(np.log(np.arange(1, int(c) + 1)).sum() for c in self.y)

    def log_det(self, pivots: np.ndarray) -> float:
        return float(np.linalg.slogdet(pivots)[1].sum())

    def spread(self, cells: np.ndarray) -> np.ndarray:
        """[steps, p] of values of the seen cells, zero elsewhere."""
        out = np.zeros(self.on.shape)
        out[self.on] = cells
        return out

    def posterior(self, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Means, covariances, upper covariances and the pivots of the precision that lam stands for; the prior's are kept."""
        shift = poisson._solved(self.inverses, self.multipliers, self.spread(self.y - lam) @ self.model.C)
        pivots, multipliers = poisson._factored(self.diag + np.einsum("tp,pij->tij", self.spread(lam), self.squares), self.off)
        cov, up = poisson._inverse(np.linalg.inv(pivots), multipliers)
        return self.mean + shift, cov, up, pivots

    def __call__(self, lam: np.ndarray) -> tuple[float, np.ndarray]:
        if not (lam > 0).all():
            return np.inf, np.full(len(lam), np.nan)
        m, cov, _, pivots = self.posterior(lam)
        e = self.y - lam
        drive = (m @ self.model.C.T + self.model.d)[self.on]
        prior = (self.mean @ self.model.C.T + self.model.d)[self.on]
        v = np.einsum("ci,cij,cj->c", self.loadings, cov[self.step], self.loadings)
        value = (lam * (np.log(lam) - 1)).sum() + e @ prior + 0.5 * e @ (drive - prior) - 0.5 * (self.log_det(pivots) - self.log_prior)
        return float(value + self.constant), np.log(lam) - drive - v / 2

    def fit(self, m: np.ndarray, cov: np.ndarray) -> float:
        """The expected log-likelihood of the counts under a posterior."""
        drive = (m @ self.model.C.T + self.model.d)[self.on]
        v = np.einsum("ci,cij,cj->c", self.loadings, cov[self.step], self.loadings)
        with np.errstate(over="ignore"):
            return float((self.y * drive - np.exp(drive + v / 2)).sum() + self.constant)

    def lower(self, lam: np.ndarray) -> float:
        """The bound of the posterior that lam stands for: at most the dual value, and equal to it at the optimum."""
        m, cov, up, pivots = self.posterior(lam)
        z = m - self.mean
        trace = np.einsum("tij,tji->", self.diag, cov) + 2 * np.einsum("tij,tij->", self.off, up)
        divergence = 0.5 * (trace + (z * poisson._times(self.diag, self.off, z)).sum() - m.size + self.log_det(pivots) - self.log_prior)
        return self.fit(m, cov) - divergence


def infer(model: Model, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Means, covariances, covariances with the step before, the bound of one trial's evidence, and by how much the dual lies above it.

    It begins at the rates of the Laplace approximation; a trial without seen cells has its prior.
    """
    dual = Dual(model, y)
    x, v, _, _ = poisson.laplace(model, y)
    drive = (x @ model.C.T + model.d)[dual.on]
    start = np.exp(np.minimum(drive + 0.5 * np.einsum("ci,cij,cj->c", dual.loadings, v[dual.step], dual.loadings), 50.0))
    lam = minimised(dual, np.maximum(start, 1e-12), lambda at: at) if len(dual.y) else start
    m, cov, up, _ = dual.posterior(lam)
    cross = np.zeros_like(cov)
    cross[1:] = np.transpose(up, (0, 2, 1))
    low = dual.lower(lam)
    return m, cov, cross, low, dual(lam)[0] - low if len(dual.y) else 0.0


def posterior(packed: DataFrame, model: Model) -> DataFrame:
    """(trial, t, x, v, bound, gap) per step of a packed panel; bound and gap (see ``infer``) are the trial's, at its first step.

    The panel holds every step of a trial's span; a table without rows gives none.
    """
    p = len(model.d)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        m, cov, _, bound, gap = infer(model, matrix(frame, p))
        none = np.zeros(len(m) - 1)
        return pd.DataFrame({"trial": frame["trial"].iloc[0], "t": np.sort(frame["t"].to_numpy()), "x": list(m), "v": [a.ravel() for a in cov], "bound": np.r_[bound, none], "gap": np.r_[gap, none]})

    return shared_out(packed, "trial").groupBy("trial").applyInPandas(run, "trial int, t int, x array<double>, v array<double>, bound double, gap double")
