"""Stitching: completing lag covariances whose pairs were never observed together, and aligning partial models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessera.jobs import fitting


def observed(lagcov: DataFrame, lags: int, n_vars: int) -> np.ndarray:
    """[lags, n_vars, n_vars]: which covariances a table has (its size is known beforehand)."""
    out = np.zeros((lags, n_vars, n_vars), bool)
    for r in lagcov.select("m", "i", "j").collect():
        out[r["m"], r["i"], r["j"]] = True
    return out


def fill(q: np.ndarray, seen: np.ndarray, n: int, k: int, rounds: int = 50, damp: float = 0.5) -> tuple[np.ndarray, list[float]]:
    """Covariances with the unseen entries imputed: identify a system, predict them, move towards the prediction, repeat.

    Also returns how far the entries moved in each round.
    """
    now, trace = np.where(seen, q, 0.0), []
    for _ in range(rounds):
        a, c, pi, r = fitting.subspace(now, n, k)
        made = np.array([c @ np.linalg.matrix_power(a, m) @ pi @ c.T + (np.diag(r) if m == 0 else 0) for m in range(len(q))])
        new = np.where(seen, q, damp * now + (1 - damp) * made)
        trace.append(float(np.abs(new - now).max()))
        now = new
        if trace[-1] < 1e-9:
            break
    return now, trace


def align(c_from: np.ndarray, a_from: np.ndarray, c_to: np.ndarray, a_to: np.ndarray, steps: int) -> np.ndarray:
    """The change of latent basis that turns one model's observability of shared variables into another's."""
    stack = lambda c, a: np.vstack([c @ np.linalg.matrix_power(a, t) for t in range(steps)])
    return np.linalg.pinv(stack(c_from, a_from)) @ stack(c_to, a_to)


def ho_kalman(impulses: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A, B, C of a deterministic system from its impulse responses G(1), G(2), ... [2k, outputs, inputs]."""
    p, m = impulses.shape[1:]
    h = np.block([[impulses[r + c] for c in range(k)] for r in range(k)])
    u, s, vt = np.linalg.svd(h, full_matrices=False)
    o, reach = u[:, :n] * np.sqrt(s[:n]), np.sqrt(s[:n])[:, None] * vt[:n]
    return np.linalg.pinv(o[:-p]) @ o[p:], reach[:, :m], o[:p]


def soft_impute(x: np.ndarray, n: int, shrink: float = 0.0, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """A matrix with its NaN entries completed at rank n, singular values lowered by ``shrink``."""
    on = np.isfinite(x)
    now = np.where(on, x, 0.0)
    for _ in range(rounds):
        u, s, vt = np.linalg.svd(now, full_matrices=False)
        low = (u[:, :n] * np.maximum(s[:n] - shrink, 0)) @ vt[:n]
        new = np.where(on, x, low)
        if np.abs(new - now).max() < tolerance:
            return new
        now = new
    return now
