"""What the queries without SQL twins must satisfy, number by number; none of them is only counted."""

import numpy as np
import pytest

from tests.conftest import SF
from tessera.jobs.state_queries import ORACLES, QUERIES

WITHOUT = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def made(spark):
    found = {}

    def get(name):
        if name not in found:
            found[name] = QUERIES[name](spark, SF).toPandas()
        return found[name]

    return get


def square(cells):
    n = int(round(len(cells) ** 0.5))
    return np.reshape(cells, (n, n))


@pytest.mark.parametrize("name", ["kalman_smoother", "kalman_smoother_gap_vector", "laplace_inference", "laplace_softplus", "variational_inference"])
def test_posteriors(made, name):
    """Every hour of every day has one finite mean and a positive covariance; the likelihood stands at a day's first hour alone."""
    rows = made(name)
    assert (rows.groupby("trial")["t"].apply(lambda t: sorted(t) == list(range(24)))).all()
    assert all(np.isfinite(x).all() for x in rows["x"]) and min(np.linalg.eigvalsh((square(v) + square(v).T) / 2).min() for v in rows["v"]) > 0
    level = rows["loglik" if "loglik" in rows else "bound"]
    assert (level[rows["t"] != 0] == 0).all() and (level[rows["t"] == 0] < 0).all()


def test_gaps_are_less_certain_than_what_was_seen(made):
    seen, gap = made("kalman_smoother"), made("kalman_smoother_gap_vector")
    size = lambda f: f.assign(d=[np.linalg.det(square(v)) for v in f["v"]]).groupby("t")["d"].mean()
    assert (size(gap)[9:11] > size(seen)[9:11]).all()


def test_bounds_of_the_evidence(made):
    """Dual and primal bounds meet on every day."""
    assert made("variational_inference")["gap"].abs().max() < 1e-5


def test_traces_rise(made):
    for name, level in (("em_fit", "loglik"), ("plds_em", "bound")):
        rows = made(name).sort_values("round")
        assert rows["round"].tolist() == list(range(len(rows))) and rows[level].iloc[-1] > rows[level].iloc[0]
    assert made("em_fit").sort_values("round")["loglik"].is_monotonic_increasing


def test_rounds_of_parameters(made):
    """The log-likelihoods of the table are those of the fit, and each round has all parameters."""
    rows = made("em_parameters")
    levels = rows[rows["name"] == "loglik"].sort_values("round")["value"].to_numpy()
    assert np.allclose(levels, made("em_fit").sort_values("round")["loglik"].to_numpy()[: len(levels)])
    p = int(rows[rows["name"] == "d"]["j"].max()) + 1
    count = rows.groupby(["round", "name"]).size().unstack()
    assert (count[["A", "Q", "V0"]] == 4).all(axis=None) and (count[["d", "R"]] == p).all(axis=None) and (count["C"] == 2 * p).all()
    assert (rows[rows["name"] == "R"]["value"] > 0).all()


def test_batches_cover_all_days(made):
    rows, whole = made("online_em"), made("em_fit").sort_values("round")["loglik"].iloc[0]
    days = made("kalman_smoother")["trial"].nunique()
    assert rows["trials"].sum() == days and rows["batch"].tolist() == sorted(rows["batch"])
    #: The first batch is scored by the start model, as all days are in the first round of the fit.
    assert abs(rows["loglik"].iloc[0] - whole / days) < 0.5 * abs(whole / days) and rows["loglik"].iloc[-1] > rows["loglik"].iloc[0]


def test_identified_covariances(made):
    """A variable's variance is what states and noise explain; covariances that were seen stay as they are when others are filled in."""
    rows = made("ssid_svd")
    own = rows[(rows["m"] == 0) & (rows["i"] == rows["j"])]
    assert (own["model"] >= own["q"] - 1e-6).all() and np.isfinite(rows["model"]).all()
    filled = made("iter_ssid")
    seen = filled["q"].notna()
    assert seen.any() and (~seen).any() and np.allclose(filled["filled"][seen], filled["q"][seen]) and np.isfinite(filled["filled"]).all()


def test_stitched_covariances_are_symmetric_and_positive_at_lag_0(made):
    rows = made("stitched_lagcov")
    p = rows["i"].max() + 1
    q = np.zeros((p, p))
    own = rows[rows["m"] == 0]
    q[own["i"], own["j"]] = own["q"]
    assert len(rows) == 4 * p * p and np.allclose(q, q.T, atol=1e-8) and np.diag(q).min() > 0


def test_descent_lowers_the_loss(made):
    rows = made("hankel_sgd").sort_values("round")
    assert len(rows) == 12 and rows["loss"].iloc[-3:].mean() < rows["loss"].iloc[:3].mean()


def test_components_of_counts_lower_the_loss(made):
    loss = made("expfam_pca").sort_values("turn")["loss"]
    assert len(loss) == 3 and loss.is_monotonic_decreasing


def test_predictions_and_draws(made):
    """Rates of the last six hours of each day; draws for all hours, on average near the measured counts."""
    rows = made("predict_range")
    assert set(rows["t"]) == set(range(18, 24)) and (rows["rate"] > 0).all()
    drawn, counts = made("plds_sample"), made("bin_spike_times")
    assert (drawn["y"] >= 0).all() and (drawn["y"] == drawn["y"].round()).all() and len(drawn) == len(counts)
    assert 0.2 < (drawn["y"].mean() + 0.05) / (counts["y"].mean() + 0.05) < 8


def test_each_query_without_sql_is_tested_here():
    known = "kalman_smoother kalman_smoother_gap_vector laplace_inference laplace_softplus variational_inference em_fit plds_em em_parameters online_em ssid_svd iter_ssid stitched_lagcov hankel_sgd expfam_pca predict_range plds_sample"
    #: Those of test_low_rank_rates and test_timescales.
    elsewhere = "low_rank_rates em_timescales"
    assert WITHOUT == sorted([*known.split(), *elsewhere.split()])
