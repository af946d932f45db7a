from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from gaugewise.operators import comparison

D = pd.date_range("2000-01-01", "2003-12-31")
X = 5 + 3 * np.sin(2 * np.pi * np.arange(len(D)) / 365.25) + np.convolve(np.random.default_rng(3).gamma(1.0, 3.0, len(D) + 9), np.ones(10) / 10, "valid")


def divergence(a, b):
    edges = np.histogram_bin_edges(np.concatenate([a, b]), bins="auto")
    p, q = (np.histogram(v, edges)[0] + np.finfo(float).eps for v in (a, b))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return 1 - np.sqrt((p * np.log2(p / m)).sum() / 2 + (q * np.log2(q / m)).sum() / 2)


def test_daily_metrics(flow_from):
    y = X * 1.05 + np.cos(np.arange(len(X)))
    pairs = comparison.paired(flow_from({"s": (D, X)}), flow_from({"s": (D, y)}, "series2"))
    got = {r.metric: r.value for r in comparison.daily_metrics(pairs).collect()}
    a, b = pd.Series(X), pd.Series(y)
    r, alpha, beta = np.corrcoef(X, y)[0, 1], y.std() / X.std(), y.mean() / X.mean()
    assert got["pairwise_valid_days"] == len(X) and got["pearson_correlation"] == pytest.approx(r) and got["spearman_correlation"] == pytest.approx(a.rank().corr(b.rank()))
    assert got["nash_sutcliffe_efficiency"] == pytest.approx(1 - ((y - X) ** 2).sum() / ((X - X.mean()) ** 2).sum()) and got["kling_gupta_efficiency"] == pytest.approx(1 - np.sqrt((r - 1) ** 2 + (alpha - 1) ** 2 + (beta - 1) ** 2))
    assert got["percent_bias"] == pytest.approx(100 * (y - X).sum() / X.sum())


def test_constant_side_gives_nulls(flow_from):
    pairs = comparison.paired(flow_from({"s": (D[:9], [1.0] * 9)}), flow_from({"s": (D[:9], range(9))}, "series2"))
    got = {r.metric: r.value for r in comparison.daily_metrics(pairs).collect()}
    assert got["pearson_correlation"] is None and got["nash_sutcliffe_efficiency"] is None and got["kling_gupta_efficiency"] is None and got["mean_bias"] == 3


def test_inverse_jsd_matches_histograms(flow_from, one):
    y = X**1.2
    got = one(comparison.inverse_jsd(flow_from({"s": (D, X)}), flow_from({"s": (D, y)})))["value"]
    back = one(comparison.inverse_jsd(flow_from({"s": (D, y)}), flow_from({"s": (D, X)})))["value"]
    assert got == pytest.approx(divergence(X, y), abs=1e-9) and back == pytest.approx(got, abs=1e-12)
    assert one(comparison.inverse_jsd(flow_from({"s": (D[:3], [2, 2, 2])}), flow_from({"s": (D[:3], [2, 2, 2])})))["value"] == 1.0


def test_a_series_is_like_itself(flow_from, one):
    a = comparison.signatures(flow_from({"s": (D, X)}))
    b = comparison.signatures(flow_from({"s": (D, X)}, "series2"))
    parts = comparison.components(a, b)
    rows = {r.component: r for r in parts.collect()}
    assert len(rows) == 8 and all(r.tier == "Tier 3" for r in rows.values()) and rows["representative_event_shape"].value == pytest.approx(1)
    row = one(comparison.composite(parts))
    assert row["layer2_class"] == "Similar" and row["layer2_score"] == 0 and row["assessable_components"] == 8


def test_unfit_and_disjoint(flow_from):
    a = flow_from([("s", "2000-01-01", 1), ("s", "2000-01-01", 2), ("t", "2000-01-02", 1), ("t", "2000-01-01", 1)])
    b = flow_from([("s", "2000-01-01", None), ("t", "2010-01-01", 1)], "series2")
    got = {r.station_id: r.reason for r in comparison.unfit(a, b).collect()}
    assert got == {"s": "candidate has no valid values; reference has duplicate timestamps", "t": "reference is not sorted"}
    assert comparison.paired(a, b).count() == 0
    base, chosen = comparison.historical(flow_from({"s": (D, X)}), "2001-01-01", "2001-12-31")
    assert base.count() + chosen.count() == len(D) and chosen.count() == 365
