from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gaugewise.operators import layer1, layer2


def filtered(x: np.ndarray, alpha: float = 0.925, passes: int = 3) -> np.ndarray:
    """The filter as its recursion says."""
    for n in range(passes):
        y = x if n % 2 == 0 else x[::-1]
        q = 0.0
        out = [y[0]]
        for a, b in zip(y, y[1:], strict=False):
            q = max(alpha * q + (1 + alpha) / 2 * (b - a), 0.0)
            out.append(min(max(b - q, 0.0), b))
        x = np.asarray(out if n % 2 == 0 else out[::-1])
    return x


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1000), min_size=40, max_size=120))
def test_baseflow_closed_form_is_the_recursion(flow_from, values):
    x = np.asarray(values) + 1.0
    got = layer2.baseflow(flow_from({"a": (pd.date_range("2001-01-01", periods=len(x)), x)})).collect()
    assert got[0].baseflow_index == pytest.approx(filtered(x).sum() / x.sum(), rel=1e-9)


def test_baseflow_splits_segments_and_years(flow_from):
    days = pd.date_range("2000-12-20", periods=40).delete([20])
    x = np.random.default_rng(1).uniform(1, 9, len(days))
    got = {r.year: r.baseflow_index for r in layer2.baseflow(flow_from({"a": (days, x)})).collect()}
    parts = [x[:12]], [x[12:20], x[20:]]
    for year, segments in zip((2000, 2001), parts, strict=True):
        assert got[year] == pytest.approx(sum(filtered(s).sum() for s in segments) / sum(s.sum() for s in segments))


def test_flood(flow_from, one):
    flow = flow_from({"a": (pd.date_range("2000-01-01", periods=9), [1, 1, 2, 4, 8, 5, 3, 1, 1])})
    e = one(layer2.high_flow_events(flow, 0.95, 0.7))
    assert str(e["peak_date"]) == "2000-01-05" and e["peak_flow"] == 8 and e["curve"] == [4, 8, 5] and e["time_to_peak_days"] == 1 and e["event_duration_days"] == 3
    assert e["rising_slope"] == 4 and e["recession_slope"] == -3
    with pytest.raises(ValueError):
        layer2.high_flow_events(flow, 0.5, 0.9)
    assert layer2.high_flow_events(flow_from({"a": (pd.date_range("2000-01-01", periods=2), [1, 2])})).count() == 0


def test_annual_table_of_a_sine(flow_from):
    days = pd.date_range("2000-01-01", "2001-12-31")
    x = 2 + np.sin(2 * np.pi * np.arange(len(days)) / 365.25)
    rows = {r.year: r for r in layer2.annual_signatures(flow_from({"a": (days, x)})).collect()}
    s = pd.Series(x, days)
    for year, r in rows.items():
        y = s[s.index.year == year]
        assert r.mean_flow == pytest.approx(y.mean()) and r.median_flow == pytest.approx(y.median()) and r.usable_months == 12
        assert r.flashiness_index == pytest.approx(y.diff().abs().sum() / y.sum()) and r.lag1_autocorrelation == pytest.approx(np.corrcoef(y[1:], y[:-1])[0, 1])
        m = y.groupby(y.index.month).mean()
        assert r.seasonality_index == pytest.approx((m - m.sum() / 12).abs().sum() / m.sum())
        assert r.wettest_month == int(y.groupby(y.index.month).median().idxmax())


def test_crosscheck_and_representative(flow_from):
    x = 10 + np.sin(np.arange(3650) * 0.7)
    x[100] = 300
    for at in (200, 260, 320):
        x[at : at + 5] = [30, 60, 70, 60, 30]
    flow = flow_from({"a": (pd.date_range("2000-01-01", periods=3650), x)})
    spikes = layer1.spike_candidates(flow).where("status = 'candidate'").select("station_id", "series_slot", "ts", "type")
    events = layer2.high_flow_events(flow, 0.998, 0.9965)
    checked = layer2.crosscheck(spikes, events)
    assert [r.crosscheck_status for r in checked.collect()] == ["spike_peak_overlap_review"]
    eligible = layer2.representative_eligibility(events, checked)
    shown = layer2.representative_event(eligible).collect()
    assert eligible.where("not representative_eligible").count() == 1 and shown[0].peak_flow == 70 and shown[0].event_id == 2


def test_empty_and_constant(flow_from):
    assert layer2.annual_signatures(flow_from([])).count() == 0
    row = layer2.annual_signatures(flow_from({"a": (pd.date_range("2000-01-01", periods=366), [0.0] * 366)})).collect()[0]
    assert row.flashiness_index is None and row.baseflow_index is None and row.lag1_autocorrelation is None and row.seasonality_index is None
