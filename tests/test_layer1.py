from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from gaugewise.operators import layer1 as l1


def test_zero_flow_months(flow_from, one):
    days = pd.date_range("1980-01-01", "1980-03-31")
    values = [None if d.month == 2 else 0.0 if d == pd.Timestamp("1980-01-05") else 1.0 for d in days]
    flow = flow_from({"a": (days, values)})
    row = one(l1.zero_flow_regime(flow))
    assert (row["valid_count"], row["zero_count"]) == (62, 1) and row["zero_ratio"] == pytest.approx(1 / 62) and row["longest_zero_spell_days"] == 1
    assert {r.month: r.zero_ratio for r in l1.zero_flow_months(flow).collect()} == {1: pytest.approx(1 / 31), 3: 0.0}


def test_all_missing_is_not_assessed(flow_from, one):
    flow = flow_from({"a": (pd.date_range("1980-01-01", periods=91), [None] * 91)})
    assert l1.zero_flow_regime(flow).count() == 0
    row = one(l1.missing_values(flow))
    assert row["assessed"] is False and row["value"] is None and one(l1.long_gaps(flow))["value"] is None


def test_gaps_are_counted_in_rows(flow_from, one):
    values = [1, None, None, None, 1, None, None, None, None, 1]
    flow = flow_from({"a": (pd.date_range("2000-01-01", periods=10), values)})
    row = one(l1.long_gaps(flow))
    assert row["value"] == 4 and row["reported_gaps"] == 1 and row["flag"]


def test_negatives_are_strict(flow_from, one):
    flow = flow_from({"a": (pd.date_range("2000-01-01", periods=4), [-0.001, -0.0011, -2, 1])})
    assert one(l1.negative_discharge(flow)) == {"station_id": "a", "series_slot": "series1", "value": 2, "maximum_negative_magnitude": 2.0, "flag": True}


def test_duplicates_count_a_null_as_a_value(flow_from, one):
    flow = flow_from([("a", "2000-01-01", 1), ("a", "2000-01-01", None), ("a", "2000-01-02", 2), ("a", "2000-01-02", 2), ("a", "2000-01-02", 2)])
    row = one(l1.duplicate_timestamps(flow))
    assert (row["value"], row["extra_duplicate_rows"], row["conflicting_groups"]) == (2, 3, 1)
    assert [r["values"] for r in l1.duplicate_groups(flow).orderBy("ts").collect()] == [[1.0, None], [2.0, 2.0, 2.0]]


def test_timestep_uses_source_order(flow_from, one):
    flow = flow_from([("a", "2000-01-02", 1), ("a", "2000-01-01", 1), ("a", "2000-01-05", 1)])
    row = one(l1.timestep_consistency(flow))
    assert (row["value"], row["irregular_spacing_count"], row["out_of_order_rows"]) == (2, 1, 1)
    assert one(l1.timestep_consistency(flow_from([("a", "2000-01-02", 1)])))["assessed"] is False


def test_plateaus_at_the_limit(flow_from):
    def series(n):
        return [1.0] + [5.0004] * n + [2.0]

    days = {n: pd.date_range("2000-01-01", periods=n + 2) for n in (14, 15)}
    got = l1.plateaus(flow_from({f"s{n}": (days[n], series(n)) for n in days})).collect()
    assert [(r.station_id, r.observation_count, r.plateau_value, r.value_before, r.value_after) for r in got] == [("s15", 15, 5.0, 1.0, 2.0)]
    with pytest.raises(ValueError):
        l1.plateaus(flow_from([]), 1)


def _noise(n=3650):
    return 10 + np.sin(np.arange(n) * 0.7) + 0.2 * np.cos(np.arange(n) * 2.3)


def test_spike_dip_and_context(flow_from):
    x = _noise()
    x[100], x[300] = 90.0, -60.0
    x[98], x[298] = x[99] + 1, x[299] - 1  # no coherent rise or fall around them
    y = _noise()
    y[100:105] = [30, 60, 95, 60, 30]
    days = pd.date_range("2000-01-01", periods=len(x))
    z = list(_noise())
    z[200], z[202] = 95.0, None
    got = {(r.station_id, r.ts.isoformat()): (r.type, r.status) for r in l1.spike_candidates(flow_from({"a": (days, x), "b": (days, y), "c": (days, z)})).collect()}
    assert got[("a", "2000-04-10")] == ("spike", "candidate") and got[("a", "2000-10-27")] == ("dip", "candidate")
    assert ("b", "2000-04-12") not in got or got[("b", "2000-04-12")][1] == "rejected_coherent"
    assert got[("c", "2000-07-19")] == ("spike", "rejected_context")
    assert l1.spike_candidates(flow_from({"a": (days, [1.0] * len(days))})).count() == 0


def test_row_order_does_not_matter(flow_from):
    x = _noise()
    x[50] = 80
    days = pd.date_range("2000-01-01", periods=3650)
    rows = [("a", d, v) for d, v in zip(days, x, strict=True)]
    a = {tuple(r) for r in l1.spike_candidates(flow_from(rows)).collect()}
    b = {tuple(r) for r in l1.spike_candidates(flow_from(rows[::-1])).collect()}
    assert a == b and a
