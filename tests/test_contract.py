from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from gaugewise.operators import comparison, composite, context, contract, network
from gaugewise.operators.primitives import prepared


def record(years=9, seed=3):
    d = pd.date_range("2000-01-01", periods=365 * years)
    x = 5 + 3 * np.sin(2 * np.pi * np.arange(len(d)) / 365.25) + np.convolve(np.random.default_rng(seed).gamma(1.0, 3.0, len(d) + 9), np.ones(10) / 10, "valid")
    return d, x


def test_wide_rows_of_a_station(flow_from):
    d, x = record()
    bad = x.copy()
    bad[100:140] = np.nan  # a gap of 40 days
    bad[300:340] = 7.0  # a plateau
    bad[500] = -2.0
    bad[900] *= 40  # a spike
    rows = [("a", t, None if np.isnan(v) else float(v)) for t, v in zip(d, bad, strict=True)] + [("a", d[-1], 1.0)] + [("b", t, None) for t in d[:5]]
    flow = prepared(flow_from(rows))
    found = composite.screened(flow)
    one = contract.layer1_summary(flow, found)
    assert len([c for c in one.columns if c.startswith("threshold_")]) == 18 and len(one.columns) == 2 + 37 + 18
    got = {r.station_id: r for r in one.collect()}
    a, b = got["a"], got["b"]
    assert (a.missing_day_count, a.long_gap_count, a.longest_gap_days, a.duplicate_timestamp_count, a.duplicate_extra_row_count) == (40, 1, 40, 1, 1)
    assert (a.negative_discharge_count, a.most_negative_discharge_magnitude, a.nonzero_plateau_count, a.longest_nonzero_plateau_days) == (1, 2.0, 1, 40)
    assert a.missing_percentage == pytest.approx(100 * 40 / (len(d) + 1)) and a.spike_count >= 1 and a.unresolved_spike_dip_count == a.spike_count + a.dip_count and a.threshold_spike_robust_cutoff_used >= 8
    assert a.layer1_scope_conclusion == f"Overall Layer 1 assessment: {a.layer1_class}." and a.layer1_enabled_checks == "; ".join(composite.CHECKS)
    assert a.layer1_primary_concerns.startswith("long_gaps; duplicate_timestamps") and (b.missing_day_count, b.spike_count, b.missing_percentage) == (0, 0, None)
    two = contract.layer2_summary(flow, found)
    r = {x.station_id: x for x in two.collect()}
    assert set(r) == {"a"} and r["a"].valid_observation_count == len(d) - 39 and r["a"].annual_signature_year_count == 9 and r["a"].threshold_high_flow_trigger_value >= r["a"].threshold_high_flow_boundary_value
    assert r["a"].high_flow_event_count == found["events"].where("station_id = 'a'").count() and 1 <= r["a"].typical_wettest_month <= 12
    whole = contract.station_summary(flow, one, two, names={"series1": {"name": "gauge", "role": "observation", "units": "m3/s"}})
    got = {r.station_id: r for r in whole.collect()}
    assert (got["a"].series_name, got["a"].unit, got["a"].layer1_class, got["a"].layer2_valid_observation_count, got["a"].layer3_status) == ("gauge", "m3/s", a.layer1_class, len(d) - 39, "not_assessed")
    assert got["a"].threshold_layer1_spike_minimum_score == 8 and got["a"].threshold_layer2_high_flow_trigger_percentile == 0.95 and got["b"].valid_observation_count == 0 and got["b"].layer2_mean_discharge is None


def test_disabled_checks_have_no_metrics(flow_from, one):
    settings = {n: {"enabled": n == "duplicate_timestamps"} for n in composite.CHECKS}
    flow = prepared(flow_from({"a": record(1)}))
    row = one(contract.layer1_summary(flow, composite.screened(flow, settings), settings))
    assert row["missing_day_count"] == 0 and row["missing_percentage"] is None and row["step_shift_tier"] is None and row["duplicate_timestamp_count"] == 0
    assert row["layer1_scope_conclusion"] == "Focused Layer 1 assessment: No concerns detected within the selected checks." and row["layer1_enabled_checks"] == "duplicate_timestamps" and row["layer1_primary_concerns"] == "None"


def test_context_contract(spark, flow_from):
    d, x = record()
    flow = flow_from({s: (d, x) for s in ("a", "b")} | {"far": (d, x[::-1].copy())})
    names = "station_id string, longitude double, latitude double, river_name string, catchment_name string, catchment_area_km2 double, series_type string, climate_code string"
    s = spark.createDataFrame([("a", 0.0, 50.0, "r", "c", 100.0, "observation", "C1"), ("b", 0.1, 50.0, "r", "c", 100.0, "observation", "C1"), ("far", 90.0, 0.0, "q", "e", 9.0, "observation", "C2")], names)
    found = context.network_context(flow, s)
    rows = {r.station_id: r for r in contract.context_summary(found).collect()}
    a, far = rows["a"], rows["far"]
    assert a.context_agreement_score_percent == pytest.approx(100) and a.context_agreement_class == a.nearby_gauge_agreement_class == "Strong agreement" and (a.nearby_gauge_count, a.comparable_catchment_count) == (1, 0)
    assert (far.context_agreement_class, far.nearby_gauge_count, far.nearby_checks_assessed, far.context_agreement_score_percent) == ("Not assessed", 0, 0, None)
    assert a.threshold_nearby_context_weight == 0.7 and a.nearby_checks_supported == a.nearby_checks_assessed > 5
    evidence = contract.context_evidence(found)
    kinds = {(r.evidence_type, r.context_group): r["count"] for r in evidence.groupBy("evidence_type", "context_group").count().collect()}
    assert kinds["context_check", None] == 20 and kinds["nearby_gauge", None] == 2 and kinds["peer_metric_comparison", "nearby_gauge"] == 20
    flow = flow.where("station_id in ('a', 'far')")
    status = {r.station_id: r.layer3_status for r in contract.station_summary(flow, layer3=contract.context_summary(found), places=s.unionByName(s)).collect()}
    assert status == {"a": "assessed", "far": "not_assessed"}


def test_supplied_metrics(spark):
    rows = [("a", "reference", "KGE", 0.8), ("a", "reference", "NSE", None), ("a", "candidate", "KGE", 0.7), ("a", "candidate", "KGE", 0.7), (None, "candidate", "KGE", 0.1), ("b", "candidate", None, 0.1)]
    table = spark.createDataFrame(rows, "station_id string, provider string, metric string, value double")
    got = {(r.station_id, r.provider): r.metrics for r in comparison.supplied_metrics(table).collect()}
    assert got == {("a", "reference"): {"KGE": 0.8, "NSE": None}, ("a", "candidate"): {"KGE": 0.7}}
    assert comparison.supplied_metrics(table.limit(0)).count() == 0


def test_ranking_over_many_tasks(spark):
    g = np.random.default_rng(1)
    classes = list(network.PRIORITY)
    rows = [(f"s{i:03}", "series1", classes[g.integers(4)], None if i % 17 == 0 else float(g.integers(5))) for i in range(200)]
    got = {r.station_id: r.attention_rank for r in network.attention_ranking(spark.createDataFrame(rows, "station_id string, series_slot string, layer1_class string, layer1_score_percent double")).collect()}
    order = sorted((r for r in rows if network.PRIORITY[r[2]] >= 2), key=lambda r: (-network.PRIORITY[r[2]], r[3] is None, -(r[3] or 0), r[0]))
    assert got == {r[0]: 0 for r in rows} | {r[0]: i for i, r in enumerate(order, 1)}
    assert network.attention_ranking(spark.createDataFrame(rows[:0], "station_id string, series_slot string, layer1_class string, layer1_score_percent double")).count() == 0
