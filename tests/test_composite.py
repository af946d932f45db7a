from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from gaugewise.config import LAYER1, overlay, settings
from gaugewise.operators import composite, epoch_drift, network, step_shift


def days(years, start=1990):
    return pd.date_range(f"{start}-01-01", f"{start + years - 1}-12-31")


def season(d, seed=0):
    return 5 + 2 * np.sin(2 * np.pi * d.dayofyear / 365.25) + np.random.default_rng(seed).normal(0, 0.2, len(d))


def test_one_step_is_found_and_dated(flow_from):
    d = days(20)
    x = season(d) + np.where(d.year >= 2000, 6.0, 0.0)
    flow = flow_from({"step": (d, x), "none": (d, season(d, 1))})
    got = step_shift.tiered_boundaries(flow).collect()
    assert len(got) == 1 and got[0].station_id == "step" and got[0].tier == "Tier 1" and str(got[0].boundary_date) == "2000-01-01"
    rows = {r.station_id: r for r in step_shift.step_shift(flow).collect()}
    assert rows["step"].tier == "Tier 1" and rows["none"].tier == "Tier 3" and rows["step"].block_years == 4 and rows["none"].assessed


def test_short_record_has_no_blocks(flow_from, one):
    row = one(step_shift.step_shift(flow_from({"a": (days(2), season(days(2)))})))
    assert row["assessed"] is False and row["tier"] is None


def test_trend_then_plateau(flow_from, one):
    d = days(20)
    x = season(d) * np.exp(np.clip(d.year - 1990, 0, 10) * 0.12)
    flow = flow_from({"a": (d, x)})
    states = [r.state for r in epoch_drift.epochs(flow).orderBy("epoch").collect()]
    assert states[:2] == ["rising", "rising"] and states[-1] == "stable"
    row = one(epoch_drift.epoch_drift(flow))
    assert row["dominant_state"] == "rising" and row["epoch_count"] == 4 and row["assessed_years"] == 20
    assert epoch_drift.overview(flow).count() >= 1


def only(*names):
    return {n: {"enabled": n in names} for n in composite.CHECKS}


def test_focused_duplicate_check(flow_from, one):
    d = pd.date_range("2000-01-01", periods=731)
    flow = flow_from([("a", d[0], 2.0), *[("a", t, 2 + np.sin(i / 60)) for i, t in enumerate(d)]])
    s = only("duplicate_timestamps")
    row = one(composite.composite(composite.components(flow, s), s))
    assert row["layer1_class"] == "Needs review" and row["layer1_score_percent"] == 100 and row["assessment_scope"] == "Focused" and (row["enabled_check_count"], row["total_composite_check_count"]) == (1, 9)


def test_missing_and_gap_tiers(flow_from):
    d = pd.date_range("2000-01-01", periods=200)
    x = np.linspace(1, 2, 200)
    series = {"t3": x.copy(), "t2": x.copy(), "t1": x.copy()}
    series["t2"][50:64:1] = np.nan
    series["t1"][50:90] = np.nan
    got = {(r.station_id, r.check): r.tier for r in composite.tiers(flow_from({k: (d, v) for k, v in series.items()}), only("missing_values", "long_gaps")).collect()}
    assert got == {("t3", "missing_values"): "Tier 3", ("t3", "long_gaps"): "Tier 3", ("t2", "missing_values"): "Tier 2", ("t2", "long_gaps"): "Tier 2", ("t1", "missing_values"): "Tier 1", ("t1", "long_gaps"): "Tier 1"}


def test_negative_tier_against_low_flow(flow_from):
    d = pd.date_range("2000-01-01", periods=100)
    small, large = np.full(100, 5.0), np.full(100, 5.0)
    small[3], large[3] = -1.0, -6.0
    got = {r.station_id: r.tier for r in composite.tiers(flow_from({"small": (d, small), "large": (d, large)}), only("negative_discharge")).collect()}
    assert got == {"small": "Tier 2", "large": "Tier 1"}


def test_nothing_to_assess(flow_from, one):
    flow = flow_from({"a": (pd.date_range("2000-01-01", periods=3), [None] * 3)})
    s = only("missing_values", "negative_discharge")
    row = one(composite.composite(composite.components(flow, s), s))
    assert row["layer1_class"] == "Not assessable" and row["unavailable_checks"] == "missing_values; negative_discharge" and row["layer1_score_percent"] is None


def test_network_tables(spark):
    rows = [("a", "series1", "Needs review", 50.0), ("a", "series2", "No review needed", 0.0), ("b", "series1", "Minor concerns", 10.0), ("c", "series1", "Needs review", None)]
    summary = spark.createDataFrame(rows, "station_id string, series_slot string, layer1_class string, layer1_score_percent double")
    counts = {r.layer1_class: (r.series_count, r.station_count) for r in network.assessment_counts(summary).collect()}
    assert counts == {"Needs review": (2, 2), "No review needed": (1, 0), "Minor concerns": (1, 1)}
    ranks = {(r.station_id, r.series_slot): r.attention_rank for r in network.attention_ranking(summary).collect()}
    assert ranks == {("a", "series1"): 1, ("c", "series1"): 2, ("b", "series1"): 3, ("a", "series2"): 0}
    strong = spark.createDataFrame([("a", "Strong review"), ("b", "Review")], "station_id string, layer2_class string")
    assert {r.station_id: (r.review_required, r.strong_review) for r in network.requires_review(strong).collect()} == {"a": (False, True), "b": (True, False)}


def test_settings():
    assert overlay(LAYER1, {"spike_dip": {"minimum_score": 9}})["spike_dip"]["minimum_recovery"] == 0.8 and LAYER1["spike_dip"]["minimum_score"] == 8.0
    with pytest.raises(ValueError, match="layer1.spike_dip.minimum_scor"):
        settings({"layer1": {"spike_dip": {"minimum_scor": 9}}})
