from __future__ import annotations

import glob

import numpy as np
import pandas as pd

from gaugewise.operators import evidence, step_shift
from gaugewise.operators.primitives import prepared
from gaugewise.sinks import evidence as text

KEYS = ["station_id", "series_slot"]


def test_twelve_tables(flow_from):
    d = pd.date_range("1990-01-01", "2009-12-31")
    x = 5 + 2 * np.sin(2 * np.pi * np.asarray(d.dayofyear) / 365.25) + np.random.default_rng(1).normal(0, 0.2, len(d)) + np.where(d.year >= 2000, 6.0, 0.0)
    x[100:140], x[2000:2030], x[3000:3020] = np.nan, 4.0, 0.0
    flow = prepared(flow_from({"a": (d, x), "none": (d[:5], [None] * 5)}))
    tables = evidence.layer1_evidence(flow)
    assert list(tables) == list(evidence.LAYER1_TABLES)
    rows = {n: df.collect() for n, df in tables.items()}
    assert all(set(KEYS) <= set(df.columns) for df in tables.values()) and not any(r.station_id == "none" for n in rows for r in rows[n])
    assert [(r.missing_count, str(r.start_ts)[:10]) for r in rows["missing_intervals"]] == [(40, "1990-04-11")] and len(rows["long_gaps"]) == 1
    assert len(rows["nonzero_plateau_periods"]) == 1 and len(rows["zero_flow_spells"]) == 1 and len(rows["epoch_drift_annual_evidence"]) == 20 and len(rows["epoch_drift_five_year_epochs"]) == 4
    shifts = [r for r in rows["step_shift_boundaries"] if r.diagnosis != "Tier 3"]
    regimes = sorted(rows["step_shift_regimes"], key=lambda r: r.regime)
    assert len(regimes) == len(shifts) + 1 and str(regimes[0].start) == "1990-01-01" and str(regimes[-1].end) == "2009-12-31" and sum(r.valid_day_count for r in regimes) == np.isfinite(x).sum()
    assert [r.start for r in regimes[1:]] == [r.boundary for r in shifts] and regimes[0].median < 6 < regimes[-1].median
    assert {r.period for r in rows["epoch_drift_diagnosis"]} == {f"{r.first_year}-{r.last_year}" for r in rows["epoch_drift_overview_slopes"]}
    off = evidence.layer1_evidence(flow, {"step_shift": {"enabled": False}})
    assert set(tables) - set(off) == {"step_shift_boundaries", "step_shift_regimes"}


def test_one_regime_without_shifts(flow_from):
    d = pd.date_range("1990-01-01", "2009-12-31")
    flow = flow_from({"a": (d, 5 + np.sin(2 * np.pi * d.dayofyear / 365.25)), "short": (d[:400], np.ones(400))})
    assert step_shift.tiered_boundaries(flow).count() == 0
    rows = evidence.regimes(flow).collect()
    assert [(r.station_id, r.regime, str(r.start), str(r.end), r.valid_day_count) for r in rows] == [("a", 1, "1990-01-01", "2009-12-31", len(d))]


def test_reports_are_written_in_order(spark, tmp_path):
    """Records numbered, nulls left out, long values wrapped, series without evidence said to have none."""
    series = spark.createDataFrame([("a", "series1"), ("b", "series1"), ("a", "series1")], "station_id string, series_slot string")
    gaps = spark.createDataFrame([("a", "series1", pd.Timestamp("2000-02-01").date(), 3.0, None), ("a", "series1", pd.Timestamp("2000-01-01").date(), 2.25, "word " * 40), ("gone", "series1", None, None, None)], "station_id string, series_slot string, start date, mean_size double, note string")
    one = spark.createDataFrame([("a", "series1", [1, 2])], "station_id string, series_slot string, parts array<int>")
    text.write_reports(text.evidence_lines(series, {"long_gaps": gaps, "other": one}, "Layer 1").repartition(7), str(tmp_path / "e"))
    files = glob.glob(f"{tmp_path}/e/name=*/*.txt")
    assert len(files) == 2
    a, b = (open([f for f in files if f"name={n}_series1" in f][0]).read().splitlines() for n in "ab")
    assert a[1].strip() == "LAYER 1 EVIDENCE" and a[0] == "=" * 80 and a.index("LONG GAPS") < a.index("  Record 1") < a.index("  Record 2") < a.index("OTHER") < len(a) - 2
    start = [x for x in a if x.startswith("    Start")]
    assert [x[-10:].strip() for x in start] == ["1 Jan 2000", "1 Feb 2000"] and any(x.endswith(" 2.250") for x in a) and any(x.endswith(" 3") for x in a) and any(x.endswith("[1,2]") for x in a)
    note = a.index("    Note:")
    assert a[note + 1].startswith("      word word") and len(a[note + 1]) <= 74 and sum("word" in x for x in a) == 4 and a.count("  Record 1") == 1
    assert "  No detailed evidence was recorded." in b and "LONG GAPS" not in b and b[-2].strip() == "End of evidence report."


def test_network_summary_has_blocks(spark, tmp_path):
    summary = spark.createDataFrame(
        [("a", "series1", "Gauge", "observation", "Needs review", "Focused", 1, 9, 3, 62.5, "assessed", "Low agreement"), ("a", "series2", "Model", None, "No review needed", "Full", 9, 9, 0, 0.0, "not_assessed", None), ("b", "series1", "Gauge", None, None, None, None, None, None, None, "not_assessed", None)],
        "station_id string, series_slot string, series_name string, series_role string, layer1_class string, layer1_assessment_scope string, layer1_enabled_check_count int, layer1_total_composite_check_count int, layer1_score long, layer1_score_percent double, layer3_status string, layer3_context_agreement_class string",
    )
    ranking = spark.createDataFrame([("a", "series1", "Needs review", 62.5, 1)] + [(f"z{i}", "series1", "Minor concerns", None, i) for i in range(2, 24)], "station_id string, series_slot string, layer1_class string, layer1_score_percent double, attention_rank int")
    triggers = spark.createDataFrame([("step_shift", 0, 0, 0, 0, 2), ("missing_values", 2, 1, 1, 2, 1)], "check string, assessable_count long, tier1_count long, tier2_count long, triggered_count long, place int")
    text.write_in_order(text.network_lines(summary, ranking, triggers), str(tmp_path / "n"))
    lines = [x for f in sorted(glob.glob(f"{tmp_path}/n/part-*")) for x in open(f).read().splitlines()]

    def after(label):
        return next(x.split(".. ")[-1] for x in lines if x.startswith(label + " "))

    assert (after("  Unique stations"), after("  Station-series assessments"), after("    Needs review (one or more series)"), after("    Minor concerns only")) == ("2", "3", "1", "0")
    assert lines.count("    Not assessed " + "." * 31 + " 1") == 2 and "  3 additional concerning station-series are in the ranking table." in lines
    ranks = [int(x[2:6]) for x in lines if x[6:8] == "  " and x[2:6].strip().isdigit()]
    assert ranks == list(range(1, 21)) and lines.index("a  -  Gauge") < lines.index("a  -  Model") < lines.index("b  -  Gauge")
    table = [x for x in lines if x.startswith("  MISSING VALUES") or x.startswith("  STEP SHIFT")]
    assert table[0].split() == ["MISSING", "VALUES", "2", "1", "1", "2", "100.0%"] and table[1].split()[-1] == "-"
    assert "  Layer 1 status ............................... Needs review (selected checks only)" in lines and "  Contextual agreement ......................... Low agreement" in lines and max(map(len, lines)) <= 100
