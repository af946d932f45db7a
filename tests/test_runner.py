from __future__ import annotations

import glob

import numpy as np
import pandas as pd
import pytest

from gaugewise.__main__ import main
from gaugewise.operators import composite
from gaugewise.plans.runner import Settings, run
from gaugewise.streaming.incremental import latest, screen_stream

BASE = {"run": {"all_stations": True}, "series1": {"format": "csv", "path": "x.csv", "units": "m3/s"}}


def wide(path, factor=1.0, stations=("A", "B")):
    days = pd.date_range("2000-01-01", periods=730)
    frame = pd.DataFrame({"date": days.strftime("%Y-%m-%d")} | {s: factor * (2 + k + np.sin(np.arange(730) / 58 + 0.1 * k)) for k, s in enumerate(stations)})
    frame.to_csv(path, index=False)
    return str(path)


@pytest.mark.parametrize("change, message", [
    ({"run": {}}, "choose one"), ({"run": {"all_stations": True, "station_ids": ["a"]}}, "choose one"), ({"series1": {"format": "xls", "path": "x", "units": "u"}}, "format"), ({"series1": {"format": "csv", "path": "x"}}, "units"),
    ({"series1": {"format": "result_pickle", "path": "x", "units": "u"}}, "trusted"), ({"series1": {"format": "netcdf", "path": "x", "units": "u"}}, "variable"), ({"series1": BASE["series1"] | {"timespan": {"mode": "range", "start_date": "2001-01-02", "end_date": "2001-01-01"}}}, "order"),
    ({"series1": BASE["series1"] | {"timespan": {"start_date": "2001-01-02"}}}, "range"), ({"layers": {"comparison": True}}, "series2"), ({"layers": {"layer1": False, "layer3": True}}, "layer 3"), ({"layer1": {"spike_dips": {}}}, "spike_dips"), ({"output": {"html_mode": "some"}}, "html_mode"),
    ({"layers": {"comparison": True}, "series2": {"enabled": True, "format": "csv", "path": "y", "units": "l/s"}}, "equal units"), ({"layers": {"comparison": True}, "series2": {"enabled": True, "format": "csv", "path": "y", "name": "series1"}}, "distinct"),
])
def test_settings_are_checked(change, message):
    with pytest.raises(ValueError, match=message):
        Settings(**(BASE | change))


def test_configured_run(spark, tmp_path, capsys):
    wide(tmp_path / "a.csv")
    wide(tmp_path / "b.csv", 1.05)
    (tmp_path / "context.csv").write_text("station_id,longitude,latitude,river_name,catchment_name,catchment_area_km2,series_type\nA,0,50,r,c,100,obs\nB,0.1,50,r,c,120,obs\n")
    (tmp_path / "metrics.csv").write_text("station_id,metric,value\nA,KGE,0.9\nB,KGE,bad\n")
    config = tmp_path / "run.toml"
    config.write_text(f"""
[run]
all_stations = true
[layers]
comparison = true
layer3 = true
[series1]
format = "csv"
path = "{tmp_path}/a.csv"
units = "m3/s"
[series2]
enabled = true
format = "csv"
path = "{tmp_path}/b.csv"
units = "m3/s"
metrics_path = "{tmp_path}/metrics.csv"
[comparison]
calculate_daily_metrics = true
[context]
path = "{tmp_path}/context.csv"
[output]
directory = "{tmp_path}/out"
html_mode = "all"
write_csv = true
""")
    assert main(["run", "--config", str(config)]) == 0 and "completed: 2" in capsys.readouterr().out
    out = f"{tmp_path}/out"
    assert spark.read.parquet(f"{out}/tables/composite").count() == 4
    metrics = {(r.station_id, r.metric): r.value for r in spark.read.parquet(f"{out}/tables/daily_metrics").collect()}
    assert metrics["A", "mean_ratio"] == pytest.approx(1.05) and metrics["B", "pearson_correlation"] == pytest.approx(1)
    assert {r.layer2_class for r in spark.read.parquet(f"{out}/tables/comparison_composite").collect()} <= {"Similar", "Review", "Strong review"}
    assert spark.read.parquet(f"{out}/tables/context_combined").count() == 2
    assert {(r.station_id, r.provider): r.metrics for r in spark.read.parquet(f"{out}/tables/supplied_metrics").collect()} == {("A", "candidate"): {"KGE": 0.9}, ("B", "candidate"): {"KGE": None}}
    summary = {(r.station_id, r.series_slot): r for r in spark.read.parquet(f"{out}/tables/station_summary").collect()}
    assert len(summary) == 4 and summary["A", "series1"].river_name == "r" and summary["A", "series1"].unit == "m3/s" and summary["A", "series1"].layer3_status == "assessed"
    assert summary["A", "series2"].comparison_layer2_class is not None and summary["A", "series1"].comparison_layer2_class is None and summary["B", "series2"].layer3_status == "not_assessed"
    pages = [open(p).read() for p in glob.glob(f"{out}/pages/name=*/*.txt")]
    assert len(pages) == 4 and all("<svg" in p and "missing_values" in p for p in pages)
    reports = [open(p).read() for p in glob.glob(f"{out}/reports/name=*/*.txt")]
    assert len(reports) == 4 and all("SCREENING SUMMARY" in p and "Requested timespan" in p and "Selected calendar" in p and "Evidence coverage" in p for p in reports) and all(len(x) <= 84 for p in reports for x in p.splitlines())
    status = "".join(open(p).read() for p in glob.glob(f"{out}/status/part-*"))
    assert [x.split("\t")[:2] for x in status.splitlines()] == [["A", "completed"], ["B", "completed"]]
    assert glob.glob(f"{out}/csv/components/*.csv") and glob.glob(f"{out}/csv/evidence_step_shift_regimes/*.csv") and len(glob.glob(f"{out}/evidence/layer1/name=*/*.txt")) == 4 and len(glob.glob(f"{out}/evidence/comparison/name=*/*.txt")) == 2 and len(glob.glob(f"{out}/evidence/layer3/name=*/*.txt")) == 2 and glob.glob(f"{out}/settings/part-*") and "ATTENTION" in "".join(open(p).read() for p in glob.glob(f"{out}/network/part-*"))


def test_exit_codes(spark, tmp_path):
    assert main(["run", "--config", str(tmp_path / "none.toml")]) == 2
    (tmp_path / "a.csv").write_text("date,A,B\n2000-01-01,1,\n2000-01-02,2,\n")
    config = tmp_path / "run.toml"
    config.write_text(f'[run]\nall_stations = true\n[layers]\nlayer1 = false\n[series1]\nformat = "csv"\npath = "{tmp_path}/a.csv"\nunits = "u"\n')
    assert main(["run", "--config", str(config)]) == 1
    config.write_text("[runs]\n")
    assert main(["run", "--config", str(config)]) == 2


def test_unfit_station_fails_alone(spark, tmp_path):
    wide(tmp_path / "a.csv")
    lines = (tmp_path / "a.csv").read_text().splitlines()
    (tmp_path / "b.csv").write_text("\n".join([lines[0].replace("B", "C"), *lines[1:]]))
    s = Settings(run={"station_ids": ["A"]}, series1={"format": "csv", "path": str(tmp_path / "a.csv"), "units": "u"}, series2={"enabled": True, "format": "csv", "path": str(tmp_path / "b.csv")}, layers={"layer1": False})
    assert [tuple(r)[:2] for r in run(spark, s)["manifest"].collect()] == [("A", "completed")]


def test_stream(spark, flow_from, tmp_path):
    def screen(flow):
        keep = {n: {"enabled": n == "missing_values"} for n in composite.CHECKS}
        return composite.composite(composite.components(flow, keep), keep)

    days = pd.date_range("2000-01-01", periods=40)
    first = flow_from({"a": (days[:20], [1.0] * 20), "b": (days[:20], [1.0] * 20)})
    second = flow_from({"a": (days[20:], [None] * 19 + [1.0])})
    for i, part in enumerate((first, second)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        query = screen_stream(stream, str(tmp_path / "table"), str(tmp_path / "results"), screen, str(tmp_path / "check"))
        query.awaitTermination(120)
        assert query.exception() is None and i in (0, 1)
    got = {r.station_id: r.layer1_class for r in latest(spark.read.parquet(str(tmp_path / "results"))).collect()}
    assert got == {"a": "Needs review", "b": "No review needed"}


def test_station_reports_alone(spark):
    """Numbers with fixed decimals and no separators of thousands; a null is not provided."""
    from gaugewise.sinks import reports

    composite = spark.createDataFrame(
        [("a", "series1", 3, "Needs review", 12.345, "Focused", 2, 9, 2, 100.0), ("b", "series1", 0, "Not assessable", None, "Full", 9, 9, 0, 0.0)],
        "station_id string, series_slot string, layer1_score long, layer1_class string, layer1_score_percent double, assessment_scope string, enabled_check_count int, total_composite_check_count int, assessable_checks long, evidence_coverage_percent double",
    )
    parts = spark.createDataFrame([("a", "series1", "long_gaps", "Tier 1", 1234.5, 2), ("b", "series1", "long_gaps", "Not assessable", None, 2)], "station_id string, series_slot string, check string, tier string, raw_value double, weight int")
    record = spark.createDataFrame([("a", "series1", 10, 12345.678, 2.0, 0.0, 9.0, 1.0, 8.0)], "station_id string, series_slot string, valid_count long, mean_flow double, median_flow double, minimum_flow double, maximum_flow double, q05_low_flow double, q95_high_flow double")
    available = spark.createDataFrame([("a", "series1", None, None, 10)], "station_id string, series_slot string, first_valid date, last_valid date, calendar_count long")
    text = {r.name: r.text for r in reports.station_reports(composite, parts, record, available).collect()}
    assert "12345.678" in text["a_series1"] and "1234.500" in text["a_series1"] and "12.3%" in text["a_series1"] and "Needs review (selected checks only)" in text["a_series1"]
    assert "not provided" in text["b_series1"] and max(map(len, text["a_series1"].split("\n"))) <= 100
