from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest

from gaugewise.operators import failures
from gaugewise.plans.runner import Settings, assess, run
from gaugewise.sinks import store
from gaugewise.sources import readers
from gaugewise.sources.provenance import Sourced

FOCUS = {n: {"enabled": n in ("missing_values", "long_gaps", "duplicate_timestamps")} for n in ("missing_values", "long_gaps", "duplicate_timestamps", "timestep_consistency", "negative_discharge", "spike_dip", "low_variability", "step_shift", "epoch_drift")}


def csv(path, columns: dict, days: int = 400, first: str = "2000-01-01") -> str:
    dates = pd.date_range(first, periods=days).strftime("%Y-%m-%d")
    frame = pd.DataFrame({"date": dates} | {s: v if isinstance(v, list) else 2 + np.sin(np.arange(days) / 58) * v for s, v in columns.items()})
    frame.to_csv(path, index=False)
    return str(path)


def config(path, out=None, ids=None, **more) -> Settings:
    run_ = {"station_ids": ids} if ids else {"all_stations": True}
    output = {"output": {"directory": str(out), "html_mode": "none", "write_text": False}} if out else {}
    return Settings(run=run_ | more.pop("run", {}), series1={"format": "csv", "path": path, "units": "m3/s"} | more.pop("series1", {}), layer1=FOCUS, **output, **more)


def test_a_broken_station_fails_alone(spark, tmp_path):
    """Its failure has type and message; the others' tables are those of a run without it."""
    broken = [1.0] * 399 + ["n/a?"]
    path, alone = csv(tmp_path / "a.csv", {"GOOD": 1.0, "BAD": broken, "NONE": [None] * 400}), csv(tmp_path / "b.csv", {"GOOD": 1.0})
    out = run(spark, config(path))
    rows = {r.station_id: r.asDict() for r in out["manifest"].collect()}
    assert rows["BAD"] | {"elapsed_seconds": 0} == {"station_id": "BAD", "status": "failed", "series2_status": "not_attempted", "review_required": False, "error_type": "ValueError", "error_message": "not a number: n/a?", "layer3_status": "not_assessed", "valid_count": 0, "elapsed_seconds": 0}
    assert (rows["GOOD"]["status"], rows["GOOD"]["error_type"], rows["GOOD"]["series2_status"], rows["GOOD"]["valid_count"]) == ("completed", None, "disabled", 400)
    assert (rows["NONE"]["status"], rows["NONE"]["error_type"]) == ("skipped", "NoValidSeries1Values")
    assert rows["GOOD"]["elapsed_seconds"] > 0 == rows["BAD"]["elapsed_seconds"]
    one = run(spark, config(alone))
    for name in ("components", "composite", "station_summary"):
        rows = out[name].drop("input_dataset").collect()
        assert [r for r in rows if r.station_id == "GOOD"] == one[name].drop("input_dataset").collect() and not [r for r in rows if r.station_id == "BAD"]


def test_stop_at_the_first_failure(spark, tmp_path):
    path = csv(tmp_path / "a.csv", {"GOOD": 1.0, "BAD": [1.0] * 399 + ["x"], "WORSE": ["y"] * 400})
    told = []
    with pytest.raises(failures.StationError, match="BAD .*ValueError: not a number: x"):
        run(spark, config(path, run={"continue_on_station_error": False}), progress=lambda event, row: told.append((event, row["name"])))
    assert ("failed", "isolate failures") in told and ("started", "screen") not in told


def test_errors_of_rows(spark, flow_from):
    """Bad dates, missing dates, infinite values; the first in source order counts, with the number of such rows."""
    text = spark.createDataFrame([("a", "2000-01-01", "1"), ("a", "2000-01-02", " "), ("a", "2000-01-03", "NaN"), ("b", "soon", "1"), ("b", None, "2"), ("c", "2000-01-01", "1e999"), ("d", "2000-01-01", "1"), ("d", "2000-01-02", "1,5"), ("d", "2000-01-03", "-")], "station_id string, ts string, value string")
    got = {r.station_id: (r.error_type, r.error_message, r.failed_rows) for r in failures.station_failures(readers.long_table(text, errors=True)).collect()}
    assert got == {"b": ("TypeError", "not a date: ", 2), "c": ("ValueError", "not finite: 2000-01-01", 1), "d": ("ValueError", "not a number: 1,5", 2)}
    (flow,), wrong = failures.isolated(readers.long_table(text, errors=True))
    assert [(r.station_id, r.value) for r in flow.orderBy("ts").collect()] == [("a", 1.0), ("a", None), ("a", None)] and wrong.count() == 3
    clean = flow_from({"a": (["2000-01-01"], [1.0])})
    assert failures.isolated(clean)[1].count() == 0 and failures.isolated(clean.limit(0))[0][0].count() == 0


def test_series_at_hand(spark, flow_from):
    """``assess`` takes flows as they are, and a failure of the second series takes the station out."""
    days = pd.date_range("2000-01-01", periods=60)
    first = flow_from({s: (days, list(np.arange(60.0))) for s in ("a", "b", "c")})
    second = flow_from({"a": (days, list(np.arange(60.0) + 1)), "b": (days, [float("inf")] * 60)}, "series2")
    told = []
    out = assess(first, second, Settings(run={"all_stations": True}, series1={"format": "parquet", "path": "-", "units": "u"}, layer1=FOCUS), progress=lambda event, row: told.append((event, row["name"])))
    rows = {r.station_id: (r.status, r.series2_status, r.error_type) for r in out["manifest"].collect()}
    assert rows == {"a": ("completed", "available", None), "b": ("failed", "not_attempted", "ValueError"), "c": ("completed", "not_available", None)}
    assert {(r.station_id, r.series_slot) for r in out["composite"].collect()} == {("a", "series1"), ("a", "series2"), ("c", "series1")}
    assert told[:2] == [("started", "isolate failures"), ("completed", "isolate failures")] and ("completed", "screen") in told


def test_manifest_asks_for_review(spark, flow_from):
    days = pd.date_range("2000-01-01", periods=100)
    first = flow_from({"a": (days, [1.0] + [None] * 98 + [1.0]), "b": (days, list(np.arange(100.0)))})
    rows = {r.station_id: r.review_required for r in assess(first, settings=Settings(run={"all_stations": True}, series1={"format": "parquet", "path": "-", "units": "u"}, layer1=FOCUS))["manifest"].collect()}
    assert rows == {"a": True, "b": False}


def test_reruns_replace_their_stations_only(spark, tmp_path):
    """A second run of one station leaves the files and rows of the others; a run that is not committed does not count."""
    out = tmp_path / "out"
    run(spark, config(csv(tmp_path / "a.csv", {"A": 1.0, "B": 1.0, "C": 1.0}), out))
    before = {p: p.stat().st_mtime_ns for p in (out / "tables").rglob("*.parquet")}
    run(spark, config(csv(tmp_path / "b.csv", {"A": [1.0] + [None] * 398 + [1.0]}), out, ids=["A"]))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    got = {r.station_id: r.layer1_class for r in store.read(spark, f"{out}/tables", "composite").collect()}
    assert got == {"A": "Needs review", "B": "No review needed", "C": "No review needed"}
    assert {r.station_id: r.status for r in store.read(spark, f"{out}/tables", "manifest").collect()} == dict.fromkeys("ABC", "completed")
    assert store.read(spark, f"{out}/tables", "counts").count() == 1
    store.write(spark.createDataFrame([("B", "wrong")], "station_id string, layer1_class string"), f"{out}/tables", "composite", store.new_run())
    assert {r.station_id: r.layer1_class for r in store.read(spark, f"{out}/tables", "composite").collect()} == got
    assert len(store.drop_superseded(spark, f"{out}/tables", "composite")) == 1 and store.read(spark, f"{out}/tables", "composite").count() == 3


def test_log_and_settings_of_the_run(spark, tmp_path):
    out = tmp_path / "out"
    tables = run(spark, config(csv(tmp_path / "a.csv", {"A": 1.0, "B": 1.0}), out, layer2={"events": {"trigger_percentile": 0.9}}))
    log = {r.name: r for r in spark.read.parquet(f"{out}/log").collect()}
    assert set(tables) - {"log"} <= set(log) and log["composite"].rows == 2 and log["composite"].kind == "table" and log["screen"].rows is None and all(r.seconds >= 0 for r in log.values())
    assert json.loads(log["composite"].settings)["missing_values"]["enabled"] is True and json.loads(log["events"].settings)["events"]["trigger_percentile"] == 0.9
    said = json.loads(spark.read.text(f"{out}/settings").first()[0])
    assert said["series1"]["units"] == "m3/s" and said["run"] == {"all_stations": True} and said["layer2"]["events"]["trigger_percentile"] == 0.9 and "run_layer1" not in said["layers"]
    lines = [r.value for r in spark.read.text(f"{out}/log_text").collect()]
    assert any("composite" in x and "2 rows" in x for x in lines)


def test_provenance(spark, flow_from, tmp_path):
    days = pd.date_range("2000-01-01", periods=10)
    flow = flow_from({"a": (days, [None] * 3 + [1.0] * 7), "b": (days[:2], [1.0, 2.0])})
    rows = {r.station_id: r.provenance for r in Sourced(flow, {"path": "p", "unit": "u"}).timespan("2000-01-03", "2000-01-08").became(flow.where("ts >= '2000-01-03' and ts < '2000-01-09'"), "checked").table().collect()}
    a, b = rows["a"], rows["b"]
    assert (a.path, a.format, a.requested_mode, a.requested_start, str(a.source_start), str(a.selected_start), str(a.first_valid), a.selected_count, a.valid_count) == ("p", None, "range", "2000-01-03", "2000-01-01", "2000-01-03", "2000-01-04", 6, 5)
    assert (b.source_count, b.selected_count, b.selected_start) == (2, 0, None) and a.transformations == ["selected timespan", "checked"]
    path = csv(tmp_path / "a.csv", {"A": 1.0})
    out = run(spark, config(path, series1={"timespan": {"mode": "range", "start_date": "2000-02-01", "end_date": "2000-03-31"}}))
    row = out["station_summary"].first()
    assert (row.requested_timespan_mode, row.requested_start, str(row.source_calendar_start)[:10], str(row.selected_calendar_start)[:10], row.selected_row_count, row.input_dataset) == ("range", "2000-02-01", "2000-01-01", "2000-02-01", 60, path)
    assert out["provenance"].first().provenance.transformations == ["parsed configured date column", "selected timespan"]
