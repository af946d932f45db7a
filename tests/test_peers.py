from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewise.operators import context

SCHEMA = "station_id string, longitude double, latitude double, river_name string, catchment_name string, catchment_area_km2 double, series_type string, climate_code string"


def region(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    areas = np.round(100 * 2 ** rng.uniform(0, 8, n), 1)
    areas[: n // 20] = 400.0
    rows = [(f"s{i}", float(x), float(y), f"r{i % 7}", f"c{i % 11}", float(a) if i % 97 else None, "observation", f"k{i % 2}") for i, (x, y, a) in enumerate(zip(rng.uniform(0, 6, n), rng.uniform(45, 50, n), areas))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("changes", [{}, {"require_same_climate": False, "maximum_search_radius_km": 120.0}])
def test_bands_give_the_same_peers(spark, monkeypatch, changes):
    """Rounds of widening bands against one search over the whole ratio."""
    stations = region(spark, 260)
    local = context.local_peers(stations).select("station_id", "peer_station_id")

    def peers():
        return sorted(map(tuple, context.analogue_peers(stations, local, changes).select("station_id", "peer_station_id", "peer_rank", "ready").collect()))

    one = peers()
    assert context.area_widths(260, 5, 1.0) == [0.25, 1.0]
    monkeypatch.setattr(context, "CROWD", 1)
    assert context.area_widths(260, 5, 1.0)[0] < 0.02 and peers() == one
    monkeypatch.setattr(context, "CROWD", 10**9)
    assert context.area_widths(260, 5, 1.0) == [1.0] and peers() == one


def test_pairs_grow_with_stations(spark):
    """Pairs of the first band for each station, in one region of more and more stations."""

    def met(n):
        width = context.area_widths(n, 5, 1.0)[0]
        return context.candidates(region(spark, n, 1).where("catchment_area_km2 <> 400"), 1000.0, area_width=width).count() / n

    few, many = met(300), met(3000)
    assert many < 4 * few and many < 60


def test_pair_status_and_reasons(spark):
    """Dates on neither side do not apply; what is not there is not assessed, with the reason."""
    none, rows = None, []
    for name, start, peaks, shifts, epoch, zero in [("t", 0, [10, 20], [], "stable", 0.1), ("same", 0, [11, 21], [], "stable", 0.1), ("late", 9000, [9001], [9002], "rising", 0.5), ("bare", 0, [], none, none, none), ("short", 3900, [], [], "stable", 0.0)]:
        rows.append((name, "series1", start, start + 4000, peaks, shifts, epoch, 1.0, 0.5, zero, [1.0] * 12, none, none, none, none))
    found = spark.createDataFrame(rows, "station_id string, series_slot string, record_start int, record_end int, peak_days array<int>, shift_days array<int>, epoch_behaviour string, flashiness double, baseflow double, zero_flow double, profile array<double>, curve array<double>, peak_flow double, time_to_peak_days int, event_duration_days int")
    peers = spark.createDataFrame([("t", p) for p in ("same", "late", "bare", "short")] + [("bare", "t")], "station_id string, peer_station_id string")
    pairs = context.pair_checks(peers, found)
    got = {(r.station_id, r.peer_station_id, r.check): (r.pair_status, r.reason) for r in pairs.collect()}
    assert got["t", "same", "peak_timing"] == ("supported", None) and got["t", "same", "step_shift_timing"] == ("not_applicable", context.NO_DATES)
    assert got["t", "late", "peak_timing"] == ("not_assessed", "no common period") and got["t", "late", "epoch_behaviour"] == ("not_assessed", "no common period") and got["t", "late", "zero_flow"][0] == "not_supported"
    assert got["t", "bare", "step_shift_timing"] == ("not_assessed", "peer evidence is unavailable") and got["t", "bare", "peak_timing"][0] == "not_supported" and got["bare", "t", "epoch_behaviour"] == ("not_assessed", "target evidence is unavailable")
    assert got["t", "short", "epoch_behaviour"] == ("not_assessed", "common period is too short") and got["t", "same", "event_shape"] == ("not_assessed", "target evidence is unavailable")
    checks = {(r.station_id, r.check): r for r in context.finished_checks(pairs).collect()}
    assert checks["t", "step_shift_timing"].not_applicable_peer_count == 2 and checks["t", "step_shift_timing"].reason == "no peer has comparable evidence in a common period"
    assert checks["t", "event_shape"].reason == "target evidence is unavailable" and checks["t", "zero_flow"].reason is None and checks["t", "zero_flow"].assessed_peer_count == 3
    maps = {r.station_id: r for r in context.with_availability(found).collect()}
    assert maps["t"].availability == {k: k != "representative_event" for k in context.EVIDENCE} and set(maps["bare"].unavailable_reasons) == {"step_shift_dates", "epoch_behaviour", "zero_flow_ratio", "representative_event"}
    assert found.where(F.col("station_id") == "t").count() == 1
