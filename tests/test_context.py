from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewise.operators import context


def greedy(a, b, tolerance):
    i = j = m = 0
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= tolerance:
            i, j, m = i + 1, j + 1, m + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return m


def test_matched_dates(spark):
    rng = np.random.default_rng(0)
    rows = [([], [], 0), ([1], [], 0)]
    for _ in range(30):
        a, b = (sorted(rng.integers(0, 200, rng.integers(0, 25)).tolist()) for _ in range(2))
        rows.append((a, b, greedy(a, b, 5)))
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, m int")
    got = df.select("m", context.matched_dates(F.col("a"), F.col("b"), 5).alias("x"), context.matched_dates(F.col("b"), F.col("a"), 5).alias("y")).collect()
    assert all(r.m == r.x == r.y for r in got)


def _stations(spark, rows):
    return spark.createDataFrame(rows, "station_id string, longitude double, latitude double, river_name string, catchment_name string, catchment_area_km2 double, series_type string, climate_code string")


def test_peers_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i:02d}", float(x), float(y), f"R{i % 3}" if i % 4 else " ", f"c{i % 5}", float(100 + 10 * i), "observation", f"k{i % 2}") for i, (x, y) in enumerate(rng.uniform(-1, 1, (40, 2)) * [179.9, 1.0] + [0, 60])]
    rows += [("pole1", 10.0, 89.9, "", "", 100.0, "observation", None), ("pole2", -170.0, 89.9, "", "", 100.0, "observation", None), ("edge1", 179.99, 0.0, "", "", 1.0, "observation", "x"), ("edge2", -179.99, 0.0, "", "", 2.0, "observation", "x")]
    got = {(r.station_id, r.peer_station_id): r.distance_km for r in context.candidates(_stations(spark, rows), 300.0).collect()}

    def km(a, b):
        lo1, la1, lo2, la2 = map(np.radians, (a[1], a[2], b[1], b[2]))
        return 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin((lo2 - lo1) / 2) ** 2))

    expected = {(a[0], b[0]): km(a, b) for a in rows for b in rows if a[0] != b[0] and km(a, b) <= 300}
    assert set(got) == set(expected) and all(got[k] == pytest.approx(v) for k, v in expected.items()) and ("pole1", "pole2") in got and ("edge1", "edge2") in got


def test_local_order_and_analogue_rules(spark):
    rows = [("t", 0.0, 50.0, "Rhine", "A", 100.0, "observation", "C1"), ("near", 0.1, 50.0, " ", "B", 100.0, "observation", "C1"), ("catch", 0.3, 50.0, "", "a ", 150.0, "observation", "C1"), ("river", 0.2, 50.0, "RHINE", "B", 300.0, "observation", "C1"), ("sim", 0.1, 50.1, "Rhine", "A", 100.0, "simulation", "C1"),
            ("far", 3.0, 50.0, "", "", 200.0, "observation", "C1"), ("big", 3.0, 50.1, "", "", 201.0, "observation", "C1"), ("wet", 3.0, 50.2, "", "", 100.0, "observation", "C2"), ("far2", 4.0, 50.0, "", "", 110.0, "observation", "C1")]
    s = _stations(spark, rows)
    local = context.local_peers(s)
    assert [r.peer_station_id for r in local.where("station_id = 't'").orderBy("peer_rank").collect()] == ["catch", "river", "near"]
    analogue = context.analogue_peers(s, local)
    assert [(r.peer_station_id, r.ready) for r in analogue.where("station_id = 't'").orderBy("peer_rank").collect()] == [("far2", True), ("far", True)]


def test_validation(spark):
    raw = spark.createDataFrame([("a", "1", "2", "r", "c", "10", "OBS"), ("b", "1", "99", "r", "c", "x", "guess"), (None, "1", "2", "r", "c", "10", "sim"), ("d", "1", "2", "r", "c", "10", "ml"), (" d", "1", "2", "r", "c", "10", "ml")],
                                "station_id string, longitude string, latitude string, river_name string, catchment_name string, catchment_area_km2 string, series_type string")
    got = [r.rejection_reason for r in context.validate_context(raw).orderBy("station_id").collect()]
    assert got == ["missing station_id", "", "invalid latitude; invalid catchment area; unknown series_type", "duplicate station_id", "duplicate station_id"]
    with pytest.raises(ValueError, match="latitude"):
        context.validate_context(raw.drop("latitude"))


def test_combined_weights(spark):
    near = spark.createDataFrame([("t", "peak_timing", 0.5), ("t", "flashiness", 1.0), ("t", "baseflow", None), ("t", "zero_flow", 0.8)], "station_id string, check string, similarity double")
    far = spark.createDataFrame([("t", "flashiness", 0.5), ("t", "baseflow", 0.6)], "station_id string, check string, similarity double")
    rows = context.combined_checks(near, far)
    got = {r.check: r.combined_similarity_percent for r in rows.collect()}
    assert got["peak_timing"] == 50 and got["flashiness"] == pytest.approx(85) and got["baseflow"] == pytest.approx(18) and got["zero_flow"] == pytest.approx(80) and got["event_shape"] is None
    row = context.combined_context(rows).collect()[0]
    assert row.combined_score_percent == pytest.approx((50 + 85 + 18 + 80) / 4) and row.combined_classification == "Moderate agreement" and row.report_similarity_met


def test_network_context_of_alike_stations(spark, flow_from):
    d = pd.date_range("2000-01-01", "2008-12-31")
    x = 5 + 3 * np.sin(2 * np.pi * np.arange(len(d)) / 365.25) + np.convolve(np.random.default_rng(3).gamma(1.0, 3.0, len(d) + 9), np.ones(10) / 10, "valid")
    flow = flow_from({s: (d, x) for s in ("a", "b")})
    s = _stations(spark, [("a", 0.0, 50.0, "r", "c", 100.0, "observation", "C1"), ("b", 0.1, 50.0, "r", "c", 100.0, "observation", "C1"), ("absent", 0.1, 50.0, "r", "c", 100.0, "observation", "C1")])
    out = context.network_context(flow, s)
    rows = {r.station_id: r for r in out["combined"].collect()}
    assert set(rows) == {"a", "b"} and rows["a"].combined_score_percent == pytest.approx(100) and rows["a"].combined_classification == "Strong agreement"
