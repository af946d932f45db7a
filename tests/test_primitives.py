from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gaugewise.functions.numeric import correlation, half_even, month_distance, ratio, resampled
from gaugewise.operators import primitives as p


def test_valid_record_keeps_order_duplicates_and_inner_nulls(flow_from):
    flow = flow_from([("a", "2000-01-03", 3), ("a", "2000-01-01", None), ("a", "2000-01-02", 2), ("a", "2000-01-02", 5), ("a", "2000-01-04", None), ("a", "2000-01-05", 1), ("a", "2000-01-06", None)])
    rows = p.valid_record(flow).orderBy("pos").collect()
    assert [(r.ts.day, r.value) for r in rows] == [(2, 2.0), (2, 5.0), (3, 3.0), (4, None), (5, 1.0)]


def test_missing_intervals_by_position(flow_from):
    values = [None, 1, None, None, 2, None]
    flow = flow_from({"a": (pd.date_range("2000-01-01", periods=6), values), "b": (pd.date_range("2000-01-01", periods=2), [None, None])})
    got = {(r.station_id, r.position): r.missing_count for r in p.missing_intervals(flow).collect()}
    assert got == {("a", "leading"): 1, ("a", "internal"): 2, ("a", "trailing"): 1, ("b", "all"): 2}


def test_monthly_statistics_collapse_clip_and_complete(flow_from, one):
    days = list(pd.date_range("2000-01-01", "2000-01-12")) + [pd.Timestamp("2000-01-12"), pd.Timestamp("2000-03-01")]
    flow = flow_from({"a": (days, [-1.0] * 11 + [4.0, 6.0, 2.0])})
    rows = {r.month.month: r for r in p.monthly_statistics(flow).collect()}
    assert set(rows) == {1, 2, 3} and rows[1].valid_days == 12 and rows[1].median == 0.0 and rows[2].median is None and rows[3].valid_days == 1 and rows[3].median is None
    assert rows[1].q90 == np.quantile([0.0] * 11 + [5.0], 0.9)


def test_log_offset_of_a_dry_series(flow_from, one):
    flow = flow_from({"a": (pd.date_range("2000-01-01", periods=3), [0, 0, None])})
    assert one(p.log_offset(flow))["log_offset"] == 1e-6


def test_numbers(spark, one):
    df = spark.createDataFrame([(0.0005, 1.0, 0.0), (1.0015, 2.0, 0.0), (2.5, 4.0, 0.0)], "x double, y double, z double")
    assert [r[0] for r in df.select(half_even(F.col("x"), 3)).collect()] == list(np.round([0.0005, 1.0015, 2.5], 3))
    row = one(df.agg(correlation(F.col("x"), F.col("z")).alias("c"), ratio(F.sum("x"), F.sum("z")).alias("r"), correlation(F.col("x"), F.col("y")).alias("d")))
    assert row["c"] is None and row["r"] is None and abs(row["d"] - np.corrcoef([0.0005, 1.0015, 2.5], [1, 2, 4])[0, 1]) < 1e-12
    assert one(spark.range(1).select(month_distance(F.lit(12), F.lit(1)).alias("m")))["m"] == 1


def test_resampled_matches_interpolation(spark, one):
    x = [1.0, 4.0, 2.0, 8.0]
    got = one(spark.createDataFrame([(x,)], "x array<double>").select(resampled(F.col("x"), 100).alias("y")))["y"]
    assert np.allclose(got, np.interp(np.linspace(0, 1, 100), np.linspace(0, 1, 4), x))


def test_pair_availability(flow_from, one):
    a = flow_from({"s": (pd.date_range("2000-01-01", periods=4), [1, None, 3, 4])})
    b = flow_from({"s": (pd.date_range("2000-01-03", periods=4), [1, None, 3, 4])}, "series2")
    row = one(p.pair_availability(a, b))
    assert row["common_rows"] == 2 and row["paired_valid"] == 1 and row["reference_only_before"] == 1 and row["reference_only_within"] == 1 and row["candidate_only_after"] == 2


def test_empty_flow(flow_from):
    flow = flow_from([])
    for f in (p.valid_record, p.missing_intervals, p.missingness, p.summary, p.monthly_statistics, p.log_offset, p.availability):
        assert f(flow).count() == 0
