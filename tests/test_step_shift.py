from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gaugewise.config import LAYER1
from gaugewise.functions.arrays import array_median, first_place, neighbours
from gaugewise.operators import step_shift
from gaugewise.operators.primitives import log_offset, monthly_statistics, prepared, valid_record

C = LAYER1["step_shift"]


def scales_of(x: np.ndarray) -> np.ndarray:
    out = []
    for column, floor in zip(x.T, step_shift.FLOORS.values(), strict=True):
        d = np.abs(np.diff(column))
        d = d[d <= np.median(d)]
        out.append(max(floor, np.median(d) + 1.4826 * np.median(np.abs(d - np.median(d)))))
    return np.asarray(out)


def by_hand(blocks: pd.DataFrame, months: pd.DataFrame, threshold: float) -> list[tuple]:
    blocks = blocks.sort_values("block")
    if len(blocks) < 3:
        return []
    x, w, at, years = blocks[step_shift.FEATURES].to_numpy(float), blocks.valid_months.to_numpy(float), list(pd.to_datetime(blocks.start)), int(blocks.block_years.iloc[0])
    s = scales_of(x)
    while len(x) > 1:
        far = [np.abs((x[i + 1] - x[i]) / s).max() for i in range(len(x) - 1)]
        i = int(np.argmin(far))
        if far[i] >= threshold:
            break
        x[i], w[i] = (x[i] * w[i] + x[i + 1] * w[i + 1]) / (w[i] + w[i + 1]), w[i] + w[i + 1]
        x, w = np.delete(x, i + 1, 0), np.delete(w, i + 1)
        del at[i + 1]
    found: list[dict] = []
    last, way = None, None
    for i in range(1, len(x)):
        score = np.abs(x[i] - x[i - 1]) / s
        turn = np.sign((x[i] - x[i - 1])[score.argmax()])
        if found and turn == way and (at[i] - last).days <= 366 * years * C["consolidation_max_block_widths"]:
            found[-1]["score"], found[-1]["n"] = np.maximum(found[-1]["score"], score), found[-1]["n"] + 1
        else:
            found.append({"at": at[i], "date": at[i], "score": score, "n": 1})
        last, way = at[i], turn
    level = months.dropna(subset=["level"])
    level = pd.Series(level.level.to_numpy(), index=pd.to_datetime(level.month)).sort_index()
    anomaly = level - level.groupby(level.index.month).transform("median")
    reach = max(1, round(years * 12 * C["refinement_block_fraction"]))
    for f in found:
        if f["score"][0] >= threshold:
            most = -1.0
            for k in range(-reach, reach + 1):
                date = f["at"] + pd.DateOffset(months=k)
                a, b = anomaly[(anomaly.index >= date - pd.DateOffset(months=reach)) & (anomaly.index < date)], anomaly[(anomaly.index >= date) & (anomaly.index < date + pd.DateOffset(months=reach))]
                if min(len(a), len(b)) >= max(3, -(-reach // 2)) and abs(b.median() - a.median()) > most:
                    f["date"], most = date, abs(b.median() - a.median())
    found.sort(key=lambda f: f["date"])
    for a, b in zip(found, found[1:], strict=False):
        if b["date"] <= a["date"]:
            b["date"] = b["at"]
    return [(i, f["date"].date(), f["at"].date(), f["n"], *np.round(f["score"], 6)) for i, f in enumerate(found, 1)]


def test_boundaries_against_brute_force(flow_from):
    """Records of 2 to 60 years with steps of level and of season, gaps, zeros and constants."""
    rng, series = np.random.default_rng(5), {}
    for k, years in enumerate((2, 5, 9, 11, 14, 20, 30, 45, 60)):
        d = pd.date_range("1950-01-01", periods=int(years * 365.25))
        x = 5 + 2 * np.sin(2 * np.pi * d.dayofyear / 365.25) * rng.choice([0.3, 1, 2], 70)[d.year - 1950] + rng.normal(0, 0.2, len(d))
        x = np.asarray(x * np.exp(np.cumsum(rng.choice([0, 0, 0, 0.7, -0.6, 0.9], 70)))[d.year - 1950])
        if k % 3 == 1:
            x[rng.random(len(d)) < 0.4] = np.nan
        if k % 3 == 2:
            x[len(d) // 3 : len(d) // 2] = np.nan
        series[f"s{k}"] = (d, x)
    series |= {"flat": (pd.date_range("1950-01-01", periods=9000), np.ones(9000)), "zero": (pd.date_range("1950-01-01", periods=9000), np.zeros(9000))}
    flow = prepared(flow_from(series))
    blocks = step_shift.block_features(flow).toPandas()
    months = monthly_statistics(flow, int(C["minimum_valid_days_per_month"])).join(log_offset(valid_record(flow)), ["station_id", "series_slot"]).select("station_id", "month", F.ln(F.col("median") + F.col("log_offset")).alias("level")).toPandas()
    for threshold in (C["structural_threshold"], 0.7):
        got: dict = {}
        for r in step_shift.boundaries(flow, {"structural_threshold": threshold}).orderBy("station_id", "boundary").collect():
            got.setdefault(r.station_id, []).append((r.boundary, r.boundary_date, r.approximate_date, r.collapsed_edge_count, *[round(r[f"score_{f}"], 6) for f in step_shift.FEATURES]))
        want = {s: rows for s, b in blocks.groupby("station_id") if (rows := by_hand(b, months[months.station_id == s], threshold))}
        assert got == want and len(got) > 4 and sum(map(len, got.values())) > 6


def test_array_steps(spark):
    rows = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0],), ([],), ([7.0],)], "x array<double>")
    got = rows.select(array_median(F.col("x")).alias("m"), neighbours(F.col("x"), lambda a, b: b - a).alias("d"), first_place(F.col("x"), F.lit(1.0)).alias("i")).collect()
    assert [(r.m, r.d, r.i) for r in got] == [(2.0, [-2.0, 1.0], 1), (2.5, [-3.0], 1), (None, [], -1), (7.0, [], -1)]


def test_no_python_in_the_plan(spark, flow_from):
    flow = flow_from({"a": (pd.date_range("2000-01-01", periods=10), range(10))})
    plan = step_shift.step_shift(flow.select("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
