from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd

from gaugewise.config import LAYER1
from gaugewise.operators import epoch_drift
from gaugewise.operators.primitives import prepared

C = LAYER1["epoch_drift"]


def line(x, y):
    i, j = np.triu_indices(len(x), 1)
    slope = float(np.median((y[j] - y[i]) / (x[j] - x[i])))
    return slope, float(np.median(y) - slope * np.median(x))


def by_hand(years: pd.DataFrame, noise: float, c: dict) -> list[tuple]:
    """years: epoch, year, level_anomaly of one run."""
    years = years.sort_values("year")
    ids, x, y = sorted(years.epoch.unique()), years.year.to_numpy(float), years.level_anomaly.to_numpy(float)
    e = np.searchsorted(ids, years.epoch.to_numpy())
    parts = min(c["maximum_overview_slopes"], -(-len(ids) // c["overview_epochs_per_segment"]))

    def on(a, b):
        return (e >= a) & (e < b)

    def error(a, b):
        slope, base = line(x[on(a, b)], y[on(a, b)])
        return float(((y[on(a, b)] - base - slope * x[on(a, b)]) ** 2).sum())

    def state(a, b):
        slope = line(x[on(a, b)], y[on(a, b)])[0]
        return "stable" if abs(slope) * max(np.ptp(x[on(a, b)]), 1) / noise < c["meaningful_epoch_change_score"] else "rising" if slope > 0 else "falling"

    cuts = min(combinations(range(1, len(ids)), parts - 1), key=lambda k: sum(error(*p) for p in zip((0, *k), (*k, len(ids)), strict=True)))
    joined: list[list] = []
    for a, b in zip((0, *cuts), (*cuts, len(ids)), strict=True):
        if joined and joined[-1][2] == state(a, b):
            joined[-1][1] = b
        else:
            joined.append([a, b, state(a, b)])
    return [(i, int(x[on(a, b)].min()), int(x[on(a, b)].max()), round(line(x[on(a, b)], y[on(a, b)])[0], 8), state(a, b)) for i, (a, b, _) in enumerate(joined, 1)]


def test_overview_against_all_groupings(flow_from):
    """Records of 5 to 70 years with trends that turn, and runs parted by a gap of years."""
    rng, series = np.random.default_rng(3), {}
    for k, years in enumerate((5, 12, 23, 30, 41, 55, 70)):
        d = pd.date_range("1950-01-01", periods=int(years * 365.25))
        trend = np.cumsum(rng.choice([-0.06, 0, 0.05], 16))[(d.year - 1950) // 5] + rng.normal(0, 0.02, 80)[d.year - 1950]
        x = np.asarray((5 + 2 * np.sin(2 * np.pi * d.dayofyear / 365.25)) * np.exp(trend))
        if k == 5:
            x[(d.year > 1972) & (d.year < 1976)] = np.nan
        series[f"s{k}"] = (d, x)
    flow = prepared(flow_from(series))
    for changes in ({"overview_epochs_per_segment": 100}, {"overview_epochs_per_segment": 2, "maximum_overview_slopes": 3}):
        c = C | changes
        runs = epoch_drift._runs(epoch_drift.annual_levels(flow, c), c)
        years = runs.join(epoch_drift.epochs(flow, c).select("station_id", "series_slot", "run", "epoch", "first_year", "last_year"), ["station_id", "series_slot", "run"]).where("year between first_year and last_year").toPandas()
        noise = {r.station_id: r.noise for r in epoch_drift.noise_scale(runs, c["annual_noise_floor_log"]).collect()}
        got: dict = {}
        for r in epoch_drift.overview(flow, changes).orderBy("station_id", "run", "overview").collect():
            got.setdefault((r.station_id, r.run), []).append((r.overview, r.first_year, r.last_year, round(r.slope, 8), r.state))
        assert got == {k: by_hand(g, noise[k[0]], c) for k, g in years.groupby(["station_id", "run"])} and len(got) == 8
    assert "Python" not in epoch_drift.overview(flow.select("*"))._jdf.queryExecution().executedPlan().toString()
