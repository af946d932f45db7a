"""No task takes in all rows of a series: windows over raw rows are cut into stretches."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from gaugewise.operators import comparison, layer1, primitives

SF_DIR = "/root/testdata/sf0.001"


def whole_series_windows(df) -> list[str]:
    """Windows by station, or station and slot, alone that read rows as they are, not aggregated ones."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    found = []
    for i, line in enumerate(lines):
        by = re.search(r"Window \[.*?\], \[([^\[\]]*)\]", line)
        if by and "stretch" not in by[1] and not next(x for x in lines[i + 1 :] if not re.match(r"\W*(Project|Filter) ", x)).lstrip(" :+-").startswith("Aggregate"):
            found.append(line)
    return found


@pytest.mark.parametrize("name", ["l1_timestep", "c_independent", "monthly_stats", "l1_duplicate_groups"])
def test_no_window_over_the_raw_rows_of_a_series(spark, name):
    assert whole_series_windows(entry.queries()[name](spark, SF_DIR)) == []


def _shuffled(n: int = 60):
    days = pd.date_range("2000-01-01", periods=n).to_numpy().copy()
    rng = np.random.default_rng(3)
    for at in range(0, n - 8, 9):
        days[at : at + 5] = rng.permutation(days[at : at + 5])
    return days


@pytest.mark.parametrize("stretch", [1, 4, 7, 1 << 16])
def test_disorder_across_stretches(flow_from, monkeypatch, one, stretch):
    monkeypatch.setattr(primitives, "STRETCH", stretch)
    days = _shuffled()
    values = [None if i in (0, 1, 20, 58, 59) else 1.0 for i in range(60)]
    flow = flow_from({"a": (days, values)})
    given = [d for d, v in zip(days, values, strict=True) if v is not None]
    inside = [d for d in days if min(given) <= d <= max(given)]
    back = sum(b < a for a, b in zip(inside, inside[1:], strict=False))
    assert back > 5 and one(layer1.timestep_consistency(flow))["out_of_order_rows"] == back
    one_back = flow_from({"a": (pd.to_datetime(["2000-01-01", "2000-01-02", "2000-01-03", "2000-01-05", "2000-01-04"]), [1.0] * 5), "b": (pd.date_range("2000-01-01", periods=9), [1.0] * 9)})
    assert [tuple(r) for r in comparison.unfit(one_back, one_back.where("station_id = 'b'")).collect()] == [("a", "reference is not sorted")]


def test_positions_of_raw_rows_rise_in_source_order(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gaugewise.plans import fixtures

    def got():
        rows = fixtures.rows(spark, SF_DIR).orderBy("station_id", "src_pos").groupBy("station_id").agg(F.collect_list(F.struct("src_pos", "ts", "value")).alias("r"))
        out = {r.station_id: sorted(r.r) for r in rows.collect()}
        assert all(len({x.src_pos for x in r}) == len(r) for r in out.values())
        return {s: [(x.ts, x.value) for x in r] for s, r in out.items()}

    whole = got()
    monkeypatch.setattr(fixtures, "ORDERS", 7)
    assert got() == whole


def test_months_of_a_record_with_repeated_days_and_undated_values(flow_from, spark):
    rows = [("a", "2000-01-31", None), ("a", "2000-02-01", None), ("a", "2000-02-01", 3.0), ("a", "2000-02-01", 3.0), ("a", "2000-02-01", 9.0), ("a", "2000-04-01", 1.0), ("a", "2000-05-01", None)]
    flow = flow_from(rows)
    got = {r.month.month: (r.valid_days, r.median) for r in primitives.monthly_statistics(flow, 1).collect()}
    assert got == {2: (1, 3.0), 3: (0, None), 4: (1, 1.0)}
    undated = flow.unionByName(spark.createDataFrame([("a", "series1", None, 1.0, 9)], flow.schema))  # stands first, so the record begins there
    assert sorted(r.month.month for r in primitives.monthly_statistics(undated, 1).collect()) == [1, 2, 3, 4]


def test_conflicts_of_repeated_times(flow_from):
    days = ["2000-01-01"] * 2 + ["2000-01-02"] * 2 + ["2000-01-03"] * 2 + ["2000-01-04"] * 2 + ["2000-01-05"] * 2
    values = [1, 2, 1, 1, None, None, None, 1, 0.0, -0.0]
    got = layer1.duplicate_groups(flow_from([("a", d, v) for d, v in zip(days, values, strict=True)])).orderBy("ts").collect()
    assert [r.conflicting for r in got] == [True, False, False, True, False]
