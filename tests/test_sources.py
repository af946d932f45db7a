from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pytest

from gaugewise.operators import context
from gaugewise.sources import readers


def test_wide_csv_keeps_the_source(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("date,A,B.x\n2000-01-02,2,\n2000-01-01,,5\n2000-01-01,1,6\n")
    flow = readers.wide_csv(spark, str(path))
    rows = sorted((r.station_id, r.src_pos, r.ts.isoformat()[:10], r.value) for r in flow.collect())
    assert rows == [("A", 0, "2000-01-02", 2.0), ("A", 1, "2000-01-01", None), ("A", 2, "2000-01-01", 1.0), ("B.x", 0, "2000-01-02", None), ("B.x", 1, "2000-01-01", 5.0), ("B.x", 2, "2000-01-01", 6.0)]
    one = readers.wide_csv(spark, str(path), stations=["A"])
    assert "B.x" not in one._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1] and one.count() == 3
    with pytest.raises(KeyError):
        readers.wide_csv(spark, str(path), stations=["C"])
    with pytest.raises(ValueError):
        readers.wide_csv(spark, str(path), "day")
    path.write_text("date,A\n2000-01-02,two\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.wide_csv(spark, str(path)).collect()


def test_timespan_is_inclusive(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("date,A\n2000-01-01,1\n2000-01-02,\n2000-01-03,3\n2000-01-04,4\n2000-01-05,5\n")
    flow = readers.wide_csv(spark, str(path))
    chosen = readers.select_timespan(flow, "2000-01-02", "2000-01-04")
    row = readers.timespan_metadata(flow, chosen).collect()[0]
    assert (row.source_count, row.selected_count, row.valid_count, row.first_valid.day, row.last_valid.day) == (5, 3, 2, 3, 4)
    assert {r.series2_status for r in readers.pair_status(flow, None).collect()} == {"disabled"}


def test_selection(spark, flow_from):
    flow = flow_from([("a", "2000-01-01", 1), ("b", "2000-01-01", 1)])
    assert readers.select_stations(flow, [" a", "a", ""]).count() == 1 and readers.select_stations(flow).count() == 2
    with pytest.raises(KeyError, match="x"):
        readers.select_stations(flow, ["a", "x"])
    assert readers.station_file(["a", " ", "# note", " b "]) == ["a", "b"]


class Array:
    def __init__(self, values):
        self.values = np.asarray(values)


class Variable:
    def __init__(self, by_step):
        self.by_step = by_step

    def sel(self, time_step):
        return Array(self.by_step[time_step])


def _pickle(tmp_path, name, key=None, dates=("2000-01-01", "2000-01-02"), steps=(-1, 0)):
    data = {"date": Array(pd.to_datetime(list(dates))), "time_step": Array(list(steps)), "streamflow_obs": Variable({-1: [9, 9], 0: [1.0, np.nan]}), "streamflow_sim": Variable({-1: [9, 9], 0: [3.0, 4.0]})}
    (tmp_path / f"{name}_results.p").write_bytes(pickle.dumps({key or name: {"1D": {"xr": data, "NSE": 0.5}}}))
    return str(tmp_path / f"{name}_results.p")


def test_result_pickles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Array, "__module__", "pickle_classes")
    monkeypatch.setattr(Variable, "__module__", "pickle_classes")
    import sys
    import types

    module = types.ModuleType("pickle_classes")
    module.Array, module.Variable = Array, Variable
    monkeypatch.setitem(sys.modules, "pickle_classes", module)
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "pickle_classes.py").write_text(
        "import numpy as np\n\nclass Array:\n    def __init__(self, values):\n        self.values = np.asarray(values)\n\nclass Variable:\n    def __init__(self, by_step):\n        self.by_step = by_step\n\n    def sel(self, time_step):\n        return Array(self.by_step[time_step])\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "code" / "pickle_classes.py"))
    path = _pickle(tmp_path, "S1")
    with pytest.raises(ValueError, match="trusted"):
        readers.result_pickles(spark, [path])
    assert [(r.station_id, r.value) for r in readers.result_pickles(spark, [path], True).orderBy("ts").collect()] == [("S1", 1.0), ("S1", None)]
    assert [r.value for r in readers.result_pickles(spark, [path], True, "simulation").orderBy("ts").collect()] == [3.0, 4.0]
    with pytest.raises(ValueError, match="trusted"):
        readers.stored_metrics(spark, [path])
    assert [tuple(r) for r in readers.stored_metrics(spark, [path], True).collect()] == [("S1", "NSE", 0.5)]
    for bad in (_pickle(tmp_path, "S2", key="other"), _pickle(tmp_path, "S3", dates=("2000-01-02", "2000-01-01")), _pickle(tmp_path, "S4", steps=(-1,))):
        with pytest.raises(Exception, match="must hold|unsorted|time step"):
            readers.result_pickles(spark, [bad], True).collect()


def test_netcdf_names():
    variables = {"streamflow": ("basin", "date"), "rain": ("basin", "date"), "area": ("basin",)}
    assert readers.netcdf_names(variables, ["date"]) == ("streamflow", "date", "basin")
    assert readers.netcdf_names({"q": ("t", "gauge_id")}, ["t"]) == ("q", "t", "gauge_id")
    with pytest.raises(ValueError):
        readers.netcdf_names({"a": ("x", "t"), "b": ("x", "t")}, ["t"])


def test_netcdf_says_what_it_needs(spark, tmp_path):
    try:
        import xarray  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="xarray"):
            readers.netcdf(spark, str(tmp_path / "x.nc"), "q", "t", "s")


def test_legend_and_raster(spark, tmp_path):
    path = tmp_path / "legend.txt"
    path.write_text("classes\n" + "\n".join(f"    {i}:  C{i}   Name, of {i}   [{i} 0 255]" for i in range(1, 31)))
    legend = readers.climate_legend(spark, str(path))
    assert legend.where("climate_id = 7").collect()[0].climate_description == "Name, of 7"
    cells = spark.createDataFrame([(0, 3, 5), (1, 3, 40)], "row int, col int, climate_id int")
    stations = spark.createDataFrame([("corner", 180.0, 90.0), ("sea", 100.0, -90.0)], "station_id string, longitude double, latitude double")
    got = {r.station_id: r.climate_code for r in context.attach_climate(stations, cells, legend, 4, 2).collect()}
    assert got == {"corner": "C5", "sea": None}
    path.write_text("1: Af x [0 0 0]")
    with pytest.raises(ValueError):
        readers.climate_legend(spark, str(path))
