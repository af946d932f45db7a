from __future__ import annotations

import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = str(Path(__file__).resolve().parents[1])
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def flow_from(spark):
    """A flow from {station: (dates, values)} or a list of (station, date, value); rows keep their order as source order."""

    def make(data, slot: str = "series1"):
        rows = []
        if isinstance(data, dict):
            for station, (dates, values) in data.items():
                rows += [(station, slot, pd.Timestamp(d).date(), None if v is None or v != v else float(v), i) for i, (d, v) in enumerate(zip(dates, values, strict=True))]
        else:
            rows = [(s, slot, pd.Timestamp(d).date(), None if v is None else float(v), i) for i, (s, d, v) in enumerate(data)]
        return spark.createDataFrame(rows, "station_id string, series_slot string, ts date, value double, src_pos long")

    return make


@pytest.fixture()
def one():
    """The only row of a frame, as a dict."""

    def get(df):
        rows = df.collect()
        assert len(rows) == 1
        return rows[0].asDict()

    return get
