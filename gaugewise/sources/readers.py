"""Readers of station series and station context. All give flows, lazily."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewise.operators import failures
from gaugewise.operators.primitives import KEYS

FLOW = "station_id string, series_slot string, ts timestamp_ntz, value double, src_pos long"


def wide_csv(spark: SparkSession, path: str, date_column: str = "date", slot: str = "series1", stations: list[str] | None = None, errors: bool = False) -> DataFrame:
    """A CSV with a date column and one column per station.

    Columns of stations that are not asked for are never parsed. Order, repeats and empty cells stay.
    A cell that is no number, or a date that is none, stops the read; with ``errors`` it is null and
    a column ``error`` says so, a bad date's for all stations.
    """
    raw = spark.read.option("header", True).csv(path)
    if date_column not in raw.columns:
        raise ValueError(f"no column {date_column!r} in {path}")
    have = [c for c in raw.columns if c != date_column]
    if not have:
        raise ValueError(f"no station column in {path}")
    if missing := [s for s in stations or [] if s not in have]:
        raise KeyError(", ".join(missing))
    names = list(dict.fromkeys(stations)) if stations else have
    quoted = ["`" + c.replace("`", "``") + "`" for c in names]
    rows = raw.select(F.col(f"`{date_column}`").cast("string").alias("at"), F.monotonically_increasing_id().alias("src_pos"), *[F.col(q).cast("string").alias(c) for q, c in zip(quoted, names, strict=True)])
    long = rows.unpivot(["at", "src_pos"], quoted, "station_id", "cell")
    return _read(long, F.lit(slot), F.col("at"), F.col("cell"), F.col("src_pos"), errors)


def _read(df: DataFrame, slot: Column, time: Column, cell: Column, place: Column, errors: bool) -> DataFrame:
    """Texts of time and value as a flow, with what is wrong with them if ``errors``."""
    day = time.try_cast("timestamp_ntz") if errors else time.cast("timestamp_ntz")
    found = [F.coalesce(failures.not_a_date(time), failures.not_a_number(cell)).alias("error")] if errors else []
    return df.select(F.col("station_id").cast("string").alias("station_id"), slot.alias("series_slot"), day.alias("ts"), failures.number(cell, not errors).alias("value"), place.alias("src_pos"), *found)


def long_table(df: DataFrame, station: str = "station_id", time: str = "ts", value: str = "value", order: str | None = None, slot: str = "series1", errors: bool = False) -> DataFrame:
    """Any table of station, time and value; ``order`` names the source position.

    A text that is no number or date stops the read; with ``errors`` it is null and a column ``error`` says so.
    """
    if errors:
        place = F.col(order).cast("long") if order else F.lit(None).cast("long")
        return _read(df.withColumnRenamed(station, "station_id"), F.lit(slot), F.col(time).cast("string"), F.col(value).cast("string"), place, True)
    v = F.col(value).cast("double")
    return df.select(F.col(station).cast("string").alias("station_id"), F.lit(slot).alias("series_slot"), F.col(time).cast("timestamp_ntz").alias("ts"), F.when(~F.isnan(v), v).alias("value"), (F.col(order).cast("long") if order else F.lit(None).cast("long")).alias("src_pos"))


def context_csv(spark: SparkSession, path: str) -> DataFrame:
    """Station context as text; ``operators.context.validate_context`` checks it."""
    return spark.read.option("header", True).csv(path)


def climate_legend(spark: SparkSession, path: str) -> DataFrame:
    """climate_id, climate_code, climate_description from lines such as ``1: Af Tropical, rainforest [0 0 255]``."""
    line = r"^\s*(\d+)\s*:\s*(\S+)\s*([^\[]*)"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    out = rows.select(F.regexp_extract("value", line, 1).cast("int").alias("climate_id"), F.regexp_extract("value", line, 2).alias("climate_code"), F.trim(F.regexp_extract("value", line, 3)).alias("climate_description"))
    if sorted(r[0] for r in out.select("climate_id").limit(100).collect()) != list(range(1, 31)):
        raise ValueError("a legend defines the classes 1 to 30, each once")
    return out


def result_pickles(spark: SparkSession, paths: list[str], trusted: bool = False, role: str = "observation", slot: str = "series1", errors: bool = False) -> DataFrame:
    """Trusted pickles, one station a file: {station: {"1D": {"xr": dataset, ...}}}, the contemporaneous step only.

    Unpickling runs code, so ``trusted`` must be set. The file's name is ``<station>_results.p``. A file that
    cannot be read stops the job; with ``errors`` it is one row of its station whose ``error`` says why.
    """
    if not trusted:
        raise ValueError("unpickling can run code: set trusted only for files you trust")
    variable = "streamflow_obs" if role in ("observation", "historical_observation") else "streamflow_sim"

    def one(name: str, path: str, content: bytes) -> pd.DataFrame:
        import pickle

        payload = pickle.loads(content)  # noqa: S301
        if not isinstance(payload, dict) or list(payload) != [name]:
            raise ValueError(f"{path} must hold exactly the station {name!r}")
        data = payload[name]["1D"]["xr"]
        if 0 not in list(data["time_step"].values):
            raise ValueError(f"{path} has no time step 0")
        times = pd.DatetimeIndex(data["date"].values)
        if times.has_duplicates or not times.is_monotonic_increasing:
            raise ValueError(f"{path} has repeated or unsorted dates")
        values = pd.Series(data[variable].sel(time_step=0).values, dtype=float)
        return pd.DataFrame({"station_id": name, "series_slot": slot, "ts": times, "value": values, "src_pos": range(len(times)), "error_type": None, "error_message": None})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                name = re.sub(r"_results\.p$", "", path.rpartition("/")[2])
                try:
                    yield one(name, path, content)
                except Exception as e:  # whatever a broken file raises belongs to its station
                    if not errors:
                        raise
                    yield pd.DataFrame({"station_id": [name], "series_slot": slot, "ts": pd.NaT, "value": None, "src_pos": 0, "error_type": type(e).__name__, "error_message": str(e)})

    files = spark.read.format("binaryFile").load(paths)
    out = files.select("path", "content").mapInPandas(read, FLOW + ", error_type string, error_message string")
    out = out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    wrong = F.when(F.col("error_type").isNotNull(), F.struct("error_type", "error_message"))
    return (out.withColumn("error", wrong) if errors else out).drop("error_type", "error_message")


def stored_metrics(spark: SparkSession, paths: list[str], trusted: bool = False) -> DataFrame:
    """station_id, metric, value of the numbers that trusted pickles hold beside their series; what is no number is left out."""
    if not trusted:
        raise ValueError("unpickling can run code: set trusted only for files you trust")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle
        from numbers import Real

        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                name = re.sub(r"_results\.p$", "", path.rpartition("/")[2])
                daily = pickle.loads(content)[name]["1D"]  # noqa: S301
                rows = [(name, str(k), float(v)) for k, v in daily.items() if k != "xr" and isinstance(v, Real)]
                yield pd.DataFrame(rows, columns=["station_id", "metric", "value"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(read, "station_id string, metric string, value double")


def netcdf_names(variables: dict[str, tuple[str, ...]], times: list[str], variable: str | None = None, time: str | None = None, station: str | None = None) -> tuple[str, str, str]:
    """(variable, time, station) of a station x time dataset; what is not given is inferred, doubt is an error.

    ``variables``: dimensions by variable; ``times``: coordinates of dates.
    """
    def one(found: list[str], what: str) -> str:
        if len(found) != 1:
            raise ValueError(f"{what} is ambiguous: {found}")
        return found[0]

    flat = [v for v, dims in variables.items() if len(dims) == 2]
    likely = [v for v in flat if any(x in v.lower() for x in ("streamflow", "discharge", "qobs"))]
    variable = variable or one(likely or flat, "variable")
    time = time or one([t for t in times if t in variables[variable]], "time coordinate")
    other = [d for d in variables[variable] if d != time]
    station = station or one([d for d in other if any(x in d.lower() for x in ("basin", "station", "gauge"))] or other, "station coordinate")
    return variable, time, station


def netcdf(spark: SparkSession, path: str, variable: str, time: str, station: str, stations: list[str] | None = None, slot: str = "series1") -> DataFrame:
    """Station x time NetCDF in a folder that all executors mount; a task reads a slice of the stations.

    Needs xarray, which is no dependency.
    """
    try:
        import xarray
    except ImportError as e:
        raise RuntimeError("NetCDF needs xarray with a NetCDF engine") from e
    with xarray.open_dataset(path) as data:
        ids = [str(x) for x in data[station].values]
    if missing := [s for s in stations or [] if ids.count(s) != 1]:
        raise KeyError(", ".join(missing))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with xarray.open_dataset(path) as data:
            for batch in batches:
                for i, name in zip(batch.place, batch.station_id, strict=True):
                    values = data[variable].isel({station: int(i)}).values.astype(float)
                    yield pd.DataFrame({"station_id": name, "series_slot": slot, "ts": pd.DatetimeIndex(data[time].values), "value": values, "src_pos": range(len(values))})

    wanted = [(i, s) for i, s in enumerate(ids) if not stations or s in stations]
    places = spark.createDataFrame(wanted, "place int, station_id string").repartition(max(1, len(wanted) // 50))
    return places.mapInPandas(read, FLOW).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def select_stations(flow: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Rows of the requested stations, pushed down to the scan; one that is absent is an error. None: all."""
    if not requested:
        return flow
    names = list(dict.fromkeys(s.strip() for s in requested if s.strip()))
    chosen = flow.where(F.col("station_id").isin(names))
    have = {r[0] for r in chosen.select("station_id").distinct().collect()}  # at most the requested names
    if missing := [n for n in names if n not in have]:
        raise KeyError("unknown stations: " + ", ".join(missing))
    return chosen


def station_file(lines: list[str]) -> list[str]:
    """Station names of a text file: blank lines and comments do not count."""
    return [s for s in (line.strip() for line in lines) if s and not s.startswith("#")]


def inside(start: str | None = None, end: str | None = None) -> Column:
    """Whether a row lies from the first to the last day, both inclusive."""
    later = F.col("ts") >= F.lit(start).cast("timestamp_ntz") if start else F.lit(True)
    return later & (F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")) if end else later


def select_timespan(flow: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from the first to the last day, both inclusive."""
    return flow.where(inside(start, end))


def timespan_metadata(source: DataFrame, selected: DataFrame) -> DataFrame:
    """Calendar of the source and of the selection, first and last valid time, and counts."""
    given = F.when(F.col("value").isNotNull(), F.col("ts"))
    a = source.groupBy(*KEYS).agg(F.min("ts").alias("source_start"), F.max("ts").alias("source_end"), F.count(F.lit(1)).alias("source_count"))
    b = selected.groupBy(*KEYS).agg(F.min("ts").alias("selected_start"), F.max("ts").alias("selected_end"), F.count(F.lit(1)).alias("selected_count"), F.count("value").alias("valid_count"), F.min(given).alias("first_valid"), F.max(given).alias("last_valid"))
    return a.join(b, KEYS, "left").fillna(0, ["selected_count", "valid_count"])


def pair_status(series1: DataFrame, series2: DataFrame | None) -> DataFrame:
    """Stations of the first series with what there is of the second: available, not_available or disabled."""
    stations = series1.select("station_id").distinct()
    if series2 is None:
        return stations.withColumn("series2_status", F.lit("disabled"))
    have = series2.where("value is not null").select("station_id").distinct().withColumn("have", F.lit(True))
    return stations.join(have, "station_id", "left").select("station_id", F.when(F.col("have"), "available").otherwise("not_available").alias("series2_status"))
