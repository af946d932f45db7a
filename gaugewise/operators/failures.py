"""Failures as data: a row that cannot be read or screened carries its error, and its station leaves the run alone.

Nothing is caught on the driver: errors are expressions beside the values, so one job reads sound
and broken stations together. A flow with errors has a further column ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.functions.shared import written
from gaugewise.operators.primitives import KEYS

ERROR = "struct<error_type: string, error_message: string>"
COLUMNS = ["station_id", "series_slot", "stage", "error_type", "error_message", "failed_rows"]


class StationError(RuntimeError):
    """The first failure of a run that is to stop at it."""


def error(kind: str, message: Column) -> Column:
    return F.struct(F.lit(kind).alias("error_type"), message.alias("error_message")).cast(ERROR)


def number(text: Column, raises: bool = True) -> Column:
    """A number from text: null for blanks and NaN. What is none stops the job or, else, is null."""
    value = (text.cast("double") if raises else text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def not_a_number(text: Column) -> Column:
    """The error of a text that is neither blank nor a number."""
    return F.when(text.try_cast("double").isNull() & (F.trim(text) != ""), error("ValueError", F.concat(F.lit("not a number: "), text)))


def not_a_date(text: Column) -> Column:
    """The error of a text that is no date, blanks too."""
    return F.when(text.try_cast("timestamp_ntz").isNull(), error("TypeError", F.concat(F.lit("not a date: "), F.coalesce(text, F.lit("")))))


def judged(flow: DataFrame) -> DataFrame:
    """``flow`` with the ``error`` of each row: the reader's, else a missing date, else a value that is not finite."""
    read = F.col("error") if "error" in flow.columns else F.lit(None).cast(ERROR)
    infinite = F.abs("value") == float("inf")
    own = F.when(F.col("ts").isNull(), error("TypeError", F.lit("a row has no date"))).when(infinite, error("ValueError", F.concat(F.lit("not finite: "), F.col("ts").cast("date").cast("string"))))
    return flow.withColumn("error", F.coalesce(read, own))


def station_failures(*flows: DataFrame, stage: str = "load") -> DataFrame:
    """One row for each series with an error: the first one in source order, and how many rows have one."""
    out = None
    for flow in flows:
        wrong = judged(flow).where("error is not null").groupBy(*KEYS).agg(F.min_by("error", F.struct("src_pos", "ts", "error")).alias("e"), F.count(F.lit(1)).alias("failed_rows"))
        rows = wrong.select(*KEYS, F.lit(stage).alias("stage"), "e.error_type", "e.error_message", "failed_rows")
        out = rows if out is None else out.unionByName(rows)
    return out


def none(like: DataFrame) -> DataFrame:
    """No failure; ``like`` is any frame of the session."""
    return like.sparkSession.createDataFrame([], "station_id string, series_slot string, stage string, error_type string, error_message string, failed_rows long")


def isolated(*flows: DataFrame, keep_on: bool = True) -> tuple[list[DataFrame], DataFrame]:
    """The flows without every station that has an error in any of them, and the failures, which are written at once.

    ``keep_on`` False: the first failure by station is raised instead.
    """
    failures = written(station_failures(*flows), "failures")
    if not keep_on:
        stop(failures)
    bad = failures.select("station_id").distinct()
    return [f.drop("error").join(bad, "station_id", "left_anti").select([c for c in f.columns if c != "error"]) for f in flows], failures


def stop(failures: DataFrame) -> None:
    """Raises the first failure by station and slot, if there is one."""
    for r in failures.orderBy(*KEYS).limit(1).collect():
        raise StationError(f"{r.station_id} ({r.series_slot}, {r.stage}): {r.error_type}: {r.error_message}")
