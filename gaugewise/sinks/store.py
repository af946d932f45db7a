"""Results of many runs in one folder: each run adds its rows, and a station's latest committed run counts.

A run writes ``<table>/run_id=...`` and, when all tables stand, its stations into ``index``. Until then nobody
sees it, so that a run which breaks off leaves the earlier results whole; a rerun of two stations writes the rows
of these two and touches no other file.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run_id string, name string, kind string, rows long, seconds double, started_at timestamp, settings string"


def new_run() -> str:
    """Names of later runs sort after those of earlier ones."""
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


class Log:
    """What a run did: steps and tables with their rows, seconds and settings; ``progress`` is told of each as it starts and ends."""

    def __init__(self, progress: Callable[[str, Mapping[str, Any]], None] | None = None) -> None:
        self.rows: list[dict[str, Any]] = []
        self.tell = progress or (lambda event, row: None)
        self.began = time.perf_counter()

    def seconds(self) -> float:
        return time.perf_counter() - self.began

    def timed(self, name: str, work: Callable[[], Any], settings: str = "", kind: str = "step", count: Callable[[], int] | None = None) -> Any:
        """What ``work`` gives; an error is told of and raised."""
        row = {"name": name, "kind": kind, "rows": None, "seconds": 0.0, "started_at": datetime.now(timezone.utc), "settings": settings}
        self.tell("started", row)
        started = time.perf_counter()
        try:
            out = work()
            row |= {"seconds": time.perf_counter() - started, "rows": count() if count else None}
        except Exception as e:
            self.tell("failed", row | {"error_type": type(e).__name__, "error_message": str(e)})
            raise
        self.rows.append(row)
        self.tell("completed", row)
        return out

    def table(self, spark: SparkSession, run_id: str) -> DataFrame:
        return spark.createDataFrame([(run_id, *[r[k] for k in ("name", "kind", "rows", "seconds", "started_at", "settings")]) for r in self.rows], LOG)


def write(df: DataFrame, path: str, name: str, run_id: str, log: Log | None = None, settings: str = "") -> None:
    """Adds the rows of a run to a table; rows, told by the files' footers, and seconds go to ``log``."""
    where = f"{path}/{name}/run_id={run_id}"
    (log or Log()).timed(name, lambda: df.drop("run_id").write.mode("overwrite").parquet(where), settings, "table", lambda: df.sparkSession.read.schema(df.schema).parquet(where).count())


def commit(stations: DataFrame, path: str, run_id: str) -> None:
    """From now on this run counts for its stations."""
    stations.select("station_id").distinct().withColumn("committed_at", F.lit(datetime.now(timezone.utc))).write.mode("overwrite").parquet(f"{path}/index/run_id={run_id}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """station_id, run_id: the run that counts for each station."""
    index = spark.read.option("recursiveFileLookup", False).parquet(f"{path}/index")
    return index.groupBy("station_id").agg(F.max_by("run_id", F.struct("committed_at", "run_id")).cast("string").alias("run_id"))


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as the runs that count left it; one without stations as the last committed run left it. Columns that only some runs have are null in others."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{path}/{name}").withColumn("run_id", F.col("run_id").cast("string"))
    keep = current(spark, path)
    if "station_id" in rows.columns:
        return rows.join(keep, ["station_id", "run_id"], "left_semi")
    return rows.join(keep.agg(F.max("run_id").alias("run_id")), "run_id", "left_semi")


def log_lines(log: DataFrame) -> DataFrame:
    """The log as text, a line for each row in the order of time."""
    said = F.format_string("%s | %-8s | %-28s | %12s rows | %9.2f s", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"), "kind", "name", F.coalesce(F.col("rows").cast("string"), F.lit("-")), "seconds")
    return log.orderBy("started_at").select(said.alias("value"))


def superseded(spark: SparkSession, path: str, name: str) -> list[str]:
    """Runs in a table that count for no station any more, uncommitted ones too; as many names as runs at most."""
    there = spark.read.parquet(f"{path}/{name}").select(F.col("run_id").cast("string").alias("run_id")).distinct()
    return sorted(r[0] for r in there.join(current(spark, path), "run_id", "left_anti").collect())


def drop_superseded(spark: SparkSession, path: str, name: str) -> list[str]:
    """Deletes those runs' files of a table. Not while a run is writing: it is not committed yet."""
    gone = superseded(spark, path, name)
    for run_id in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/run_id={run_id}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone
