"""Tables in the folder that all executors share: what several steps read is made once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of the warehouse, and a temporary one only where the master is local.

    On a cluster a warehouse on a machine's own disk is refused: executors would not see each other's files.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        local = re.match(r"local(\[|$)", spark.sparkContext.master)
        where = tempfile.mkdtemp(prefix="checkpoint-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        if not local and (where.startswith("file:") or "://" not in where):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: cuts lineage and survives lost executors.

    A folder for each value of the columns ``by``. The table is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave, once nothing reads them any more; other frames stay."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path is not None:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def once(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A table of a prepared flow is written at its first use and reread after that; other flows are computed as they come."""

    @wraps(f)
    def shared(flow: DataFrame, *args, **settings) -> DataFrame:
        memo = getattr(flow, "prepared", None)
        given = [*args, *settings.values()]
        if memo is None or any(isinstance(x, DataFrame) for x in given):
            return f(flow, *args, **settings)
        key = (f.__name__, repr(args), repr(sorted(settings.items())))
        if key not in memo:
            memo[key] = written(f(flow, *args, **settings), f.__name__)
        return memo[key]

    return shared
