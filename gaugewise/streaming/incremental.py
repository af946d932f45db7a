"""Screening of arriving rows: a stream appends to a table, and the series it touches are screened anew.

Every check takes whole records, so a batch of arrivals recomputes the series it touches and no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugewise.operators.primitives import KEYS


def screen_stream(arrivals: DataFrame, table: str, results: str, screen: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Starts a query: each batch of flow rows goes to ``table``, and ``screen`` of the touched series to ``results``.

    A batch that runs twice after a failure writes the same folder again, so nothing is doubled.
    ``latest`` reads the newest result of each series.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{table}/batch={number}")
        touched = df.select(*KEYS).distinct()
        records = spark.read.schema(df.schema).option("basePath", table).parquet(f"{table}/batch=*").join(touched, KEYS, "left_semi")
        screen(records).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(results: DataFrame) -> DataFrame:
    """Of each series the rows of the newest batch; ``results`` is read from the folder, with its ``batch``."""
    newest = F.max("batch").over(Window.partitionBy(*KEYS))
    return results.withColumn("newest", newest).where("batch = newest").drop("newest", "batch")
