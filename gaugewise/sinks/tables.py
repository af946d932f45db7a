"""Result tables as CSV, texts and settings; ``store`` keeps the tables themselves."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(tables: Mapping[str, DataFrame], path: str) -> None:
    """Evidence as CSV with a header; nested columns as JSON."""
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_text(df: DataFrame, path: str) -> None:
    """A table of (name, text), a file for each row's text, by the tasks that hold them."""
    df.select(F.col("name"), F.col("text")).write.mode("overwrite").partitionBy("name").text(path)


def write_settings(settings: Mapping, spark, path: str) -> None:
    """The settings of a run as one line of JSON."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
