"""Daily series derived from the star schema, for queries and benches.

Each has a Spark form here and the same rows as SQL in ``SQL``, common table expressions that an
oracle puts before its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewise.operators.primitives import flow_of

#: Order keys whose rows of one station are numbered by one task.
ORDERS = 4096


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shipped(spark: SparkSession, sf_dir: str, region: bool) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").withColumn("d", F.col("l_shipdate").cast("date"))
    places = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    if region:
        places = places.join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lines.join(places, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("station_id", F.col("r_name" if region else "n_name"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows: several a day, source order explicit: positions rise in it and leave gaps.

    A station's rows are numbered in stretches of ORDERS order keys, with room for 2**28 rows each, so that no task sorts them all.
    """
    stretch = F.floor(F.col("l_orderkey") / ORDERS)
    order = Window.partitionBy("station_id", "stretch").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    out = _shipped(spark, sf_dir, True).withColumn("stretch", stretch).withColumn("place", F.col("stretch") * (1 << 28) + F.row_number().over(order))
    return flow_of(out.select("station_id", F.col("d").alias("ts"), F.col("l_quantity").cast("double").alias("value"), "place"), order="place")


def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense daily sums, five stations."""
    daily = _shipped(spark, sf_dir, True).groupBy("station_id", F.col("d").alias("ts")).agg(F.sum("l_quantity").cast("double").alias("value"))
    return flow_of(daily)


def nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse daily sums, many stations."""
    daily = _shipped(spark, sf_dir, False).groupBy("station_id", F.col("d").alias("ts")).agg(F.sum("l_quantity").cast("double").alias("value"))
    return flow_of(daily)


def nation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse series on all days of the table, null where absent."""
    flow = nation(spark, sf_dir)
    days = _t(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("ts")).distinct()
    spine = days.select(F.collect_set("ts").alias("days"))
    stations = flow.select("station_id").distinct()
    grid = stations.join(F.broadcast(spine)).select("station_id", F.explode("days").alias("ts"))
    return flow_of(grid.join(flow.select("station_id", "ts", "value"), ["station_id", "ts"], "left"))


def _day() -> object:
    return F.year("ts") * 366 + F.dayofyear("ts")


def spiky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolated impulses in the dense series."""
    return region(spark, sf_dir).withColumn("value", F.when(_day() % 211 == 100, F.col("value") * 12 + 600).otherwise(F.col("value")))


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plateaus of 20 days in the dense series."""
    return region(spark, sf_dir).withColumn("value", F.when(F.floor(_day() / 20) % 9 == 4, F.lit(77.0)).otherwise(F.col("value")))


def lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse series less 40, so that some values are negative."""
    return nation(spark, sf_dir).withColumn("value", F.col("value") - 40)


def zeroed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse series with 0 on absent days."""
    return nation_null(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(0.0)))


def candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second series of the dense stations: 25.5 for each row of a day, none on days divisible by 17."""
    daily = _shipped(spark, sf_dir, True).groupBy("station_id", F.col("d").alias("ts")).agg((F.count(F.lit(1)) * 25.5).cast("double").alias("value"))
    return flow_of(daily.withColumn("value", F.when(_day() % 17 != 0, F.col("value"))), slot="series2")


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse series as text, with cells that are no number (stations 6k + 1), a day that is none (6k + 2) and no values at all (6k + 3)."""
    flow = nation(spark, sf_dir)
    key, day = F.substring_index("station_id", "_", -1).cast("int") % 6, F.dayofyear("ts")
    value = F.when((key == 1) & (day == 100), "err").when(key != 3, F.col("value").cast("string"))
    return flow.select("station_id", F.when((key == 2) & (day == 50), "unknown").otherwise(F.col("ts").cast("string")).alias("ts"), value.alias("value"))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station places, rivers and catchments."""
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    return n.select(
        F.col("n_name").alias("station_id"), (5.0 + 0.25 * (key % 5)).cast("double").alias("longitude"), (47.0 + 0.25 * F.floor(key / 5)).cast("double").alias("latitude"),
        F.concat(F.lit("river_"), F.col("n_regionkey").cast("string")).alias("river_name"), F.col("r_name").alias("catchment_name"),
        (500.0 + 40.0 * key).cast("double").alias("catchment_area_km2"), F.lit("observation").alias("series_type"),
    )


#: Common table expressions of the same rows; each is (station_id, ts, value), flow_rows with src_pos.
SQL = {
    "flow_rows": """SELECT r_name AS station_id, CAST(l_shipdate AS DATE) AS ts, CAST(l_quantity AS DOUBLE) AS value,
  row_number() OVER (PARTITION BY r_name ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS src_pos
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "flow_region": """SELECT r_name AS station_id, CAST(l_shipdate AS DATE) AS ts, CAST(sum(l_quantity) AS DOUBLE) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "flow_nation": """SELECT n_name AS station_id, CAST(l_shipdate AS DATE) AS ts, CAST(sum(l_quantity) AS DOUBLE) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    "flow_nation_null": """SELECT s.station_id, c.ts, f.value FROM (SELECT DISTINCT station_id FROM flow_nation) s
  CROSS JOIN (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ts FROM lineitem) c LEFT JOIN flow_nation f ON f.station_id = s.station_id AND f.ts = c.ts""",
    "flow_spiky": "SELECT station_id, ts, CASE WHEN (year(ts) * 366 + dayofyear(ts)) % 211 = 100 THEN value * 12 + 600 ELSE value END AS value FROM flow_region",
    "flow_flat": "SELECT station_id, ts, CASE WHEN CAST(floor((year(ts) * 366 + dayofyear(ts)) / 20.0) AS BIGINT) % 9 = 4 THEN 77.0 ELSE value END AS value FROM flow_region",
    "flow_lowered": "SELECT station_id, ts, value - 40 AS value FROM flow_nation",
    "flow_zeroed": "SELECT station_id, ts, coalesce(value, 0.0) AS value FROM flow_nation_null",
    "flow_broken": """SELECT station_id, CASE WHEN k = 2 AND dayofyear(ts) = 50 THEN 'unknown' ELSE CAST(ts AS VARCHAR) END AS ts, CASE WHEN k = 1 AND dayofyear(ts) = 100 THEN 'err' WHEN k <> 3 THEN CAST(value AS VARCHAR) END AS value
  FROM (SELECT *, CAST(split_part(station_id, '_', 2) AS INTEGER) % 6 AS k FROM flow_nation)""",
    "flow_candidate": """SELECT r_name AS station_id, CAST(l_shipdate AS DATE) AS ts,
  CASE WHEN (year(CAST(l_shipdate AS DATE)) * 366 + dayofyear(CAST(l_shipdate AS DATE))) % 17 <> 0 THEN CAST(count(*) * 25.5 AS DOUBLE) END AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, CAST(l_shipdate AS DATE)""",
    "context": """SELECT n_name AS station_id, CAST(5.0 + 0.25 * (n_nationkey % 5) AS DOUBLE) AS longitude, CAST(47.0 + 0.25 * floor(n_nationkey / 5.0) AS DOUBLE) AS latitude,
  'river_' || CAST(n_regionkey AS VARCHAR) AS river_name, r_name AS catchment_name, CAST(500.0 + 40.0 * n_nationkey AS DOUBLE) AS catchment_area_km2, 'observation' AS series_type
  FROM nation JOIN region ON n_regionkey = r_regionkey""",
}
_NEEDS = {"flow_broken": ["flow_nation"], "flow_nation_null": ["flow_nation"], "flow_spiky": ["flow_region"], "flow_flat": ["flow_region"], "flow_lowered": ["flow_nation"], "flow_zeroed": ["flow_nation", "flow_nation_null"]}


def with_sql(names: list[str], rest: str) -> str:
    """``WITH`` the named series, then ``rest`` (further expressions and the final SELECT)."""
    order: list[str] = []
    for name in names:
        order += [n for n in [*_NEEDS.get(name, []), name] if n not in order]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + rest
