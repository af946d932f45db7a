"""Selection and pairing as queries over the derived series, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewise.plans import fixtures as fx
from gaugewise.plans.layer1_queries import dated, r, tidy
from gaugewise.sources import readers
from gaugewise.sources.provenance import Sourced

STATIONS = ["NATION_3", "NATION_1", "NATION_3"]


def _span(s, d):
    flow = fx.nation(s, d)
    return flow, readers.select_timespan(flow, "1997-01-01", "1998-12-31")


QUERIES = {
    "sel_stations": lambda s, d: tidy(readers.select_stations(fx.nation(s, d), STATIONS).select("station_id", "ts", "value")),
    "sel_timespan": lambda s, d: tidy(_span(s, d)[1].select("station_id", "ts", "value")),
    "timespan_meta": lambda s, d: tidy(readers.timespan_metadata(*_span(s, d))),
    "provenance": lambda s, d: tidy(Sourced(fx.nation(s, d), {"path": "lineitem", "format": "parquet", "unit": "pieces"}).timespan("1997-01-01", "1998-12-31").table().select("station_id", "provenance.*").withColumn("transformations", F.array_join("transformations", "; "))),
    "pair_status": lambda s, d: tidy(readers.pair_status(fx.region(s, d), fx.candidate(s, d).where(F.col("station_id") != "ASIA"))),
}
ORACLE_SQL = {
    "sel_stations": dated(fx.with_sql(["flow_nation"], f" SELECT station_id, ts, {r('value')} AS value FROM flow_nation WHERE station_id IN ('NATION_1', 'NATION_3')"), "ts"),
    "sel_timespan": dated(fx.with_sql(["flow_nation"], f" SELECT station_id, ts, {r('value')} AS value FROM flow_nation WHERE ts BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"), "ts"),
    "timespan_meta": dated(fx.with_sql(["flow_nation"], """, a AS (SELECT station_id, min(ts) AS source_start, max(ts) AS source_end, count(*) AS source_count FROM flow_nation GROUP BY 1),
 b AS (SELECT station_id, min(ts) AS selected_start, max(ts) AS selected_end, count(*) AS selected_count, count(value) AS valid_count, min(ts) AS first_valid, max(ts) AS last_valid FROM flow_nation WHERE ts BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1)
 SELECT a.*, selected_start, selected_end, coalesce(selected_count, 0) AS selected_count, coalesce(valid_count, 0) AS valid_count, first_valid, last_valid FROM a LEFT JOIN b ON a.station_id = b.station_id"""), "source_start", "source_end", "selected_start", "selected_end", "first_valid", "last_valid"),
    "provenance": dated(fx.with_sql(["flow_nation"], """, a AS (SELECT station_id, min(ts) AS source_start, max(ts) AS source_end, count(*) AS source_count, min(ts) FILTER (WHERE x) AS selected_start, max(ts) FILTER (WHERE x) AS selected_end, count(*) FILTER (WHERE x) AS selected_count,
   min(ts) FILTER (WHERE x AND value IS NOT NULL) AS first_valid, max(ts) FILTER (WHERE x AND value IS NOT NULL) AS last_valid, count(value) FILTER (WHERE x) AS valid_count
  FROM (SELECT *, ts BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AS x FROM flow_nation) GROUP BY 1)
 SELECT *, 'lineitem' AS path, 'parquet' AS format, CAST(NULL AS VARCHAR) AS variable, CAST(NULL AS VARCHAR) AS station_coordinate, CAST(NULL AS VARCHAR) AS time_coordinate, 'pieces' AS unit, 'range' AS requested_mode, '1997-01-01' AS requested_start, '1998-12-31' AS requested_end, 'selected timespan' AS transformations FROM a"""), "source_start", "source_end", "selected_start", "selected_end", "first_valid", "last_valid"),
    "pair_status": fx.with_sql(["flow_region", "flow_candidate"], " SELECT a.station_id, CASE WHEN b.station_id IS NULL THEN 'not_available' ELSE 'available' END AS series2_status FROM (SELECT DISTINCT station_id FROM flow_region) a LEFT JOIN (SELECT DISTINCT station_id FROM flow_candidate WHERE value IS NOT NULL AND station_id <> 'ASIA') b ON a.station_id = b.station_id"),
}
