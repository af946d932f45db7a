"""Wide rows of whole stations as queries over the derived series. They hold step shift and epoch drift, so SQL expresses only the metrics that came with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.functions.shared import written
from gaugewise.operators import comparison, composite, context, contract
from gaugewise.operators.primitives import prepared, summary
from gaugewise.plans import fixtures as fx
from gaugewise.plans.context_queries import LOCAL, _stations
from gaugewise.plans.layer1_queries import r, tidy


def _layers(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The prepared flow with its rows of layers 1 and 2."""
    flow = prepared(fx.spiky(s, d))
    found = composite.screened(flow)
    return flow, contract.layer1_summary(flow, found), contract.layer2_summary(flow, found)


def _stations_in_one(s, d) -> DataFrame:
    flow, one, two = _layers(s, d)
    return contract.station_summary(flow, written(one, "layer1"), written(two, "layer2"), names={"series1": {"role": "observation", "units": "m3/s"}})


def _context(s, d) -> dict[str, DataFrame]:
    return context.network_context(fx.nation(s, d), _stations(s, d), {"local_peers": LOCAL})


def _supplied(s, d) -> DataFrame:
    given = summary(fx.region(s, d)).select("station_id", F.lit("candidate").alias("provider"), F.col("n").cast("double").alias("count"), "minimum", "maximum").unpivot(["station_id", "provider"], ["count", "minimum", "maximum"], "metric", "value")
    return comparison.supplied_metrics(given).select("station_id", "provider", F.explode("metrics").alias("metric", "value"))


QUERIES = {
    "l1_summary": lambda s, d: tidy(_layers(s, d)[1]),
    "l2_contract": lambda s, d: tidy(_layers(s, d)[2]),
    "station_summary": lambda s, d: tidy(_stations_in_one(s, d)),
    "l3_summary": lambda s, d: tidy(contract.context_summary(_context(s, d), {"local_peers": LOCAL})),
    "l3_summary_evidence": lambda s, d: tidy(contract.context_evidence(_context(s, d), {"local_peers": LOCAL})),
    "c_supplied": lambda s, d: tidy(_supplied(s, d)),
}
ORACLE_SQL = {
    "c_supplied": fx.with_sql(["flow_region"], f" SELECT station_id, 'candidate' AS provider, metric, {r('value')} AS value FROM (SELECT station_id, CAST(count(value) AS DOUBLE) AS count, min(value) AS minimum, max(value) AS maximum FROM flow_region GROUP BY 1) UNPIVOT (value FOR metric IN (count, minimum, maximum))"),
}
