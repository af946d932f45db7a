"""Network context and network-level tables as queries over the derived series, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.functions.shared import written
from gaugewise.operators import composite, context, epoch_drift, failures, layer1, layer2, network, step_shift
from gaugewise.operators.primitives import KEYS, prepared
from gaugewise.plans import fixtures as fx
from gaugewise.plans.composite_queries import changes_sql, tiers_sql
from gaugewise.plans.layer1_queries import r, record, tidy
from gaugewise.plans.layer2_queries import BASEFLOW, REPRESENTATIVE, annual_sql, events_sql, yearly_sql
from gaugewise.sources import readers

#: A lower threshold, so that sparse records have shifts.
STEPS = {"structural_threshold": 1.0}
LOCAL = {"maximum_search_radius_km": 60.0}
WIDTH, HEIGHT = 72, 36


def _dirty(s, d) -> DataFrame:
    """The context with text numbers, a repeated station, a bad latitude and an unknown type."""
    rows = fx.context(s, d)
    key = F.substring_index("station_id", "_", -1).cast("int")
    rows = rows.withColumns({"latitude": F.when(key == 3, "north").otherwise(F.col("latitude").cast("string")), "series_type": F.when(key == 5, " OBS ").when(key == 7, "guess").otherwise("observed"), "catchment_area_km2": F.when(key == 9, -1.0).otherwise(F.col("catchment_area_km2")), "station_id": F.when(key == 2, " NATION_1 ").otherwise(F.col("station_id"))})
    return rows


def _texts(s, d) -> DataFrame:
    return readers.long_table(fx.broken(s, d), errors=True)


def _manifest(s, d) -> DataFrame:
    """The stations of the context with what became of their series, some of them broken."""
    (flow,), failed = failures.isolated(_texts(s, d))
    return network.manifest(fx.context(s, d), flow, failed)


def _climate(s) -> tuple[DataFrame, DataFrame]:
    cells = s.range(WIDTH * HEIGHT).select((F.col("id") / WIDTH).cast("int").alias("row"), (F.col("id") % WIDTH).cast("int").alias("col"))
    cells = cells.withColumn("climate_id", ((F.col("row") * 7 + F.floor(F.col("col") / 2)) % 31).cast("int"))
    legend = s.range(1, 31).select(F.col("id").cast("int").alias("climate_id"), F.concat(F.lit("C"), F.col("id").cast("string")).alias("climate_code"))
    return cells, legend


def _stations(s, d) -> DataFrame:
    return context.attach_climate(fx.context(s, d), *_climate(s), WIDTH, HEIGHT)


def _local(s, d) -> DataFrame:
    return context.local_peers(_stations(s, d), LOCAL)


def _evidence(s, d, changes: bool = True) -> DataFrame:
    """The evidence of all ten checks; spikes are not held against events. Without ``changes`` shifts and epochs are left out."""
    flow = prepared(fx.nation(s, d))
    annual, events = layer2.annual_signatures(flow), layer2.high_flow_events(flow)
    day = F.datediff("peak_date", F.lit("1970-01-01").cast("date"))
    number = F.datediff("ts", F.lit("1970-01-01").cast("date"))
    parts = [
        flow.groupBy(*KEYS).agg(F.min(number).alias("record_start"), F.max(number).alias("record_end")),
        events.groupBy(*KEYS).agg(F.array_sort(F.collect_list(day)).alias("peak_days")),
        annual.groupBy(*KEYS).agg(F.percentile("flashiness_index", F.lit(0.5)).alias("flashiness"), F.percentile("baseflow_index", F.lit(0.5)).alias("baseflow")),
        layer1.zero_flow_regime(flow).select(*KEYS, F.col("zero_ratio").alias("zero_flow")),
        layer2.seasonality_profile(layer2.monthly_profile(flow)).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "median"))), lambda x: x["median"]).alias("profile")),
        layer2.representative_event(events).select(*KEYS, "curve", "peak_flow", "time_to_peak_days", "event_duration_days"),
    ]
    if not changes:
        return context.with_availability(reduce(lambda a, b: a.join(b, KEYS, "left"), parts).withColumns({"shift_days": F.lit(None).cast("array<int>"), "epoch_behaviour": F.lit(None).cast("string")}))
    shift = F.datediff("boundary_date", F.lit("1970-01-01").cast("date"))
    parts += [
        step_shift.tiered_boundaries(flow, STEPS).where("tier <> 'Tier 3'").groupBy(*KEYS).agg(F.array_sort(F.collect_list(shift)).alias("shift_days")),
        step_shift.step_shift(flow, STEPS).select(*KEYS, F.col("assessed").alias("steps_assessed")), epoch_drift.epoch_drift(flow).select(*KEYS, F.col("dominant_state").alias("epoch_behaviour")),
    ]
    out = reduce(lambda a, b: a.join(b, KEYS, "left"), parts)
    return context.with_availability(out.withColumn("shift_days", F.when(F.col("steps_assessed"), F.coalesce("shift_days", F.array().cast("array<int>")))).drop("steps_assessed"))


def _similar(s, d, analogue: bool = False, found: DataFrame | None = None) -> DataFrame:
    peers = _local(s, d)
    if analogue:
        peers = context.analogue_peers(_stations(s, d), peers, {"require_same_climate": False})
    return context.pair_checks(peers, _evidence(s, d) if found is None else found)


def _pick(*names: str):
    return lambda s, d: tidy(_similar(s, d, found=_evidence(s, d, False)).where(F.col("check").isin(*names)).drop("pair_status", "reason"))


def _combined(s, d) -> DataFrame:
    found = written(_evidence(s, d), "evidence")
    near, far = context.finished_checks(_similar(s, d, False, found)), context.finished_checks(_similar(s, d, True, found).where(F.col("check").isin(context.SHARED)))
    return context.combined_checks(near, far)


def _assessed(s, d):
    flow = fx.flat(s, d)
    parts = written(composite.components(flow), "components")
    return parts, composite.composite(parts)


QUERIES = {
    "ctx_validate": lambda s, d: tidy(context.validate_context(_dirty(s, d))),
    "climate_lookup": lambda s, d: tidy(_stations(s, d).select("station_id", "climate_id", "climate_code")),
    "haversine": lambda s, d: tidy(context.candidates(_stations(s, d), 150.0).select("station_id", "peer_station_id", "distance_km")),
    "peer_candidates": lambda s, d: tidy(context.candidates(_stations(s, d), 60.0)),
    "peers_local": lambda s, d: tidy(_local(s, d).select("station_id", "peer_station_id", "distance_km", "catchment_area_ratio", "relationship_rank", "peer_rank", "ready")),
    "peers_analogue": lambda s, d: tidy(context.analogue_peers(_stations(s, d), _local(s, d), {"require_same_climate": False}).select("station_id", "peer_station_id", "distance_km", "catchment_area_ratio", "relationship_rank", "peer_rank", "ready")),
    "date_match": _pick("peak_timing"),
    "l3_peak_timing": lambda s, d: tidy(context.finished_checks(_similar(s, d, found=_evidence(s, d, False)).where("check = 'peak_timing'"))),
    "l3_shift": lambda s, d: tidy(context.finished_checks(_similar(s, d).where("check = 'step_shift_timing'"))),
    "l3_epoch": lambda s, d: tidy(context.finished_checks(_similar(s, d).where("check = 'epoch_behaviour'"))),
    "l3_pair_checks": lambda s, d: tidy(_similar(s, d)),
    "l3_availability": lambda s, d: tidy(_evidence(s, d).select("station_id", F.explode("availability").alias("kind", "available"), "unavailable_reasons").select("station_id", "kind", "available", F.try_element_at("unavailable_reasons", F.col("kind")).alias("reason"))),
    "l3_scalar": _pick("flashiness", "baseflow", "zero_flow"),
    "l3_seasonality": _pick("seasonality_shape"),
    "l3_event_metric": _pick("event_time_to_peak", "event_duration"),
    "l3_event_shape": _pick("event_shape"),
    "l3_checks": lambda s, d: tidy(context.finished_checks(_similar(s, d))),
    "l3_context": lambda s, d: tidy(context.context_summary(context.finished_checks(_similar(s, d)), context.LOCAL_ONLY + context.SHARED)),
    "l3_combined_checks": lambda s, d: tidy(_combined(s, d)),
    "l3_combined": lambda s, d: tidy(context.combined_context(_combined(s, d))),
    "l3_evidence": lambda s, d: tidy(_evidence(s, d).select("station_id", "record_start", "record_end", F.size("peak_days").alias("peaks"), "flashiness", "baseflow", "zero_flow", "peak_flow", "time_to_peak_days", "event_duration_days")),
    "l3_run": lambda s, d: tidy(context.network_context(fx.nation(s, d), _stations(s, d), {"local_peers": LOCAL})["combined"]),
    "net_counts": lambda s, d: tidy(network.assessment_counts(_assessed(s, d)[1])),
    "net_ranking": lambda s, d: tidy(network.attention_ranking(_assessed(s, d)[1])),
    "net_triggers": lambda s, d: tidy(network.trigger_summary(_assessed(s, d)[0])),
    "review_required": lambda s, d: tidy(network.requires_review(_assessed(s, d)[1])),
    "status_index": lambda s, d: tidy(network.status_index(_assessed(s, d)[1])),
    "net_failures": lambda s, d: failures.station_failures(_texts(s, d)).drop("series_slot"),
    "manifest": _manifest,
}

_STATIONS = """,
st0 AS (SELECT *, least(CAST(trunc((longitude + 180.0) / 5.0) AS INTEGER), 71) AS col, least(CAST(trunc((90.0 - latitude) / 5.0) AS INTEGER), 35) AS row_ FROM context),
st AS (SELECT st0.*, CASE WHEN (row_ * 7 + col // 2) % 31 BETWEEN 1 AND 30 THEN CAST((row_ * 7 + col // 2) % 31 AS INTEGER) END AS climate_id, CASE WHEN (row_ * 7 + col // 2) % 31 BETWEEN 1 AND 30 THEN 'C' || CAST((row_ * 7 + col // 2) % 31 AS VARCHAR) END AS climate_code FROM st0),
pa AS (SELECT a.station_id, b.station_id AS peer_station_id, 2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin((radians(b.longitude) - radians(a.longitude)) / 2), 2))))) AS distance_km,
 greatest(b.catchment_area_km2 / a.catchment_area_km2, a.catchment_area_km2 / b.catchment_area_km2) AS catchment_area_ratio, a.catchment_name = b.catchment_name AS same_catchment, a.river_name = b.river_name AS same_river, coalesce(a.climate_code = b.climate_code, FALSE) AS same_climate,
 CASE WHEN a.catchment_name = b.catchment_name AND a.river_name = b.river_name THEN 0 WHEN a.catchment_name = b.catchment_name THEN 1 WHEN a.river_name = b.river_name THEN 2 ELSE 3 END AS relationship_rank FROM st a JOIN st b ON a.station_id <> b.station_id),
lp AS (SELECT *, count(*) OVER (PARTITION BY station_id) >= 1 AS ready FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY relationship_rank, distance_km, catchment_area_ratio, peer_station_id) AS peer_rank FROM pa WHERE distance_km <= 60) WHERE peer_rank <= 5),
ap AS (SELECT *, count(*) OVER (PARTITION BY station_id) >= 2 AS ready FROM (SELECT pa.*, row_number() OVER (PARTITION BY pa.station_id ORDER BY pa.catchment_area_ratio, pa.relationship_rank, pa.distance_km, pa.peer_station_id) AS peer_rank
 FROM pa LEFT JOIN lp ON pa.station_id = lp.station_id AND pa.peer_station_id = lp.peer_station_id WHERE lp.station_id IS NULL AND pa.distance_km <= 1000 AND pa.catchment_area_ratio <= 2) WHERE peer_rank <= 5)"""
_EVIDENCE = record("flow_nation") + yearly_sql("flow_nation") + BASEFLOW + ", sp AS (SELECT station_id, ts FROM flow_nation WHERE FALSE)" + annual_sql("sp") + events_sql("flow_nation") + ", eligible AS (SELECT *, TRUE AS representative_eligible FROM events)" + REPRESENTATIVE + """,
re AS (SELECT station_id, min(ts) AS rs, max(ts) AS re_ FROM flow_nation WHERE value IS NOT NULL GROUP BY 1),
sg AS (SELECT station_id, quantile_cont(flashiness_index, 0.5) AS flashiness, quantile_cont(baseflow_index, 0.5) AS baseflow FROM annual GROUP BY 1),
zr AS (SELECT station_id, count(*) FILTER (WHERE round_even(value, 3) = 0) / CAST(count(value) AS DOUBLE) AS zero_flow FROM record GROUP BY 1),
pr AS (SELECT station_id, month, quantile_cont(monthly_median, 0.5) AS median FROM monthly GROUP BY 1, 2),
pdays AS (SELECT station_id, peak_date AS day FROM events),""" + changes_sql("flow_nation", STEPS["structural_threshold"]) + """,
have AS (SELECT re.station_id, coalesce(sa.done, FALSE) AS shift, eb.one AS epoch, zr.zero_flow IS NOT NULL AS zero, coalesce(sg.flashiness IS NOT NULL OR sg.baseflow IS NOT NULL, FALSE) AS yearly, pz.station_id IS NOT NULL AS months, rz.station_id IS NOT NULL AS event
  FROM re LEFT JOIN sa ON re.station_id = sa.station_id LEFT JOIN eb ON re.station_id = eb.station_id LEFT JOIN zr ON re.station_id = zr.station_id LEFT JOIN sg ON re.station_id = sg.station_id
  LEFT JOIN (SELECT DISTINCT station_id FROM pr WHERE median IS NOT NULL) pz ON re.station_id = pz.station_id LEFT JOIN (SELECT DISTINCT station_id FROM representative) rz ON re.station_id = rz.station_id)"""
_SIMILAR = """,
prs AS (SELECT station_id, peer_station_id FROM {peers} WHERE station_id IN (SELECT station_id FROM re) AND peer_station_id IN (SELECT station_id FROM re)),
sc AS (SELECT p.station_id, p.peer_station_id, a.flashiness AS fa, b.flashiness AS fb, a.baseflow AS ba, b.baseflow AS bb, za.zero_flow AS z1, zb.zero_flow AS z2 FROM prs p LEFT JOIN sg a ON p.station_id = a.station_id LEFT JOIN sg b ON p.peer_station_id = b.station_id LEFT JOIN zr za ON p.station_id = za.station_id LEFT JOIN zr zb ON p.peer_station_id = zb.station_id),
se AS (SELECT p.station_id, p.peer_station_id, CASE WHEN count(*) >= 6 THEN sum(a.median * b.median) / (sqrt(sum(a.median * a.median)) * sqrt(sum(b.median * b.median))) END AS v FROM prs p JOIN pr a ON p.station_id = a.station_id JOIN pr b ON p.peer_station_id = b.station_id AND a.month = b.month GROUP BY 1, 2),
em AS (SELECT p.station_id, p.peer_station_id, abs(b.time_to_peak_days - a.time_to_peak_days) AS t, abs(b.event_duration_days - a.event_duration_days) AS u, a.peak_flow AS pa_, b.peak_flow AS pb_ FROM prs p LEFT JOIN representative a ON p.station_id = a.station_id LEFT JOIN representative b ON p.peer_station_id = b.station_id),
cv AS (SELECT e.station_id, row_number() OVER (PARTITION BY e.station_id ORDER BY f.ts) - 1 AS i, count(*) OVER (PARTITION BY e.station_id) AS n, f.value FROM representative e JOIN flow_nation f ON e.station_id = f.station_id AND f.ts BETWEEN e.event_start AND e.event_end),
rp AS (SELECT t.station_id, t.k, a.value + (b.value - a.value) * (place - floor(place)) AS v FROM (SELECT station_id, k, k * (n - 1) / 100.0 AS place, n FROM (SELECT DISTINCT station_id, n FROM cv WHERE n >= 2) CROSS JOIN (SELECT unnest(range(0, 101)) AS k)) t
 JOIN cv a ON a.station_id = t.station_id AND a.i = CAST(floor(place) AS BIGINT) JOIN cv b ON b.station_id = t.station_id AND b.i = least(CAST(floor(place) AS BIGINT) + 1, t.n - 1)),
sh AS (SELECT p.station_id, p.peer_station_id, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS v FROM prs p JOIN rp a ON p.station_id = a.station_id JOIN rp b ON p.peer_station_id = b.station_id AND a.k = b.k GROUP BY 1, 2),
ov AS (SELECT p.station_id, p.peer_station_id, greatest(a.rs, b.rs) AS lo, least(a.re_, b.re_) AS hi FROM prs p JOIN re a ON p.station_id = a.station_id JOIN re b ON p.peer_station_id = b.station_id),
{dates}
sims AS (SELECT station_id, peer_station_id, 'peak_timing' AS chk, v AS similarity FROM pk UNION ALL SELECT ov.station_id, ov.peer_station_id, 'step_shift_timing', CASE WHEN ha.shift AND hb.shift THEN v END FROM ov JOIN spk ON ov.station_id = spk.station_id AND ov.peer_station_id = spk.peer_station_id JOIN have ha ON ov.station_id = ha.station_id JOIN have hb ON ov.peer_station_id = hb.station_id
 UNION ALL SELECT ov.station_id, ov.peer_station_id, 'epoch_behaviour', CASE WHEN hi - lo + 1 >= 5 * 365.25 AND ha.epoch IS NOT NULL AND hb.epoch IS NOT NULL THEN CASE WHEN ha.epoch = hb.epoch THEN 1.0 ELSE 0.0 END END FROM ov JOIN have ha ON ov.station_id = ha.station_id JOIN have hb ON ov.peer_station_id = hb.station_id UNION ALL SELECT station_id, peer_station_id, 'flashiness', CASE WHEN fa = 0 AND fb = 0 THEN 1.0 WHEN fa = 0 OR fb = 0 THEN 0.0 ELSE least(fa, fb) / greatest(fa, fb) END FROM sc
 UNION ALL SELECT station_id, peer_station_id, 'baseflow', CASE WHEN ba IS NOT NULL AND bb IS NOT NULL THEN greatest(0.0, least(1.0, 1 - abs(ba - bb))) END FROM sc UNION ALL SELECT station_id, peer_station_id, 'zero_flow', CASE WHEN z1 IS NOT NULL AND z2 IS NOT NULL THEN greatest(0.0, least(1.0, 1 - abs(z1 - z2))) END FROM sc
 UNION ALL SELECT p.station_id, p.peer_station_id, 'seasonality_shape', v FROM prs p LEFT JOIN se ON p.station_id = se.station_id AND p.peer_station_id = se.peer_station_id
 UNION ALL SELECT em.station_id, em.peer_station_id, 'event_shape', sh.v * least(pa_, pb_) / greatest(pa_, pb_) FROM em LEFT JOIN sh ON em.station_id = sh.station_id AND em.peer_station_id = sh.peer_station_id
 UNION ALL SELECT station_id, peer_station_id, 'event_time_to_peak', CASE WHEN t IS NOT NULL THEN greatest(0.0, 1 - t / 10.0) END FROM em UNION ALL SELECT station_id, peer_station_id, 'event_duration', CASE WHEN u IS NOT NULL THEN greatest(0.0, 1 - u / 14.0) END FROM em),
lst AS (SELECT *, CASE WHEN chk IN ('peak_timing', 'step_shift_timing', 'epoch_behaviour', 'event_time_to_peak', 'event_duration') THEN 0.5 ELSE 0.8 END AS least_ FROM sims),
why AS (SELECT lst.*, hi < lo AS apart, CASE WHEN similarity IS NOT NULL THEN NULL WHEN NOT {avail_a} THEN 'target evidence is unavailable' WHEN NOT {avail_b} THEN 'peer evidence is unavailable'
   WHEN chk IN ('peak_timing', 'step_shift_timing', 'epoch_behaviour') AND hi < lo THEN 'no common period' WHEN chk = 'peak_timing' AND np_ = 0 OR chk = 'step_shift_timing' AND ns_ = 0 THEN 'neither station has dates in the common period'
   WHEN chk = 'epoch_behaviour' AND hi - lo + 1 < 5 * 365.25 THEN 'common period is too short' ELSE 'evidence is not comparable' END AS reason
  FROM lst JOIN ov ON lst.station_id = ov.station_id AND lst.peer_station_id = ov.peer_station_id JOIN have ha ON lst.station_id = ha.station_id JOIN have hb ON lst.peer_station_id = hb.station_id
  JOIN (SELECT station_id, peer_station_id, any_value(len(x) + len(y)) AS np_ FROM walk GROUP BY 1, 2) wp ON lst.station_id = wp.station_id AND lst.peer_station_id = wp.peer_station_id JOIN (SELECT station_id, peer_station_id, any_value(len(x) + len(y)) AS ns_ FROM swalk GROUP BY 1, 2) ws ON lst.station_id = ws.station_id AND lst.peer_station_id = ws.peer_station_id),
told AS (SELECT *, CASE WHEN similarity >= least_ THEN 'supported' WHEN similarity IS NOT NULL THEN 'not_supported' WHEN reason LIKE 'neither%' THEN 'not_applicable' ELSE 'not_assessed' END AS pair_status FROM why),
chk AS (SELECT station_id, chk, quantile_cont(similarity, 0.5) AS similarity, count(similarity) AS assessed_peer_count, count(*) FILTER (WHERE similarity >= least_) AS supporting_peer_count, any_value(least_) AS least_, count(*) FILTER (WHERE pair_status = 'not_applicable') AS nap, bool_and(coalesce(reason LIKE 'target%', FALSE)) AS lacking FROM told GROUP BY 1, 2),
checks AS (SELECT station_id, chk, CASE WHEN assessed_peer_count = 0 THEN 'not_assessed' WHEN similarity >= least_ THEN 'supported' ELSE 'not_supported' END AS status, similarity, assessed_peer_count, supporting_peer_count, nap, CASE WHEN assessed_peer_count = 0 THEN CASE WHEN lacking THEN 'target evidence is unavailable' ELSE 'no peer has comparable evidence in a common period' END END AS reason FROM chk)"""
_NAMES = "prs sc se em cv rp sh ov ad bd ab walk pk sad sbd sab swalk spk sims lst why told chk checks".split()


def _dates(p: str, days: str, tolerance: int) -> str:
    near = f"abs(x[i] - y[j]) <= {tolerance}"
    side = "SELECT o.station_id, o.peer_station_id, list(CAST(e.day - DATE '1970-01-01' AS INTEGER) ORDER BY e.day) AS d FROM ov o JOIN {days} e ON e.station_id = o.{who} AND e.day BETWEEN lo AND hi GROUP BY 1, 2"
    return f"""{p}ad AS ({side.format(days=days, who="station_id")}),
{p}bd AS ({side.format(days=days, who="peer_station_id")}),
{p}ab AS (SELECT o.station_id, o.peer_station_id, coalesce(a.d, []) AS x, coalesce(b.d, []) AS y FROM ov o LEFT JOIN {p}ad a ON o.station_id = a.station_id AND o.peer_station_id = a.peer_station_id LEFT JOIN {p}bd b ON o.station_id = b.station_id AND o.peer_station_id = b.peer_station_id),
{p}walk AS (SELECT station_id, peer_station_id, x, y, 1 AS i, 1 AS j, 0 AS m FROM {p}ab UNION ALL SELECT station_id, peer_station_id, x, y, i + CASE WHEN {near} OR x[i] < y[j] THEN 1 ELSE 0 END, j + CASE WHEN {near} OR x[i] > y[j] THEN 1 ELSE 0 END, m + CASE WHEN {near} THEN 1 ELSE 0 END
 FROM {p}walk WHERE i <= len(x) AND j <= len(y)),
{p}pk AS (SELECT station_id, peer_station_id, CASE WHEN any_value(len(x) + len(y)) > 0 THEN 2.0 * max(m) / any_value(len(x) + len(y)) END AS v FROM {p}walk GROUP BY 1, 2),"""


_AVAILABLE = "(CASE chk WHEN 'peak_timing' THEN TRUE WHEN 'step_shift_timing' THEN {h}.shift WHEN 'epoch_behaviour' THEN {h}.epoch IS NOT NULL WHEN 'zero_flow' THEN {h}.zero WHEN 'flashiness' THEN {h}.yearly WHEN 'baseflow' THEN {h}.yearly WHEN 'seasonality_shape' THEN {h}.months ELSE {h}.event END)"


def _similar_sql(peers: str, p: str = "") -> str:
    import re

    body = _SIMILAR.replace("{peers}", peers).replace("{avail_a}", _AVAILABLE.format(h="ha")).replace("{avail_b}", _AVAILABLE.format(h="hb"))
    body = body.replace("{dates}", _dates("", "pdays", 5) + "\n" + _dates("s", "sdays", 50))
    if not p:
        return body
    for n in _NAMES:
        body = re.sub(rf"(?<=[,\n ]){n} AS \(SELECT", f"{p}{n} AS (SELECT", body)
        body = re.sub(rf"\b(FROM|JOIN) {n}\b(?= (?:ON|JOIN|LEFT)\b)", rf"\1 {p}{n} {n}", body)  # named by itself further on
        body = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {p}{n}", body)
    return body


_BASE = fx.with_sql(["flow_nation", "context"], _STATIONS + _EVIDENCE).replace("WITH ", "WITH RECURSIVE ", 1)
_ONE = _BASE + _similar_sql("lp")
_TWO = _ONE + _similar_sql("ap", "x_") + """,
tg AS (SELECT station_id FROM checks UNION SELECT station_id FROM x_checks),
nm AS (SELECT station_id, unnest(['peak_timing', 'step_shift_timing', 'epoch_behaviour', 'flashiness', 'baseflow', 'zero_flow', 'seasonality_shape', 'event_shape', 'event_time_to_peak', 'event_duration']) AS chk FROM tg),
cb0 AS (SELECT n.station_id, n.chk, n.chk IN ('peak_timing', 'step_shift_timing', 'epoch_behaviour') AS only_, l.similarity AS l, CASE WHEN n.chk NOT IN ('peak_timing', 'step_shift_timing', 'epoch_behaviour') THEN a.similarity END AS a
 FROM nm n LEFT JOIN checks l ON n.station_id = l.station_id AND n.chk = l.chk LEFT JOIN x_checks a ON n.station_id = a.station_id AND n.chk = a.chk),
cb AS (SELECT station_id, chk, l, a, CASE WHEN l IS NULL THEN NULL WHEN only_ OR a IS NULL THEN 100 * l ELSE 100 * l * 0.7 END AS lc, CASE WHEN only_ AND l IS NOT NULL THEN 0.0 WHEN a IS NOT NULL THEN 100 * a * 0.3 END AS ac FROM cb0),
cbt AS (SELECT *, CASE WHEN l IS NOT NULL OR a IS NOT NULL THEN coalesce(lc, 0.0) + coalesce(ac, 0.0) END AS total FROM cb)"""


def _grade(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'Not assessed' WHEN {x} >= 75 THEN 'Strong agreement' WHEN {x} >= 40 THEN 'Moderate agreement' ELSE 'Low agreement' END"


def _sims(*names: str) -> str:
    return _ONE + f" SELECT station_id, peer_station_id, chk AS \"check\", {r('similarity')} AS similarity FROM sims WHERE chk IN ({', '.join(repr(n) for n in names)})"


_CHECKS = f" SELECT station_id, chk AS \"check\", status, {r('similarity')} AS similarity, assessed_peer_count, supporting_peer_count, nap AS not_applicable_peer_count, reason FROM checks"
_PEER = f"station_id, peer_station_id, {r('distance_km')} AS distance_km, {r('catchment_area_ratio')} AS catchment_area_ratio, relationship_rank, CAST(peer_rank AS INTEGER) AS peer_rank, ready"
_ERRORS = """, errors AS (
  SELECT station_id, arg_min(error_type, day) AS error_type, arg_min(error_message, day) AS error_message, count(*) AS failed_rows FROM (
    SELECT station_id, coalesce(try_cast(ts AS TIMESTAMP), TIMESTAMP '0001-01-01') AS day, CASE WHEN try_cast(ts AS TIMESTAMP) IS NULL THEN 'TypeError' ELSE 'ValueError' END AS error_type,
      CASE WHEN try_cast(ts AS TIMESTAMP) IS NULL THEN 'not a date: ' || ts ELSE 'not a number: ' || value END AS error_message
    FROM flow_broken WHERE try_cast(ts AS TIMESTAMP) IS NULL OR (value IS NOT NULL AND try_cast(value AS DOUBLE) IS NULL)
  ) GROUP BY station_id)"""
ORACLE_SQL = {
    "ctx_validate": fx.with_sql(["context"], """, k AS (SELECT *, CAST(split_part(station_id, '_', 2) AS INTEGER) AS key FROM context),
 w AS (SELECT CASE WHEN key = 2 THEN 'NATION_1' ELSE station_id END AS station_id, longitude, CASE WHEN key = 3 THEN NULL ELSE latitude END AS latitude, river_name, catchment_name, CASE WHEN key = 9 THEN -1.0 ELSE catchment_area_km2 END AS catchment_area_km2, CASE WHEN key = 7 THEN NULL ELSE 'observation' END AS series_type FROM k)
 SELECT *, concat_ws('; ', CASE WHEN count(*) OVER (PARTITION BY station_id) > 1 THEN 'duplicate station_id' END, CASE WHEN latitude IS NULL THEN 'invalid latitude' END, CASE WHEN NOT catchment_area_km2 > 0 THEN 'invalid catchment area' END, CASE WHEN series_type IS NULL THEN 'unknown series_type' END) AS rejection_reason FROM w"""),
    "climate_lookup": fx.with_sql(["context"], _STATIONS + " SELECT station_id, climate_id, climate_code FROM st"),
    "haversine": fx.with_sql(["context"], _STATIONS + f" SELECT station_id, peer_station_id, {r('distance_km')} AS distance_km FROM pa WHERE distance_km <= 150"),
    "peer_candidates": fx.with_sql(["context"], _STATIONS + f" SELECT station_id, peer_station_id, {r('distance_km')} AS distance_km, {r('catchment_area_ratio')} AS catchment_area_ratio, same_catchment, same_river, same_climate, relationship_rank FROM pa WHERE distance_km <= 60"),
    "peers_local": fx.with_sql(["context"], _STATIONS + f" SELECT {_PEER} FROM lp"),
    "peers_analogue": fx.with_sql(["context"], _STATIONS + f" SELECT {_PEER} FROM ap"),
    "date_match": _sims("peak_timing"),
    "l3_peak_timing": _ONE + _CHECKS + " WHERE chk = 'peak_timing'",
    "l3_shift": _ONE + _CHECKS + " WHERE chk = 'step_shift_timing'",
    "l3_epoch": _ONE + _CHECKS + " WHERE chk = 'epoch_behaviour'",
    "l3_pair_checks": _ONE + f" SELECT station_id, peer_station_id, chk AS \"check\", {r('similarity')} AS similarity, pair_status, reason FROM told",
    "l3_availability": _BASE + """ SELECT station_id, kind, available, CASE WHEN NOT available THEN 'Required Layer 1/2 evidence was unavailable or not calculable.' END AS reason FROM (
 SELECT station_id, unnest(['peak_dates', 'step_shift_dates', 'epoch_behaviour', 'zero_flow_ratio', 'annual_signatures', 'seasonality_profile', 'representative_event']) AS kind, unnest([TRUE, shift, epoch IS NOT NULL, zero, yearly, months, event]) AS available FROM have)""",
    "l3_scalar": _sims("flashiness", "baseflow", "zero_flow"),
    "l3_seasonality": _sims("seasonality_shape"),
    "l3_event_metric": _sims("event_time_to_peak", "event_duration"),
    "l3_event_shape": _sims("event_shape"),
    "l3_checks": _ONE + _CHECKS,
    "l3_context": _ONE + f" SELECT station_id, {r('100 * avg(similarity)')} AS score_percent, {_grade('100 * avg(similarity)')} AS classification, count(*) FILTER (WHERE status = 'supported') AS supported_checks, count(similarity) AS assessed_checks, {r('100.0 * count(similarity) / 10')} AS coverage_percent FROM checks GROUP BY 1",
    "l3_combined_checks": _TWO + f" SELECT station_id, chk AS \"check\", {r('l')} AS local_support_fraction, {r('a')} AS comparable_support_fraction, {r('lc')} AS local_contribution_percent, {r('ac')} AS comparable_contribution_percent, {r('total')} AS combined_similarity_percent FROM cbt",
    "l3_combined": _TWO + f" SELECT station_id, {r('avg(total)')} AS combined_score_percent, {_grade('avg(total)')} AS combined_classification, {r('avg(CASE WHEN total IS NOT NULL THEN coalesce(lc, 0.0) END)')} AS local_contribution_percent, {r('avg(CASE WHEN total IS NOT NULL THEN coalesce(ac, 0.0) END)')} AS comparable_contribution_percent, count(total) AS assessed_checks, coalesce(avg(total) >= 50, FALSE) AS report_similarity_met FROM cbt GROUP BY 1",
    "l3_evidence": _BASE + f""", pc AS (SELECT station_id, count(*) AS peaks FROM events GROUP BY 1) SELECT re.station_id, CAST(rs - DATE '1970-01-01' AS INTEGER) AS record_start, CAST(re_ - DATE '1970-01-01' AS INTEGER) AS record_end, CAST(peaks AS INTEGER) AS peaks, {r('flashiness')} AS flashiness, {r('baseflow')} AS baseflow, {r('zero_flow')} AS zero_flow,
 {r('peak_flow')} AS peak_flow, {r('time_to_peak_days')} AS time_to_peak_days, {r('event_duration_days')} AS event_duration_days FROM re LEFT JOIN pc ON re.station_id = pc.station_id LEFT JOIN sg ON re.station_id = sg.station_id LEFT JOIN zr ON re.station_id = zr.station_id LEFT JOIN representative e ON re.station_id = e.station_id""",
    "net_failures": fx.with_sql(["flow_broken"], _ERRORS + " SELECT station_id, 'load' AS stage, error_type, error_message, failed_rows FROM errors"),
    "manifest": fx.with_sql(["flow_broken", "context"], _ERRORS + """, n AS (SELECT station_id, count(value) AS n FROM flow_broken GROUP BY 1)
 SELECT c.station_id, CASE WHEN e.station_id IS NOT NULL THEN 'failed' WHEN coalesce(n, 0) = 0 THEN 'skipped' ELSE 'completed' END AS status, CASE WHEN e.station_id IS NOT NULL OR coalesce(n, 0) = 0 THEN 'not_attempted' ELSE 'disabled' END AS series2_status, false AS review_required,
  CASE WHEN e.station_id IS NULL AND coalesce(n, 0) = 0 THEN 'NoValidSeries1Values' ELSE error_type END AS error_type, CASE WHEN e.station_id IS NULL AND coalesce(n, 0) = 0 THEN 'no valid observations' ELSE error_message END AS error_message,
  'not_assessed' AS layer3_status, CASE WHEN e.station_id IS NULL THEN coalesce(n, 0) ELSE 0 END AS valid_count
 FROM context c LEFT JOIN errors e ON c.station_id = e.station_id LEFT JOIN n ON c.station_id = n.station_id"""),
}
_NET = tiers_sql("flow_flat") + """, ncl AS (SELECT station_id, 100.0 * sum(p * w) / sum(CASE WHEN p IS NOT NULL THEN 2 * w END) AS pct FROM al GROUP BY 1),
nc AS (SELECT station_id, pct, CASE WHEN pct >= 20 THEN 'Needs review' WHEN pct >= 7.5 THEN 'Minor concerns' ELSE 'No review needed' END AS layer1_class FROM ncl),
np AS (SELECT *, CASE layer1_class WHEN 'Needs review' THEN 3 WHEN 'Minor concerns' THEN 2 ELSE 1 END AS pr_ FROM nc)"""
ORACLE_SQL |= {
    "net_counts": _NET + " SELECT layer1_class, count(*) AS series_count, count(DISTINCT station_id) AS station_count FROM nc GROUP BY 1",
    "net_ranking": _NET + f" SELECT station_id, layer1_class, {r('pct')} AS layer1_score_percent, CAST(CASE WHEN pr_ >= 2 THEN row_number() OVER (PARTITION BY pr_ >= 2 ORDER BY pr_ DESC, pct DESC, station_id) ELSE 0 END AS INTEGER) AS attention_rank FROM np",
    "net_triggers": _NET + f", tr AS (SELECT chk, count(p) AS a, count(*) FILTER (WHERE p > 0) AS t, count(*) FILTER (WHERE p = 2) AS t1, count(*) FILTER (WHERE p = 1) AS t2 FROM al GROUP BY 1) SELECT chk AS \"check\", a AS assessable_count, t1 AS tier1_count, t2 AS tier2_count, t AS triggered_count, {r('100.0 * t / nullif(a, 0)')} AS trigger_rate_percent, CAST(row_number() OVER (ORDER BY t DESC, 100.0 * t / nullif(a, 0) DESC, chk) AS INTEGER) AS place FROM tr",
    "review_required": _NET + " SELECT station_id, layer1_class = 'Needs review' AS review_required, FALSE AS strong_review FROM nc",
    "status_index": _NET + " SELECT station_id, layer1_class AS series1_class, CAST(NULL AS VARCHAR) AS series2_class FROM nc",
}
