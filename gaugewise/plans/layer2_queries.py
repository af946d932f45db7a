"""Signatures and events as queries over the derived series, with their SQL."""

from __future__ import annotations


from gaugewise.operators import layer1, layer2
from gaugewise.operators.primitives import prepared
from gaugewise.plans import fixtures as fx
from gaugewise.plans.layer1_queries import SPIKES, dated, r, record, tidy


def _spikes(s, d):
    return layer1.spike_candidates(fx.spiky(s, d)).where("status = 'candidate'")


def _annual(s, d):
    flow = prepared(fx.spiky(s, d))
    return layer2.annual_signatures(flow, layer1.spike_candidates(flow).where("status = 'candidate'"))


def _checked(s, d):
    flow = prepared(fx.spiky(s, d))
    events = layer2.high_flow_events(flow)
    return events, layer2.crosscheck(layer1.spike_candidates(flow).where("status = 'candidate'").select("station_id", "series_slot", "ts", "type"), events)


YEARLY = """,
yr AS (SELECT station_id, ts, value, year(ts) AS year, lag(value) OVER w AS before_, coalesce(ts - lag(ts) OVER w = 1, FALSE) AS daily FROM {source} WINDOW w AS (PARTITION BY station_id, year(ts) ORDER BY ts)),
mo AS (SELECT station_id, year, month(ts) AS month, count(value) AS valid_days, avg(value) AS monthly_mean, quantile_cont(value, 0.5) AS monthly_median FROM yr GROUP BY 1, 2, 3),
monthly AS (SELECT * FROM (SELECT *, sum(valid_days) OVER (PARTITION BY station_id, year) AS in_year FROM mo) WHERE in_year >= 30 AND valid_days >= 10),
flash AS (SELECT station_id, year, CASE WHEN sum(value) > 0 AND count(CASE WHEN daily THEN value - before_ END) > 0 THEN sum(CASE WHEN daily THEN abs(value - before_) END) / sum(value) END AS flashiness_index FROM yr GROUP BY 1, 2),
lag1 AS (SELECT station_id, year, CASE WHEN count(*) >= 3 AND var_pop(value) > 0 AND var_pop(before_) > 0 THEN covar_pop(value, before_) / (stddev_pop(value) * stddev_pop(before_)) END AS lag1_autocorrelation
  FROM yr WHERE daily AND value IS NOT NULL AND before_ IS NOT NULL GROUP BY 1, 2),
season AS (SELECT station_id, year, CASE WHEN any_value(total) > 0 THEN sum(abs(monthly_mean - total / 12)) / any_value(total) END AS seasonality_index
  FROM (SELECT *, sum(monthly_mean) OVER (PARTITION BY station_id, year) AS total, count(*) OVER (PARTITION BY station_id, year) AS n FROM monthly) WHERE n = 12 GROUP BY 1, 2),
wet AS (SELECT station_id, year, count(*) AS usable_months, arg_min(month, struct_pack(a := -monthly_median, b := month)) AS w, arg_min(month, struct_pack(a := monthly_median, b := month)) AS dr FROM monthly GROUP BY 1, 2),
seg AS (SELECT *, sum(CASE WHEN value IS NOT NULL AND NOT (daily AND before_ IS NOT NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, year ORDER BY ts) AS segment FROM yr),
b0 AS (SELECT * FROM (SELECT station_id, year, segment, ts, value, value AS x, count(*) OVER s AS days, min(value) OVER s AS lowest FROM seg WHERE value IS NOT NULL WINDOW s AS (PARTITION BY station_id, year, segment)) WHERE days >= 3 AND lowest >= 0)"""


def _pass(n: int, order: str) -> str:
    o = f"OVER (PARTITION BY station_id, year, segment ORDER BY ts {order})"
    return f""",
a{n} AS (SELECT *, row_number() {o} - 1 AS i, x - lag(x) {o} AS dx FROM b{n - 1}),
s{n} AS (SELECT *, sum(coalesce(0.9625 * dx * pow(0.925, -i), 0.0)) {o} AS s FROM a{n}),
q{n} AS (SELECT *, pow(0.925, i) * (s - min(s) {o}) AS q FROM s{n}),
b{n} AS (SELECT station_id, year, segment, ts, value, greatest(0.0, least(x, x - q)) AS x FROM q{n})"""


BASEFLOW = _pass(1, "ASC") + _pass(2, "DESC") + _pass(3, "ASC") + """,
base AS (SELECT station_id, year, CASE WHEN sum(value) > 0 THEN sum(x) / sum(value) END AS baseflow_index FROM b3 GROUP BY 1, 2)"""
EVENTS = """,
th AS (SELECT station_id, quantile_cont(value, 0.95) AS hi, quantile_cont(value, 0.9) AS lo FROM {source} GROUP BY 1 HAVING count(value) >= 3),
ev0 AS (SELECT f.station_id, ts, value, hi, lo, coalesce(value >= lo, FALSE) AS above FROM {source} f JOIN th ON f.station_id = th.station_id),
ev1 AS (SELECT *, CASE WHEN above AND NOT (coalesce(lag(above) OVER w, FALSE) AND coalesce(ts - lag(ts) OVER w = 1, FALSE)) THEN 1 ELSE 0 END AS st FROM ev0 WINDOW w AS (PARTITION BY station_id ORDER BY ts)),
ev2 AS (SELECT *, sum(st) OVER (PARTITION BY station_id ORDER BY ts) AS run FROM ev1),
ev3 AS (SELECT station_id, run, min(ts) AS event_start, arg_min(ts, struct_pack(a := -value, b := ts)) AS peak_date, max(ts) AS event_end, any_value(hi) AS trigger_threshold, any_value(lo) AS boundary_threshold,
  arg_min(value, ts) AS start_flow, max(value) AS peak_flow, arg_max(value, ts) AS end_flow FROM ev2 WHERE above GROUP BY 1, 2 HAVING max(value) >= any_value(hi)),
events AS (SELECT station_id, row_number() OVER (PARTITION BY station_id ORDER BY event_start) AS event_id, event_start, peak_date, event_end, trigger_threshold, boundary_threshold, start_flow, peak_flow, end_flow,
  CAST(peak_date - event_start AS DOUBLE) AS time_to_peak_days, CAST(event_end - peak_date AS DOUBLE) AS recession_days, CAST(event_end - event_start + 1 AS DOUBLE) AS event_duration_days,
  (peak_flow - start_flow) / nullif(peak_date - event_start, 0) AS rising_slope, (end_flow - peak_flow) / nullif(event_end - peak_date, 0) AS recession_slope FROM ev3)"""
CROSS = """,
cand AS (SELECT station_id, ts, type FROM found WHERE status = 'candidate'),
cc AS (SELECT c.station_id, c.ts, c.type, e.event_id, e.event_duration_days AS dur, coalesce(c.type = 'spike' AND e.event_id IS NOT NULL AND c.ts = e.peak_date, FALSE) AS peak,
  row_number() OVER (PARTITION BY c.station_id, c.ts, c.type ORDER BY e.event_id) AS turn FROM cand c LEFT JOIN events e ON c.station_id = e.station_id AND c.ts BETWEEN e.event_start AND e.event_end),
crossed AS (SELECT station_id, ts, type, event_id AS matched_event_id, dur AS matched_event_duration_days, peak AS coincides_with_event_peak,
  CASE WHEN type = 'dip' OR event_id IS NULL THEN 'retained_for_review' WHEN peak THEN 'spike_peak_overlap_review' WHEN dur < 3 THEN 'retained_for_review' ELSE 'plausible_event_context' END AS crosscheck_status FROM cc WHERE turn = 1),
eligible AS (SELECT e.*, NOT EXISTS (SELECT 1 FROM crossed c WHERE c.station_id = e.station_id AND c.matched_event_id = e.event_id AND c.coincides_with_event_peak) AS representative_eligible FROM events e)"""
_M = ["peak_flow", "event_duration_days", "time_to_peak_days", "rising_slope", "recession_slope"]
REPRESENTATIVE = (
    ",\nmid AS (SELECT station_id, " + ", ".join(f"quantile_cont({m}, 0.5) AS c_{m}, stddev_pop({m}) AS s_{m}" for m in _M) + " FROM eligible WHERE representative_eligible GROUP BY 1)"
    + ",\nmad AS (SELECT e.station_id, " + ", ".join(f"quantile_cont(abs({m} - c_{m}), 0.5) AS a_{m}" for m in _M) + " FROM eligible e JOIN mid ON e.station_id = mid.station_id WHERE representative_eligible GROUP BY 1)"
    + ",\ndist AS (SELECT e.*, (" + " + ".join(f"coalesce(pow(({m} - c_{m}) / CASE WHEN a_{m} > 0 THEN a_{m} WHEN s_{m} > 0 THEN s_{m} ELSE 1.0 END, 2), 0.0)" for m in _M)
    + ") / greatest(" + " + ".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE 1 END" for m in _M) + ", 1) AS distance FROM eligible e JOIN mid ON e.station_id = mid.station_id JOIN mad ON e.station_id = mad.station_id WHERE representative_eligible)"
    + ",\nrepresentative AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY distance, event_id) AS turn FROM dist) WHERE turn = 1)"
)


def yearly_sql(source: str) -> str:
    return YEARLY.replace("{source}", source)


def events_sql(source: str) -> str:
    return EVENTS.replace("{source}", source)


QUERIES = {
    "l2_annual": lambda s, d: tidy(_annual(s, d)),
    "l2_flashiness": lambda s, d: tidy(layer2.flashiness(fx.region(s, d))),
    "l2_baseflow": lambda s, d: tidy(layer2.baseflow(fx.region(s, d))),
    "l2_seasonality": lambda s, d: tidy(layer2.seasonality(layer2.monthly_profile(fx.region(s, d)))),
    "l2_lag1": lambda s, d: tidy(layer2.lag1_autocorrelation(fx.region(s, d))),
    "l2_monthly": lambda s, d: tidy(layer2.monthly_profile(fx.nation(s, d))),
    "l2_extreme_months": lambda s, d: tidy(layer2.extreme_months(layer2.monthly_profile(fx.region(s, d)))),
    "l2_profile": lambda s, d: tidy(layer2.seasonality_profile(layer2.monthly_profile(fx.nation(s, d)))),
    "l2_events": lambda s, d: tidy(layer2.high_flow_events(fx.region(s, d)), "curve"),
    "l2_crosscheck": lambda s, d: tidy(_checked(s, d)[1]),
    "l2_eligibility": lambda s, d: tidy(layer2.representative_eligibility(*_checked(s, d)).select("station_id", "event_id", "representative_eligible")),
    "l2_representative": lambda s, d: tidy(layer2.representative_event(layer2.representative_eligibility(*_checked(s, d))).select("station_id", "event_id", "event_start", "peak_flow", "distance")),
    "l2_diag_summary": lambda s, d: tidy(layer2.diagnostic_summary(layer2.annual_signatures(fx.region(s, d)), layer2.high_flow_events(fx.region(s, d)))),
    "l2_summary": lambda s, d: tidy(layer2.record_summary(fx.spiky(s, d), _spikes(s, d))),
}
_A = ["mean_flow", "median_flow", "minimum_flow", "maximum_flow", "raw_minimum_flow", "raw_maximum_flow", "flashiness_index", "baseflow_index", "seasonality_index", "lag1_autocorrelation"]
ANNUAL = """,
ann0 AS (SELECT y.station_id, y.year, avg(value) AS mean_flow, quantile_cont(value, 0.5) AS median_flow, min(CASE WHEN k.ts IS NULL THEN value END) AS minimum_flow, max(CASE WHEN k.ts IS NULL THEN value END) AS maximum_flow,
  min(value) AS raw_minimum_flow, max(value) AS raw_maximum_flow, count(CASE WHEN k.ts IS NOT NULL THEN value END) AS extrema_excluded_candidate_count, count(value) AS valid_days
  FROM yr y LEFT JOIN {spikes} k ON y.station_id = k.station_id AND y.ts = k.ts GROUP BY 1, 2 HAVING count(value) >= 30),
annual AS (SELECT a.*, flashiness_index, baseflow_index, seasonality_index, lag1_autocorrelation, coalesce(usable_months, 0) AS usable_months, CASE WHEN usable_months = 12 THEN w END AS wettest_month, CASE WHEN usable_months = 12 THEN dr END AS driest_month
  FROM ann0 a LEFT JOIN flash USING (station_id, year) LEFT JOIN base USING (station_id, year) LEFT JOIN season USING (station_id, year) LEFT JOIN lag1 USING (station_id, year) LEFT JOIN wet USING (station_id, year))"""


def annual_sql(spikes: str) -> str:
    return ANNUAL.replace("{spikes}", spikes)


_SPIKY = fx.with_sql(["flow_spiky"], record("flow_spiky") + SPIKES + events_sql("flow_spiky"))
_D = ["flashiness_index", "baseflow_index", "seasonality_index", "lag1_autocorrelation", "time_to_peak_days", "rising_slope", "recession_slope", "event_duration_days", "peak_flow"]
ORACLE_SQL = {
    "l2_annual": fx.with_sql(["flow_spiky"], record("flow_spiky") + SPIKES + yearly_sql("flow_spiky") + BASEFLOW + ", sp AS (SELECT station_id, ts FROM found WHERE status = 'candidate')" + annual_sql("sp")
        + " SELECT station_id, year, " + ", ".join(f"{r(c)} AS {c}" for c in _A) + ", extrema_excluded_candidate_count, valid_days, usable_months, wettest_month, driest_month FROM annual"),
    "l2_flashiness": fx.with_sql(["flow_region"], yearly_sql("flow_region") + f" SELECT station_id, year, {r('flashiness_index')} AS flashiness_index FROM flash"),
    "l2_baseflow": fx.with_sql(["flow_region"], yearly_sql("flow_region") + BASEFLOW + f" SELECT station_id, year, {r('baseflow_index')} AS baseflow_index FROM base"),
    "l2_seasonality": fx.with_sql(["flow_region"], yearly_sql("flow_region") + f" SELECT station_id, year, {r('seasonality_index')} AS seasonality_index FROM season"),
    "l2_lag1": fx.with_sql(["flow_region"], yearly_sql("flow_region") + f" SELECT y.station_id, y.year, {r('lag1_autocorrelation')} AS lag1_autocorrelation FROM (SELECT DISTINCT station_id, year FROM yr) y LEFT JOIN lag1 USING (station_id, year)"),
    "l2_monthly": fx.with_sql(["flow_nation"], yearly_sql("flow_nation") + f" SELECT station_id, year, month, valid_days, {r('monthly_mean')} AS monthly_mean, {r('monthly_median')} AS monthly_median FROM monthly"),
    "l2_extreme_months": fx.with_sql(["flow_region"], yearly_sql("flow_region") + " SELECT station_id, year, usable_months, CASE WHEN usable_months = 12 THEN w END AS wettest_month, CASE WHEN usable_months = 12 THEN dr END AS driest_month FROM wet"),
    "l2_profile": fx.with_sql(["flow_nation"], yearly_sql("flow_nation") + f""", have AS (SELECT station_id, month, quantile_cont(monthly_median, 0.5) AS median, count(*) AS year_count FROM monthly GROUP BY 1, 2),
 spine AS (SELECT station_id, unnest(range(1, 13)) AS month FROM (SELECT DISTINCT station_id FROM monthly)) SELECT s.station_id, CAST(s.month AS INTEGER) AS month, {r('median')} AS median, year_count FROM spine s LEFT JOIN have h ON s.station_id = h.station_id AND s.month = h.month"""),
    "l2_events": dated(fx.with_sql(["flow_region"], events_sql("flow_region") + " SELECT station_id, event_id, event_start, peak_date, event_end, " + ", ".join(f"{r(c)} AS {c}" for c in ["trigger_threshold", "boundary_threshold", "start_flow", "peak_flow", "end_flow", "time_to_peak_days", "recession_days", "event_duration_days", "rising_slope", "recession_slope"]) + " FROM events"), "event_start", "peak_date", "event_end"),
    "l2_crosscheck": dated(_SPIKY + CROSS + " SELECT * FROM crossed", "ts"),
    "l2_eligibility": _SPIKY + CROSS + " SELECT station_id, event_id, representative_eligible FROM eligible",
    "l2_representative": dated(_SPIKY + CROSS + REPRESENTATIVE + f" SELECT station_id, event_id, event_start, {r('peak_flow')} AS peak_flow, {r('distance')} AS distance FROM representative", "event_start"),
    "l2_diag_summary": fx.with_sql(["flow_region"], yearly_sql("flow_region") + BASEFLOW + ", sp AS (SELECT station_id, ts FROM flow_region WHERE FALSE)" + annual_sql("sp") + events_sql("flow_region") + ", ".join([""] + [f"x{i} AS (SELECT station_id, '{c}' AS diagnostic, CAST({c} AS DOUBLE) AS x FROM {'annual' if i < 4 else 'events'})" for i, c in enumerate(_D)])
        + ", al AS (" + " UNION ALL ".join(f"SELECT * FROM x{i}" for i in range(9)) + f") SELECT station_id, diagnostic, {r('quantile_cont(x, 0.5)')} AS median, {r('quantile_cont(x, 0.1)')} AS p10, {r('quantile_cont(x, 0.9)')} AS p90, count(x) AS sample_count FROM al GROUP BY 1, 2"),
    "l2_summary": fx.with_sql(["flow_spiky"], record("flow_spiky") + SPIKES + f""", sp AS (SELECT station_id, ts FROM found WHERE status = 'candidate'),
 j AS (SELECT f.*, sp.ts IS NOT NULL AS spike FROM flow_spiky f LEFT JOIN sp ON f.station_id = sp.station_id AND f.ts = sp.ts)
 SELECT station_id, count(value) AS valid_count, count(*) - count(value) AS raw_missing_count, {r('quantile_cont(value, 0.05)')} AS q05_low_flow, {r('quantile_cont(value, 0.95)')} AS q95_high_flow, {r('avg(value) FILTER (WHERE NOT spike)')} AS mean_flow,
 {r('quantile_cont(value, 0.5) FILTER (WHERE NOT spike)')} AS median_flow, {r('min(value) FILTER (WHERE NOT spike)')} AS minimum_flow, {r('max(value) FILTER (WHERE NOT spike)')} AS maximum_flow, count(CASE WHEN spike THEN value END) AS extrema_excluded_candidate_count FROM j GROUP BY 1"""),
}
