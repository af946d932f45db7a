"""Two-series comparison as queries over the derived series, with their SQL."""

from __future__ import annotations

import re

from gaugewise.operators import comparison, layer2
from gaugewise.plans import fixtures as fx
from gaugewise.plans.layer1_queries import dated, r, tidy
from gaugewise.plans.layer2_queries import _D, BASEFLOW, REPRESENTATIVE, annual_sql, events_sql, yearly_sql


def _flows(s, d):
    return fx.region(s, d), fx.candidate(s, d)


def _annual(s, d):
    return [layer2.annual_signatures(f) for f in _flows(s, d)]


def _profiles(s, d):
    return [layer2.seasonality_profile(layer2.monthly_profile(f)) for f in _flows(s, d)]


def _events(s, d):
    return [layer2.high_flow_events(f) for f in _flows(s, d)]


def _signatures(s, d):
    return [comparison.signatures(f) for f in _flows(s, d)]


QUERIES = {
    "c_paired": lambda s, d: tidy(comparison.paired(*_flows(s, d)).where("reference is not null and candidate is not null")),
    "c_independent": lambda s, d: tidy(comparison.unfit(fx.rows(s, d), fx.candidate(s, d))),
    "c_historical": lambda s, d: tidy(layer2.record_summary(comparison.historical(fx.region(s, d), "1998-01-01", "1999-12-31")[0])),
    "c_daily_metrics": lambda s, d: tidy(comparison.daily_metrics(comparison.paired(*_flows(s, d)))),
    "c_annual": lambda s, d: tidy(comparison.annual_differences(*_annual(s, d))),
    "c_signature_summary": lambda s, d: tidy(comparison.signature_summaries(*_annual(s, d))),
    "c_diag": lambda s, d: tidy(comparison.diagnostic_differences(*[x["diagnostics"] for x in _signatures(s, d)])),
    "c_jsd": lambda s, d: tidy(comparison.inverse_jsd(*_flows(s, d))),
    "c_cosine": lambda s, d: tidy(comparison.annual_cosine(*_annual(s, d), "flashiness_index")),
    "c_seasonal_cosine": lambda s, d: tidy(comparison.seasonal_cosine(*_profiles(s, d))),
    "c_timing": lambda s, d: tidy(comparison.seasonal_timing(*_profiles(s, d))),
    "c_event_diff": lambda s, d: tidy(comparison.event_differences(*_events(s, d))),
    "c_event_shape": lambda s, d: tidy(comparison.event_shape(*[layer2.representative_event(e) for e in _events(s, d)])),
    "c_components": lambda s, d: tidy(comparison.components(*_signatures(s, d))),
    "c_composite": lambda s, d: tidy(comparison.composite(comparison.components(*_signatures(s, d)))),
}


_NAMES = "yr mo monthly flash lag1 season wet seg b0 a1 s1 q1 b1 a2 s2 q2 b2 a3 s3 q3 b3 base ann0 annual th ev0 ev1 ev2 ev3 events sp eligible mid mad dist representative have spine profile".split()
_PROFILE = """, have AS (SELECT station_id, month, quantile_cont(monthly_median, 0.5) AS median FROM monthly GROUP BY 1, 2),
spine AS (SELECT station_id, unnest(range(1, 13)) AS month FROM (SELECT DISTINCT station_id FROM monthly)),
profile AS (SELECT s.station_id, s.month, median FROM spine s LEFT JOIN have h ON s.station_id = h.station_id AND s.month = h.month)"""


def _side(source: str, p: str) -> str:
    body = yearly_sql(source) + BASEFLOW + ", sp AS (SELECT station_id, ts FROM yr WHERE FALSE)" + annual_sql("sp") + _PROFILE + events_sql(source)
    body += ", eligible AS (SELECT *, TRUE AS representative_eligible FROM events)" + REPRESENTATIVE
    for n in _NAMES:
        body = re.sub(rf"(?<=[,\n ]){n} AS \(", f"{p}{n} AS (", body)
        # a use keeps the plain name as its alias, unless it has one
        body = re.sub(rf"\b(FROM|JOIN) {n}\b(?! [a-z]\b)(?!\w)", rf"\1 {p}{n} {n}", body)
        body = re.sub(rf"\b(FROM|JOIN) {n}(?= [a-z]\b)", rf"\1 {p}{n}", body)
    return body


_BOTH = fx.with_sql(["flow_region", "flow_candidate"], _side("flow_region", "r_") + _side("flow_candidate", "c_"))
_PAIRED = """, j AS (SELECT coalesce(a.station_id, b.station_id) AS station_id, coalesce(a.ts, b.ts) AS ts, a.value AS reference, b.value AS candidate FROM flow_region a FULL OUTER JOIN flow_candidate b ON a.station_id = b.station_id AND a.ts = b.ts),
lim AS (SELECT station_id, greatest(min(ts) FILTER (WHERE reference IS NOT NULL), min(ts) FILTER (WHERE candidate IS NOT NULL)) AS lo, least(max(ts) FILTER (WHERE reference IS NOT NULL), max(ts) FILTER (WHERE candidate IS NOT NULL)) AS hi FROM j GROUP BY 1),
pairs AS (SELECT j.* FROM j JOIN lim ON j.station_id = lim.station_id WHERE ts BETWEEN lo AND hi AND reference IS NOT NULL AND candidate IS NOT NULL)"""
_METRICS = """, rk AS (SELECT *, rank() OVER (PARTITION BY station_id ORDER BY reference) + (count(*) OVER (PARTITION BY station_id, reference) - 1) / 2.0 AS rr,
 rank() OVER (PARTITION BY station_id ORDER BY candidate) + (count(*) OVER (PARTITION BY station_id, candidate) - 1) / 2.0 AS rc FROM pairs),
m AS (SELECT station_id, CAST(count(*) AS DOUBLE) AS pairwise_valid_days, avg(reference) AS reference_mean, avg(candidate) AS candidate_mean, avg(candidate - reference) AS mean_bias, avg(abs(candidate - reference)) AS mean_absolute_error,
 sqrt(avg((candidate - reference) * (candidate - reference))) AS root_mean_squared_error, 100 * sum(candidate - reference) / nullif(sum(reference), 0) AS percent_bias,
 covar_pop(reference, candidate) / nullif(stddev_pop(reference) * stddev_pop(candidate), 0) AS pearson_correlation, covar_pop(rr, rc) / nullif(stddev_pop(rr) * stddev_pop(rc), 0) AS spearman_correlation,
 1 - avg((candidate - reference) * (candidate - reference)) / nullif(var_pop(reference), 0) AS nash_sutcliffe_efficiency, stddev_pop(candidate) / nullif(stddev_pop(reference), 0) AS variability_ratio, avg(candidate) / nullif(avg(reference), 0) AS mean_ratio FROM rk GROUP BY 1),
k AS (SELECT *, 1 - sqrt(pow(pearson_correlation - 1, 2) + pow(variability_ratio - 1, 2) + pow(mean_ratio - 1, 2)) AS kling_gupta_efficiency FROM m)"""
_MN = ["pairwise_valid_days", "reference_mean", "candidate_mean", "mean_bias", "mean_absolute_error", "root_mean_squared_error", "percent_bias", "pearson_correlation", "spearman_correlation", "nash_sutcliffe_efficiency", "variability_ratio", "mean_ratio", "kling_gupta_efficiency"]
_SUMMARIES = ", ".join([""] + [f"d_{p} AS (SELECT station_id, diagnostic, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.9) AS p90, count(x) AS sample_count FROM ("
    + " UNION ALL ".join(f"SELECT station_id, '{c}' AS diagnostic, CAST({c} AS DOUBLE) AS x FROM {p}_{'annual' if i < 4 else 'events'}" for i, c in enumerate(_D)) + ") GROUP BY 1, 2)" for p in "rc"])
_JSD = """, bo AS (SELECT station_id, 0 AS side, value FROM flow_region WHERE value IS NOT NULL UNION ALL SELECT station_id, 1 AS side, value FROM flow_candidate WHERE value IS NOT NULL),
st AS (SELECT station_id, count(*) AS n, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1, min(value) AS low, max(value) AS high, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM bo GROUP BY 1),
st2 AS (SELECT *, CAST(ceil((high - low) / least(greatest(2 * iqr / pow(n, 1.0 / 3), (high - low) / sqrt(n) / 2), (high - low) / (log2(n) + 1))) AS INTEGER) AS bins FROM st),
bi AS (SELECT station_id, low, high, bins, n0, n1, unnest(range(0, bins)) AS i FROM st2),
ed AS (SELECT *, low + i * ((high - low) / bins) AS e0, CASE WHEN i + 1 = bins THEN high ELSE low + (i + 1) * ((high - low) / bins) END AS e1 FROM bi),
co AS (SELECT e.station_id, i, any_value(bins) AS bins, any_value(n0) AS n0, any_value(n1) AS n1, count(*) FILTER (WHERE side = 0) AS c0, count(*) FILTER (WHERE side = 1) AS c1
 FROM ed e LEFT JOIN bo ON e.station_id = bo.station_id AND value >= e0 AND (value < e1 OR (i + 1 = bins AND value <= e1)) GROUP BY 1, 2),
pq AS (SELECT station_id, (c0 + pow(2.0, -52)) / (n0 + bins * pow(2.0, -52)) AS p, (c1 + pow(2.0, -52)) / (n1 + bins * pow(2.0, -52)) AS q FROM co),
jsd AS (SELECT station_id, least(1.0, greatest(0.0, 1 - sqrt(greatest(sum(0.5 * p * log2(p / (0.5 * (p + q))) + 0.5 * q * log2(q / (0.5 * (p + q)))), 0.0)))) AS value FROM pq GROUP BY 1)"""
_AM = comparison.ANNUAL_METRICS
_COMPONENTS = _JSD + "".join(f""", cos_{n} AS (SELECT station_id, CASE WHEN count(*) >= 2 THEN sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) END AS value
 FROM (SELECT a.station_id, a.{c} AS x, b.{c} AS y FROM r_annual a JOIN c_annual b ON a.station_id = b.station_id AND a.year = b.year WHERE a.{c} IS NOT NULL AND b.{c} IS NOT NULL) GROUP BY 1),
 med_{n} AS (SELECT a.station_id, b.m - a.m AS median_bias FROM (SELECT station_id, quantile_cont({c}, 0.5) AS m FROM r_annual GROUP BY 1) a JOIN (SELECT station_id, quantile_cont({c}, 0.5) AS m FROM c_annual GROUP BY 1) b ON a.station_id = b.station_id)""" for n, c in (("f", "flashiness_index"), ("b", "baseflow_index"))) + """,
sea AS (SELECT a.station_id, CASE WHEN count(CASE WHEN b.median IS NOT NULL THEN a.median END) >= 2 THEN sum(a.median * b.median) / (sqrt(sum(CASE WHEN b.median IS NOT NULL THEN a.median * a.median END)) * sqrt(sum(CASE WHEN a.median IS NOT NULL THEN b.median * b.median END))) END AS value,
 quantile_cont(b.median, 0.5) - quantile_cont(a.median, 0.5) AS median_bias FROM r_profile a JOIN c_profile b ON a.station_id = b.station_id AND a.month = b.month GROUP BY 1),
ends AS (SELECT a.station_id, a.w AS wr, a.d AS dr, b.w AS wc, b.d AS dc FROM (SELECT station_id, arg_min(month, struct_pack(x := -median, y := month)) AS w, arg_min(month, struct_pack(x := median, y := month)) AS d FROM r_profile WHERE median IS NOT NULL GROUP BY 1) a
 JOIN (SELECT station_id, arg_min(month, struct_pack(x := -median, y := month)) AS w, arg_min(month, struct_pack(x := median, y := month)) AS d FROM c_profile WHERE median IS NOT NULL GROUP BY 1) b ON a.station_id = b.station_id),
tim AS (SELECT station_id, CAST(greatest(least(abs(wr - wc), 12 - abs(wr - wc)), least(abs(dr - dc), 12 - abs(dr - dc))) AS DOUBLE) AS value FROM ends),
evd AS (SELECT a.station_id, abs(b.p - a.p) AS time_to_peak, abs(b.d - a.d) AS duration FROM (SELECT station_id, quantile_cont(time_to_peak_days, 0.5) AS p, quantile_cont(event_duration_days, 0.5) AS d FROM r_events GROUP BY 1) a
 JOIN (SELECT station_id, quantile_cont(time_to_peak_days, 0.5) AS p, quantile_cont(event_duration_days, 0.5) AS d FROM c_events GROUP BY 1) b ON a.station_id = b.station_id)""" + "".join(f""",
cv_{p} AS (SELECT e.station_id, row_number() OVER (PARTITION BY e.station_id ORDER BY f.ts) - 1 AS i, count(*) OVER (PARTITION BY e.station_id) AS n, f.value FROM {p}_representative e JOIN {s} f ON e.station_id = f.station_id AND f.ts BETWEEN e.event_start AND e.event_end WHERE f.value IS NOT NULL),
at_{p} AS (SELECT station_id, k, k * (n - 1) / 99.0 AS place, n FROM (SELECT DISTINCT station_id, n FROM cv_{p} WHERE n >= 2) CROSS JOIN (SELECT unnest(range(0, 100)) AS k)),
rs_{p} AS (SELECT t.station_id, t.k, a.value + (b.value - a.value) * (place - floor(place)) AS v FROM at_{p} t JOIN cv_{p} a ON a.station_id = t.station_id AND a.i = CAST(floor(place) AS BIGINT) JOIN cv_{p} b ON b.station_id = t.station_id AND b.i = least(CAST(floor(place) AS BIGINT) + 1, t.n - 1))""" for p, s in (("r", "flow_region"), ("c", "flow_candidate"))) + """,
shp0 AS (SELECT a.station_id, sum(a.v * b.v) / nullif(sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)), 0) AS value FROM rs_r a JOIN rs_c b ON a.station_id = b.station_id AND a.k = b.k GROUP BY 1),
shp AS (SELECT a.station_id, s.value FROM r_representative a JOIN c_representative b ON a.station_id = b.station_id LEFT JOIN shp0 s ON s.station_id = a.station_id),
vals AS (SELECT station_id, 'flow_behaviour' AS component, value, CAST(NULL AS DOUBLE) AS median_bias FROM jsd UNION ALL SELECT station_id, 'annual_flashiness_shape', value, median_bias FROM cos_f JOIN med_f USING (station_id)
 UNION ALL SELECT station_id, 'annual_baseflow_shape', value, median_bias FROM cos_b JOIN med_b USING (station_id) UNION ALL SELECT station_id, 'seasonal_profile_shape', value, median_bias FROM sea
 UNION ALL SELECT station_id, 'seasonal_timing', value, NULL FROM tim UNION ALL SELECT station_id, 'event_time_to_peak', time_to_peak, NULL FROM evd UNION ALL SELECT station_id, 'event_duration', duration, NULL FROM evd
 UNION ALL SELECT station_id, 'representative_event_shape', value, NULL FROM shp),
tiers AS (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN component = 'seasonal_timing' THEN CASE WHEN value <= 1 THEN 0 WHEN value <= 3 THEN 1 ELSE 2 END
 WHEN component = 'event_time_to_peak' THEN CASE WHEN value <= 3 THEN 0 WHEN value < 5 THEN 1 ELSE 2 END WHEN component = 'event_duration' THEN CASE WHEN value <= 3 THEN 0 WHEN value <= 7 THEN 1 ELSE 2 END
 ELSE CASE WHEN value >= 0.8 THEN 0 WHEN value >= 0.5 THEN 1 ELSE 2 END END AS pts FROM vals)"""
ORACLE_SQL = {
    "c_paired": dated(fx.with_sql(["flow_region", "flow_candidate"], _PAIRED + f" SELECT station_id, ts, {r('reference')} AS reference, {r('candidate')} AS candidate FROM pairs"), "ts"),
    "c_independent": fx.with_sql(["flow_rows", "flow_candidate"], """, s AS (SELECT station_id, count(*) > count(DISTINCT ts) AS rep, bool_or(ts < prev) AS dis, count(value) = 0 AS em FROM (SELECT *, lag(ts) OVER (PARTITION BY station_id ORDER BY src_pos) AS prev FROM flow_rows) GROUP BY 1),
 c AS (SELECT station_id, count(value) = 0 AS em FROM flow_candidate GROUP BY 1), u AS (SELECT station_id, concat_ws('; ', CASE WHEN rep THEN 'reference has duplicate timestamps' END, CASE WHEN dis THEN 'reference is not sorted' END, CASE WHEN em THEN 'reference has no valid values' END) AS reason FROM s
 UNION ALL SELECT station_id, CASE WHEN em THEN 'candidate has no valid values' ELSE '' END FROM c) SELECT station_id, string_agg(reason, '; ' ORDER BY reason) AS reason FROM u WHERE reason <> '' GROUP BY 1"""),
    "c_historical": fx.with_sql(["flow_region"], f""", h AS (SELECT * FROM flow_region WHERE ts NOT BETWEEN DATE '1998-01-01' AND DATE '1999-12-31')
 SELECT station_id, count(value) AS valid_count, count(*) - count(value) AS raw_missing_count, {r('quantile_cont(value, 0.05)')} AS q05_low_flow, {r('quantile_cont(value, 0.95)')} AS q95_high_flow, {r('avg(value)')} AS mean_flow, {r('quantile_cont(value, 0.5)')} AS median_flow,
 {r('min(value)')} AS minimum_flow, {r('max(value)')} AS maximum_flow, 0 AS extrema_excluded_candidate_count FROM h GROUP BY 1"""),
    "c_daily_metrics": fx.with_sql(["flow_region", "flow_candidate"], _PAIRED + _METRICS + " " + " UNION ALL ".join(f"SELECT station_id, '{n}' AS metric, {r(n)} AS value FROM k" for n in _MN)),
    "c_annual": _BOTH + " " + " UNION ALL ".join(f"SELECT a.station_id, a.year, '{c}' AS metric, {r(f'CAST(a.{c} AS DOUBLE)')} AS reference_value, {r(f'CAST(b.{c} AS DOUBLE)')} AS candidate_value, " + (f"CAST(least(abs(a.{c} - b.{c}), 12 - abs(a.{c} - b.{c})) AS DOUBLE)" if c in comparison.MONTH_METRICS else r(f"b.{c} - a.{c}")) + " AS difference FROM r_annual a JOIN c_annual b ON a.station_id = b.station_id AND a.year = b.year" for c in _AM),
    "c_signature_summary": _BOTH + " " + " UNION ALL ".join(
        f"SELECT a.station_id, '{c}' AS metric, {r('a.t')} AS reference_typical_value, {r('b.t')} AS candidate_typical_value, " + ("least(abs(a.t - b.t), 12 - abs(a.t - b.t))" if c in comparison.MONTH_METRICS else r("b.t - a.t")) + " AS difference, a.n AS reference_year_count, b.n AS candidate_year_count FROM "
        + " JOIN ".join(f"(SELECT station_id, {'arg_min(CAST(x AS DOUBLE), struct_pack(p := -same, q := x)) FILTER (WHERE x IS NOT NULL)' if c in comparison.MONTH_METRICS else 'quantile_cont(x, 0.5)'} AS t, count(x) AS n FROM (SELECT station_id, {c} AS x, count({c}) OVER (PARTITION BY station_id, {c}) AS same FROM {p}_annual) GROUP BY 1) {q}" for p, q in (("r", "a"), ("c", "b")))
        + " ON a.station_id = b.station_id" for c in _AM),
    "c_diag": _BOTH + _SUMMARIES + " SELECT station_id, diagnostic, " + ", ".join(f"{r(f'{t}.{c}')} AS {c}_{side}" for t, side in (("a", "reference"), ("b", "candidate")) for c in ("median", "p10", "p90"))
    + f", a.sample_count AS sample_count_reference, b.sample_count AS sample_count_candidate, {r('b.median - a.median')} AS median_difference FROM d_r a FULL OUTER JOIN d_c b USING (station_id, diagnostic)",
    "c_jsd": fx.with_sql(["flow_region", "flow_candidate"], _JSD + f" SELECT station_id, {r('value')} AS value FROM jsd"),
    "c_cosine": _BOTH + _COMPONENTS + f" SELECT station_id, {r('value')} AS value, {r('median_bias')} AS median_bias FROM cos_f JOIN med_f USING (station_id)",
    "c_seasonal_cosine": _BOTH + _COMPONENTS + f" SELECT station_id, {r('value')} AS value, {r('median_bias')} AS median_bias FROM sea",
    "c_timing": _BOTH + _COMPONENTS + " SELECT station_id, value FROM tim",
    "c_event_diff": _BOTH + _COMPONENTS + f" SELECT station_id, {r('time_to_peak')} AS time_to_peak, {r('duration')} AS duration FROM evd",
    "c_event_shape": _BOTH + _COMPONENTS + f" SELECT station_id, {r('value')} AS value FROM shp",
    "c_components": _BOTH + _COMPONENTS + f" SELECT station_id, component, {r('value')} AS value, {r('median_bias')} AS median_bias, pts IS NOT NULL AS assessable, CASE pts WHEN 0 THEN 'Tier 3' WHEN 1 THEN 'Tier 2' WHEN 2 THEN 'Tier 1' ELSE 'Not assessable' END AS tier, pts AS tier_points, 1 AS weight, coalesce(pts, 0) AS contribution FROM tiers",
    "c_composite": _BOTH + _COMPONENTS + f""", sc AS (SELECT station_id, CAST(coalesce(sum(pts), 0) AS BIGINT) AS layer2_score, count(pts) * 2 AS mx, count(pts) AS na, string_agg(CASE WHEN pts IS NULL THEN component END, '; ' ORDER BY component) AS un FROM tiers GROUP BY 1)
 SELECT station_id, layer2_score, {r('100.0 * layer2_score / nullif(mx, 0)')} AS layer2_score_percent, mx AS maximum_assessable_score, CASE WHEN na < 4 THEN 'Not assessable' WHEN 100.0 * layer2_score / mx <= 12.5 THEN 'Similar' WHEN 100.0 * layer2_score / mx <= 43.75 THEN 'Review' ELSE 'Strong review' END AS layer2_class,
 na AS assessable_components, na < 4 AS assessment_incomplete, coalesce(un, '') AS unavailable_components FROM sc""",
}
