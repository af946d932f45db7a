"""Shared primitives and intrinsic checks as queries over the derived series, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.operators import layer1, primitives
from gaugewise.plans import fixtures as fx


def tidy(df: DataFrame, *more: str) -> DataFrame:
    """Without the slot; doubles rounded to six decimals and days as ISO text, so that both engines give one value."""
    df = df.drop("series_slot", *more)
    form = {"double": lambda c: F.round(c, 6), "date": lambda c: c.cast("string")}
    return df.select(*[form.get(t, lambda c: c)(F.col(c)).alias(c) for c, t in df.dtypes])


def dated(sql: str, *columns: str) -> str:
    """``sql`` with these days as ISO text."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)}) FROM ({sql})"


def r(x: str) -> str:
    return f"round({x}, 6)"


POSITIONED = """,
placed AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts{tie}) AS pos FROM {source}),
bounded AS (SELECT *, min(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY station_id) AS first_pos,
  max(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY station_id) AS last_pos FROM placed),
record AS (SELECT station_id, ts, value, pos FROM bounded WHERE pos BETWEEN first_pos AND last_pos)"""
RUNS = """,
grouped AS (SELECT *, pos - row_number() OVER (PARTITION BY station_id, value IS NULL ORDER BY pos) AS grp FROM bounded),
runs AS (SELECT station_id, grp, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS missing_count, min(pos) AS at_pos, min(first_pos) AS f, min(last_pos) AS l
  FROM grouped WHERE value IS NULL GROUP BY station_id, grp),
intervals AS (SELECT station_id, start_ts, end_ts, missing_count, CAST(end_ts - start_ts + 1 AS INTEGER) AS calendar_duration_days,
  CASE WHEN f IS NULL THEN 'all' WHEN at_pos < f THEN 'leading' WHEN at_pos > l THEN 'trailing' ELSE 'internal' END AS position FROM runs)"""


def record(source: str, tie: str = "") -> str:
    return POSITIONED.replace("{source}", source).replace("{tie}", tie)


MONTHLY = """,
daily AS (SELECT station_id, ts AS d, quantile_cont(value, 0.5) AS v FROM record GROUP BY station_id, ts),
stats AS (SELECT station_id, CAST(date_trunc('month', d) AS DATE) AS month, count(v) AS n,
  quantile_cont(greatest(v, 0), 0.25) AS q25, quantile_cont(greatest(v, 0), 0.5) AS q50, quantile_cont(greatest(v, 0), 0.75) AS q75, quantile_cont(greatest(v, 0), 0.9) AS q90
  FROM daily WHERE v IS NOT NULL GROUP BY 1, 2),
months AS (SELECT station_id, CAST(unnest(generate_series(date_trunc('month', min(d)), date_trunc('month', max(d)), INTERVAL 1 MONTH)) AS DATE) AS month FROM daily GROUP BY station_id),
monthly AS (SELECT m.station_id, m.month, coalesce(s.n, 0) AS valid_days, CASE WHEN s.n >= 10 THEN q25 END AS q25, CASE WHEN s.n >= 10 THEN q50 END AS median,
  CASE WHEN s.n >= 10 THEN q75 END AS q75, CASE WHEN s.n >= 10 THEN q90 END AS q90 FROM months m LEFT JOIN stats s ON m.station_id = s.station_id AND m.month = s.month)"""

SPIKES = """,
near AS (SELECT *, lag(value, 2) OVER w AS m2, lag(value) OVER w AS m1, lead(value) OVER w AS p1, lead(value, 2) OVER w AS p2,
  ts - lag(ts) OVER w AS step, lead(ts) OVER w - ts AS step1, lead(ts, 2) OVER w - lead(ts) OVER w AS step2, lag(ts) OVER w - lag(ts, 2) OVER w AS step0
  FROM record WINDOW w AS (PARTITION BY station_id ORDER BY pos)),
moves AS (SELECT *, value - m1 AS into_, p1 - value AS out_, coalesce(step0 = 1 AND step = 1 AND step1 = 1 AND step2 = 1 AND m2 IS NOT NULL AND m1 IS NOT NULL AND value IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL, FALSE) AS five FROM near),
sized AS (SELECT *, coalesce(into_ * out_ < 0, FALSE) AS turning, CASE WHEN into_ IS NOT NULL AND out_ IS NOT NULL THEN least(abs(into_), abs(out_)) END AS jump,
  1 - abs(p1 - m1) / nullif(abs(into_) + abs(out_), 0) AS recovery, CASE WHEN step = 1 THEN abs(into_) END AS change, month(ts) AS mon FROM moves),
least_change AS (SELECT station_id, min(CASE WHEN change > 0 THEN change END) AS resolution FROM sized GROUP BY 1),
refs AS (SELECT s.station_id, mon, CASE WHEN quantile_cont(change, 0.5) > 0 THEN quantile_cont(change, 0.5) ELSE any_value(resolution) END AS normal,
  CASE WHEN quantile_cont(change, 0.99) > 0 THEN quantile_cont(change, 0.99) ELSE any_value(resolution) END AS large
  FROM sized s JOIN least_change l ON s.station_id = l.station_id GROUP BY s.station_id, mon),
scored AS (SELECT s.*, normal, large, jump / nullif(normal, 0) AS score FROM sized s JOIN refs r ON s.station_id = r.station_id AND s.mon = r.mon),
centre AS (SELECT station_id, quantile_cont(score, 0.5) AS c, quantile_cont(score, 0.995) AS h FROM scored WHERE turning AND score IS NOT NULL GROUP BY 1),
cut AS (SELECT s.station_id, greatest(8.0, any_value(h), any_value(c) + 6.0 * 1.4826 * quantile_cont(abs(score - c), 0.5)) AS cutoff
  FROM scored s JOIN centre ON s.station_id = centre.station_id WHERE turning AND score IS NOT NULL GROUP BY s.station_id),
found AS (SELECT s.*, cutoff, CASE WHEN into_ > 0 THEN 'spike' ELSE 'dip' END AS type, CASE WHEN NOT five THEN 'rejected_context'
  WHEN coalesce(abs(m1 - m2) >= normal AND abs(p2 - p1) >= normal AND ((m2 < m1 AND m1 < value AND value > p1 AND p1 > p2) OR (m2 > m1 AND m1 > value AND value < p1 AND p1 < p2)), FALSE) THEN 'rejected_coherent'
  ELSE 'candidate' END AS status FROM scored s JOIN cut ON s.station_id = cut.station_id WHERE turning AND recovery >= 0.8 AND jump >= large AND score >= cutoff)"""

QUERIES = {
    "valid_record": lambda s, d: tidy(primitives.valid_record(fx.nation_null(s, d)).select("station_id", "ts", "value", "pos")),
    "missing_intervals": lambda s, d: tidy(primitives.missing_intervals(fx.nation_null(s, d))),
    "missingness": lambda s, d: tidy(primitives.missingness(fx.nation_null(s, d))),
    "eda_summary": lambda s, d: tidy(primitives.summary(fx.region(s, d))),
    "monthly_stats": lambda s, d: tidy(primitives.monthly_statistics(fx.rows(s, d))),
    "log_offset": lambda s, d: tidy(primitives.log_offset(fx.region(s, d))),
    "availability": lambda s, d: tidy(primitives.availability(fx.nation_null(s, d))),
    "pair_availability": lambda s, d: tidy(primitives.pair_availability(fx.region(s, d), fx.candidate(s, d))),
    "l1_missing": lambda s, d: tidy(layer1.missing_values(fx.nation_null(s, d))),
    "l1_long_gaps": lambda s, d: tidy(layer1.long_gaps(fx.nation_null(s, d))),
    "l1_gap_intervals": lambda s, d: tidy(layer1.long_gap_intervals(fx.nation_null(s, d))),
    "l1_negative": lambda s, d: tidy(layer1.negative_discharge(fx.lowered(s, d))),
    "l1_duplicates": lambda s, d: tidy(layer1.duplicate_timestamps(fx.rows(s, d))),
    "l1_duplicate_groups": lambda s, d: tidy(layer1.duplicate_groups(fx.rows(s, d)).withColumn("values", F.array_join(F.transform("values", lambda v: v.cast("int").cast("string")), ","))),
    "l1_timestep": lambda s, d: tidy(layer1.timestep_consistency(fx.rows(s, d))),
    "l1_irregular_intervals": lambda s, d: tidy(layer1.irregular_intervals(fx.nation(s, d))),
    "l1_zero_flow": lambda s, d: tidy(layer1.zero_flow_regime(fx.zeroed(s, d))),
    "l1_zero_spells": lambda s, d: tidy(layer1.zero_flow_spells(fx.zeroed(s, d))),
    "l1_zero_months": lambda s, d: tidy(layer1.zero_flow_months(fx.zeroed(s, d))),
    "l1_plateaus": lambda s, d: tidy(layer1.plateaus(fx.flat(s, d))),
    "l1_low_variability": lambda s, d: tidy(layer1.low_variability(fx.flat(s, d))),
    "l1_spike_dip": lambda s, d: tidy(layer1.spike_candidates(fx.spiky(s, d))),
    "l1_spike_counts": lambda s, d: tidy(layer1.spike_dip(fx.spiky(s, d))),
}

ORACLE_SQL = {
    "valid_record": fx.with_sql(["flow_nation_null"], record("flow_nation_null") + f" SELECT station_id, ts, {r('value')} AS value, CAST(pos AS INTEGER) AS pos FROM record"),
    "missing_intervals": fx.with_sql(["flow_nation_null"], record("flow_nation_null") + RUNS + " SELECT * FROM intervals"),
    "missingness": fx.with_sql(["flow_nation_null"], record("flow_nation_null") + """ SELECT station_id, count(*) FILTER (WHERE value IS NULL AND pos < first_pos) AS leading_missing,
 count(*) FILTER (WHERE value IS NULL AND pos BETWEEN first_pos AND last_pos) AS internal_missing, count(*) FILTER (WHERE value IS NULL AND pos > last_pos) AS trailing_missing,
 count(*) FILTER (WHERE value IS NULL) AS total_missing, count(*) FILTER (WHERE pos BETWEEN first_pos AND last_pos) AS record_rows, count(*) AS source_rows FROM bounded GROUP BY 1"""),
    "eda_summary": fx.with_sql(["flow_region"], f""" SELECT station_id, count(*) AS n, {r('min(value)')} AS minimum, {r('quantile_cont(value, 0.05)')} AS q05, {r('quantile_cont(value, 0.5)')} AS median,
 {r('avg(value)')} AS mean, {r('quantile_cont(value, 0.95)')} AS q95, {r('max(value)')} AS maximum, min(ts) AS first_ts, max(ts) AS last_ts FROM flow_region GROUP BY 1"""),
    "monthly_stats": fx.with_sql(["flow_rows"], record("flow_rows", ", src_pos") + MONTHLY + f" SELECT station_id, month, valid_days, {r('q25')} AS q25, {r('median')} AS median, {r('q75')} AS q75, {r('q90')} AS q90 FROM monthly"),
    "log_offset": fx.with_sql(["flow_region"], f" SELECT station_id, {r('greatest(coalesce(0.1 * quantile_cont(value, 0.1) FILTER (WHERE value > 0), 1e-6), 1e-6)')} AS log_offset FROM flow_region GROUP BY 1"),
    "availability": fx.with_sql(["flow_nation_null"], """ SELECT station_id, min(ts) AS calendar_start, max(ts) AS calendar_end, count(*) AS calendar_count, count(value) AS valid_count, count(*) - count(value) AS missing_count,
 min(ts) FILTER (WHERE value IS NOT NULL) AS first_valid, max(ts) FILTER (WHERE value IS NOT NULL) AS last_valid FROM flow_nation_null GROUP BY 1"""),
    "pair_availability": fx.with_sql(["flow_region", "flow_candidate"], """, j AS (SELECT coalesce(a.station_id, b.station_id) AS station_id, coalesce(a.ts, b.ts) AS ts, a.value AS a, b.value AS b, a.ts IS NOT NULL AND b.ts IS NOT NULL AS common
 FROM flow_region a FULL OUTER JOIN flow_candidate b ON a.station_id = b.station_id AND a.ts = b.ts),
lim AS (SELECT station_id, min(ts) FILTER (WHERE a IS NOT NULL) AS fa, max(ts) FILTER (WHERE a IS NOT NULL) AS la, min(ts) FILTER (WHERE b IS NOT NULL) AS fb, max(ts) FILTER (WHERE b IS NOT NULL) AS lb FROM j GROUP BY 1)
SELECT j.station_id, count(*) FILTER (WHERE common) AS common_rows, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS paired_valid,
 count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL) AS reference_only, count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL AND ts < fb) AS reference_only_before,
 count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL AND ts BETWEEN fb AND lb) AS reference_only_within, count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL AND ts > lb) AS reference_only_after,
 count(*) FILTER (WHERE b IS NOT NULL AND a IS NULL) AS candidate_only, count(*) FILTER (WHERE b IS NOT NULL AND a IS NULL AND ts < fa) AS candidate_only_before,
 count(*) FILTER (WHERE b IS NOT NULL AND a IS NULL AND ts BETWEEN fa AND la) AS candidate_only_within, count(*) FILTER (WHERE b IS NOT NULL AND a IS NULL AND ts > la) AS candidate_only_after
FROM j JOIN lim ON j.station_id = lim.station_id GROUP BY j.station_id"""),
    "l1_missing": fx.with_sql(["flow_nation_null"], record("flow_nation_null") + f""", c AS (SELECT station_id, count(*) FILTER (WHERE value IS NULL AND pos BETWEEN first_pos AND last_pos) AS n,
 count(*) FILTER (WHERE pos BETWEEN first_pos AND last_pos) AS m, count(*) FILTER (WHERE value IS NULL AND pos < first_pos) AS leading_missing, count(*) FILTER (WHERE value IS NULL AND pos > last_pos) AS trailing_missing FROM bounded GROUP BY 1)
 SELECT station_id, CASE WHEN m > 0 THEN n END AS value, {r('100.0 * n / nullif(m, 0)')} AS internal_missing_percentage, leading_missing, trailing_missing, CASE WHEN m > 0 THEN n > 0 END AS flag, m > 0 AS assessed FROM c"""),
    "l1_long_gaps": fx.with_sql(["flow_nation_null"], record("flow_nation_null") + RUNS + """, a AS (SELECT station_id, count(*) FILTER (WHERE pos BETWEEN first_pos AND last_pos) > 0 AS assessed FROM bounded GROUP BY 1),
 g AS (SELECT station_id, max(missing_count) AS longest, count(*) FILTER (WHERE missing_count > 3) AS reported, sum(missing_count) FILTER (WHERE missing_count > 5) AS rows_ FROM intervals WHERE position = 'internal' GROUP BY 1)
 SELECT a.station_id, CASE WHEN assessed THEN coalesce(longest, 0) END AS value, coalesce(reported, 0) AS reported_gaps, CAST(coalesce(rows_, 0) AS BIGINT) AS long_gap_rows, CASE WHEN assessed THEN coalesce(reported, 0) > 0 END AS flag, assessed
 FROM a LEFT JOIN g ON a.station_id = g.station_id"""),
    "l1_gap_intervals": fx.with_sql(["flow_nation_null"], record("flow_nation_null") + RUNS + " SELECT * FROM intervals WHERE position = 'internal' AND missing_count > 3"),
    "l1_negative": fx.with_sql(["flow_lowered"], record("flow_lowered") + f""" SELECT station_id, count(*) FILTER (WHERE value < -0.001) AS value, {r('coalesce(abs(min(value) FILTER (WHERE value < -0.001)), 0.0)')} AS maximum_negative_magnitude,
 count(*) FILTER (WHERE value < -0.001) > 0 AS flag FROM record GROUP BY 1"""),
    "l1_duplicates": fx.with_sql(["flow_rows"], """, g AS (SELECT station_id, ts, count(*) AS n, count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS kinds FROM flow_rows GROUP BY 1, 2)
 SELECT station_id, count(*) FILTER (WHERE n > 1) AS value, CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS extra_duplicate_rows, count(*) FILTER (WHERE n > 1 AND kinds > 1) AS conflicting_groups, count(*) FILTER (WHERE n > 1) > 0 AS flag FROM g GROUP BY 1"""),
    "l1_duplicate_groups": fx.with_sql(["flow_rows"], """ SELECT station_id, ts, count(*) AS occurrences, string_agg(CAST(CAST(value AS INTEGER) AS VARCHAR), ',' ORDER BY src_pos) AS values,
 count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) > 1 AS conflicting FROM flow_rows GROUP BY 1, 2 HAVING count(*) > 1"""),
    "l1_timestep": fx.with_sql(["flow_rows"], """, b AS (SELECT *, min(ts) OVER (PARTITION BY station_id) AS lo, max(ts) OVER (PARTITION BY station_id) AS hi FROM flow_rows WHERE value IS NOT NULL),
 i AS (SELECT f.* FROM flow_rows f JOIN (SELECT DISTINCT station_id, lo, hi FROM b) x ON f.station_id = x.station_id AND f.ts BETWEEN lo AND hi),
 o AS (SELECT station_id, count(*) FILTER (WHERE ts < prev) AS back, count(DISTINCT ts) AS times FROM (SELECT *, lag(ts) OVER (PARTITION BY station_id ORDER BY src_pos) AS prev FROM i) GROUP BY 1),
 u AS (SELECT station_id, count(*) FILTER (WHERE ts - prev <> 1) AS irregular FROM (SELECT station_id, ts, lag(ts) OVER (PARTITION BY station_id ORDER BY ts) AS prev FROM (SELECT DISTINCT station_id, ts FROM i)) GROUP BY 1)
 SELECT o.station_id, CASE WHEN times >= 2 THEN irregular + CASE WHEN back > 0 THEN 1 ELSE 0 END END AS value, irregular AS irregular_spacing_count, back AS out_of_order_rows,
 CASE WHEN times >= 2 THEN irregular + CASE WHEN back > 0 THEN 1 ELSE 0 END > 0 END AS flag, times >= 2 AS assessed FROM o JOIN u ON o.station_id = u.station_id"""),
    "l1_irregular_intervals": fx.with_sql(["flow_nation"], """ SELECT station_id, ts, prev AS previous_ts, CAST(ts - prev AS DOUBLE) AS interval_days FROM (SELECT station_id, ts, lag(ts) OVER (PARTITION BY station_id ORDER BY ts) AS prev FROM flow_nation WHERE value IS NOT NULL) WHERE ts - prev <> 1"""),
}
ZERO = """, z AS (SELECT *, coalesce(round_even(value, 3) = 0, FALSE) AS zero FROM record),
 zb AS (SELECT *, CASE WHEN zero <> coalesce(lag(zero) OVER w, FALSE) OR coalesce(ts - lag(ts) OVER w, 0) <> 1 THEN 1 ELSE 0 END AS b FROM z WINDOW w AS (PARTITION BY station_id ORDER BY pos)),
 zs AS (SELECT *, sum(b) OVER (PARTITION BY station_id ORDER BY pos) AS spell FROM zb),
 spells AS (SELECT station_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS observation_count, CAST(max(ts) - min(ts) + 1 AS INTEGER) AS calendar_duration_days FROM zs WHERE zero GROUP BY station_id, spell)"""
PLATEAUS = """, q AS (SELECT *, round_even(value, 3) AS rv, lag(value) OVER w AS before_, lead(value) OVER w AS after_, ts - lag(ts) OVER w AS step FROM record WINDOW w AS (PARTITION BY station_id ORDER BY pos)),
 q2 AS (SELECT *, CASE WHEN rv IS NOT NULL AND rv <> 0 AND rv = lag(rv) OVER (PARTITION BY station_id ORDER BY pos) AND step = 1 THEN 0 ELSE 1 END AS b FROM q),
 q3 AS (SELECT *, sum(b) OVER (PARTITION BY station_id ORDER BY pos) AS run FROM q2),
 plateaus AS (SELECT station_id, min(ts) AS start_ts, max(ts) AS end_ts, any_value(rv) AS plateau_value, count(*) AS observation_count, CAST(max(ts) - min(ts) + 1 AS INTEGER) AS calendar_duration_days,
 arg_min(before_, pos) AS value_before, arg_max(after_, pos) AS value_after FROM q3 WHERE rv IS NOT NULL AND rv <> 0 GROUP BY station_id, run HAVING count(*) >= 15)"""
ORACLE_SQL |= {
    "l1_zero_spells": fx.with_sql(["flow_zeroed"], record("flow_zeroed") + ZERO + " SELECT * FROM spells"),
    "l1_zero_months": fx.with_sql(["flow_zeroed"], record("flow_zeroed") + ZERO + f" SELECT station_id, CAST(month(ts) AS INTEGER) AS month, count(*) FILTER (WHERE zero) AS zero_count, count(*) AS valid_count, {r('CAST(count(*) FILTER (WHERE zero) AS DOUBLE) / count(*)')} AS zero_ratio FROM z WHERE value IS NOT NULL GROUP BY 1, 2"),
    "l1_zero_flow": fx.with_sql(["flow_zeroed"], record("flow_zeroed") + ZERO + f""", b AS (SELECT station_id, count(*) FILTER (WHERE zero) AS zc, count(value) AS vc FROM z GROUP BY 1),
 s AS (SELECT station_id, count(*) AS n, max(calendar_duration_days) AS d, max(observation_count) AS o FROM spells GROUP BY 1)
 SELECT b.station_id, zc AS zero_count, vc AS valid_count, {r('coalesce(CAST(zc AS DOUBLE) / nullif(vc, 0), 0.0)')} AS zero_ratio, coalesce(n, 0) AS zero_spell_count, CAST(coalesce(d, 0) AS BIGINT) AS longest_zero_spell_days, coalesce(o, 0) AS longest_zero_spell_observations
 FROM b LEFT JOIN s ON b.station_id = s.station_id"""),
    "l1_plateaus": fx.with_sql(["flow_flat"], record("flow_flat") + PLATEAUS + " SELECT * FROM plateaus"),
    "l1_low_variability": fx.with_sql(["flow_flat"], record("flow_flat") + PLATEAUS + """, s AS (SELECT station_id, sum(observation_count) AS n, count(*) AS p, max(calendar_duration_days) AS d FROM plateaus GROUP BY 1)
 SELECT b.station_id, CAST(coalesce(n, 0) AS BIGINT) AS value, coalesce(p, 0) AS plateau_count, CAST(coalesce(d, 0) AS BIGINT) AS longest_plateau_days, coalesce(p, 0) > 0 AS flag FROM (SELECT DISTINCT station_id FROM record) b LEFT JOIN s ON b.station_id = s.station_id"""),
    "l1_spike_dip": fx.with_sql(["flow_spiky"], record("flow_spiky") + SPIKES + f" SELECT station_id, ts, {r('value')} AS value, {r('m1')} AS previous_value, {r('p1')} AS next_value, type, {r('jump')} AS jump, {r('recovery')} AS recovery, {r('score')} AS score, {r('cutoff')} AS cutoff, status FROM found"),
    "l1_spike_counts": fx.with_sql(["flow_spiky"], record("flow_spiky") + SPIKES + """ SELECT b.station_id, count(*) FILTER (WHERE status = 'candidate') AS value, count(*) FILTER (WHERE status = 'rejected_coherent') AS rejected_coherent,
 count(*) FILTER (WHERE status = 'rejected_context') AS rejected_context, count(*) FILTER (WHERE status = 'candidate') > 0 AS flag FROM (SELECT DISTINCT station_id FROM record) b LEFT JOIN found f ON b.station_id = f.station_id GROUP BY 1"""),
}
_DAYS = {
    "valid_record": ["ts"], "missing_intervals": ["start_ts", "end_ts"], "eda_summary": ["first_ts", "last_ts"], "monthly_stats": ["month"],
    "availability": ["calendar_start", "calendar_end", "first_valid", "last_valid"], "l1_gap_intervals": ["start_ts", "end_ts"], "l1_duplicate_groups": ["ts"],
    "l1_irregular_intervals": ["ts", "previous_ts"], "l1_zero_spells": ["start_ts", "end_ts"], "l1_plateaus": ["start_ts", "end_ts"], "l1_spike_dip": ["ts"],
}
ORACLE_SQL |= {name: dated(ORACLE_SQL[name], *columns) for name, columns in _DAYS.items()}
