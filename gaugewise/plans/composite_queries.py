"""Step shift, epoch drift and the intrinsic composite as queries, with the SQL of those that SQL can express."""

from __future__ import annotations

from gaugewise.operators import composite, epoch_drift, evidence, layer1, layer2, step_shift
from gaugewise.operators.primitives import prepared
from gaugewise.plans import fixtures as fx
from gaugewise.plans.layer1_queries import MONTHLY, PLATEAUS, RUNS, SPIKES, dated, r, record, tidy
from gaugewise.plans.layer2_queries import CROSS, events_sql
from gaugewise.plans.step_sql import recursive, steps

#: Short epochs, so that the records of the tables have several to group.
FINE = {"epoch_years": 2, "minimum_valid_annual_levels": 2, "overview_epochs_per_segment": 2, "annual_noise_floor_log": 0.001}
ALL = ", ".join(f"'{n}'" for n in composite.CHECKS)


def _parts(s, d, settings):
    flow = prepared(fx.spiky(s, d))
    spikes = layer1.spike_candidates(flow).where("status = 'candidate'").select("station_id", "series_slot", "ts", "type")
    return composite.components(flow, settings, layer2.crosscheck(spikes, layer2.high_flow_events(flow)))


QUERIES = {
    "l1_step_blocks": lambda s, d: tidy(step_shift.block_features(fx.region(s, d)).drop("block_years")),
    "l1_step_boundaries": lambda s, d: tidy(step_shift.tiered_boundaries(fx.region(s, d), {"structural_threshold": 1.0})),
    "l1_step_regimes": lambda s, d: tidy(evidence.regimes(fx.region(s, d), {"structural_threshold": 1.0})),
    "l1_step_shift": lambda s, d: tidy(step_shift.step_shift(fx.region(s, d))),
    "l1_epoch_annual": lambda s, d: tidy(epoch_drift.annual_levels(fx.region(s, d))),
    "l1_epochs": lambda s, d: tidy(epoch_drift.epochs(fx.region(s, d))),
    "l1_epoch_drift": lambda s, d: tidy(epoch_drift.epoch_drift(fx.region(s, d))),
    "l1_epoch_overview": lambda s, d: tidy(epoch_drift.overview(fx.region(s, d))),
    "l1_epoch_overview_fine": lambda s, d: tidy(epoch_drift.overview(fx.nation(s, d), FINE)),
    "l1_components": lambda s, d: tidy(_parts(s, d, None)),
    "l1_composite": lambda s, d: tidy(composite.composite(_parts(s, d, None))),
    "l1_composite_full": lambda s, d: tidy(composite.composite(_parts(s, d, None))),
}
_OFFSET = """,
off AS (SELECT station_id, greatest(coalesce(0.1 * quantile_cont(value, 0.1) FILTER (WHERE value > 0), 1e-6), 1e-6) AS log_offset FROM record GROUP BY 1)"""
_BLOCKS = """,
rule0 AS (SELECT station_id, min(ts) AS first_day, max(ts) AS last_day FROM record GROUP BY 1),
rule AS (SELECT *, CASE WHEN (last_day - first_day + 1) / 365.2425 >= 12 THEN 4 ELSE greatest(1, CAST(floor((last_day - first_day + 1) / 365.2425 / 3.0) AS INTEGER)) END AS by_ FROM rule0),
bl AS (SELECT *, unnest(range(0, CAST(floor((year(last_day) - year(first_day)) / CAST(by_ AS DOUBLE)) AS INTEGER) + 1)) AS block FROM rule),
blk AS (SELECT station_id, block, greatest(make_date(CAST(year(first_day) + block * by_ AS BIGINT), 1, 1), first_day) AS start, least(make_date(CAST(year(first_day) + (block + 1) * by_ AS BIGINT), 1, 1) - 1, last_day) AS end_ FROM bl),
lg AS (SELECT m.station_id, month, ln(median + log_offset) AS a, ln(q25 + log_offset) AS b, ln(q75 + log_offset) AS c, ln(q90 + log_offset) AS e FROM monthly m JOIN off ON m.station_id = off.station_id WHERE median IS NOT NULL),
bm AS (SELECT k.*, month, a, b, c, e FROM blk k JOIN lg ON k.station_id = lg.station_id AND month BETWEEN start AND end_),
cl AS (SELECT station_id, block, quantile_cont(x, 0.9) - quantile_cont(x, 0.1) AS amp FROM (SELECT station_id, block, month(month) AS mm, quantile_cont(a, 0.5) AS x FROM bm GROUP BY 1, 2, 3) GROUP BY 1, 2),
bf AS (SELECT station_id, block, any_value(start) AS start, any_value(end_) AS end_, count(*) AS valid_months, count(DISTINCT month(month)) AS cm, quantile_cont(a, 0.5) AS level_log, quantile_cont(e, 0.5) AS high_log, quantile_cont(c - b, 0.5) AS variability_log FROM bm GROUP BY 1, 2)"""
_ANNUAL = """,
lv AS (SELECT m.station_id, month, ln(median + log_offset) AS level, log_offset FROM monthly m JOIN off ON m.station_id = off.station_id),
clim AS (SELECT station_id, month(month) AS mm, quantile_cont(level, 0.5) AS usual FROM lv GROUP BY 1, 2),
rf AS (SELECT station_id, quantile_cont(level, 0.5) AS reference FROM lv GROUP BY 1),
an AS (SELECT lv.station_id, CAST(year(month) AS INTEGER) AS year, count(level - usual) AS valid_months, quantile_cont(level - usual, 0.5) AS x, any_value(log_offset) AS log_offset FROM lv JOIN clim ON lv.station_id = clim.station_id AND month(month) = mm GROUP BY 1, 2),
ann AS (SELECT an.station_id, year, valid_months, CASE WHEN valid_months >= 8 THEN x END AS level_anomaly, reference, log_offset FROM an JOIN rf ON an.station_id = rf.station_id)"""
_EPOCHS = """,
ru0 AS (SELECT station_id, year, level_anomaly AS y, year - row_number() OVER (PARTITION BY station_id ORDER BY year) AS g FROM ann WHERE level_anomaly IS NOT NULL),
ru1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY station_id, g) AS n FROM ru0) WHERE n >= 5),
ru AS (SELECT *, dense_rank() OVER (PARTITION BY station_id ORDER BY g) AS run FROM ru1),
df AS (SELECT station_id, abs(y - lag(y) OVER (PARTITION BY station_id, run ORDER BY year)) AS d FROM ru),
orr AS (SELECT df.station_id, d FROM df JOIN (SELECT station_id, quantile_cont(d, 0.5) AS h FROM df GROUP BY 1) q ON df.station_id = q.station_id WHERE d <= h),
noise AS (SELECT o.station_id, greatest(any_value(c) + 1.4826 * quantile_cont(abs(d - c), 0.5), 0.03) AS noise FROM orr o JOIN (SELECT station_id, quantile_cont(d, 0.5) AS c FROM orr GROUP BY 1) q ON o.station_id = q.station_id GROUP BY 1),
pt AS (SELECT station_id, run, year, y, n, row_number() OVER (PARTITION BY station_id, run ORDER BY year) - 1 AS i, CAST(floor(n / 5.0) AS INTEGER) AS k FROM ru),
pp AS (SELECT *, CASE WHEN i < (n % k) * (floor(n / CAST(k AS DOUBLE)) + 1) THEN floor(i / (floor(n / CAST(k AS DOUBLE)) + 1)) ELSE (n % k) + floor((i - (n % k) * (floor(n / CAST(k AS DOUBLE)) + 1)) / floor(n / CAST(k AS DOUBLE))) END AS part FROM pt),
sl AS (SELECT a.station_id, a.run, a.part, quantile_cont((b.y - a.y) / (b.year - a.year), 0.5) AS slope FROM pp a JOIN pp b ON a.station_id = b.station_id AND a.run = b.run AND a.part = b.part AND b.year > a.year GROUP BY 1, 2, 3),
li AS (SELECT station_id, run, part, min(year) AS first_year, max(year) AS last_year, count(*) AS years, quantile_cont(y, 0.5) AS my, quantile_cont(year, 0.5) AS mx FROM pp GROUP BY 1, 2, 3),
ep AS (SELECT li.*, slope, abs(slope) * greatest(last_year - first_year, 1) / noise AS change_score FROM li JOIN sl ON li.station_id = sl.station_id AND li.run = sl.run AND li.part = sl.part JOIN noise ON li.station_id = noise.station_id),
epochs AS (SELECT station_id, run, row_number() OVER (PARTITION BY station_id ORDER BY run, part) AS epoch, first_year, last_year, years, slope, my - slope * mx AS intercept, change_score, CASE WHEN change_score < 1 THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS state FROM ep),
drift AS (SELECT b.station_id, CAST(coalesce(sum(years), 0) AS BIGINT) AS assessed_years, count(epoch) AS epoch_count, sum(CASE WHEN state = 'stable' THEN years ELSE 0 END) / CAST(sum(years) AS DOUBLE) AS share, count(DISTINCT CASE WHEN state <> 'stable' THEN state END) AS kinds, min(CASE WHEN state <> 'stable' THEN state END) AS one_
  FROM (SELECT DISTINCT station_id FROM record) b LEFT JOIN epochs e ON b.station_id = e.station_id GROUP BY 1)"""
_TIERS = """,
mi AS (SELECT station_id, count(*) FILTER (WHERE value IS NULL AND pos BETWEEN first_pos AND last_pos) AS n, count(*) FILTER (WHERE pos BETWEEN first_pos AND last_pos) AS m FROM bounded GROUP BY 1),
ga AS (SELECT station_id, max(missing_count) AS longest, sum(missing_count) FILTER (WHERE missing_count > 5) AS lg_rows FROM intervals WHERE position = 'internal' GROUP BY 1),
mg AS (SELECT mi.station_id, 100.0 * n / m AS pct, coalesce(longest, 0) AS longest, coalesce(lg_rows / CAST(nullif(n, 0) AS DOUBLE), 0.0) AS long_share FROM mi LEFT JOIN ga ON mi.station_id = ga.station_id),
mt AS (SELECT *, CASE WHEN pct > 15 THEN 2 WHEN pct >= 5 THEN 1 ELSE 0 END AS mp FROM mg),
dp AS (SELECT station_id, count(*) FILTER (WHERE n > 1) AS v FROM (SELECT station_id, ts, count(*) AS n FROM flow_spiky GROUP BY 1, 2) GROUP BY 1),
ts_ AS (SELECT station_id, count(*) FILTER (WHERE ts - prev <> 1) AS v FROM (SELECT station_id, ts, lag(ts) OVER (PARTITION BY station_id ORDER BY ts) AS prev FROM flow_spiky WHERE value IS NOT NULL) GROUP BY 1),
ng AS (SELECT station_id, count(*) FILTER (WHERE value < -0.001) AS c, coalesce(abs(min(value) FILTER (WHERE value < -0.001)), 0.0) AS v, quantile_cont(greatest(value, 0), 0.05) AS low FROM record GROUP BY 1),
sk AS (SELECT b.station_id, count(c.ts) AS v FROM (SELECT DISTINCT station_id FROM record) b LEFT JOIN (SELECT * FROM crossed WHERE crosscheck_status <> 'plausible_event_context') c ON b.station_id = c.station_id GROUP BY 1),
pl AS (SELECT b.station_id, coalesce(max(calendar_duration_days), 0) AS v FROM (SELECT DISTINCT station_id FROM record) b LEFT JOIN plateaus p ON b.station_id = p.station_id GROUP BY 1),
al AS (SELECT station_id, 'missing_values' AS chk, pct AS v, mp AS p, 2 AS w FROM mt
 UNION ALL SELECT station_id, 'long_gaps', longest, CASE WHEN longest >= 31 OR (mp = 2 AND long_share >= 0.25) THEN 2 WHEN longest >= 6 OR (mp = 1 AND long_share >= 0.5) THEN 1 ELSE 0 END, 2 FROM mt
 UNION ALL SELECT station_id, 'duplicate_timestamps', v, CASE WHEN v > 0 THEN 2 ELSE 0 END, 3 FROM dp UNION ALL SELECT station_id, 'timestep_consistency', v, CASE WHEN v > 0 THEN 2 ELSE 0 END, 3 FROM ts_
 UNION ALL SELECT station_id, 'negative_discharge', v, CASE WHEN c = 0 THEN 0 WHEN v >= low THEN 2 ELSE 1 END, 3 FROM ng UNION ALL SELECT station_id, 'spike_dip', v, CASE WHEN v >= 6 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END, 1 FROM sk
 UNION ALL SELECT station_id, 'low_variability', v, CASE WHEN v >= 31 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END, 1 FROM pl
 UNION ALL SELECT station_id, 'step_shift', score, p, 3 FROM ss
 UNION ALL SELECT station_id, 'epoch_drift', share, CASE WHEN share IS NULL THEN NULL WHEN share >= 0.75 THEN 0 WHEN share >= 0.5 THEN 1 ELSE 2 END, 2 FROM drift)"""
_EPOCH_SQL = record("flow_region") + MONTHLY + _OFFSET + _ANNUAL
_FULL = recursive(fx.with_sql(["flow_spiky"], record("flow_spiky") + RUNS + SPIKES + events_sql("flow_spiky") + CROSS + PLATEAUS + MONTHLY + _OFFSET + _BLOCKS + _ANNUAL + steps() + _EPOCHS + _TIERS))
_T = "CASE p WHEN 0 THEN 'Tier 3' WHEN 1 THEN 'Tier 2' WHEN 2 THEN 'Tier 1' ELSE 'Not assessable' END"
ORACLE_SQL = {
    "l1_step_blocks": dated(fx.with_sql(["flow_region"], record("flow_region") + MONTHLY + _OFFSET + _BLOCKS + f""" SELECT bf.station_id, CAST(bf.block AS INTEGER) AS block, start, end_ AS "end", {r('valid_months / (datediff(\'month\', start, end_) + 1.0)')} AS coverage, valid_months, {r('level_log')} AS level_log, {r('high_log')} AS high_log,
 {r('amp')} AS seasonal_amplitude_log, {r('variability_log')} AS variability_log FROM bf JOIN cl ON bf.station_id = cl.station_id AND bf.block = cl.block WHERE valid_months / (datediff('month', start, end_) + 1.0) >= 0.55 AND cm >= 8"""), "start", '"end"'),
    "l1_epoch_annual": fx.with_sql(["flow_region"], _EPOCH_SQL + f" SELECT station_id, year, valid_months, {r('level_anomaly')} AS level_anomaly, {r('exp(reference + level_anomaly) - log_offset')} AS display_level, {r('reference')} AS reference, {r('log_offset')} AS log_offset FROM ann"),
    "l1_epochs": fx.with_sql(["flow_region"], _EPOCH_SQL + _EPOCHS + f" SELECT station_id, CAST(run AS INTEGER) AS run, CAST(epoch AS INTEGER) AS epoch, first_year, last_year, years, {r('slope')} AS slope, {r('intercept')} AS intercept, {r('change_score')} AS change_score, state FROM epochs"),
    "l1_epoch_drift": fx.with_sql(["flow_region"], _EPOCH_SQL + _EPOCHS + f""" SELECT station_id, assessed_years, epoch_count, {r('share')} AS stable_year_fraction, CASE WHEN epoch_count = 0 THEN NULL WHEN share >= 0.75 THEN 'Tier 3' WHEN share >= 0.5 THEN 'Tier 2' ELSE 'Tier 1' END AS tier,
 CASE WHEN epoch_count = 0 THEN NULL WHEN kinds = 0 THEN 'stable' WHEN kinds = 1 THEN one_ ELSE 'mixed' END AS dominant_state, epoch_count > 0 AS assessed FROM drift"""),
    "l1_components": _FULL + f" SELECT station_id, chk AS \"check\", p IS NOT NULL AS assessable, {r('CAST(v AS DOUBLE)')} AS raw_value, {_T} AS tier, p AS tier_points, w AS weight, coalesce(p * w, 0) AS contribution FROM al",
    "l1_composite": _FULL + f""", sc AS (SELECT station_id, CAST(sum(coalesce(p * w, 0)) AS BIGINT) AS layer1_score, CAST(coalesce(sum(CASE WHEN p IS NOT NULL THEN 2 * w END), 0) AS BIGINT) AS mx, count(p) AS n, string_agg(CASE WHEN p IS NULL THEN chk END, '; ' ORDER BY list_position([{ALL}], chk)) AS un FROM al GROUP BY 1)
 SELECT station_id, layer1_score, CASE WHEN n = 0 THEN 'Not assessable' WHEN 100.0 * layer1_score / mx >= 20 THEN 'Needs review' WHEN 100.0 * layer1_score / mx >= 7.5 THEN 'Minor concerns' ELSE 'No review needed' END AS layer1_class, {r('100.0 * layer1_score / nullif(mx, 0)')} AS layer1_score_percent, mx AS maximum_assessable_score,
 'Full' AS assessment_scope, 9 AS enabled_check_count, 9 AS total_composite_check_count, '' AS disabled_checks, n AS assessable_checks, {r('100.0 * n / 9')} AS evidence_coverage_percent, un IS NOT NULL AS assessment_incomplete, coalesce(un, '') AS unavailable_checks FROM sc""",
}


ORACLE_SQL["l1_composite_full"] = ORACLE_SQL["l1_composite"]
_STEP = recursive(fx.with_sql(["flow_region"], record("flow_region") + MONTHLY + _OFFSET + _BLOCKS + _ANNUAL + "{steps}"))
ORACLE_SQL["l1_step_boundaries"] = dated(
    _STEP.replace("{steps}", steps(1.0)) + f""" SELECT station_id, CAST(i AS INTEGER) AS boundary, day_ AS boundary_date, at_ AS approximate_date, {r('greatest(s1, s2, s3, s4)')} AS structural_score, CAST(n AS INTEGER) AS collapsed_edge_count, {r('s1')} AS score_level_log, {r('s2')} AS score_high_log, {r('s3')} AS score_seasonal_amplitude_log,
 {r('s4')} AS score_variability_log, {r('before_median')} AS before_median, {r('after_median')} AS after_median, {r('change')} AS absolute_median_change, {r('low_bound')} AS low_bound, {r('high_bound')} AS high_bound, tier FROM zb""", "boundary_date", "approximate_date"
)
ORACLE_SQL["l1_step_regimes"] = dated(
    _STEP.replace("{steps}", steps(1.0)) + f""", g0 AS (SELECT station_id, first_day AS a FROM rule0 UNION ALL SELECT station_id, day_ FROM zb WHERE tier <> 'Tier 3'),
g1 AS (SELECT g0.station_id, a, coalesce(lead(a) OVER w - 1, last_day) AS b, row_number() OVER w AS i FROM g0 JOIN rule0 ON g0.station_id = rule0.station_id JOIN ss ON g0.station_id = ss.station_id WHERE done WINDOW w AS (PARTITION BY g0.station_id ORDER BY a))
 SELECT station_id, CAST(i AS INTEGER) AS regime, CAST(a AS DATE) AS start, CAST(b AS DATE) AS "end", (SELECT count(value) FROM record WHERE record.station_id = g1.station_id AND ts BETWEEN a AND b) AS valid_day_count, {r('(SELECT quantile_cont(median, 0.5) FROM monthly WHERE monthly.station_id = g1.station_id AND month BETWEEN a AND b)')} AS median FROM g1 WHERE a <= b""", "start", '"end"'
)
ORACLE_SQL["l1_step_shift"] = _STEP.replace("{steps}", steps()) + f""" SELECT station_id, retained AS value, n AS boundary_count, blocks AS block_count, {r('record_years')} AS record_years, CAST(by_ AS INTEGER) AS block_years, {r('score')} AS step_shift_score,
 CASE p WHEN 0 THEN 'Tier 3' WHEN 1 THEN 'Tier 2' WHEN 2 THEN 'Tier 1' END AS tier, done AS assessed FROM ss"""


def _overview_sql(source: str, epoch_years: int, levels: int, per: int, floor: float) -> str:
    """All groupings of a run's epochs by recursion, the one of least error, like neighbours joined."""
    epochs = _EPOCHS.replace("WHERE n >= 5", f"WHERE n >= {levels}").replace("floor(n / 5.0)", f"floor(n / {epoch_years}.0)").replace("0.03) AS noise", f"{floor}) AS noise")
    return recursive(fx.with_sql([source], record(source) + MONTHLY + _OFFSET + _ANNUAL + epochs)) + f""",
oy AS (SELECT ru.station_id, ru.run, year, y, dense_rank() OVER (PARTITION BY ru.station_id, ru.run ORDER BY epoch) - 1 AS e FROM ru JOIN epochs ON ru.station_id = epochs.station_id AND ru.run = epochs.run AND year BETWEEN first_year AND last_year),
ow AS (SELECT station_id, run, max(e) + 1 AS n, least(4, CAST(ceil((max(e) + 1) / {per}.0) AS INTEGER)) AS parts FROM oy GROUP BY 1, 2),
ob AS (SELECT station_id, run, a, unnest(range(a + 1, n + 1)) AS b FROM (SELECT station_id, run, n, unnest(range(0, n)) AS a FROM ow)),
os AS (SELECT ob.station_id, ob.run, a, b, quantile_cont((q.y - p.y) / (q.year - p.year), 0.5) AS slope FROM ob JOIN oy p ON ob.station_id = p.station_id AND ob.run = p.run AND p.e >= a AND p.e < b JOIN oy q ON ob.station_id = q.station_id AND ob.run = q.run AND q.e >= a AND q.e < b AND q.year > p.year GROUP BY 1, 2, 3, 4),
oc AS (SELECT os.station_id, os.run, a, b, any_value(slope) AS slope, quantile_cont(y, 0.5) - any_value(slope) * quantile_cont(year, 0.5) AS base, min(year) AS y0, max(year) AS y1 FROM os JOIN oy ON os.station_id = oy.station_id AND os.run = oy.run AND e >= a AND e < b GROUP BY 1, 2, 3, 4),
oe AS (SELECT oc.*, cost, CASE WHEN abs(slope) * greatest(y1 - y0, 1) / noise < 1 THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS state FROM oc JOIN noise ON oc.station_id = noise.station_id
  JOIN (SELECT oc.station_id, oc.run, a, b, sum((y - base - slope * year) * (y - base - slope * year)) AS cost FROM oc JOIN oy ON oc.station_id = oy.station_id AND oc.run = oy.run AND e >= a AND e < b GROUP BY 1, 2, 3, 4) k ON oc.station_id = k.station_id AND oc.run = k.run AND oc.a = k.a AND oc.b = k.b),
og AS (SELECT station_id, run, 0 AS k, CAST(0 AS BIGINT) AS e, CAST(0.0 AS DOUBLE) AS total, CAST([] AS BIGINT[]) AS cuts FROM ow UNION ALL SELECT og.station_id, og.run, k + 1, CAST(b AS BIGINT), total + cost, list_append(cuts, CAST(b AS BIGINT)) FROM og JOIN oe ON og.station_id = oe.station_id AND og.run = oe.run AND og.e = oe.a JOIN ow ON og.station_id = ow.station_id AND og.run = ow.run WHERE k < parts),
oh AS (SELECT og.station_id, og.run, cuts FROM og JOIN ow ON og.station_id = ow.station_id AND og.run = ow.run WHERE k = parts AND e = n QUALIFY row_number() OVER (PARTITION BY og.station_id, og.run ORDER BY total, cuts) = 1),
oi AS (SELECT station_id, run, unnest(cuts) AS b, unnest(list_prepend(0, cuts[:-2])) AS a FROM oh),
oj AS (SELECT oi.*, state, CASE WHEN state = lag(state) OVER (PARTITION BY oi.station_id, oi.run ORDER BY oi.a) THEN 0 ELSE 1 END AS fresh FROM oi JOIN oe ON oi.station_id = oe.station_id AND oi.run = oe.run AND oi.a = oe.a AND oi.b = oe.b),
ok AS (SELECT station_id, run, i, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY station_id, run ORDER BY a) AS i FROM oj) GROUP BY 1, 2, 3)
SELECT ok.station_id, CAST(ok.run AS INTEGER) AS run, CAST(i AS INTEGER) AS overview, y0 AS first_year, y1 AS last_year, {r('slope')} AS slope, state FROM ok JOIN oe ON ok.station_id = oe.station_id AND ok.run = oe.run AND ok.a = oe.a AND ok.b = oe.b"""


ORACLE_SQL["l1_epoch_overview"] = _overview_sql("flow_region", 5, 5, 4, 0.03)
ORACLE_SQL["l1_epoch_overview_fine"] = _overview_sql("flow_nation", 2, 2, 2, 0.001)


def tiers_sql(source: str) -> str:
    """Tiers of all nine checks of a flow, spikes not held against events."""
    body = _TIERS.replace("flow_spiky", source).replace("(SELECT * FROM crossed WHERE crosscheck_status <> 'plausible_event_context')", "(SELECT * FROM found WHERE status = 'candidate')")
    return recursive(fx.with_sql([source], record(source) + RUNS + SPIKES + PLATEAUS + MONTHLY + _OFFSET + _BLOCKS + _ANNUAL + steps() + _EPOCHS + body))


def changes_sql(source: str, threshold: float) -> str:
    """CTEs ``sdays`` (days of shifts above Tier 3), ``sa`` (whether shifts were assessed) and ``eb`` (dominant epoch state ``one``), with names of their own inside."""
    body = "WITH RECURSIVE start_ AS (SELECT 1)" + record(source) + MONTHLY + _OFFSET + _BLOCKS + _ANNUAL
    return f"""
sdays AS ({body}{steps(threshold)} SELECT station_id, day_ AS day FROM zb WHERE tier <> 'Tier 3'),
sa AS ({body}{steps(threshold)} SELECT station_id, done FROM ss),
eb AS ({body}{_EPOCHS} SELECT station_id, CASE WHEN epoch_count = 0 THEN NULL WHEN kinds = 0 THEN 'stable' WHEN kinds = 1 THEN one_ ELSE 'mixed' END AS one FROM drift)"""
