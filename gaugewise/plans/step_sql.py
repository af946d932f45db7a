"""Step shifts as recursive SQL, after the blocks, months and levels of ``composite_queries``: the oracle of the fold."""

from __future__ import annotations

from gaugewise.config import LAYER1

_C = LAYER1["step_shift"]
_F = "abce"  # level, high flow, seasonal amplitude, variability
_FLOOR = {"a": 0.1, "b": 0.15, "c": 0.15, "e": 0.12}


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def steps(threshold: float = _C["structural_threshold"], source_months: str = "monthly") -> str:
    """CTEs ``zb`` (dated boundaries with tiers) and ``ss`` (score, tier and counts of each series)."""
    scales = ", ".join(f"max(s) FILTER (WHERE f = '{x}') AS s{x}" for x in _F)
    moves = ", ".join(f"abs({x} - lag({x}) OVER w)" for x in _F)
    floors = " ".join(f"WHEN '{x}' THEN {v}" for x, v in _FLOOR.items())
    far = ", ".join(f"abs(segs[j + 1].{x} - segs[j].{x}) / s{x}" for x in _F)
    mean = ", ".join(f"{x} := (segs[p].{x} * segs[p].w + segs[p + 1].{x} * segs[p + 1].w) / (segs[p].w + segs[p + 1].w)" for x in _F)
    signed = ", ".join(f"(segs[j + 1].{x} - segs[j].{x}) / s{x}" for x in _F)
    reach = f"greatest(1, CAST(round_even(by_ * 12 * {_C['refinement_block_fraction']}, 0) AS INTEGER))"
    return f""",
zk AS (SELECT bf.station_id, start, CAST(valid_months AS DOUBLE) AS w, level_log AS a, high_log AS b, amp AS c, variability_log AS e, row_number() OVER (PARTITION BY bf.station_id ORDER BY bf.block) AS i, count(*) OVER (PARTITION BY bf.station_id) AS n
  FROM bf JOIN cl ON bf.station_id = cl.station_id AND bf.block = cl.block WHERE valid_months / (datediff('month', start, end_) + 1.0) >= {_C['minimum_block_coverage']} AND cm >= {_C['minimum_calendar_months']}),
zd AS (SELECT station_id, unnest(['a', 'b', 'c', 'e']) AS f, unnest([{moves}]) AS d FROM zk WHERE n >= 3 WINDOW w AS (PARTITION BY station_id ORDER BY i)),
zh AS (SELECT zd.station_id, zd.f, d FROM zd JOIN (SELECT station_id, f, quantile_cont(d, 0.5) AS h FROM zd GROUP BY 1, 2) q ON zd.station_id = q.station_id AND zd.f = q.f WHERE d <= h),
zs AS (SELECT zh.station_id, zh.f, greatest(CASE zh.f {floors} END, any_value(c0) + 1.4826 * quantile_cont(abs(d - c0), 0.5)) AS s
  FROM zh JOIN (SELECT station_id, f, quantile_cont(d, 0.5) AS c0 FROM zh GROUP BY 1, 2) q ON zh.station_id = q.station_id AND zh.f = q.f GROUP BY 1, 2),
zc AS (SELECT station_id, {scales} FROM zs GROUP BY 1),
zm AS (
  SELECT station_id, 0 AS k, list(struct_pack(st := start, w := w, a := a, b := b, c := c, e := e) ORDER BY i) AS segs FROM zk WHERE n >= 3 GROUP BY 1
  UNION ALL
  SELECT station_id, k + 1, list_concat(list_concat(segs[1:p - 1], [struct_pack(st := segs[p].st, w := segs[p].w + segs[p + 1].w, {mean})]), segs[p + 2:])
  FROM (SELECT *, list_min(g) AS least, list_position(g, list_min(g)) AS p FROM (SELECT zm.station_id, k, segs, list_transform(range(1, len(segs)), lambda j: greatest({far})) AS g FROM zm JOIN zc ON zm.station_id = zc.station_id WHERE len(segs) > 1))
  WHERE least < {threshold}),
zg AS (SELECT station_id, arg_max(segs, k) AS segs FROM zm GROUP BY 1),
ze AS (SELECT zg.station_id, by_, j, segs[j + 1].st AS at_, [{signed}] AS v FROM (SELECT station_id, segs, unnest(range(1, len(segs))) AS j FROM zg) zg JOIN zc ON zg.station_id = zc.station_id JOIN rule ON zg.station_id = rule.station_id),
zt AS (SELECT *, list_transform(v, lambda x: abs(x)) AS score, sign(v[list_position(list_transform(v, lambda x: abs(x)), list_max(list_transform(v, lambda x: abs(x))))]) AS turn FROM ze),
zi AS (SELECT *, CASE WHEN turn = lag(turn) OVER w AND at_ - lag(at_) OVER w <= 366 * by_ * {_C['consolidation_max_block_widths']} THEN 0 ELSE 1 END AS fresh FROM zt WINDOW w AS (PARTITION BY station_id ORDER BY j)),
zn AS (SELECT *, sum(fresh) OVER (PARTITION BY station_id ORDER BY j) AS cand FROM zi),
zf AS (SELECT station_id, cand, any_value(by_) AS by_, min(at_) AS at_, count(*) AS n, max(score[1]) AS s1, max(score[2]) AS s2, max(score[3]) AS s3, max(score[4]) AS s4 FROM zn GROUP BY 1, 2),
za AS (SELECT lv.station_id, lv.month, level - usual AS x FROM lv JOIN clim ON lv.station_id = clim.station_id AND month(lv.month) = mm WHERE level IS NOT NULL),
zr AS (SELECT station_id, cand, {reach} AS reach, unnest(range(-{reach}, {reach} + 1)) AS shift, at_ FROM zf WHERE s1 >= {threshold}),
zw AS (SELECT station_id, cand, reach, CAST(at_ + to_months(CAST(shift AS INTEGER)) AS DATE) AS day_ FROM zr),
zq AS (SELECT zw.station_id, cand, day_, any_value(reach) AS reach, count(*) FILTER (WHERE month < day_) AS nb, count(*) FILTER (WHERE month >= day_) AS na, abs(quantile_cont(x, 0.5) FILTER (WHERE month >= day_) - quantile_cont(x, 0.5) FILTER (WHERE month < day_)) AS gain
  FROM zw JOIN za ON zw.station_id = za.station_id AND month >= CAST(day_ - to_months(reach) AS DATE) AND month < CAST(day_ + to_months(reach) AS DATE) GROUP BY 1, 2, 3),
zy AS (SELECT station_id, cand, day_ FROM zq WHERE nb >= greatest(3, ceil(reach / 2.0)) AND na >= greatest(3, ceil(reach / 2.0)) QUALIFY row_number() OVER (PARTITION BY station_id, cand ORDER BY gain DESC, day_) = 1),
zo AS (SELECT zf.*, coalesce(day_, at_) AS day0, row_number() OVER (PARTITION BY zf.station_id ORDER BY coalesce(day_, at_), zf.cand) AS i FROM zf LEFT JOIN zy ON zf.station_id = zy.station_id AND zf.cand = zy.cand),
zx AS (SELECT station_id, i, day0 AS day_ FROM zo WHERE i = 1 UNION ALL SELECT zo.station_id, zo.i, CASE WHEN zo.day0 <= zx.day_ THEN zo.at_ ELSE zo.day0 END FROM zx JOIN zo ON zx.station_id = zo.station_id AND zo.i = zx.i + 1),
zp AS (SELECT zo.*, zx.day_, coalesce(lag(zx.day_) OVER w, first_day) AS from_day, coalesce(lead(zx.day_) OVER w, last_day + 1) AS to_day
  FROM zo JOIN zx ON zo.station_id = zx.station_id AND zo.i = zx.i JOIN rule0 ON zo.station_id = rule0.station_id WINDOW w AS (PARTITION BY zo.station_id ORDER BY zo.i)),
zv AS (SELECT zp.station_id, i, quantile_cont(median, 0.5) FILTER (WHERE month >= from_day AND month < day_) AS before_median, quantile_cont(median, 0.5) FILTER (WHERE month >= day_ AND month < to_day) AS after_median FROM zp JOIN {source_months} m ON zp.station_id = m.station_id GROUP BY 1, 2),
zl AS (SELECT station_id, quantile_cont(greatest(value, 0), {_C['tier_3_maximum_quantile']}) AS low_bound, quantile_cont(greatest(value, 0), {_C['tier_1_minimum_quantile']}) AS high_bound FROM record WHERE value IS NOT NULL GROUP BY 1),
zb AS (SELECT zp.*, before_median, after_median, abs(after_median - before_median) AS change, low_bound, high_bound, CASE WHEN abs(after_median - before_median) <= low_bound THEN 'Tier 3' WHEN abs(after_median - before_median) >= high_bound THEN 'Tier 1' ELSE 'Tier 2' END AS tier
  FROM zp JOIN zv ON zp.station_id = zv.station_id AND zp.i = zv.i JOIN zl ON zp.station_id = zl.station_id),
zz AS (SELECT station_id, count(*) AS n, count(*) FILTER (WHERE tier <> 'Tier 3') AS retained, avg(CASE tier WHEN 'Tier 1' THEN {_C['tier_1_points']} WHEN 'Tier 2' THEN {_C['tier_2_points']} ELSE {_C['tier_3_points']} END) AS score FROM zb GROUP BY 1),
zu AS (SELECT station_id, count(*) AS blocks FROM zk GROUP BY 1),
ss AS (SELECT rule.station_id, coalesce(retained, 0) AS retained, coalesce(n, 0) AS n, coalesce(blocks, 0) AS blocks, (last_day - first_day + 1) / 365.2425 AS record_years, by_, coalesce(blocks, 0) >= 3 AS done, CASE WHEN coalesce(blocks, 0) >= 3 THEN coalesce(score, 0.0) END AS score,
    CASE WHEN coalesce(blocks, 0) < 3 THEN NULL WHEN coalesce(score, 0.0) > {_C['composite_tier_1_above_score']} THEN 2 WHEN coalesce(score, 0.0) >= {_C['composite_tier_2_minimum_score']} THEN 1 ELSE 0 END AS p
  FROM rule LEFT JOIN zz ON rule.station_id = zz.station_id LEFT JOIN zu ON rule.station_id = zu.station_id)"""
