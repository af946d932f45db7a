"""Two series of each station: preparation, daily metrics, signature differences and the composite.

``reference`` and ``candidate`` are flows; their stations are matched, their slots are not.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.config import LAYER2, overlay
from gaugewise.functions.numeric import correlation, cosine, median, month_distance, quantile, ratio, resampled
from gaugewise.functions.shared import written
from gaugewise.operators import layer2
from gaugewise.operators.primitives import KEYS, out_of_order, prepared

ANNUAL_METRICS = [
    "mean_flow", "median_flow", "minimum_flow", "maximum_flow", "flashiness_index", "baseflow_index", "seasonality_index", "lag1_autocorrelation", "wettest_month", "driest_month",
]
MONTH_METRICS = ["wettest_month", "driest_month"]
POINTS = {"Tier 3": 0, "Tier 2": 1, "Tier 1": 2}
EPS = 2.0**-52


def unfit(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Stations that cannot be compared: a side with repeated times, out of order, or without values."""

    def side(flow: DataFrame, name: str) -> DataFrame:
        disorder = out_of_order(flow).groupBy(F.col("station_id").alias("of")).agg(F.bool_or(F.col("out_of_order_rows") > 0).alias("disorder"))
        counts = flow.groupBy("station_id").agg((F.count(F.lit(1)) > F.count_distinct("ts")).alias("repeated"), (F.count("value") == 0).alias("empty"))
        return counts.join(disorder, F.col("station_id").eqNullSafe(F.col("of")), "left").select("station_id", F.concat_ws("; ", F.when(F.col("repeated"), f"{name} has duplicate timestamps"), F.when(F.col("disorder"), f"{name} is not sorted"), F.when(F.col("empty"), f"{name} has no valid values")).alias("reason"))

    both = side(reference, "reference").unionByName(side(candidate, "candidate")).where("reason <> ''")
    return both.groupBy("station_id").agg(F.concat_ws("; ", F.sort_array(F.collect_list("reason"))).alias("reason"))


def paired(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Rows of the joint calendar inside the overlap of both valid records: station_id, ts, reference, candidate."""
    a, b = reference.select("station_id", "ts", F.col("value").alias("reference")), candidate.select("station_id", "ts", F.col("value").alias("candidate"))
    both = a.join(b, ["station_id", "ts"], "full_outer")
    w = Window.partitionBy("station_id")

    def bound(f, c: str) -> Column:
        return f(F.when(F.col(c).isNotNull(), F.col("ts"))).over(w)

    both = both.withColumns({"ra": bound(F.min, "reference"), "rb": bound(F.max, "reference"), "ca": bound(F.min, "candidate"), "cb": bound(F.max, "candidate")})
    inside = (F.col("ts") >= F.greatest("ra", "ca")) & (F.col("ts") <= F.least("rb", "cb")) & F.col("ra").isNotNull() & F.col("ca").isNotNull()
    return both.where(inside).drop("ra", "rb", "ca", "cb")


def coverage(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Of each station with both sides the window they share, its rows, and the pairs with both values."""
    both = F.col("reference").isNotNull() & F.col("candidate").isNotNull()
    return paired(reference, candidate).groupBy("station_id").agg(
        F.min("ts").alias("common_start_date"), F.max("ts").alias("common_end_date"), F.count(F.lit(1)).alias("common_timestamp_count"), F.count_if(both).alias("pairwise_valid_count")
    )


def paired_flows(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the overlap as flows."""

    def side(c: str, slot: str) -> DataFrame:
        return pairs.select("station_id", F.lit(slot).alias("series_slot"), "ts", F.col(c).alias("value"), F.lit(None).cast("long").alias("src_pos"))

    return side("reference", "series1"), side("candidate", "series2")


def historical(flow: DataFrame, start: str, end: str, exclude_selected: bool = True) -> tuple[DataFrame, DataFrame]:
    """(baseline, selected period) of one flow; the period is left out of the baseline if asked."""
    day = F.col("ts").cast("date")
    selected = day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return flow.where(~selected) if exclude_selected else flow, flow.where(selected)


def daily_metrics(pairs: DataFrame) -> DataFrame:
    """Thirteen metrics of each station over pairs with both values: station_id, metric, value."""
    rows = pairs.where("reference is not null and candidate is not null")

    def rank(c: str) -> Column:
        same = F.count(F.lit(1)).over(Window.partitionBy("station_id", c))
        return F.rank().over(Window.partitionBy("station_id").orderBy(c)) + (same - 1) / 2

    rows = rows.withColumns({"rank_r": rank("reference"), "rank_c": rank("candidate")})
    x, y = F.col("reference"), F.col("candidate")
    e = y - x
    m = rows.groupBy("station_id").agg(
        F.count(F.lit(1)).cast("double").alias("pairwise_valid_days"), F.avg(x).alias("reference_mean"), F.avg(y).alias("candidate_mean"), F.avg(e).alias("mean_bias"), F.avg(F.abs(e)).alias("mean_absolute_error"),
        F.sqrt(F.avg(e * e)).alias("root_mean_squared_error"), F.when(F.sum(x) != 0, ratio(100 * F.sum(e), F.sum(x))).alias("percent_bias"), correlation(x, y).alias("pearson_correlation"),
        correlation(F.col("rank_r"), F.col("rank_c")).alias("spearman_correlation"), F.when(F.var_pop(x) > 0, 1 - ratio(F.avg(e * e), F.var_pop(x))).alias("nash_sutcliffe_efficiency"),
        F.when(F.stddev_pop(x) > 0, ratio(F.stddev_pop(y), F.stddev_pop(x))).alias("variability_ratio"), F.when(F.avg(x) != 0, ratio(F.avg(y), F.avg(x))).alias("mean_ratio"),
    )
    m = m.withColumn("kling_gupta_efficiency", 1 - F.sqrt(F.pow(F.col("pearson_correlation") - 1, 2) + F.pow(F.col("variability_ratio") - 1, 2) + F.pow(F.col("mean_ratio") - 1, 2)))
    return m.unpivot(["station_id"], [c for c in m.columns if c != "station_id"], "metric", "value")


def annual_differences(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Ten signatures of the years that both have: reference, candidate and difference (months: circular distance)."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select("station_id", "year", *[F.col(c).cast("double") for c in ANNUAL_METRICS]).unpivot(["station_id", "year"], ANNUAL_METRICS, "metric", name)

    a, b = F.col("reference_value"), F.col("candidate_value")
    diff = F.when(F.col("metric").isin(MONTH_METRICS), month_distance(a, b)).otherwise(b - a)
    return long(reference, "reference_value").join(long(candidate, "candidate_value"), ["station_id", "year", "metric"]).withColumn("difference", F.when(a.isNotNull() & b.isNotNull(), diff))


def signature_summaries(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Typical yearly signatures of either side, medians, for months the most frequent (least on ties)."""

    def typical(df: DataFrame, side: str) -> DataFrame:
        long = df.select("station_id", *[F.col(c).cast("double") for c in ANNUAL_METRICS]).unpivot(["station_id"], ANNUAL_METRICS, "metric", "x")
        counted = long.withColumn("same", F.count("x").over(Window.partitionBy("station_id", "metric", "x")))
        mode = F.min_by("x", F.when(F.col("x").isNotNull(), F.struct(-F.col("same"), "x")))
        return counted.groupBy("station_id", "metric").agg(F.when(F.col("metric").isin(MONTH_METRICS), mode).otherwise(median(F.col("x"))).alias(f"{side}_typical_value"), F.count("x").alias(f"{side}_year_count"))

    a, b = F.col("reference_typical_value"), F.col("candidate_typical_value")
    diff = F.when(F.col("metric").isin(MONTH_METRICS), month_distance(a, b)).otherwise(b - a)
    return typical(reference, "reference").join(typical(candidate, "candidate"), ["station_id", "metric"]).withColumn("difference", F.when(a.isNotNull() & b.isNotNull(), diff))


def diagnostic_differences(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Whole-record diagnostics of both sides side by side, and the difference of their medians."""
    names = ["median", "p10", "p90", "sample_count"]
    a = reference.select("station_id", "diagnostic", *[F.col(c).alias(f"{c}_reference") for c in names])
    b = candidate.select("station_id", "diagnostic", *[F.col(c).alias(f"{c}_candidate") for c in names])
    return a.join(b, ["station_id", "diagnostic"], "full_outer").withColumn("median_difference", F.col("median_candidate") - F.col("median_reference"))


def inverse_jsd(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """1 - sqrt of the Jensen-Shannon divergence (base 2) of both value distributions, on shared bins.

    Bin width: the Freedman-Diaconis width but half the square-root rule's at least, and Sturges'
    at most. One bin gives 1 if the means are close, else 0; fewer than two values a side give null.
    """
    both = reference.select("station_id", F.lit(0).alias("side"), "value").unionByName(candidate.select("station_id", F.lit(1).alias("side"), "value")).where("value is not null")
    v, side = F.col("value"), F.col("side")
    n, span, iqr = F.count(F.lit(1)), F.max(v) - F.min(v), quantile(v, 0.75) - quantile(v, 0.25)
    s = both.groupBy("station_id").agg(
        n.alias("n"), F.count_if(side == 0).alias("n0"), F.count_if(side == 1).alias("n1"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.avg(F.when(side == 0, v)).alias("mean0"), F.avg(F.when(side == 1, v)).alias("mean1"),
        F.least(F.greatest(2 * iqr / F.pow(n.cast("double"), 1 / 3), span / F.sqrt(n.cast("double")) / 2), span / (F.log2(n.cast("double")) + 1)).alias("width"),
    )
    s = s.withColumn("bins", F.when(F.col("width") > 0, F.ceil(ratio(F.col("high") - F.col("low"), F.col("width")))).otherwise(1).cast("int"))
    edges = F.transform(F.sequence(F.lit(0), F.col("bins")), lambda i: F.when(i == F.col("bins"), F.col("high")).otherwise(F.col("low") + i * ((F.col("high") - F.col("low")) / F.col("bins"))))
    placed = both.join(s.withColumn("edges", edges), "station_id").withColumn("bin", F.least(F.size(F.filter("edges", lambda e: e <= v)), F.col("bins")))
    counts = placed.groupBy("station_id", "bin").agg(F.count_if(side == 0).alias("c0"), F.count_if(side == 1).alias("c1"))
    grid = s.where("bins > 1").select("*", F.explode(F.sequence(F.lit(1), F.col("bins"))).alias("bin")).join(counts, ["station_id", "bin"], "left")

    def share(c: str, total: str) -> Column:
        return (F.coalesce(F.col(c), F.lit(0)) + EPS) / (F.col(total) + F.col("bins") * EPS)

    p, q = share("c0", "n0"), share("c1", "n1")
    mid = 0.5 * (p + q)
    d = grid.groupBy("station_id").agg(F.sum(0.5 * p * F.log2(p / mid) + 0.5 * q * F.log2(q / mid)).alias("divergence"))
    close = F.abs(F.col("mean0") - F.col("mean1")) <= 1e-8 + 1e-5 * F.abs(F.col("mean1"))
    value = F.when((F.col("n0") < 2) | (F.col("n1") < 2), None).when(F.col("bins") < 2, F.when(close, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.sqrt(F.greatest("divergence", F.lit(0.0))))))
    return s.join(d, "station_id", "left").select("station_id", value.alias("value"))


def annual_cosine(reference: DataFrame, candidate: DataFrame, column: str) -> DataFrame:
    """Cosine of a yearly signature over common years; with fewer than two, of both read at 100 points."""
    def ordered(df: DataFrame, name: str) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("year", F.col(column).alias("x")))))
        return df.groupBy("station_id").agg(F.transform(pairs, lambda s: s["x"]).alias(name), median(F.col(column)).alias(f"median_{name}"))

    a, b = ordered(reference, "r"), ordered(candidate, "c")
    common = reference.select("station_id", "year", F.col(column).alias("x")).join(candidate.select("station_id", "year", F.col(column).alias("y")), ["station_id", "year"]).where("x is not null and y is not null")
    direct = common.groupBy("station_id").agg(F.count(F.lit(1)).alias("years"), ratio(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("direct"))
    enough = (F.size("r") >= 2) & (F.size("c") >= 2)
    shaped = F.when(enough, _cosine_or_null(resampled(F.col("r"), 100), resampled(F.col("c"), 100)))
    out = a.join(b, "station_id").join(direct, "station_id", "left")
    return out.select("station_id", F.when(F.col("years") >= 2, F.col("direct")).otherwise(shaped).alias("value"), (F.col("median_c") - F.col("median_r")).alias("median_bias"))


def _cosine_or_null(a: Column, b: Column) -> Column:
    """Cosine; null with a zero array."""
    def zero(x: Column) -> Column:
        return F.forall(x, lambda v: v == 0)

    return F.when(~zero(a) & ~zero(b), cosine(a, b))


def seasonal_cosine(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Cosine of two seasonal profiles over the months that both have, from two on."""
    both = reference.select("station_id", "month", F.col("median").alias("x")).join(candidate.select("station_id", "month", F.col("median").alias("y")), ["station_id", "month"])
    x, y = (F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col(c)) for c in "xy")
    value = F.when(F.count(x) >= 2, ratio(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))))
    return both.groupBy("station_id").agg(value.alias("value"), (median(F.col("y")) - median(F.col("x"))).alias("median_bias"))


def seasonal_timing(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """The larger of the circular distances of the wettest and the driest months of two profiles."""
    def ends(df: DataFrame, p: str) -> DataFrame:
        rows = df.where("median is not null")
        return rows.groupBy("station_id").agg(F.min_by("month", F.struct(-F.col("median"), "month")).alias(f"wet_{p}"), F.min_by("month", F.struct("median", "month")).alias(f"dry_{p}"))

    both = reference.select("station_id").distinct().join(ends(reference, "r"), "station_id", "left").join(ends(candidate, "c"), "station_id", "left")
    distance = F.greatest(month_distance(F.col("wet_r"), F.col("wet_c")), month_distance(F.col("dry_r"), F.col("dry_c")))
    return both.select("station_id", F.when(F.col("wet_r").isNotNull() & F.col("wet_c").isNotNull(), distance).cast("double").alias("value"))


def event_differences(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Absolute differences of the median time to peak and duration of events."""
    def mid(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy("station_id").agg(median(F.col("time_to_peak_days")).alias(f"peak_{p}"), median(F.col("event_duration_days")).alias(f"duration_{p}"))

    return mid(reference, "r").join(mid(candidate, "c"), "station_id", "full_outer").select("station_id", F.abs(F.col("peak_c") - F.col("peak_r")).alias("time_to_peak"), F.abs(F.col("duration_c") - F.col("duration_r")).alias("duration"))


def event_shape(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Cosine of the curves of both representative events, read at 100 points."""
    a, b = reference.select("station_id", F.col("curve").alias("x")), candidate.select("station_id", F.col("curve").alias("y"))
    enough = (F.size("x") >= 2) & (F.size("y") >= 2)
    return a.join(b, "station_id").select("station_id", F.when(enough, _cosine_or_null(resampled(F.col("x"), 100), resampled(F.col("y"), 100))).alias("value"))


def signatures(flow: DataFrame, spikes: DataFrame | None = None, settings: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """The tables of one side that the comparison takes; ``settings``: of its annual signatures and events."""
    c = overlay(LAYER2, settings)
    flow = prepared(flow)
    annual, events = written(layer2.annual_signatures(flow, spikes, **c["annual"]), "annual"), layer2.high_flow_events(flow, c["events"]["trigger_percentile"], c["events"]["boundary_percentile"])
    eligible = events if spikes is None else layer2.representative_eligibility(events, layer2.crosscheck(spikes.select(*KEYS, "ts", "type"), events, c["events"]["spike_crosscheck_minimum_event_duration_days"]))
    return {
        "flow": flow, "annual": annual, "events": events, "representative": layer2.representative_event(eligible),
        "profile": layer2.seasonality_profile(layer2.monthly_profile(flow, c["annual"]["minimum_valid_days_per_year"], c["annual"]["minimum_valid_days_per_month"])), "diagnostics": layer2.diagnostic_summary(annual, events),
    }


def components(reference: Mapping[str, DataFrame], candidate: Mapping[str, DataFrame], settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Eight components of each station: value, tier, points, weight and contribution.

    A station gets a row for every enabled component; one that cannot be assessed has no tier.
    """
    c = overlay(LAYER2["comparison"], settings)
    none = F.lit(None).cast("double")

    def part(df: DataFrame, name: str, value: str = "value", bias: bool = False) -> DataFrame:
        return df.select("station_id", F.lit(name).alias("component"), F.col(value).cast("double").alias("value"), (F.col("median_bias") if bias else none).alias("median_bias"))

    days = event_differences(reference["events"], candidate["events"])
    parts = [
        part(inverse_jsd(reference["flow"], candidate["flow"]), "flow_behaviour"),
        part(annual_cosine(reference["annual"], candidate["annual"], "flashiness_index"), "annual_flashiness_shape", bias=True),
        part(annual_cosine(reference["annual"], candidate["annual"], "baseflow_index"), "annual_baseflow_shape", bias=True),
        part(seasonal_cosine(reference["profile"], candidate["profile"]), "seasonal_profile_shape", bias=True),
        part(seasonal_timing(reference["profile"], candidate["profile"]), "seasonal_timing"),
        part(days, "event_time_to_peak", "time_to_peak"), part(days, "event_duration", "duration"),
        part(event_shape(reference["representative"], candidate["representative"]), "representative_event_shape"),
    ]
    enabled = [n for n, on in c["components"].items() if on]
    some = parts[0]
    for p in parts[1:]:
        some = some.unionByName(p)
    stations = reference["flow"].select("station_id").distinct().join(candidate["flow"].select("station_id").distinct(), "station_id")
    grid = stations.withColumn("component", F.explode(F.array(*[F.lit(n) for n in enabled]) if enabled else F.array().cast("array<string>")))
    rows = grid.join(some, ["station_id", "component"], "left")
    v, name = F.col("value"), F.col("component")
    alike = F.when(v >= c["similarity_tier3_minimum"], "Tier 3").when(v >= c["similarity_tier2_minimum"], "Tier 2").otherwise("Tier 1")
    timing = F.when(v <= c["seasonal_timing_tier3_max_months"], "Tier 3").when(v <= c["seasonal_timing_tier2_max_months"], "Tier 2").otherwise("Tier 1")
    peak = F.when(v <= c["time_to_peak_tier3_max_days"], "Tier 3").when(v < c["time_to_peak_tier1_min_days"], "Tier 2").otherwise("Tier 1")
    length = F.when(v <= c["event_duration_tier3_max_days"], "Tier 3").when(v <= c["event_duration_tier2_max_days"], "Tier 2").otherwise("Tier 1")
    tier = F.when(v.isNotNull(), F.when(name == "seasonal_timing", timing).when(name == "event_time_to_peak", peak).when(name == "event_duration", length).otherwise(alike))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in c["weights"].items() for x in pair]), name)
    points = F.when(tier == "Tier 3", POINTS["Tier 3"]).when(tier == "Tier 2", POINTS["Tier 2"]).when(tier == "Tier 1", POINTS["Tier 1"])
    return rows.select(
        "station_id", "component", "value", "median_bias", tier.isNotNull().alias("assessable"), F.coalesce(tier, F.lit("Not assessable")).alias("tier"), points.alias("tier_points"), weight.alias("weight"), F.coalesce(weight * points, F.lit(0)).alias("contribution")
    )


def composite(parts: DataFrame, settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Score, share of the possible, and class of each station."""
    c = overlay(LAYER2["comparison"], settings)
    on = F.col("assessable")
    s = parts.groupBy("station_id").agg(
        F.sum("contribution").cast("long").alias("layer2_score"), F.coalesce(F.sum(F.when(on, F.col("weight") * max(POINTS.values()))), F.lit(0)).cast("long").alias("maximum_assessable_score"),
        F.count_if(on).alias("assessable_components"), F.count(F.lit(1)).alias("n"), F.concat_ws("; ", F.sort_array(F.collect_list(F.when(~on, F.col("component"))))).alias("unavailable_components"),
    )
    pct = ratio(100.0 * F.col("layer2_score"), F.col("maximum_assessable_score"))
    few = F.col("assessable_components") < F.least(F.lit(c["minimum_assessable_components"]), F.col("n"))
    grade = F.when(few, "Not assessable").when(pct <= c["similar_maximum_percent"], "Similar").when(pct <= c["review_maximum_percent"], "Review").otherwise("Strong review")
    return s.select("station_id", "layer2_score", pct.alias("layer2_score_percent"), "maximum_assessable_score", grade.alias("layer2_class"), "assessable_components", few.alias("assessment_incomplete"), "unavailable_components")


def supplied_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics that came with the data (station_id, provider, metric, value), passed on as one map for each station and provider.

    They are shown beside the comparison and play no part in it. Of a metric given twice the largest
    value stays; a row without a station or a name is left out, a null value is kept.
    """
    once = metrics.where("station_id is not null and metric is not null").groupBy("station_id", "provider", "metric").agg(F.max("value").alias("value"))
    entries = F.array_sort(F.collect_list(F.struct("metric", "value")))
    return once.groupBy("station_id", "provider").agg(F.map_from_entries(entries).alias("metrics"))
