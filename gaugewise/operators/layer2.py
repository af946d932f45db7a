"""Hydrological signatures: annual and monthly tables, high-flow events, the representative event.

Input flows as in ``primitives``; of rows with one time the first in source order counts. A record
without values has no row anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.functions.numeric import correlation, days_between, median, quantile, ratio
from gaugewise.functions.shared import once
from gaugewise.operators.primitives import KEYS, prepared

YEAR = [*KEYS, "year"]
EVENT_METRICS = ["peak_flow", "event_duration_days", "time_to_peak_days", "rising_slope", "recession_slope"]


@once
def yearly(flow: DataFrame) -> DataFrame:
    """First row of each time, with its year, the value before within the year, and whether that is one day back."""
    first = Window.partitionBy(*KEYS, "ts").orderBy(F.col("src_pos").asc_nulls_last())
    rows = flow.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").withColumn("year", F.year("ts"))
    turn = Window.partitionBy(*YEAR).orderBy("ts")
    return rows.withColumns(
        {"before": F.lag("value").over(turn), "daily": F.coalesce(F.col("ts") - F.lag("ts").over(turn) == F.expr("interval 1 day"), F.lit(False))}
    )


@once
def monthly_profile(flow: DataFrame, minimum_valid_days_per_year: int = 30, minimum_valid_days_per_month: int = 10) -> DataFrame:
    """Mean and median of each month with enough values, in years with enough values."""
    months = yearly(flow).groupBy(*YEAR, F.month("ts").alias("month")).agg(F.count("value").alias("valid_days"), F.avg("value").alias("monthly_mean"), median(F.col("value")).alias("monthly_median"))
    enough = months.withColumn("in_year", F.sum("valid_days").over(Window.partitionBy(*YEAR)))
    return enough.where((F.col("in_year") >= minimum_valid_days_per_year) & (F.col("valid_days") >= minimum_valid_days_per_month)).drop("in_year")


def flashiness(flow: DataFrame) -> DataFrame:
    """Richards-Baker: sum of daily changes within the year over the sum of its values."""
    return yearly(flow).groupBy(*YEAR).agg(_flashiness())


def _flashiness() -> Column:
    change = F.when(F.col("daily"), F.abs(F.col("value") - F.col("before")))
    total = F.sum("value")
    return F.when((total > 0) & (F.count(change) > 0), ratio(F.sum(change), total)).alias("flashiness_index")


def lag1_autocorrelation(flow: DataFrame) -> DataFrame:
    """Pearson of values and those of the day before within the year, from 3 pairs on."""
    return yearly(flow).groupBy(*YEAR).agg(_lag1())


def _lag1() -> Column:
    x, y = F.when(F.col("daily"), F.col("value")), F.when(F.col("daily"), F.col("before"))
    pairs = F.count_if(x.isNotNull() & y.isNotNull())
    return F.when(pairs >= 3, correlation(x, y)).alias("lag1_autocorrelation")


def baseflow(flow: DataFrame, alpha: float = 0.925, passes: int = 3, minimum_segment_days: int = 3) -> DataFrame:
    """Lyne-Hollick baseflow index of each year.

    The clamped recursion q = max(alpha q' + d, 0) equals alpha^i (S - running minimum of S) with
    S the running sum of d alpha^-i, so each pass is two windows over a segment of at most a year.
    """
    if not 0 < alpha < 1 or alpha**-366 > 1e250:
        raise ValueError("alpha must lie between 0.21 and 1")
    turn = Window.partitionBy(*YEAR).orderBy("ts")
    rows = yearly(flow).withColumn("starts", (F.col("value").isNotNull() & ~(F.col("daily") & F.col("before").isNotNull())).cast("int"))
    rows = rows.withColumn("segment", F.sum("starts").over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("value is not null")
    whole = Window.partitionBy(*YEAR, "segment")
    rows = rows.withColumns({"days": F.count(F.lit(1)).over(whole), "lowest": F.min("value").over(whole)}).where((F.col("days") >= minimum_segment_days) & (F.col("lowest") >= 0))
    rows = rows.withColumn("x", F.col("value"))
    for i in range(passes):
        order = whole.orderBy(F.col("ts").asc() if i % 2 == 0 else F.col("ts").desc())
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("i", (F.row_number().over(order) - 1).cast("double"))
        rows = rows.withColumn("d", (1 + alpha) / 2 * (F.col("x") - F.lag("x").over(order)) * F.pow(F.lit(alpha), -F.col("i")))
        rows = rows.withColumn("s", F.sum(F.coalesce("d", F.lit(0.0))).over(so_far))
        quick = F.pow(F.lit(alpha), F.col("i")) * (F.col("s") - F.min("s").over(so_far))
        rows = rows.withColumn("x", F.greatest(F.lit(0.0), F.least(F.col("x"), F.col("x") - quick)))
    return rows.groupBy(*YEAR).agg(F.when(F.sum("value") > 0, ratio(F.sum("x"), F.sum("value"))).alias("baseflow_index"))


def seasonality(monthly: DataFrame) -> DataFrame:
    """Walsh-Lawler index of years with all 12 months, on monthly means."""
    m = monthly.withColumns({"total": F.sum("monthly_mean").over(Window.partitionBy(*YEAR)), "n": F.count(F.lit(1)).over(Window.partitionBy(*YEAR))}).where("n = 12")
    return m.groupBy(*YEAR).agg(F.when(F.max("total") > 0, ratio(F.sum(F.abs(F.col("monthly_mean") - F.col("total") / 12)), F.max("total"))).alias("seasonality_index"))


def extreme_months(monthly: DataFrame) -> DataFrame:
    """Months of largest and least median in years with all 12 months, the first on ties."""
    return monthly.groupBy(*YEAR).agg(
        F.count(F.lit(1)).alias("usable_months"), F.min_by("month", F.struct(-F.col("monthly_median"), "month")).alias("w"), F.min_by("month", F.struct("monthly_median", "month")).alias("d")
    ).select(*YEAR, "usable_months", F.when(F.col("usable_months") == 12, F.col("w")).alias("wettest_month"), F.when(F.col("usable_months") == 12, F.col("d")).alias("driest_month"))


def annual_signatures(
    flow: DataFrame, spikes: DataFrame | None = None, minimum_valid_days_per_year: int = 30, minimum_valid_days_per_month: int = 10,
    baseflow_alpha: float = 0.925, baseflow_passes: int = 3, minimum_baseflow_segment_days: int = 3,
) -> DataFrame:
    """One row per year with enough values. ``spikes`` (keys, ts): left out of the screened extremes."""
    flow = prepared(flow)
    rows = yearly(flow)
    if spikes is None:
        rows = rows.withColumn("spike", F.lit(False))
    else:
        rows = rows.join(spikes.select(*KEYS, "ts").distinct().withColumn("spike", F.lit(True)), [*KEYS, "ts"], "left").withColumn("spike", F.coalesce("spike", F.lit(False)))
    v = F.col("value")
    kept = F.when(~F.col("spike"), v)
    base = rows.groupBy(*YEAR).agg(
        F.avg(v).alias("mean_flow"), median(v).alias("median_flow"), F.min(kept).alias("minimum_flow"), F.max(kept).alias("maximum_flow"), F.min(v).alias("raw_minimum_flow"), F.max(v).alias("raw_maximum_flow"),
        F.count_if(v.isNotNull() & F.col("spike")).alias("extrema_excluded_candidate_count"), F.count(v).alias("valid_days"),
        _flashiness(), _lag1(),
    ).where(F.col("valid_days") >= minimum_valid_days_per_year)
    monthly = monthly_profile(flow, minimum_valid_days_per_year, minimum_valid_days_per_month)
    out = base
    for part in (baseflow(flow, baseflow_alpha, baseflow_passes, minimum_baseflow_segment_days), seasonality(monthly), extreme_months(monthly)):
        out = out.join(part, YEAR, "left")
    return out.withColumn("usable_months", F.coalesce("usable_months", F.lit(0).cast("long")))


def seasonality_profile(monthly: DataFrame) -> DataFrame:
    """Months 1 to 12 of each series with the median of the yearly medians and the number of years (null if none)."""
    have = monthly.groupBy(*KEYS, "month").agg(median(F.col("monthly_median")).alias("median"), F.count("monthly_median").alias("year_count"))
    spine = monthly.select(*KEYS).distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return spine.join(have, [*KEYS, "month"], "left")


def flow_references(flow: DataFrame, trigger_percentile: float = 0.95, boundary_percentile: float = 0.9) -> DataFrame:
    """Thresholds of high flow from all values, repeated times included; fewer than 3 values give none."""
    v = F.col("value")
    return flow.groupBy(*KEYS).agg(quantile(v, trigger_percentile).alias("trigger_threshold"), quantile(v, boundary_percentile).alias("boundary_threshold"), F.count(v).alias("n")).where("n >= 3").drop("n")


@once
def high_flow_events(flow: DataFrame, trigger_percentile: float = 0.95, boundary_percentile: float = 0.9) -> DataFrame:
    """Runs of consecutive days at or above the boundary that reach the trigger; event_id from 1 in time order."""
    if boundary_percentile > trigger_percentile:
        raise ValueError("the boundary cannot exceed the trigger")
    order = Window.partitionBy(*KEYS).orderBy("ts", F.col("src_pos").asc_nulls_last())
    above = F.coalesce(F.col("value") >= F.col("boundary_threshold"), F.lit(False))
    rows = flow.join(flow_references(flow, trigger_percentile, boundary_percentile), KEYS).withColumns({"place": F.row_number().over(order), "above": above})
    step = F.coalesce(F.col("ts") - F.lag("ts").over(order) == F.expr("interval 1 day"), F.lit(False))
    starts = F.col("above") & ~(F.coalesce(F.lag("above").over(order), F.lit(False)) & step)
    rows = rows.withColumn("run", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("above")
    runs = rows.groupBy(*KEYS, "run").agg(
        F.min("ts").alias("event_start"), F.min_by("ts", F.struct(-F.col("value"), "ts")).alias("peak_date"), F.max("ts").alias("event_end"),
        F.first("trigger_threshold").alias("trigger_threshold"), F.first("boundary_threshold").alias("boundary_threshold"),
        F.min_by("value", "place").alias("start_flow"), F.max("value").alias("peak_flow"), F.max_by("value", "place").alias("end_flow"),
        F.sort_array(F.collect_list(F.struct("place", "value"))).alias("curve"),
    ).where("peak_flow >= trigger_threshold")
    rise, fall = days_between(F.col("peak_date"), F.col("event_start")), days_between(F.col("event_end"), F.col("peak_date"))
    return runs.select(
        *KEYS, F.row_number().over(Window.partitionBy(*KEYS).orderBy("event_start")).alias("event_id"), "event_start", "peak_date", "event_end", "trigger_threshold", "boundary_threshold", "start_flow", "peak_flow", "end_flow",
        rise.alias("time_to_peak_days"), fall.alias("recession_days"), (days_between(F.col("event_end"), F.col("event_start")) + 1).alias("event_duration_days"),
        F.when(rise > 0, ratio(F.col("peak_flow") - F.col("start_flow"), rise)).alias("rising_slope"), F.when(fall > 0, ratio(F.col("end_flow") - F.col("peak_flow"), fall)).alias("recession_slope"),
        F.transform("curve", lambda c: c["value"]).alias("curve"),
    )


def crosscheck(candidates: DataFrame, events: DataFrame, minimum_event_duration_days: float = 3.0) -> DataFrame:
    """Spike and dip candidates (keys, ts, type, ...) against the event each lies in, the earliest if several."""
    e = events.select(*[F.col(k).alias(f"e_{k}") for k in KEYS], F.col("event_id").alias("matched_event_id"), "event_start", "event_end", "peak_date", F.col("event_duration_days").alias("matched_event_duration_days"))
    inside = (F.col("station_id") == F.col("e_station_id")) & (F.col("series_slot") == F.col("e_series_slot")) & F.col("ts").between(F.col("event_start"), F.col("event_end"))
    joined = candidates.join(e, inside, "left").withColumn("turn", F.row_number().over(Window.partitionBy(*KEYS, "ts", "type").orderBy("matched_event_id"))).where("turn = 1")
    matched = F.col("matched_event_id").isNotNull()
    peak = (F.col("type") == "spike") & matched & (F.col("ts") == F.col("peak_date"))
    status = (
        F.when((F.col("type") == "dip") | ~matched, "retained_for_review").when(peak, "spike_peak_overlap_review")
        .when(F.col("matched_event_duration_days") < minimum_event_duration_days, "retained_for_review").otherwise("plausible_event_context")
    )
    return joined.select(*candidates.columns, "matched_event_id", "matched_event_duration_days", F.coalesce(peak, F.lit(False)).alias("coincides_with_event_peak"), status.alias("crosscheck_status"))


def representative_eligibility(events: DataFrame, checked: DataFrame) -> DataFrame:
    """``events`` with representative_eligible: false where a spike candidate is the peak."""
    hit = checked.where("coincides_with_event_peak").select(*KEYS, F.col("matched_event_id").alias("event_id")).distinct().withColumn("hit", F.lit(True))
    return events.join(hit, [*KEYS, "event_id"], "left").withColumn("representative_eligible", F.col("hit").isNull()).drop("hit")


def representative_event(events: DataFrame) -> DataFrame:
    """The eligible event of each series nearest to the robust centre of five metrics, the first on ties."""
    if "representative_eligible" in events.columns:
        events = events.where("representative_eligible")
    w = Window.partitionBy(*KEYS)
    rows = events.withColumns({f"c_{m}": median(F.col(m)).over(w) for m in EVENT_METRICS})
    rows = rows.withColumns({f"a_{m}": median(F.abs(F.col(m) - F.col(f"c_{m}"))).over(w) for m in EVENT_METRICS} | {f"s_{m}": F.stddev_pop(m).over(w) for m in EVENT_METRICS})

    def part(m: str) -> Column:
        a, s = F.col(f"a_{m}"), F.col(f"s_{m}")
        scale = F.when(a > 0, a).when(s > 0, s).otherwise(1.0)
        return F.pow((F.col(m) - F.col(f"c_{m}")) / scale, 2)

    total = sum((F.coalesce(part(m), F.lit(0.0)) for m in EVENT_METRICS[1:]), F.coalesce(part(EVENT_METRICS[0]), F.lit(0.0)))
    given = sum((F.col(m).isNotNull().cast("int") for m in EVENT_METRICS[1:]), F.col(EVENT_METRICS[0]).isNotNull().cast("int"))
    rows = rows.withColumn("distance", total / F.greatest(given, F.lit(1)))
    return rows.withColumn("turn", F.row_number().over(w.orderBy("distance", "event_id"))).where("turn = 1").select(*events.columns, "distance")


def diagnostic_summary(annual: DataFrame, events: DataFrame) -> DataFrame:
    """Median, 10 % and 90 % quantiles and count of nine diagnostics of each series."""
    yearly_names, event_names = ["flashiness_index", "baseflow_index", "seasonality_index", "lag1_autocorrelation"], ["time_to_peak_days", "rising_slope", "recession_slope", "event_duration_days", "peak_flow"]

    def long(df: DataFrame, names: list[str]) -> DataFrame:
        return df.select(*KEYS, *[F.col(n).cast("double") for n in names]).unpivot(KEYS, names, "diagnostic", "x")

    series = annual.select(*KEYS).unionByName(events.select(*KEYS)).distinct().withColumn("diagnostic", F.explode(F.array(*[F.lit(n) for n in yearly_names + event_names])))
    x = F.col("x")
    some = long(annual, yearly_names).unionByName(long(events, event_names)).groupBy(*KEYS, "diagnostic").agg(median(x).alias("median"), quantile(x, 0.1).alias("p10"), quantile(x, 0.9).alias("p90"), F.count(x).alias("sample_count"))
    return series.join(some, [*KEYS, "diagnostic"], "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0).cast("long")))


def record_summary(flow: DataFrame, spikes: DataFrame | None = None) -> DataFrame:
    """Whole-record references: quantiles of all values, mean, median and extremes without the spikes."""
    rows = yearly(flow)
    if spikes is None:
        rows = rows.withColumn("spike", F.lit(False))
    else:
        rows = rows.join(spikes.select(*KEYS, "ts").distinct().withColumn("spike", F.lit(True)), [*KEYS, "ts"], "left").withColumn("spike", F.coalesce("spike", F.lit(False)))
    v = F.col("value")
    kept = F.when(~F.col("spike"), v)
    return rows.groupBy(*KEYS).agg(
        F.count(v).alias("valid_count"), F.count_if(v.isNull()).alias("raw_missing_count"), quantile(v, 0.05).alias("q05_low_flow"), quantile(v, 0.95).alias("q95_high_flow"), F.avg(kept).alias("mean_flow"),
        median(kept).alias("median_flow"), F.min(kept).alias("minimum_flow"), F.max(kept).alias("maximum_flow"), F.count_if(v.isNotNull() & F.col("spike")).alias("extrema_excluded_candidate_count"),
    ).where("valid_count > 0")
