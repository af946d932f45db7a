"""Intrinsic checks 1 to 8: each takes a flow and gives one row per series, or one per finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.functions.numeric import half_even, median, quantile, ratio
from gaugewise.operators.primitives import KEYS, P, ROWS, SO_FAR, daily_step, missing_intervals, missingness, out_of_order, per_series, percent, valid_record


def missing_values(flow: DataFrame) -> DataFrame:
    """Null rows inside the valid record and their share; a series without values is not assessed."""
    m = missingness(flow)
    done = F.col("record_rows") > 0
    return m.select(
        *KEYS, F.when(done, F.col("internal_missing")).alias("value"), F.when(done, percent(F.col("internal_missing"), F.col("record_rows"))).alias("internal_missing_percentage"),
        "leading_missing", "trailing_missing", F.when(done, F.col("internal_missing") > 0).alias("flag"), done.alias("assessed"),
    )


def long_gap_intervals(flow: DataFrame, minimum_reported_gap_days: int = 3) -> DataFrame:
    """Internal null runs of more rows than ``minimum_reported_gap_days``."""
    return missing_intervals(flow).where((F.col("position") == "internal") & (F.col("missing_count") > minimum_reported_gap_days))


def long_gaps(flow: DataFrame, minimum_reported_gap_days: int = 3, long_gap_definition_days: int = 5) -> DataFrame:
    """Longest internal null run, reported runs, and null rows in runs beyond the definition of a long one."""
    runs = missing_intervals(flow).where("position = 'internal'")
    n = F.col("missing_count")
    some = runs.groupBy(*KEYS).agg(F.max(n).alias("longest"), F.count_if(n > minimum_reported_gap_days).alias("reported_gaps"), F.sum(F.when(n > long_gap_definition_days, n)).alias("long_gap_rows"))
    base = missingness(flow).select(*KEYS, (F.col("record_rows") > 0).alias("assessed"))
    zero = F.lit(0).cast("long")
    return base.join(some, KEYS, "left").select(
        *KEYS, F.when(F.col("assessed"), F.coalesce("longest", zero)).alias("value"), F.coalesce("reported_gaps", zero).alias("reported_gaps"),
        F.coalesce("long_gap_rows", zero).alias("long_gap_rows"), F.when(F.col("assessed"), F.coalesce("reported_gaps", zero) > 0).alias("flag"), "assessed",
    )


def negative_discharge(flow: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Values below -tolerance and the largest magnitude among them."""
    low = F.when(F.col("value") < -tolerance, F.col("value"))
    return valid_record(flow).groupBy(*KEYS).agg(
        F.count(low).alias("value"), F.coalesce(F.abs(F.min(low)), F.lit(0.0)).alias("maximum_negative_magnitude"), (F.count(low) > 0).alias("flag")
    )


def duplicate_groups(flow: DataFrame) -> DataFrame:
    """Times that occur more than once in the source, their values in source order, and whether they differ (a null is a value)."""
    n, given = F.count(F.lit(1)), F.count("value")
    differ = F.coalesce(F.min("value") < F.max("value"), F.lit(False)) | ((given > 0) & (given < n))
    return (
        flow.groupBy(*KEYS, "ts")
        .agg(n.alias("occurrences"), F.transform(F.array_sort(F.collect_list(F.struct("src_pos", "value"))), lambda s: s["value"]).alias("values"), differ.alias("conflicting"))
        .where("occurrences > 1")
    )


def duplicate_timestamps(flow: DataFrame) -> DataFrame:
    """Distinct repeated times, extra rows and conflicting groups of each series."""
    per = flow.groupBy(*KEYS, "ts").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("kinds"))
    more = F.col("n") > 1
    return per.groupBy(*KEYS).agg(
        F.count_if(more).alias("value"), F.coalesce(F.sum(F.when(more, F.col("n") - 1)), F.lit(0)).alias("extra_duplicate_rows"),
        F.count_if(more & (F.col("kinds") > 1)).alias("conflicting_groups"), (F.count_if(more) > 0).alias("flag"),
    )


def _between_valid(flow: DataFrame) -> DataFrame:
    given = F.when(F.col("value").isNotNull(), F.col("ts"))
    return per_series(flow, lo=F.min(given), hi=F.max(given)).where("ts between lo and hi").drop("lo", "hi")


def irregular_intervals(flow: DataFrame) -> DataFrame:
    """Steps of the distinct sorted times that are not one day."""
    days = _between_valid(flow).select(*KEYS, "ts").distinct().withColumn("previous_ts", F.lag("ts").over(P().orderBy("ts")))
    step = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("previous_ts").cast("timestamp"))) / 86_400_000_000.0
    return days.where("previous_ts is not null").withColumn("interval_days", step).where("interval_days <> 1")


def timestep_consistency(flow: DataFrame) -> DataFrame:
    """Irregular steps, rows earlier than the source row before, and their sum (disorder counts once); fewer than two times are not assessed.

    Rows without a source position have no order to break.
    """
    inside = _between_valid(flow)
    times = inside.groupBy(*KEYS).agg(F.count_distinct("ts").alias("times"))
    odd = irregular_intervals(flow).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("irregular"))
    irregular, disorder = (F.coalesce(c, F.lit(0).cast("long")) for c in ("irregular", "out_of_order_rows"))
    value = irregular + (disorder > 0).cast("long")
    done = F.col("times") >= 2
    return times.join(out_of_order(inside), KEYS, "left").join(odd, KEYS, "left").select(
        *KEYS, F.when(done, value).alias("value"), irregular.alias("irregular_spacing_count"), disorder.alias("out_of_order_rows"), F.when(done, value > 0).alias("flag"), done.alias("assessed")
    )


def zero_flow_spells(flow: DataFrame, decimals: int = 3) -> DataFrame:
    """Runs of values that round to 0 on consecutive days."""
    zero = F.coalesce(half_even(F.col("value"), decimals) == 0, F.lit(False))
    rows = valid_record(flow).withColumn("zero", zero)
    breaks = (F.col("zero") != F.coalesce(F.lag("zero").over(ROWS()), F.lit(False))) | ~daily_step()
    return (
        rows.withColumn("spell", F.sum(breaks.cast("int")).over(SO_FAR())).where("zero").groupBy(*KEYS, "spell")
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("observation_count"))
        .select(*KEYS, "start_ts", "end_ts", "observation_count", (F.datediff("end_ts", "start_ts") + 1).alias("calendar_duration_days"))
    )


def zero_flow_months(flow: DataFrame, decimals: int = 3) -> DataFrame:
    """Share of zero values by calendar month; months without a value have no row."""
    zero = half_even(F.col("value"), decimals) == 0
    return valid_record(flow).where("value is not null").groupBy(*KEYS, F.month("ts").alias("month")).agg(
        F.count_if(zero).alias("zero_count"), F.count(F.lit(1)).alias("valid_count"), ratio(F.count_if(zero), F.count(F.lit(1))).alias("zero_ratio")
    )


def zero_flow_regime(flow: DataFrame, decimals: int = 3) -> DataFrame:
    """Descriptor of zero flow: counts, ratio, spells; never a flag."""
    zero = half_even(F.col("value"), decimals) == 0
    base = valid_record(flow).groupBy(*KEYS).agg(F.count_if(zero).alias("zero_count"), F.count("value").alias("valid_count"))
    spells = zero_flow_spells(flow, decimals).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("spells"), F.max("calendar_duration_days").alias("longest_days"), F.max("observation_count").alias("longest_observations")
    )
    none = F.lit(0).cast("long")
    return base.join(spells, KEYS, "left").select(
        *KEYS, "zero_count", "valid_count", F.coalesce(ratio(F.col("zero_count"), F.col("valid_count")), F.lit(0.0)).alias("zero_ratio"),
        F.coalesce("spells", none).alias("zero_spell_count"), F.coalesce(F.col("longest_days").cast("long"), none).alias("longest_zero_spell_days"),
        F.coalesce("longest_observations", none).alias("longest_zero_spell_observations"),
    )


def plateaus(flow: DataFrame, minimum_plateau_days: int = 15, decimals: int = 3) -> DataFrame:
    """Runs of one rounded non-zero value on consecutive days, with the values beside them."""
    if minimum_plateau_days < 2 or decimals < 0:
        raise ValueError("a plateau takes 2 days or more, and decimals 0 or more")
    rows = valid_record(flow).withColumns({"r": half_even(F.col("value"), decimals), "before": F.lag("value").over(ROWS()), "after": F.lead("value").over(ROWS())})
    goes_on = F.col("r").isNotNull() & (F.col("r") != 0) & (F.col("r") == F.lag("r").over(ROWS())) & daily_step()
    runs = rows.withColumn("run", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(SO_FAR())).where("r is not null and r <> 0").groupBy(*KEYS, "run").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.first("r").alias("plateau_value"), F.count(F.lit(1)).alias("observation_count"),
        F.min(F.struct("pos", "before"))["before"].alias("value_before"), F.max(F.struct("pos", "after"))["after"].alias("value_after"),
    )
    return runs.where(F.col("observation_count") >= minimum_plateau_days).select(
        *KEYS, "start_ts", "end_ts", "plateau_value", "observation_count", (F.datediff("end_ts", "start_ts") + 1).alias("calendar_duration_days"), "value_before", "value_after"
    )


def low_variability(flow: DataFrame, minimum_plateau_days: int = 15, decimals: int = 3) -> DataFrame:
    """Flagged observations, plateaus and the longest of them, for each series with values."""
    some = plateaus(flow, minimum_plateau_days, decimals).groupBy(*KEYS).agg(F.sum("observation_count").alias("n"), F.count(F.lit(1)).alias("p"), F.max("calendar_duration_days").alias("d"))
    none = F.lit(0).cast("long")
    return valid_record(flow).select(*KEYS).distinct().join(some, KEYS, "left").select(
        *KEYS, F.coalesce("n", none).alias("value"), F.coalesce("p", none).alias("plateau_count"), F.coalesce(F.col("d").cast("long"), none).alias("longest_plateau_days"), F.coalesce(F.col("p") > 0, F.lit(False)).alias("flag")
    )


def spike_candidates(
    flow: DataFrame, minimum_recovery: float = 0.8, minimum_score: float = 8.0, absolute_change_reference_quantile: float = 0.99,
    score_reference_quantile: float = 0.995, robust_mad_multiplier: float = 6.0, minimum_outer_change_multiplier: float = 1.0,
) -> DataFrame:
    """Turning points that stand out, with status candidate, rejected_coherent or rejected_context."""
    v, day = F.col("value"), F.expr("interval 1 day")

    def at(k: int, c: str = "value"):
        return F.lag(c, -k).over(ROWS()) if k < 0 else F.lead(c, k).over(ROWS())

    rows = valid_record(flow).withColumns({"m2": at(-2), "m1": at(-1), "p1": at(1), "p2": at(2)})
    rows = rows.withColumns(
        {
            "into": v - F.col("m1"), "out": F.col("p1") - v, "daily": daily_step(),
            "five_days": F.coalesce(
                (F.col("ts") - at(-1, "ts") == day) & (at(1, "ts") - F.col("ts") == day) & (at(2, "ts") - at(1, "ts") == day) & (at(-1, "ts") - at(-2, "ts") == day), F.lit(False)
            ) & F.col("m2").isNotNull() & F.col("m1").isNotNull() & v.isNotNull() & F.col("p1").isNotNull() & F.col("p2").isNotNull(),
        }
    )
    size = F.abs("into") + F.abs("out")
    rows = rows.withColumns(
        {
            "turning": F.coalesce(F.col("into") * F.col("out") < 0, F.lit(False)), "jump": F.when(F.col("into").isNotNull() & F.col("out").isNotNull(), F.least(F.abs("into"), F.abs("out"))),
            "recovery": 1 - ratio(F.abs(F.col("p1") - F.col("m1")), size), "change": F.when(F.col("daily"), F.abs("into")), "month": F.month("ts"),
        }
    )
    # references by calendar month; one that is not positive gives way to the record's least positive change
    least = rows.groupBy(*KEYS).agg(F.min(F.when(F.col("change") > 0, F.col("change"))).alias("resolution"))
    monthly = rows.groupBy(*KEYS, "month").agg(median(F.col("change")).alias("normal"), quantile(F.col("change"), absolute_change_reference_quantile).alias("large")).join(least, KEYS)
    monthly = monthly.select(*KEYS, "month", *[F.when(F.col(c) > 0, F.col(c)).otherwise(F.col("resolution")).alias(c) for c in ("normal", "large")])
    scored = rows.join(monthly, [*KEYS, "month"]).withColumn("score", ratio(F.col("jump"), F.col("normal")))
    turning = scored.where("turning and score is not null")
    centre = turning.groupBy(*KEYS).agg(median(F.col("score")).alias("centre"), quantile(F.col("score"), score_reference_quantile).alias("high"))
    spread = turning.join(centre, KEYS).groupBy(*KEYS).agg(F.first("centre").alias("centre"), F.first("high").alias("high"), median(F.abs(F.col("score") - F.col("centre"))).alias("mad"))
    cutoff = spread.select(*KEYS, F.greatest(F.lit(minimum_score), F.col("high"), F.col("centre") + robust_mad_multiplier * 1.4826 * F.col("mad")).alias("cutoff"))
    found = scored.join(cutoff, KEYS).where(F.col("turning") & (F.col("recovery") >= minimum_recovery) & (F.col("jump") >= F.col("large")) & (F.col("score") >= F.col("cutoff")))
    m2, m1, p1, p2 = (F.col(c) for c in ("m2", "m1", "p1", "p2"))
    outer = F.col("normal") * minimum_outer_change_multiplier
    coherent = (F.abs(m1 - m2) >= outer) & (F.abs(p2 - p1) >= outer) & (((m2 < m1) & (m1 < v) & (v > p1) & (p1 > p2)) | ((m2 > m1) & (m1 > v) & (v < p1) & (p1 < p2)))
    return found.select(
        *KEYS, "ts", "value", F.col("m1").alias("previous_value"), F.col("p1").alias("next_value"), F.when(F.col("into") > 0, "spike").otherwise("dip").alias("type"),
        "jump", "recovery", "score", "cutoff",
        F.when(~F.col("five_days"), "rejected_context").when(F.coalesce(coherent, F.lit(False)), "rejected_coherent").otherwise("candidate").alias("status"),
    )


def spike_dip(flow: DataFrame, **settings) -> DataFrame:
    """Candidates and rejected patterns of each series with values."""
    found = spike_candidates(flow, **settings).groupBy(*KEYS).agg(
        F.count_if(F.col("status") == "candidate").alias("value"), F.count_if(F.col("status") == "rejected_coherent").alias("coherent"), F.count_if(F.col("status") == "rejected_context").alias("context")
    )
    none = F.lit(0).cast("long")
    out = valid_record(flow).select(*KEYS).distinct().join(found, KEYS, "left")
    return out.select(*KEYS, F.coalesce("value", none).alias("value"), F.coalesce("coherent", none).alias("rejected_coherent"), F.coalesce("context", none).alias("rejected_context"), (F.coalesce("value", none) > 0).alias("flag"))


