"""Evidence tables: what each check found, a row for each find, in twelve tables of layer 1."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.config import LAYER1, overlay
from gaugewise.functions.numeric import median
from gaugewise.operators import epoch_drift, layer1, step_shift
from gaugewise.operators.composite import spikes_of
from gaugewise.operators.primitives import KEYS, missing_intervals, monthly_statistics, prepared, valid_record

# The evidence tables of layer 1 and the check that each belongs to.
LAYER1_TABLES = {
    "missing_intervals": "missing_values", "long_gaps": "long_gaps", "spike_dip_candidates": "spike_dip", "spike_dip_rejected_coherent_patterns": "spike_dip", "step_shift_boundaries": "step_shift", "step_shift_regimes": "step_shift",
    "epoch_drift_annual_evidence": "epoch_drift", "epoch_drift_five_year_epochs": "epoch_drift", "epoch_drift_overview_slopes": "epoch_drift", "epoch_drift_diagnosis": "epoch_drift", "zero_flow_spells": "zero_flow_regime", "nonzero_plateau_periods": "low_variability",
}


def regimes(flow: DataFrame, settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Periods between the changes above Tier 3: their days with a value and the median of their monthly medians.

    Every series with an assessed record has one regime at least. A month counts for the regime that its first day lies in.
    """
    c = overlay(LAYER1["step_shift"], settings)
    flow = prepared(flow)
    assessed = step_shift.step_shift(flow, c).where("assessed").select(*KEYS)
    rule = step_shift.block_rule(flow, c).join(assessed, KEYS).select(*KEYS, "first_day", "last_day")
    shifts = step_shift.tiered_boundaries(flow, c).where("tier <> 'Tier 3'").select(*KEYS, F.col("boundary_date").alias("start"))
    w = Window.partitionBy(*KEYS).orderBy("start")
    starts = rule.select(*KEYS, F.col("first_day").alias("start")).unionByName(shifts).withColumns({"regime": F.row_number().over(w), "next": F.lead("start").over(w)})
    spans = starts.join(rule.drop("first_day"), KEYS).withColumn("end", F.coalesce(F.date_sub("next", 1), "last_day")).where("start <= end").select(*KEYS, "regime", "start", "end")
    # days and months meet their regime by the year, of which a regime has few
    years = spans.withColumn("y", F.explode(F.sequence(F.year("start"), F.year("end"))))
    days = valid_record(flow).where("value is not null").select(*KEYS, F.col("ts").cast("date").alias("d"))
    inside = (F.col("d") >= F.col("start")) & (F.col("d") <= F.col("end"))
    counted = years.join(days.withColumn("y", F.year("d")), [*KEYS, "y"]).where(inside).groupBy(*KEYS, "regime").agg(F.count(F.lit(1)).alias("valid_day_count"))
    months = monthly_statistics(flow, int(c["minimum_valid_days_per_month"])).where("median is not null").select(*KEYS, F.col("month").alias("d"), "median")
    medians = years.join(months.withColumn("y", F.year("d")), [*KEYS, "y"]).where(inside).groupBy(*KEYS, "regime").agg(median(F.col("median")).alias("median"))
    out = spans.join(counted, [*KEYS, "regime"], "left").join(medians, [*KEYS, "regime"], "left")
    return out.select(*KEYS, "regime", "start", "end", F.coalesce("valid_day_count", F.lit(0).cast("long")).alias("valid_day_count"), "median")


def layer1_evidence(flow: DataFrame, settings: Mapping[str, Any] | None = None, candidates: DataFrame | None = None) -> dict[str, DataFrame]:
    """The twelve tables; those of a check that is not enabled are left out. ``candidates``: spikes and dips found before."""
    c = overlay(LAYER1, settings)
    flow = prepared(flow)

    def args(check: str, *names: str) -> dict[str, Any]:
        return {k: c[check][k] for k in names if k in c[check]}

    spikes = spikes_of(flow, settings) if candidates is None else candidates
    overview = epoch_drift.overview(flow, c["epoch_drift"])
    out = {
        "missing_intervals": missing_intervals(flow).where("position = 'internal'").drop("position"), "long_gaps": layer1.long_gap_intervals(flow, **args("long_gaps", "minimum_reported_gap_days")),
        "spike_dip_candidates": spikes.where("status = 'candidate'"), "spike_dip_rejected_coherent_patterns": spikes.where("status = 'rejected_coherent'"),
        "step_shift_boundaries": step_shift.tiered_boundaries(flow, c["step_shift"]).select(*KEYS, F.col("boundary_date").alias("boundary"), "before_median", "after_median", "absolute_median_change", F.col("low_bound").alias("fdc_q95_percentile_q05_threshold"), F.col("high_bound").alias("fdc_q75_percentile_q25_threshold"), F.col("tier").alias("diagnosis")),
        "step_shift_regimes": regimes(flow, c["step_shift"]), "epoch_drift_annual_evidence": epoch_drift.annual_levels(flow, c["epoch_drift"]), "epoch_drift_five_year_epochs": epoch_drift.epochs(flow, c["epoch_drift"]),
        "epoch_drift_overview_slopes": overview.select(*KEYS, "run", "overview", "first_year", "last_year", (100 * F.expm1("slope")).alias("sen_slope_percent_per_year"), "state"),
        "epoch_drift_diagnosis": overview.select(*KEYS, "run", "overview", F.concat_ws("-", "first_year", "last_year").alias("period"), F.col("state").alias("behaviour")),
        "zero_flow_spells": layer1.zero_flow_spells(flow), "nonzero_plateau_periods": layer1.plateaus(flow, **args("low_variability", "minimum_plateau_days", "decimals")),
    }
    return {n: df for n, df in out.items() if c.get(LAYER1_TABLES[n], {}).get("enabled", True)}
