"""Tiers of the nine intrinsic components, their weighted score and the class of a series."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.config import LAYER1, LAYER2, overlay
from gaugewise.functions.numeric import quantile, ratio
from gaugewise.functions.shared import written
from gaugewise.operators import layer1, layer2
from gaugewise.operators.epoch_drift import epoch_drift
from gaugewise.operators.primitives import KEYS, prepared, valid_record
from gaugewise.operators.step_shift import step_shift

CHECKS = ["missing_values", "long_gaps", "duplicate_timestamps", "timestep_consistency", "negative_discharge", "spike_dip", "low_variability", "step_shift", "epoch_drift"]


def _tier(bad: Column, middle: Column) -> Column:
    return F.when(bad, "Tier 1").when(middle, "Tier 2").otherwise("Tier 3")


def tiers(flow: DataFrame, settings: Mapping[str, Any] | None = None, crosschecked: DataFrame | None = None) -> DataFrame:
    """station, slot, check, raw value and tier (null: not assessable) of each enabled check.

    ``crosschecked``: candidates held against events; those in a plausible event are resolved.
    """
    c = overlay(LAYER1, settings)
    flow = prepared(flow)
    k = c["composite"]
    on = [n for n in CHECKS if c[n].get("enabled", True)]
    args = {n: {a: v for a, v in c[n].items() if a != "enabled"} for n in CHECKS}

    def row(df: DataFrame, check: str, value: Column, tier: Column) -> DataFrame:
        return df.select(*KEYS, F.lit(check).alias("check"), value.cast("double").alias("raw_value"), tier.alias("tier"))

    parts = []
    m, g = k["missing_values"], k["long_gaps"]
    missing = layer1.missing_values(flow)
    share = F.col("internal_missing_percentage")
    missing_tier = F.when(share.isNotNull(), _tier(share > m["tier_1_above_percent"], share >= m["tier_2_minimum_percent"]))
    if "missing_values" in on:
        parts.append(row(missing, "missing_values", share, missing_tier))
    if "long_gaps" in on:
        gaps = layer1.long_gaps(flow, c["long_gaps"]["minimum_reported_gap_days"], g["long_gap_definition_days"])
        both = gaps.join(missing.select(*KEYS, F.col("value").alias("missing"), (missing_tier if "missing_values" in on else F.lit(None).cast("string")).alias("missing_tier")), KEYS)
        long_share = F.coalesce(ratio(F.col("long_gap_rows"), F.col("missing")), F.lit(0.0))
        longest, mt = F.col("value"), F.coalesce("missing_tier", F.lit(""))
        bad = (longest >= g["tier_1_minimum_days"]) | ((mt == "Tier 1") & (long_share >= g["tier_1_missing_share"]))
        middle = (longest >= g["tier_2_minimum_days"]) | ((mt == "Tier 2") & (long_share >= g["tier_2_missing_share"]))
        parts.append(row(both, "long_gaps", longest, F.when(F.col("assessed"), _tier(bad, middle))))
    if "duplicate_timestamps" in on:
        parts.append(row(layer1.duplicate_timestamps(flow), "duplicate_timestamps", F.col("value"), _tier(F.col("flag"), F.lit(False))))
    if "timestep_consistency" in on:
        parts.append(row(layer1.timestep_consistency(flow), "timestep_consistency", F.col("value"), F.when(F.col("assessed"), _tier(F.col("flag"), F.lit(False)))))
    if "negative_discharge" in on:
        n = k["negative_discharge"]
        low = valid_record(flow).groupBy(*KEYS).agg(quantile(F.when(F.col("value").isNotNull(), F.greatest("value", F.lit(0.0))), n["low_flow_reference_quantile"]).alias("low"))
        neg = layer1.negative_discharge(flow, **args["negative_discharge"]).join(low, KEYS)
        some = F.col("value") > 0
        big = some & (F.col("maximum_negative_magnitude") >= F.col("low") * n["tier_1_reference_multiplier"])
        parts.append(row(neg, "negative_discharge", F.col("maximum_negative_magnitude"), _tier(big, some)))
    if "spike_dip" in on:
        if crosschecked is None:
            spikes = layer1.spike_dip(flow, **args["spike_dip"]).select(*KEYS, F.col("value").alias("n"))
        else:
            left = crosschecked.where("crosscheck_status <> 'plausible_event_context'").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
            spikes = valid_record(flow).select(*KEYS).distinct().join(left, KEYS, "left").select(*KEYS, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
        parts.append(row(spikes, "spike_dip", F.col("n"), _tier(F.col("n") >= k["spike_dip"]["tier_1_minimum_unresolved_count"], F.col("n") > 0)))
    if "low_variability" in on:
        d = F.col("longest_plateau_days")
        parts.append(row(layer1.low_variability(flow, **args["low_variability"]), "low_variability", d, _tier(d >= k["low_variability"]["tier_1_minimum_days"], d > 0)))
    if "step_shift" in on:
        parts.append(row(step_shift(flow, args["step_shift"]), "step_shift", F.col("step_shift_score"), F.col("tier")))
    if "epoch_drift" in on:
        parts.append(row(epoch_drift(flow, args["epoch_drift"]), "epoch_drift", F.col("stable_year_fraction"), F.col("tier")))
    # a series that a check has no row for could not be assessed by it
    grid = flow.select(*KEYS).distinct().withColumn("check", F.explode(F.array(*[F.lit(n) for n in on]) if on else F.array().cast("array<string>")))
    if not parts:
        return grid.select(*KEYS, "check", F.lit(None).cast("double").alias("raw_value"), F.lit(None).cast("string").alias("tier"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return grid.join(every, [*KEYS, "check"], "left")


def components(flow: DataFrame, settings: Mapping[str, Any] | None = None, crosschecked: DataFrame | None = None) -> DataFrame:
    """Tiers with points, weights and contributions."""
    k = overlay(LAYER1, settings)["composite"]
    tier = F.col("tier")
    points = F.when(tier == "Tier 1", int(k["tier_points"]["Tier 1"])).when(tier == "Tier 2", int(k["tier_points"]["Tier 2"])).when(tier == "Tier 3", int(k["tier_points"]["Tier 3"]))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in k["weights"].items() for x in pair]), F.col("check"))
    return tiers(flow, settings, crosschecked).select(
        *KEYS, "check", tier.isNotNull().alias("assessable"), "raw_value", F.coalesce(tier, F.lit("Not assessable")).alias("tier"), points.alias("tier_points"), weight.alias("weight"), F.coalesce(weight * points, F.lit(0)).alias("contribution")
    )


def composite(parts: DataFrame, settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Score over the checks that could be assessed, class, scope and coverage of each series."""
    c = overlay(LAYER1, settings)
    k = c["composite"]
    enabled = [n for n in CHECKS if c[n].get("enabled", True)]
    most = max(k["tier_points"].values())
    on = F.col("assessable")
    turn = F.array_position(F.array(*[F.lit(n) for n in CHECKS]), F.col("check"))
    missing = F.array_sort(F.collect_list(F.when(~on, F.struct(turn.alias("i"), "check"))))
    s = parts.groupBy(*KEYS).agg(F.sum("contribution").cast("long").alias("layer1_score"), F.coalesce(F.sum(F.when(on, F.col("weight") * most)), F.lit(0)).cast("long").alias("maximum_assessable_score"), F.count_if(on).alias("assessable_checks"), missing.alias("missing"))
    share = ratio(100.0 * F.col("layer1_score"), F.col("maximum_assessable_score"))
    grades = k["classification"]
    grade = F.when(F.col("assessable_checks") == 0, "Not assessable").when(share >= grades["needs_review_minimum_percent"], "Needs review").when(share >= grades["minor_concerns_minimum_percent"], "Minor concerns").otherwise("No review needed")
    scope = "Full" if len(enabled) == len(CHECKS) else "Focused"
    return s.select(
        *KEYS, "layer1_score", grade.alias("layer1_class"), share.alias("layer1_score_percent"), "maximum_assessable_score", F.lit(scope).alias("assessment_scope"), F.lit(len(enabled)).alias("enabled_check_count"), F.lit(len(CHECKS)).alias("total_composite_check_count"),
        F.lit("; ".join(n for n in CHECKS if n not in enabled)).alias("disabled_checks"), "assessable_checks", (100.0 * F.col("assessable_checks") / len(enabled) if enabled else F.lit(None).cast("double")).alias("evidence_coverage_percent"),
        (F.size("missing") > 0).alias("assessment_incomplete"), F.concat_ws("; ", F.transform("missing", lambda x: x["check"])).alias("unavailable_checks"),
    )


def spikes_of(flow: DataFrame, settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Spike and dip candidates of the layer 1 ``settings``, rejected ones included."""
    return layer1.spike_candidates(flow, **{a: v for a, v in overlay(LAYER1, settings)["spike_dip"].items() if a != "enabled"})


def screened(flow: DataFrame, settings: Mapping[str, Any] | None = None, signature_settings: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """The intrinsic checks, signatures and composite of a flow, in the order they need each other; what several need is written once.

    ``signature_settings``: of annual signatures and events, as in the defaults of layer 2.
    """
    c = overlay(LAYER2, signature_settings)
    flow = prepared(flow)
    found = written(spikes_of(flow, settings), "candidates")
    spikes = found.where("status = 'candidate'")
    events = layer2.high_flow_events(flow, c["events"]["trigger_percentile"], c["events"]["boundary_percentile"])
    checked = written(layer2.crosscheck(spikes.select(*KEYS, "ts", "type", "value", "score"), events, c["events"]["spike_crosscheck_minimum_event_duration_days"]), "crosscheck")
    parts = written(components(flow, settings, checked), "components")
    eligible = layer2.representative_eligibility(events, checked)
    return {
        "candidates": found, "events": eligible, "crosscheck": checked, "components": parts, "composite": composite(parts, settings), "annual": layer2.annual_signatures(flow, spikes, **c["annual"]),
        "monthly": layer2.monthly_profile(flow, c["annual"]["minimum_valid_days_per_year"], c["annual"]["minimum_valid_days_per_month"]), "representative": layer2.representative_event(eligible), "record": layer2.record_summary(flow, spikes),
    }
