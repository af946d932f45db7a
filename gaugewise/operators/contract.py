"""What a user reads first: one wide row for each series with its metrics and the thresholds behind them, and all evidence in one table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.config import LAYER1, LAYER2, LAYER3, overlay
from gaugewise.functions.numeric import median
from gaugewise.operators import context, layer1, layer2
from gaugewise.operators.composite import CHECKS
from gaugewise.operators.epoch_drift import epoch_drift
from gaugewise.operators.primitives import KEYS, availability, prepared
from gaugewise.operators.step_shift import step_shift, tiered_boundaries

# What a class means where only some of the checks were selected.
FOCUSED = {
    "Needs review": "Review recommended within the selected checks", "Minor concerns": "Minor concerns within the selected checks",
    "No review needed": "No concerns detected within the selected checks", "Not assessable": "The selected checks could not be assessed",
}


def _beside(base: DataFrame, parts: list[DataFrame], on: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "left"), parts, base)


def scope_conclusion(scope: Column, grade: Column) -> Column:
    """The class in words, which say whether all checks were selected."""
    words = F.element_at(F.create_map(*[F.lit(x) for pair in FOCUSED.items() for x in pair]), grade)
    return F.when(scope == "Full", F.concat(F.lit("Overall Layer 1 assessment: "), grade, F.lit("."))).otherwise(F.concat(F.lit("Focused Layer 1 assessment: "), words, F.lit(".")))


def layer1_summary(flow: DataFrame, found: Mapping[str, DataFrame], settings: Mapping[str, Any] | None = None) -> DataFrame:
    """37 metrics and 18 thresholds (``threshold_*``) of each series.

    ``found``: candidates, components and composite of ``composite.screened`` with the same settings.
    Metrics of a disabled check are null and its counts 0; a series without values has them as its
    checks give them, null where they were not assessed.
    """
    c = overlay(LAYER1, settings)
    k = c["composite"]
    flow = prepared(flow)
    zero = F.lit(0).cast("long")
    args = {n: {a: v for a, v in c[n].items() if a != "enabled"} for n in c if n != "composite"}

    def of(check: str, make: Callable[[], DataFrame], **columns: tuple[Column, str]) -> DataFrame:
        """The named columns of an enabled check's table, nulls of a disabled one, which is not made."""
        if not c[check].get("enabled", True):
            return series.select(*KEYS, *[F.lit(None).cast(t).alias(n) for n, (_, t) in columns.items()])
        return make().select(*KEYS, *[x.cast(t).alias(n) for n, (x, t) in columns.items()])

    series = flow.select(*KEYS).distinct()
    def bounds() -> DataFrame:
        return tiered_boundaries(flow, args["step_shift"]).groupBy(*KEYS).agg(F.min_by("low_bound", "boundary").alias("q95"), F.min_by("high_bound", "boundary").alias("q75"))

    turning = found["candidates"].groupBy(*KEYS).agg(
        F.count_if((F.col("status") == "candidate") & (F.col("type") == "spike")).alias("spikes"), F.count_if((F.col("status") == "candidate") & (F.col("type") == "dip")).alias("dips"), F.max("cutoff").alias("cutoff")
    )
    turn = F.array_position(F.array(*[F.lit(n) for n in CHECKS]), F.col("check"))
    concerns = found["components"].where("contribution > 0").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(turn.alias("i"), "check"))).alias("concerns"))
    grades = found["composite"].select(
        *KEYS, "layer1_score", "layer1_score_percent", F.col("maximum_assessable_score").alias("layer1_maximum_assessable_score"), F.col("assessment_scope").alias("layer1_assessment_scope"),
        scope_conclusion(F.col("assessment_scope"), F.col("layer1_class")).alias("layer1_scope_conclusion"), F.col("enabled_check_count").alias("layer1_enabled_check_count"), F.col("assessable_checks").alias("layer1_assessable_check_count"),
        F.col("total_composite_check_count").alias("layer1_total_composite_check_count"), F.col("evidence_coverage_percent").alias("layer1_evidence_coverage_percent"),
        F.lit("; ".join(n for n in CHECKS if c[n].get("enabled", True))).alias("layer1_enabled_checks"), F.col("disabled_checks").alias("layer1_disabled_checks"), "layer1_class",
    )
    col, long, number, text = F.col, "long", "double", "string"
    gaps = (c["long_gaps"]["minimum_reported_gap_days"], k["long_gaps"]["long_gap_definition_days"])
    parts = [
        of("missing_values", lambda: layer1.missing_values(flow), missing_day_count=(col("value"), long), missing_percentage=(col("internal_missing_percentage"), number)),
        of("long_gaps", lambda: layer1.long_gaps(flow, *gaps), long_gap_count=(col("reported_gaps"), long), longest_gap_days=(col("value"), long)),
        of("duplicate_timestamps", lambda: layer1.duplicate_timestamps(flow), duplicate_timestamp_count=(col("value"), long), duplicate_extra_row_count=(col("extra_duplicate_rows"), long)),
        of("timestep_consistency", lambda: layer1.timestep_consistency(flow), irregular_timestep_count=(col("irregular_spacing_count"), long), timestamps_out_of_order=(col("out_of_order_rows") > 0, "boolean")),
        of("negative_discharge", lambda: layer1.negative_discharge(flow, **args["negative_discharge"]), negative_discharge_count=(col("value"), long), most_negative_discharge_magnitude=(col("maximum_negative_magnitude"), number)),
        of("zero_flow_regime", lambda: layer1.zero_flow_regime(flow, **args["zero_flow_regime"]), zero_flow_percentage=(100 * col("zero_ratio"), number), zero_flow_spell_count=(col("zero_spell_count"), long), longest_zero_flow_spell_days=(col("longest_zero_spell_days"), long)),
        of("low_variability", lambda: layer1.low_variability(flow, **args["low_variability"]), nonzero_plateau_count=(col("plateau_count"), long), longest_nonzero_plateau_days=(col("longest_plateau_days"), long)),
        of("spike_dip", lambda: turning, spike_count=(col("spikes"), long), dip_count=(col("dips"), long), unresolved_spike_dip_count=(col("spikes") + col("dips"), long), threshold_spike_robust_cutoff_used=(col("cutoff"), number)),
        of("step_shift", lambda: step_shift(flow, args["step_shift"]), step_shift_candidate_count=(col("value"), long), step_shift_score=(col("step_shift_score"), number), step_shift_tier=(col("tier"), text)),
        of("step_shift", bounds, threshold_step_shift_fdc_q95_used=(col("q95"), number), threshold_step_shift_fdc_q75_used=(col("q75"), number)),
        of("epoch_drift", lambda: epoch_drift(flow, args["epoch_drift"]), epoch_regime=(col("dominant_state"), text), epoch_stable_fraction=(col("stable_year_fraction"), number), epoch_tier=(col("tier"), text)),
        grades, concerns,
    ]
    out = _beside(series, parts, KEYS)
    counts = ["missing_day_count", "long_gap_count", "spike_count", "dip_count", "unresolved_spike_dip_count"]
    said = F.concat_ws("; ", F.transform("concerns", lambda x: x["check"]))
    fixed = {
        "missing_tier2_threshold_percent": k["missing_values"]["tier_2_minimum_percent"], "missing_tier1_threshold_percent": k["missing_values"]["tier_1_above_percent"],
        "long_gap_definition_days": k["long_gaps"]["long_gap_definition_days"], "long_gap_tier2_days": k["long_gaps"]["tier_2_minimum_days"], "long_gap_tier1_days": k["long_gaps"]["tier_1_minimum_days"],
        "negative_discharge_tolerance": c["negative_discharge"]["tolerance"], "plateau_detection_days": c["low_variability"]["minimum_plateau_days"], "plateau_tier1_days": k["low_variability"]["tier_1_minimum_days"],
        "spike_minimum_recovery": c["spike_dip"]["minimum_recovery"], "spike_minimum_score": c["spike_dip"]["minimum_score"], "epoch_block_years": c["epoch_drift"]["epoch_years"],
        "epoch_tier2_stable_fraction": c["epoch_drift"]["tier_2_minimum_stable_fraction"], "epoch_tier3_stable_fraction": c["epoch_drift"]["tier_3_minimum_stable_fraction"],
        "layer1_minor_concerns_percent": k["classification"]["minor_concerns_minimum_percent"], "layer1_needs_review_percent": k["classification"]["needs_review_minimum_percent"],
    }
    out = out.withColumns({n: F.coalesce(n, zero) for n in counts} | {"layer1_primary_concerns": F.when(F.size("concerns") > 0, said).otherwise("None")})
    return out.withColumns({f"threshold_{n}": F.lit(v) for n, v in fixed.items()}).drop("concerns")


def layer2_summary(flow: DataFrame, found: Mapping[str, DataFrame], settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Signature metrics and thresholds of each series with values; ``found``: of ``composite.screened``."""
    c = overlay(LAYER2, settings)
    flow = prepared(flow)
    # repeated times count here, while the quantiles of the record take one row of each
    spikes = found["candidates"].where("status = 'candidate'").select(*KEYS, "ts").distinct().withColumn("spike", F.lit(True))
    v = F.col("value")
    kept = F.when(F.col("spike").isNull(), v)
    given = flow.join(spikes, [*KEYS, "ts"], "left").groupBy(*KEYS).agg(
        F.count(v).alias("valid_observation_count"), F.avg(kept).alias("mean_discharge"), median(kept).alias("median_discharge"), F.min(kept).alias("minimum_discharge"), F.max(kept).alias("maximum_discharge")
    ).where("valid_observation_count > 0")
    record = given.join(found["record"].select(*KEYS, F.col("q05_low_flow").alias("low_flow_q05"), F.col("q95_high_flow").alias("high_flow_q95"), F.col("extrema_excluded_candidate_count").alias("excluded_flagged_extrema_count")), KEYS, "left")
    names = {"median_annual_flashiness": "flashiness_index", "median_annual_baseflow_index": "baseflow_index", "median_annual_seasonality_index": "seasonality_index", "median_annual_lag1_autocorrelation": "lag1_autocorrelation"}
    typical = layer2.diagnostic_summary(found["annual"], found["events"]).groupBy(*KEYS).agg(*[F.max(F.when(F.col("diagnostic") == d, F.col("median"))).alias(n) for n, d in names.items()])
    seasonal = layer2.seasonality_profile(found["monthly"]).where("median is not null").groupBy(*KEYS).agg(
        (-F.max(F.struct(F.col("median").alias("m"), (-F.col("month")).alias("at")))["at"]).alias("typical_wettest_month"), F.min(F.struct(F.col("median").alias("m"), F.col("month").alias("at")))["at"].alias("typical_driest_month")
    )
    shown = ["peak_flow", "time_to_peak_days", "recession_days", "rising_slope", "recession_slope"]
    event = found["representative"].select(
        *KEYS, F.col("event_start").alias("representative_event_start"), F.col("peak_date").alias("representative_event_peak_date"), F.col("event_end").alias("representative_event_end"),
        F.col("event_duration_days").alias("representative_event_duration_days"), *[F.col(n).alias(f"representative_event_{n}") for n in shown],
    )
    years = found["annual"].groupBy(*KEYS).agg(F.count(F.lit(1)).alias("annual_signature_year_count"))
    events = found["events"].groupBy(*KEYS).agg(F.count(F.lit(1)).alias("high_flow_event_count"), F.count_if(~F.col("representative_eligible")).alias("spike_peak_overlap_count"))
    bounds = layer2.flow_references(flow, c["events"]["trigger_percentile"], c["events"]["boundary_percentile"])
    bounds = bounds.select(*KEYS, F.col("trigger_threshold").alias("threshold_high_flow_trigger_value"), F.col("boundary_threshold").alias("threshold_high_flow_boundary_value"))
    out = _beside(record, [years, events, typical, seasonal, event, bounds], KEYS)
    out = out.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("annual_signature_year_count", "high_flow_event_count", "spike_peak_overlap_count")})
    return out.withColumns({f"threshold_high_flow_{n}": F.lit(c["events"][n]) for n in ("trigger_percentile", "boundary_percentile")})


def united(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One table of all evidence: ``evidence_type`` is the table's name, columns that a table lacks are null.

    A column that tables have in different types is text.
    """
    types: dict[str, set[str]] = {}
    for df in tables.values():
        for n, t in df.dtypes:
            types.setdefault(n, set()).add(t)

    def plain(df: DataFrame, name: str) -> DataFrame:
        def value(n: str, t: str) -> Column:
            if len(types[n]) == 1:
                return F.col(n)
            return (F.to_json(n) if t.startswith(("array", "map", "struct")) else F.col(n).cast("string")).alias(n)

        return df.select(F.lit(name).alias("evidence_type"), *[value(n, t) for n, t in df.dtypes if n != "evidence_type"])

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [plain(df, n) for n, df in tables.items()])


def context_summary(found: Mapping[str, DataFrame], settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Agreement with nearby and comparable stations, one row for each station; ``found``: of ``context.network_context``."""
    c = overlay(LAYER3, settings)
    k = c["comparison"]
    wl, wc = max(k["local_context_weight"], 0.0), max(k["comparable_catchment_weight"], 0.0)
    wl, wc = (wl / (wl + wc), wc / (wl + wc)) if wl + wc > 0 else (0.5, 0.5)

    def side(name: str, prefix: str, agreement: str) -> DataFrame:
        return found[name].select("station_id", F.col("score_percent").alias(f"{agreement}_percent"), F.col("classification").alias(f"{agreement}_class"), F.col("supported_checks").alias(f"{prefix}_supported"), F.col("assessed_checks").alias(f"{prefix}_assessed"))

    def peers(name: str, column: str) -> DataFrame:
        return found[name].groupBy("station_id").agg(F.count(F.lit(1)).alias(column))

    base = found["evidence"].select("station_id").distinct()
    total = found["combined"].select("station_id", F.col("combined_score_percent").alias("context_agreement_score_percent"), F.col("combined_classification").alias("context_agreement_class"))
    parts = [
        total, side("local_summary", "nearby_checks", "nearby_gauge_agreement"), side("analogue_summary", "comparable_checks", "comparable_catchment_agreement"),
        peers("local_peers", "nearby_gauge_count"), peers("analogue_peers", "comparable_catchment_count"),
    ]
    out = _beside(base, parts, ["station_id"])
    counts = [n for n in out.columns if n.endswith(("_supported", "_assessed", "_count"))]
    classes = [n for n in out.columns if n.endswith("_class")]
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0).cast("long")) for n in counts} | {n: F.coalesce(F.col(n), F.lit("Not assessed")) for n in classes})
    fixed = {
        "nearby_search_radius_km": c["local_peers"]["maximum_search_radius_km"], "comparable_search_radius_km": c["analogue_peers"]["maximum_search_radius_km"], "maximum_catchment_area_ratio": c["analogue_peers"]["maximum_catchment_area_ratio"],
        "nearby_context_weight": wl, "comparable_catchment_weight": wc, "minimum_peer_consensus_fraction": k["peer_consensus_fraction"],
        "similar_minimum_percent": k["similar_minimum_percent"], "partial_minimum_percent": k["partial_minimum_percent"],
    }
    return out.withColumns({f"threshold_{n}": F.lit(v) for n, v in fixed.items()})


def context_evidence(found: Mapping[str, DataFrame], settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Every check with its agreement class, every peer, and every peer's similarity in every check, as one table."""
    k = overlay(LAYER3, settings)["comparison"]

    def met(name: str, prefix: str) -> DataFrame:
        return found[name].select("station_id", "check", F.col("supporting_peer_count").alias(f"{prefix}_peers_meeting_rule"), F.col("assessed_peer_count").alias(f"{prefix}_peers_assessed"))

    checks = found["combined_checks"].select(
        "station_id", "check", F.col("local_support_fraction").alias("nearby_median_similarity"), F.col("comparable_support_fraction").alias("comparable_catchment_median_similarity"), F.col("local_contribution_percent").alias("nearby_weighted_contribution_percent"),
        F.col("comparable_contribution_percent").alias("comparable_weighted_contribution_percent"), F.col("combined_similarity_percent").alias("combined_agreement_percent"), context.agreement(F.col("combined_similarity_percent"), k).alias("agreement_class"),
    )
    checks = _beside(checks, [met("local_checks", "nearby"), met("analogue_checks", "comparable")], ["station_id", "check"])
    pairs = found["local_similarities"].withColumn("context_group", F.lit("nearby_gauge")).unionByName(found["analogue_similarities"].withColumn("context_group", F.lit("comparable_catchment")))
    return united({"context_check": checks, "nearby_gauge": found["local_peers"], "comparable_catchment": found["analogue_peers"], "peer_metric_comparison": pairs})


def station_summary(
    flow: DataFrame, layer1: DataFrame | None = None, layer2: DataFrame | None = None, layer3: DataFrame | None = None, comparison: DataFrame | None = None,
    names: Mapping[str, Mapping[str, str]] | None = None, places: DataFrame | None = None, provenance: DataFrame | None = None,
) -> DataFrame:
    """One row for each assessed series: identity, calendar, what was done, and the metrics and thresholds of every layer.

    Metrics have the prefix of their layer, thresholds ``threshold_`` and that prefix. ``layer3`` counts
    for the first series, ``comparison`` for the second. ``names``: name, role and units of each slot;
    ``places``: station metadata by station_id, of which the first row of a station counts; ``provenance``: what
    ``Sourced.table`` gives, of which the requested and source spans and the input's path are told.
    """
    first = F.col("series_slot") == "series1"
    known = names or {}

    def told(field: str) -> Column:
        some = {s: v[field] for s, v in known.items() if v.get(field)}
        return F.element_at(F.create_map(*[F.lit(x) for pair in some.items() for x in pair]), F.col("series_slot")) if some else F.lit(None).cast("string")

    def prefixed(df: DataFrame, on: list[str], prefix: str) -> DataFrame:
        def name(n: str) -> str:
            stem = n.removeprefix("threshold_")
            return ("threshold_" if n != stem else "") + (stem if stem.startswith(prefix) else prefix + stem)

        return df.select(*on, *[F.col(n).alias(name(n)) for n in df.columns if n not in KEYS])

    out = availability(flow).select(
        *KEYS, F.coalesce(told("name"), F.col("series_slot")).alias("series_name"), told("role").alias("series_role"), told("units").alias("unit"), F.col("calendar_start").alias("selected_calendar_start"), F.col("calendar_end").alias("selected_calendar_end"),
        F.col("first_valid").alias("first_valid_date"), F.col("last_valid").alias("last_valid_date"), F.col("calendar_count").alias("selected_row_count"), F.col("valid_count").alias("valid_observation_count"),
    )
    if places is not None:
        wanted = [n for n in ("latitude", "longitude", "river_name", "catchment_name", "catchment_area_km2", "climate_code") if n in places.columns]
        out = out.join(places.groupBy("station_id").agg(*[F.min(F.struct(*wanted)).alias("place")]).select("station_id", *[F.col(f"place.{n}").alias(n) for n in wanted]), "station_id", "left")
    if provenance is not None:
        told_of = {"requested_mode": "requested_timespan_mode", "requested_start": "requested_start", "requested_end": "requested_end", "source_start": "source_calendar_start", "source_end": "source_calendar_end", "path": "input_dataset"}
        out = out.join(provenance.select(*KEYS, *[F.col(f"provenance.{k}").alias(v) for k, v in told_of.items()]), KEYS, "left")
    out = out.withColumns({"layer1_completed": F.lit(layer1 is not None), "layer2_completed": F.lit(layer2 is not None), "comparison_completed": F.lit(comparison is not None)})
    for df, prefix in ((layer1, "layer1_"), (layer2, "layer2_")):
        if df is not None:
            out = out.join(prefixed(df, KEYS, prefix), KEYS, "left")
    for df, prefix, slot in ((layer3, "layer3_", "series1"), (comparison, "comparison_", "series2")):
        if df is not None:
            out = out.join(prefixed(df, ["station_id"], prefix).withColumn("series_slot", F.lit(slot)), KEYS, "left")
    if layer3 is None:
        return out.withColumn("layer3_status", F.lit("not_assessed"))
    assessed = first & F.coalesce(F.col("layer3_context_agreement_class") != "Not assessed", F.lit(False))
    return out.withColumn("layer3_status", F.when(assessed, "assessed").otherwise("not_assessed"))
