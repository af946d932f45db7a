"""Settings of every operator, and how a user's settings are laid over them."""

from __future__ import annotations

from collections.abc import Mapping
from copy import deepcopy
from typing import Any

# Thresholds, weights and tiers of the screening rules.
LAYER1: dict[str, Any] = {
    "missing_values": {"enabled": True},
    "long_gaps": {"enabled": True, "minimum_reported_gap_days": 3},
    "negative_discharge": {"enabled": True, "tolerance": 0.001},
    "duplicate_timestamps": {"enabled": True},
    "timestep_consistency": {"enabled": True},
    "zero_flow_regime": {"enabled": True, "decimals": 3},
    "low_variability": {"enabled": True, "minimum_plateau_days": 15, "decimals": 3},
    "spike_dip": {
        "enabled": True, "minimum_recovery": 0.8, "minimum_score": 8.0, "absolute_change_reference_quantile": 0.99,
        "score_reference_quantile": 0.995, "robust_mad_multiplier": 6.0, "minimum_outer_change_multiplier": 1.0,
    },
    "step_shift": {
        "enabled": True, "long_record_min_years": 12.0, "long_record_block_years": 4, "short_record_divisor": 3.0, "minimum_block_years": 1,
        "minimum_valid_days_per_month": 10, "minimum_block_coverage": 0.55, "minimum_calendar_months": 8, "structural_threshold": 3.0,
        "tier_3_maximum_quantile": 0.05, "tier_1_minimum_quantile": 0.25, "tier_3_points": 0.0, "tier_2_points": 1.0, "tier_1_points": 2.0,
        "composite_tier_2_minimum_score": 1.0, "composite_tier_1_above_score": 1.5, "refinement_block_fraction": 0.5, "consolidation_max_block_widths": 2.0,
    },
    "epoch_drift": {
        "enabled": True, "minimum_valid_days_per_month": 10, "minimum_valid_months_per_year": 8, "epoch_years": 5, "minimum_valid_annual_levels": 5,
        "annual_noise_floor_log": 0.03, "meaningful_epoch_change_score": 1.0, "tier_3_minimum_stable_fraction": 0.75, "tier_2_minimum_stable_fraction": 0.5,
        "overview_epochs_per_segment": 4, "maximum_overview_slopes": 4,
    },
    "composite": {
        "tier_points": {"Tier 3": 0, "Tier 2": 1, "Tier 1": 2},
        "weights": {
            "duplicate_timestamps": 3, "timestep_consistency": 3, "missing_values": 2, "long_gaps": 2, "negative_discharge": 3,
            "spike_dip": 1, "low_variability": 1, "step_shift": 3, "epoch_drift": 2,
        },
        "missing_values": {"tier_2_minimum_percent": 5.0, "tier_1_above_percent": 15.0},
        "long_gaps": {"long_gap_definition_days": 5, "tier_2_minimum_days": 6, "tier_1_minimum_days": 31, "tier_2_missing_share": 0.5, "tier_1_missing_share": 0.25},
        "negative_discharge": {"low_flow_reference_quantile": 0.05, "tier_1_reference_multiplier": 1.0},
        "low_variability": {"tier_1_minimum_days": 31},
        "spike_dip": {"tier_1_minimum_unresolved_count": 6},
        "classification": {"minor_concerns_minimum_percent": 7.5, "needs_review_minimum_percent": 20.0},
    },
}
LAYER2: dict[str, Any] = {
    "annual": {"minimum_valid_days_per_year": 30, "minimum_valid_days_per_month": 10, "baseflow_alpha": 0.925, "baseflow_passes": 3, "minimum_baseflow_segment_days": 3},
    "events": {"trigger_percentile": 0.95, "boundary_percentile": 0.9, "spike_crosscheck_minimum_event_duration_days": 3.0},
    "comparison": {
        "components": {
            "flow_behaviour": True, "annual_flashiness_shape": True, "annual_baseflow_shape": True, "seasonal_profile_shape": True,
            "seasonal_timing": True, "event_time_to_peak": True, "event_duration": True, "representative_event_shape": True,
        },
        "weights": {
            "flow_behaviour": 1, "annual_flashiness_shape": 1, "annual_baseflow_shape": 1, "seasonal_profile_shape": 1,
            "seasonal_timing": 1, "event_time_to_peak": 1, "event_duration": 1, "representative_event_shape": 1,
        },
        "similarity_tier3_minimum": 0.8, "similarity_tier2_minimum": 0.5, "minimum_assessable_components": 4,
        "seasonal_timing_tier3_max_months": 1, "seasonal_timing_tier2_max_months": 3, "time_to_peak_tier3_max_days": 3.0, "time_to_peak_tier1_min_days": 5.0,
        "event_duration_tier3_max_days": 3.0, "event_duration_tier2_max_days": 7.0, "similar_maximum_percent": 12.5, "review_maximum_percent": 43.75,
    },
}
LAYER3: dict[str, Any] = {
    "series_type": "observation",
    "metadata": {"required_columns": ["station_id", "longitude", "latitude", "river_name", "catchment_name", "catchment_area_km2", "series_type"]},
    "local_peers": {"minimum_peers": 1, "maximum_peers": 5, "maximum_search_radius_km": 50.0},
    "analogue_peers": {"minimum_peers": 2, "maximum_peers": 5, "require_same_climate": True, "maximum_catchment_area_ratio": 2.0, "maximum_search_radius_km": 1000.0},
    "comparison": {
        "local_context_weight": 0.7, "comparable_catchment_weight": 0.3, "peak_tolerance_days": 5, "step_shift_tolerance_days": 50,
        "minimum_peak_timing_similarity": 0.5, "minimum_step_shift_timing_similarity": 0.5, "minimum_epoch_overlap_years": 5.0,
        "analogue_similarity_minimum": 0.8, "minimum_profile_points": 6, "event_time_to_peak_tolerance_days": 5.0, "event_duration_tolerance_days": 7.0,
        "peer_consensus_fraction": 0.5, "similar_minimum_percent": 75.0, "partial_minimum_percent": 40.0, "report_minimum_similarity_percent": 50.0,
    },
}
DEFAULTS: dict[str, Any] = {
    "layer1": LAYER1,
    "layer2": LAYER2,
    "layer3": LAYER3,
    "comparison": {"daily_metrics": {"calculate": False}, "provided_metrics": {"include": True}},
}


def overlay(base: Mapping[str, Any], changes: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """``base`` with ``changes`` laid over it, key by key through nested mappings; neither is altered."""
    out = {k: deepcopy(v) for k, v in base.items()}
    for key, value in (changes or {}).items():
        nested = isinstance(value, Mapping) and isinstance(out.get(key), dict)
        out[key] = overlay(out[key], value) if nested else deepcopy(value)
    return out


def known_keys(base: Mapping[str, Any], changes: Mapping[str, Any], path: str = "") -> list[str]:
    """Dotted names in ``changes`` that ``base`` does not have."""
    out = []
    for key, value in changes.items():
        if key not in base:
            out.append(path + key)
        elif isinstance(value, Mapping) and isinstance(base[key], Mapping):
            out += known_keys(base[key], value, f"{path}{key}.")
    return out


def settings(changes: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """All settings with a user's changes; unknown names are refused."""
    if unknown := known_keys(DEFAULTS, changes or {}):
        raise ValueError("unknown settings: " + ", ".join(sorted(unknown)))
    return overlay(DEFAULTS, changes)
