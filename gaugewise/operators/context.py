"""Network context: station metadata, climate classes, peers, and agreement with them.

Peer search is an equi-join on cells of a grid in space (edge: the search radius), so that it stays
linear in the stations of a neighbourhood; no station is compared with all others.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.config import LAYER2, LAYER3, overlay
from gaugewise.functions.numeric import cosine, haversine_km, median, ratio, resampled
from gaugewise.functions.shared import written
from gaugewise.operators import layer1, layer2
from gaugewise.operators.composite import spikes_of
from gaugewise.operators.epoch_drift import epoch_drift
from gaugewise.operators.primitives import KEYS, prepared
from gaugewise.operators.step_shift import step_shift, tiered_boundaries

# Spellings of the two series types.
SERIES_TYPES = {
    "obs": "observation", "observed": "observation", "observation": "observation", "sim": "simulation", "simulated": "simulation", "simulation": "simulation", "ml": "simulation", "model": "simulation",
}
EARTH_KM = 6371.0088
LOCAL_ONLY = ["peak_timing", "step_shift_timing", "epoch_behaviour"]
SHARED = ["flashiness", "baseflow", "zero_flow", "seasonality_shape", "event_shape", "event_time_to_peak", "event_duration"]


def validate_context(raw: DataFrame) -> DataFrame:
    """Cleaned rows with ``rejection_reason``, empty where a row is usable; copies of one id are all rejected."""
    missing = [c for c in LAYER3["metadata"]["required_columns"] if c not in raw.columns]
    if missing:
        raise ValueError("context lacks columns: " + ", ".join(missing))

    def text(c: str) -> Column:
        return F.trim(F.col(c).cast("string"))

    kinds = F.create_map(*[F.lit(x) for pair in SERIES_TYPES.items() for x in pair])
    rows = raw.select(
        text("station_id").alias("station_id"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("longitude", "latitude")], text("river_name").alias("river_name"), text("catchment_name").alias("catchment_name"),
        F.expr("try_cast(catchment_area_km2 as double)").alias("catchment_area_km2"), F.try_element_at(kinds, F.lower(text("series_type"))).alias("series_type"),
    )
    copies = F.count(F.lit(1)).over(Window.partitionBy("station_id"))

    def unless(ok: Column, reason: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), reason)

    reasons = F.concat_ws(
        "; ", unless(F.col("station_id") != "", "missing station_id"), F.when(copies > 1, "duplicate station_id"), unless(F.col("latitude").between(-90, 90), "invalid latitude"),
        unless(F.col("longitude").between(-180, 180), "invalid longitude"), unless((F.col("catchment_area_km2") > 0) & ~F.isnan("catchment_area_km2"), "invalid catchment area"), unless(F.col("series_type").isNotNull(), "unknown series_type"),
    )
    return rows.withColumn("rejection_reason", reasons)


def attach_climate(stations: DataFrame, cells: DataFrame, legend: DataFrame, width: int, height: int) -> DataFrame:
    """Climate class of the raster cell of each station: cells (row, col, climate_id), legend (climate_id, climate_code, ...)."""
    if width != 2 * height:
        raise ValueError("the raster must be twice as wide as high")
    col = F.least(((F.col("longitude") + 180.0) / (360.0 / width)).cast("int"), F.lit(width - 1))
    row = F.least(((90.0 - F.col("latitude")) / (180.0 / height)).cast("int"), F.lit(height - 1))
    named = cells.join(legend, "climate_id")  # both of fixed size
    return stations.withColumns({"row": row, "col": col}).join(named, ["row", "col"], "left").drop("row", "col")


def _cells(df: DataFrame, edge_km: float, around: bool) -> DataFrame:
    """Grid cell of each station in space, or with ``around`` the 27 cells that can hold one within an edge of it."""
    lat, lon = F.radians("latitude"), F.radians("longitude")
    place = {"cx": F.cos(lat) * F.cos(lon), "cy": F.cos(lat) * F.sin(lon), "cz": F.sin(lat)}
    out = df.withColumns({n: F.floor(v * EARTH_KM / edge_km).cast("int") for n, v in place.items()})
    if around:
        for n in place:
            out = out.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
    return out


def _area_band(width: float) -> Column:
    """Stations whose areas differ by a factor of at most 2**width are in the same band or in neighbours."""
    return F.floor(F.log2("catchment_area_km2") / F.lit(width * (1 + 1e-9))).cast("long")


def candidates(stations: DataFrame, radius_km: float, series_type: str = "observation", same: list[str] | None = None, targets: DataFrame | None = None, area_width: float | None = None) -> DataFrame:
    """Pairs of stations within the radius: distance, area ratio, shared river, catchment and climate.

    A station whose id is not unique is no target. ``same``: columns that both must share. ``targets``: ids to which the
    targets are confined; ``area_width``: areas differ by a factor of at most 2 to its power, by bands in the join key.
    """
    if "climate_code" not in stations.columns:
        stations = stations.withColumn("climate_code", F.lit(None).cast("string"))
    own = ["station_id", "longitude", "latitude", "river_name", "catchment_name", "catchment_area_km2", "climate_code"]
    unique = stations.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("station_id"))).where("copies = 1")
    keys = ["cx", "cy", "cz", *(same or []), *(["band"] if area_width else [])]
    if targets is not None:
        unique = unique.join(targets.select("station_id"), "station_id", "left_semi")
    t = _cells(unique.select(*own), radius_km, True)
    p = _cells(stations.where(F.col("series_type") == series_type).select(*own), radius_km, False)
    if area_width:
        band = _area_band(area_width)
        t, p = t.withColumn("band", F.explode(F.array(band - 1, band, band + 1))), p.withColumn("band", band)
    p = p.select(*keys, *[F.col(c).alias(f"peer_{c}") for c in own if c not in keys], *([F.col("climate_code").alias("peer_climate_code")] if "climate_code" in keys else []))
    distance = haversine_km(F.col("longitude"), F.col("latitude"), F.col("peer_longitude"), F.col("peer_latitude"))
    pairs = t.join(p, keys).where("station_id <> peer_station_id").withColumn("distance_km", distance).where(F.col("distance_km") <= radius_km)
    area, other = F.col("catchment_area_km2"), F.col("peer_catchment_area_km2")

    def alike(c: str) -> Column:
        a, b = F.lower(F.trim(c)), F.lower(F.trim(f"peer_{c}"))
        return F.coalesce((a != "") & (a == b), F.lit(False))

    catchment, river = alike("catchment_name"), alike("river_name")
    rank = F.when(catchment & river, 0).when(catchment, 1).when(river, 2).otherwise(3)
    return pairs.select(
        "station_id", "peer_station_id", "distance_km", F.greatest(ratio(other, area), ratio(area, other)).alias("catchment_area_ratio"), catchment.alias("same_catchment"), river.alias("same_river"),
        F.coalesce(F.col("climate_code") == F.col("peer_climate_code"), F.lit(False)).alias("same_climate"), rank.alias("relationship_rank"),
    )


def _best(pairs: DataFrame, order: list[str], settings: Mapping[str, Any]) -> DataFrame:
    w = Window.partitionBy("station_id")
    out = pairs.withColumn("peer_rank", F.row_number().over(w.orderBy(*order))).where(F.col("peer_rank") <= settings["maximum_peers"])
    return out.withColumn("ready", F.count(F.lit(1)).over(w) >= settings["minimum_peers"])


def local_peers(stations: DataFrame, settings: Mapping[str, Any] | None = None, series_type: str = "observation") -> DataFrame:
    """Nearby stations, best first; ``ready`` is false where there are too few, which are listed all the same."""
    c = overlay(LAYER3["local_peers"], settings)
    return _best(candidates(stations, c["maximum_search_radius_km"], series_type), ["relationship_rank", "distance_km", "catchment_area_ratio", "peer_station_id"], c)


#: Stations for each peer kept that the first band of areas may meet: more stations begin with a narrower band.
CROWD = 32


def area_widths(stations: int, peers: int, limit: float) -> list[float]:
    """Widths of the bands to search one after the other, each four times the one before, the last one the limit."""
    widths = [limit]
    while stations * widths[0] > CROWD * peers * limit:
        widths.insert(0, widths[0] / 4)
    return widths


def analogue_peers(stations: DataFrame, local: DataFrame, settings: Mapping[str, Any] | None = None, series_type: str = "observation") -> DataFrame:
    """Comparable stations of similar area and climate, without the chosen local ones.

    As the likest area comes first, a station that finds all its peers within a narrow band of areas needs no
    wider one. The bands widen from round to round, for the stations that still lack peers, up to the greatest ratio: pairs
    grow with the stations and not with their square, unless very many areas are equal. The stations are counted, and all but the last
    round written, before this returns.
    """
    c = overlay(LAYER3["analogue_peers"], settings)
    most, order = c["maximum_catchment_area_ratio"], ["catchment_area_ratio", "relationship_rank", "distance_km", "peer_station_id"]
    limit = math.log2(most) if most > 1 else 1e-6
    todo, out = None, []
    for width in area_widths(stations.count(), max(int(c["maximum_peers"]), 1), limit):
        last = width == limit
        pairs = candidates(stations, c["maximum_search_radius_km"], series_type, ["climate_code"] if c["require_same_climate"] else None, todo, width)
        pairs = pairs.where(F.col("catchment_area_ratio") <= (most if last else 2.0**width)).join(local.select("station_id", "peer_station_id"), ["station_id", "peer_station_id"], "left_anti")
        best = _best(pairs, order, c)
        if last:
            out.append(best)
            break
        best = written(best.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("station_id"))), "analogue_peers")
        settled = best.where(F.col("found") >= int(c["maximum_peers"])).drop("found")
        out.append(settled)
        todo = written((stations if todo is None else todo).select("station_id").join(settled.select("station_id"), "station_id", "left_anti"), "analogue_targets")
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def matched_dates(a: Column, b: Column, tolerance_days: float) -> Column:
    """Pairs that two sorted arrays of day numbers give, each day used once, walking both from their start."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("m"))

    def turn(s: Column, _: Column) -> Column:
        x, y = F.get(a, s["i"]), F.get(b, s["j"])
        hit = F.abs(x - y) <= tolerance_days
        return F.when(x.isNull() | y.isNull(), s).otherwise(
            F.struct((s["i"] + (hit | (x < y)).cast("int")).alias("i"), (s["j"] + (hit | (x > y)).cast("int")).alias("j"), (s["m"] + hit.cast("int")).alias("m"))
        )

    steps = F.size(a) + F.size(b)
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), steps), start, turn, lambda s: s["m"])).otherwise(0)


def evidence(flow: DataFrame, settings: Mapping[str, Any] | None = None, signature_settings: Mapping[str, Any] | None = None) -> DataFrame:
    """One row per station: everything its peers are compared on.

    ``settings``: of layer 1, whose spike candidates mark events that cannot represent the record;
    ``signature_settings``: of layer 2. Days are numbers since 1970-01-01; dates that a check found none of are empty, and null where
    the check could not run.
    """
    c = overlay(LAYER2, signature_settings)
    flow = prepared(flow)
    events = layer2.high_flow_events(flow, c["events"]["trigger_percentile"], c["events"]["boundary_percentile"])
    spikes = spikes_of(flow, settings).where("status = 'candidate'").select(*KEYS, "ts", "type")
    eligible = layer2.representative_eligibility(events, layer2.crosscheck(spikes, events, c["events"]["spike_crosscheck_minimum_event_duration_days"]))
    annual = layer2.annual_signatures(flow, None, **c["annual"])
    profile = layer2.seasonality_profile(layer2.monthly_profile(flow, c["annual"]["minimum_valid_days_per_year"], c["annual"]["minimum_valid_days_per_month"]))

    def day(c: str) -> Column:
        return F.datediff(c, F.lit("1970-01-01").cast("date"))

    given = flow.where("value is not null").groupBy(*KEYS).agg(F.min(day("ts")).alias("record_start"), F.max(day("ts")).alias("record_end"))
    peaks = events.groupBy(*KEYS).agg(F.array_sort(F.collect_list(day("peak_date"))).alias("peak_days"))
    shifts = tiered_boundaries(flow, settings and settings.get("step_shift")).where("tier <> 'Tier 3'").groupBy(*KEYS).agg(F.array_sort(F.collect_list(day("boundary_date"))).alias("shift_days"))
    steps = step_shift(flow, settings and settings.get("step_shift")).select(*KEYS, F.col("assessed").alias("steps_assessed"))
    epochs = epoch_drift(flow, settings and settings.get("epoch_drift")).select(*KEYS, F.col("dominant_state").alias("epoch_behaviour"))
    yearly = annual.groupBy(*KEYS).agg(median(F.col("flashiness_index")).alias("flashiness"), median(F.col("baseflow_index")).alias("baseflow"))
    zero = layer1.zero_flow_regime(flow).select(*KEYS, F.col("zero_ratio").alias("zero_flow"))
    months = profile.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "median"))), lambda s: s["median"]).alias("profile"))
    shown = layer2.representative_event(eligible).select(*KEYS, "curve", "peak_flow", "time_to_peak_days", "event_duration_days")
    out = given
    for part in (peaks, shifts, steps, epochs, yearly, zero, months, shown):
        out = out.join(part, KEYS, "left")
    none = F.array().cast("array<int>")
    return with_availability(out.withColumns({"peak_days": F.coalesce("peak_days", none), "shift_days": F.when(F.col("steps_assessed"), F.coalesce("shift_days", none))}).drop("steps_assessed"))


# Kinds of evidence, and the reason of those that are not there.
EVIDENCE = ["peak_dates", "step_shift_dates", "epoch_behaviour", "zero_flow_ratio", "annual_signatures", "seasonality_profile", "representative_event"]
UNAVAILABLE = "Required Layer 1/2 evidence was unavailable or not calculable."
#: The kind of evidence that each check needs.
NEEDS = {
    "peak_timing": "peak_dates", "step_shift_timing": "step_shift_dates", "epoch_behaviour": "epoch_behaviour", "flashiness": "annual_signatures", "baseflow": "annual_signatures", "zero_flow": "zero_flow_ratio",
    "seasonality_shape": "seasonality_profile", "event_shape": "representative_event", "event_time_to_peak": "representative_event", "event_duration": "representative_event",
}


def with_availability(found: DataFrame) -> DataFrame:
    """Evidence with two maps: ``availability`` of each kind, and ``unavailable_reasons`` of those that are not there.

    A check that ran and found no date is evidence; an array of dates that is null is none.
    """
    there = {
        "peak_dates": F.col("peak_days").isNotNull(), "step_shift_dates": F.col("shift_days").isNotNull(), "epoch_behaviour": F.col("epoch_behaviour").isNotNull(), "zero_flow_ratio": F.col("zero_flow").isNotNull(),
        "annual_signatures": F.col("flashiness").isNotNull() | F.col("baseflow").isNotNull(), "seasonality_profile": F.coalesce(F.exists("profile", lambda x: x.isNotNull()), F.lit(False)), "representative_event": F.col("curve").isNotNull(),
    }
    available = F.create_map(*[x for k in EVIDENCE for x in (F.lit(k), there[k])])
    out = found.withColumn("availability", available)
    return out.withColumn("unavailable_reasons", F.transform_values(F.map_filter("availability", lambda _, v: ~v), lambda _, v: F.lit(UNAVAILABLE)))


NO_DATES = "neither station has dates in the common period"


def _like(a: Column, b: Column) -> Column:
    """Smaller over larger of two non-negative values."""
    x, y = F.greatest(a, F.lit(0.0)), F.greatest(b, F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(ratio(F.least(x, y), F.greatest(x, y))))


def pair_similarities(peers: DataFrame, found: DataFrame, settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Similarity of each target and peer in each check: station_id, peer_station_id, check, similarity (null: not assessed)."""
    return pair_checks(peers, found, settings).select("station_id", "peer_station_id", "check", "similarity")


def pair_checks(peers: DataFrame, found: DataFrame, settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Each target and peer in each check: ``similarity``, ``pair_status`` and, where there is no similarity, the ``reason``.

    supported or not_supported by the check's minimum; not_applicable where both have the evidence and neither has a date
    in the common period; else not_assessed.
    """
    c = overlay(LAYER3["comparison"], settings)
    found = found if "availability" in found.columns else with_availability(found)
    names = [n for n in found.columns if n not in KEYS]
    a = found.select("station_id", *[F.col(n).alias(f"a_{n}") for n in names])
    b = found.select(F.col("station_id").alias("peer_station_id"), *[F.col(n).alias(f"b_{n}") for n in names])
    pairs = peers.select("station_id", "peer_station_id").join(a, "station_id").join(b, "peer_station_id")
    start, end = F.greatest("a_record_start", "b_record_start"), F.least("a_record_end", "b_record_end")

    def dates(n: str, tolerance: float) -> Column:
        x, y = (F.filter(F.col(f"{s}_{n}"), lambda d: (d >= start) & (d <= end)) for s in "ab")
        total = F.size(x) + F.size(y)
        return F.when((start <= end) & F.col(f"a_{n}").isNotNull() & F.col(f"b_{n}").isNotNull() & (total > 0), 2.0 * matched_dates(x, y, tolerance) / total)

    def bounded(n: str) -> Column:
        d = F.abs(F.col(f"a_{n}") - F.col(f"b_{n}"))
        return F.when(d.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d)))

    def days(n: str, tolerance: float) -> Column:
        d = F.abs(F.col(f"b_{n}") - F.col(f"a_{n}"))
        return F.when(d.isNotNull(), F.when(d == 0, 1.0).otherwise(0.0) if tolerance == 0 else F.greatest(F.lit(0.0), 1 - d / (2 * tolerance)))

    both = F.filter(F.zip_with("a_profile", "b_profile", lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda s: s["x"].isNotNull() & s["y"].isNotNull())
    season = F.when(F.size(both) >= c["minimum_profile_points"], cosine(F.transform(both, lambda s: s["x"]), F.transform(both, lambda s: s["y"])))
    curves = (F.size("a_curve") >= 2) & (F.size("b_curve") >= 2)
    shape = F.when(curves, cosine(resampled(F.col("a_curve"), 101), resampled(F.col("b_curve"), 101))) * _like(F.col("a_peak_flow"), F.col("b_peak_flow"))
    long_enough = (end - start + 1) >= c["minimum_epoch_overlap_years"] * 365.25
    epoch = F.when(long_enough & F.col("a_epoch_behaviour").isNotNull() & F.col("b_epoch_behaviour").isNotNull(), F.when(F.col("a_epoch_behaviour") == F.col("b_epoch_behaviour"), 1.0).otherwise(0.0))
    values = {
        "peak_timing": dates("peak_days", c["peak_tolerance_days"]), "step_shift_timing": dates("shift_days", c["step_shift_tolerance_days"]), "epoch_behaviour": epoch,
        "flashiness": _like(F.col("a_flashiness"), F.col("b_flashiness")), "baseflow": bounded("baseflow"), "zero_flow": bounded("zero_flow"), "seasonality_shape": season, "event_shape": shape,
        "event_time_to_peak": days("time_to_peak_days", c["event_time_to_peak_tolerance_days"]), "event_duration": days("event_duration_days", c["event_duration_tolerance_days"]),
    }
    apart = ~F.coalesce(start <= end, F.lit(False))

    def no_dates(n: str) -> Column:
        x, y = (F.filter(F.col(f"{s}_{n}"), lambda d: (d >= start) & (d <= end)) for s in "ab")
        return F.coalesce(F.size(x) + F.size(y) == 0, F.lit(False))

    own = {
        "peak_timing": F.when(apart, "no common period").when(no_dates("peak_days"), NO_DATES), "step_shift_timing": F.when(apart, "no common period").when(no_dates("shift_days"), NO_DATES),
        "epoch_behaviour": F.when(apart, "no common period").when(~long_enough, "common period is too short"),
    }

    def reason(check: str) -> Column:
        kind = NEEDS[check]
        lacks = F.when(~F.col("a_availability")[kind], "target evidence is unavailable").when(~F.col("b_availability")[kind], "peer evidence is unavailable")
        return F.coalesce(lacks, own[check] if check in own else F.lit(None).cast("string"), F.lit("evidence is not comparable"))

    told = F.array(*[F.struct(F.lit(n).alias("check"), v.cast("double").alias("similarity"), F.when(v.isNull(), reason(n)).alias("reason")) for n, v in values.items()])
    rows = pairs.select("station_id", "peer_station_id", F.inline(told))
    x = F.col("similarity")
    status = F.when(x >= minimum_of(F.col("check"), settings), "supported").when(x.isNotNull(), "not_supported").when(F.col("reason") == NO_DATES, "not_applicable").otherwise("not_assessed")
    return rows.select("station_id", "peer_station_id", "check", "similarity", status.alias("pair_status"), "reason")


def minimum_of(check: Column, settings: Mapping[str, Any] | None = None) -> Column:
    """The similarity from which a check is supported."""
    c = overlay(LAYER3["comparison"], settings)
    return (
        F.when(check == "peak_timing", c["minimum_peak_timing_similarity"]).when(check == "step_shift_timing", c["minimum_step_shift_timing_similarity"]).when(check == "epoch_behaviour", c["peer_consensus_fraction"])
        .when(check.isin("event_time_to_peak", "event_duration"), 0.5).otherwise(c["analogue_similarity_minimum"]).cast("double")
    )


def finished_checks(similarities: DataFrame, settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Median over the assessed peers, how many support, and the status of each check of each target.

    Of the rows of ``pair_checks`` it also gives the ``reason`` of a check that no peer could assess, and how many peers it did not apply to.
    """
    x, least = F.col("similarity"), minimum_of(F.col("check"), settings)
    told = "reason" in similarities.columns
    more = [F.bool_and(F.col("reason") == "target evidence is unavailable").alias("lacking"), F.count_if(F.col("pair_status") == "not_applicable").alias("not_applicable_peer_count")] if told else []
    s = similarities.withColumn("least", least).groupBy("station_id", "check").agg(median(x).alias("similarity"), F.count(x).alias("assessed_peer_count"), F.count_if(x >= F.col("least")).alias("supporting_peer_count"), F.first("least").alias("least"), *more)
    why = F.when(F.col("assessed_peer_count") == 0, F.when(F.col("lacking"), "target evidence is unavailable").otherwise("no peer has comparable evidence in a common period")) if told else None
    status = F.when(F.col("assessed_peer_count") == 0, "not_assessed").when(F.col("similarity") >= F.col("least"), "supported").otherwise("not_supported")
    return s.select("station_id", "check", status.alias("status"), "similarity", "assessed_peer_count", "supporting_peer_count", *(["not_applicable_peer_count", why.alias("reason")] if told else []))


def agreement(score: Column, settings: Mapping[str, Any] | None = None) -> Column:
    c = overlay(LAYER3["comparison"], settings)
    return F.when(score.isNull(), "Not assessed").when(score >= c["similar_minimum_percent"], "Strong agreement").when(score >= c["partial_minimum_percent"], "Moderate agreement").otherwise("Low agreement")


def context_summary(checks: DataFrame, names: list[str], settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Mean agreement over the assessed ones of ``names``, its class, and their coverage."""
    mine = checks.where(F.col("check").isin(names))
    score = 100 * F.avg("similarity")
    n = F.count("similarity")
    return mine.groupBy("station_id").agg(
        score.alias("score_percent"), agreement(score, settings).alias("classification"), F.count_if(F.col("status") == "supported").alias("supported_checks"), n.alias("assessed_checks"), (100.0 * n / len(names)).alias("coverage_percent")
    )


def combined_checks(local: DataFrame, analogue: DataFrame, settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Ten checks with the weighted contributions of local and comparable stations.

    Where only local evidence exists it counts in full; where only comparable evidence exists it
    counts with its own weight and no more.
    """
    c = overlay(LAYER3["comparison"], settings)
    wl, wc = max(c["local_context_weight"], 0.0), max(c["comparable_catchment_weight"], 0.0)
    wl, wc = (wl / (wl + wc), wc / (wl + wc)) if wl + wc > 0 else (0.5, 0.5)
    targets = local.select("station_id").unionByName(analogue.select("station_id")).distinct()
    grid = targets.withColumn("check", F.explode(F.array(*[F.lit(n) for n in LOCAL_ONLY + SHARED])))
    rows = grid.join(local.select("station_id", "check", F.col("similarity").alias("l")), ["station_id", "check"], "left")
    rows = rows.join(analogue.where(F.col("check").isin(SHARED)).select("station_id", "check", F.col("similarity").alias("a")), ["station_id", "check"], "left")
    only, lo, an = F.col("check").isin(LOCAL_ONLY), F.col("l"), F.col("a")
    from_local = F.when(lo.isNotNull(), F.when(only | an.isNull(), 100 * lo).otherwise(100 * lo * wl))
    from_other = F.when(only & lo.isNotNull(), 0.0).when(an.isNotNull(), 100 * an * wc)
    total = F.when(lo.isNotNull() | an.isNotNull(), F.coalesce(from_local, F.lit(0.0)) + F.coalesce(from_other, F.lit(0.0)))
    return rows.select("station_id", "check", lo.alias("local_support_fraction"), an.alias("comparable_support_fraction"), from_local.alias("local_contribution_percent"), from_other.alias("comparable_contribution_percent"), total.alias("combined_similarity_percent"))


def combined_context(rows: DataFrame, settings: Mapping[str, Any] | None = None) -> DataFrame:
    """Mean over the assessed checks and its class; a report is worth while from the minimum similarity on."""
    c = overlay(LAYER3["comparison"], settings)
    on = F.col("combined_similarity_percent").isNotNull()

    def mean(n: str) -> Column:
        return F.avg(F.when(on, F.coalesce(F.col(n), F.lit(0.0))))

    score = F.avg("combined_similarity_percent")
    return rows.groupBy("station_id").agg(
        score.alias("combined_score_percent"), agreement(score, settings).alias("combined_classification"), mean("local_contribution_percent").alias("local_contribution_percent"), mean("comparable_contribution_percent").alias("comparable_contribution_percent"),
        F.count_if(on).alias("assessed_checks"), F.coalesce(score >= c["report_minimum_similarity_percent"], F.lit(False)).alias("report_similarity_met"),
    )


def network_context(
    flow: DataFrame, stations: DataFrame, settings: Mapping[str, Any] | None = None, series_type: str = "observation",
    screening: Mapping[str, Any] | None = None, signature_settings: Mapping[str, Any] | None = None, composite: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Peers, checks and combined context of every station that has both metadata and a series.

    ``screening`` and ``signature_settings``: of layers 1 and 2, for the evidence. With the
    ``composite`` of the flow, a report is recommended for stations whose class asks for review and
    whose peers are similar enough.
    """
    c = overlay(LAYER3, settings)
    flow = prepared(flow)
    have = flow.select("station_id").distinct()
    usable = stations.join(have, "station_id", "left_semi")
    local = local_peers(usable, c["local_peers"], series_type)
    analogue = analogue_peers(usable, local, c["analogue_peers"], series_type)
    found = written(evidence(flow, screening, signature_settings), "evidence")
    close = written(pair_checks(local.where("ready"), found, c["comparison"]), "local_similarities")
    alike = written(pair_checks(analogue.where("ready"), found, c["comparison"]).where(F.col("check").isin(SHARED)), "analogue_similarities")
    near, far = written(finished_checks(close, c["comparison"]), "local_checks"), written(finished_checks(alike, c["comparison"]), "analogue_checks")
    rows = combined_checks(near, far, c["comparison"])
    combined = combined_context(rows, c["comparison"])
    if composite is not None:
        asks = composite.where("layer1_class = 'Needs review'").select("station_id").distinct().withColumn("asks", F.lit(True))
        combined = combined.join(asks, "station_id", "left").withColumn("report_recommended", F.col("report_similarity_met") & F.coalesce("asks", F.lit(False))).drop("asks")
    return {
        "local_peers": local, "analogue_peers": analogue, "evidence": found, "local_similarities": close, "analogue_similarities": alike, "local_checks": near, "analogue_checks": far, "combined_checks": rows, "combined": combined,
        "local_summary": context_summary(near, LOCAL_ONLY + SHARED, c["comparison"]), "analogue_summary": context_summary(far, SHARED, c["comparison"]),
    }
