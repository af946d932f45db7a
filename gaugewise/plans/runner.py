"""A whole run from settings: read, screen, compare, put in context, write."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewise.config import DEFAULTS, known_keys, overlay
from gaugewise.functions.shared import written
from gaugewise.operators import comparison, composite, context, contract, evidence, failures, layer1, network, primitives
from gaugewise.sinks import evidence as evidence_text
from gaugewise.sinks import pages, reports, store, tables
from gaugewise.sinks.store import Log
from gaugewise.sources import readers
from gaugewise.sources.provenance import Sourced

Progress = Callable[[str, Mapping[str, Any]], None]
FORMATS = ("csv", "parquet", "netcdf", "result_pickle")


@dataclass
class Settings:
    """Validated settings of a run, as read from TOML."""

    run: dict[str, Any]
    series1: dict[str, Any]
    series2: dict[str, Any] = field(default_factory=lambda: {"enabled": False})
    layers: dict[str, bool] = field(default_factory=dict)
    comparison: dict[str, Any] = field(default_factory=dict)
    context: dict[str, Any] = field(default_factory=dict)
    output: dict[str, Any] = field(default_factory=dict)
    layer1: dict[str, Any] = field(default_factory=dict)
    layer2: dict[str, Any] = field(default_factory=dict)
    layer3: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        bad: list[str] = []
        ids = [s.strip() for s in self.run.get("station_ids", []) if s.strip()]
        if bool(ids) + bool(self.run.get("station_file")) + bool(self.run.get("all_stations")) != 1:
            bad.append("choose one of run.station_ids, run.station_file and run.all_stations")
        self.layers = {"layer1": True, "layer2": True, "layer3": False, "comparison": False} | self.layers
        for name, s in (("series1", self.series1), ("series2", self.series2)):
            if name == "series2" and not s.get("enabled"):
                continue
            if s.get("format") not in FORMATS:
                bad.append(f"{name}.format must be one of {', '.join(FORMATS)}")
            if not s.get("path"):
                bad.append(f"{name}.path is missing")
            if name == "series1" and not s.get("units"):
                bad.append("series1.units is missing")
            if s.get("format") == "result_pickle" and not s.get("trusted"):
                bad.append(f"{name}.trusted must be set for pickles")
            if s.get("format") == "netcdf" and not all(s.get(k) for k in ("variable", "time_coordinate", "station_coordinate")):
                bad.append(f"{name} needs variable, time_coordinate and station_coordinate")
            span = s.get("timespan", {})
            if span.get("mode", "full") == "range":
                if not span.get("start_date") or not span.get("end_date") or str(span["start_date"]) > str(span["end_date"]):
                    bad.append(f"{name}.timespan needs start_date and end_date in order")
            elif span.get("start_date") or span.get("end_date"):
                bad.append(f"{name}.timespan dates need mode = 'range'")
        if self.layers["comparison"]:
            if not self.series2.get("enabled"):
                bad.append("a comparison needs series2")
            elif self.series1.get("units") != self.series2.get("units", self.series1.get("units")):
                bad.append("a comparison needs equal units")
            elif self.series1.get("name", "series1") == self.series2.get("name", "series2"):
                bad.append("a comparison needs distinct names")
            if self.comparison.get("mode", "paired_overlap") == "independent_timespans" and self.comparison.get("calculate_daily_metrics"):
                bad.append("independent timespans have no daily metrics")
        if self.layers["layer3"] and not (self.layers["layer1"] and self.layers["layer2"]):
            bad.append("layer 3 needs layers 1 and 2")
        for name in ("layer1", "layer2", "layer3"):
            bad += [f"unknown field {name}.{k}" for k in known_keys(DEFAULTS[name], getattr(self, name))]
        if self.output.get("html_mode", "needs_review") not in pages.MODES:
            bad.append("output.html_mode is unknown")
        if bad:
            raise ValueError("; ".join(bad))

    @classmethod
    def load(cls, path: str) -> Settings:
        import tomllib

        raw = tomllib.loads(Path(path).read_text())
        if unknown := set(raw) - set(cls.__dataclass_fields__):
            raise ValueError("unknown sections: " + ", ".join(sorted(unknown)))
        return cls(**raw)


    def effective(self) -> dict[str, Any]:
        """Everything the run uses, defaults included."""
        asked = {name: getattr(self, name) for name in self.__dataclass_fields__}
        return asked | {name: overlay(DEFAULTS[name], asked[name]) for name in ("layer1", "layer2", "layer3", "comparison")}


def read_series(spark: SparkSession, s: Mapping[str, Any], slot: str, stations: list[str] | None) -> Sourced:
    """A configured series with its errors and provenance, its stations and timespan selected."""
    origin = {"path": s["path"], "format": s["format"], "unit": s.get("units"), "variable": s.get("variable"), "time_coordinate": s.get("time_coordinate"), "station_coordinate": s.get("station_coordinate")}
    if s["format"] == "csv":
        day = s.get("date_column", "date")
        out = Sourced(readers.wide_csv(spark, s["path"], day, slot, stations, errors=True), origin | {"time_coordinate": day, "station_coordinate": "column name"}, steps=("parsed configured date column",))
    elif s["format"] == "parquet":
        out = Sourced(readers.long_table(spark.read.parquet(s["path"]), order=s.get("order_column"), slot=slot, errors=True), origin | {"variable": "value", "time_coordinate": "ts", "station_coordinate": "station_id"}).stations(stations)
    elif s["format"] == "netcdf":
        out = Sourced(readers.netcdf(spark, s["path"], s["variable"], s["time_coordinate"], s["station_coordinate"], stations, slot), origin, steps=("missing values decoded",))
    else:
        out = Sourced(readers.result_pickles(spark, _pickles(s, stations), bool(s.get("trusted")), s.get("role", "observation"), slot, errors=True), origin, steps=("contemporaneous step",))
    span = s.get("timespan", {})
    return out.timespan(str(span["start_date"]), str(span["end_date"])) if span.get("mode") == "range" else out


def supplied(spark: SparkSession, s: Mapping[str, Any], provider: str, stations: list[str] | None) -> DataFrame | None:
    """Metrics that a configured series brings: those stored in its pickles, or a CSV ``metrics_path`` of station_id, metric, value."""
    if s.get("metrics_path"):
        rows = spark.read.option("header", True).csv(s["metrics_path"]).select(F.trim("station_id").alias("station_id"), F.lit(provider).alias("provider"), "metric", F.expr("try_cast(value AS double)").alias("value"))
        return rows.where(F.col("station_id").isin(stations)) if stations else rows
    if s["format"] != "result_pickle":
        return None
    return readers.stored_metrics(spark, _pickles(s, stations), bool(s.get("trusted"))).withColumn("provider", F.lit(provider))


def _pickles(s: Mapping[str, Any], stations: list[str] | None) -> list[str]:
    return [f"{s['path']}/{name}_results.p" for name in stations] if stations else [f"{s['path']}/*_results.p"]


def screen(flow: DataFrame, settings: Mapping[str, Any] | None = None, signature_settings: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """All tables of one flow: checks, signatures, composite, network."""
    flow = primitives.prepared(flow)
    found = composite.screened(flow, settings, signature_settings)
    found["composite"] = written(found["composite"], "composite")
    found |= {
        "missing_intervals": primitives.missing_intervals(flow), "plateaus": layer1.plateaus(flow), "zero_spells": layer1.zero_flow_spells(flow), "duplicates": layer1.duplicate_groups(flow), "irregular_intervals": layer1.irregular_intervals(flow),
        "layer1_summary": written(contract.layer1_summary(flow, found, settings), "layer1_summary"), "layer2_summary": written(contract.layer2_summary(flow, found, signature_settings), "layer2_summary"),
        "availability": primitives.availability(flow), "counts": network.assessment_counts(found["composite"]), "triggers": network.trigger_summary(found["components"]), "ranking": network.attention_ranking(found["composite"]), "status": network.status_index(found["composite"]),
    }
    return found


def compare(
    reference: DataFrame, candidate: DataFrame, mode: str = "paired_overlap", settings: Mapping[str, Any] | None = None, daily: bool = False,
    screening: Mapping[str, Any] | None = None, signature_settings: Mapping[str, Any] | None = None,
) -> dict[str, DataFrame]:
    """All tables of a comparison. Stations that cannot be compared are in ``unfit`` with the reason, and in no other table.

    Independent timespans compare each side's own signatures, without its spike candidates by the
    layer 1 settings ``screening``; ``signature_settings``: of layer 2.
    """
    reasons = written(comparison.unfit(reference, candidate), "unfit")
    reference, candidate = (f.join(reasons.select("station_id"), "station_id", "left_anti") for f in (reference, candidate))
    out = {"unfit": reasons}
    pairs = comparison.paired(reference, candidate)
    if mode == "paired_overlap":
        reference, candidate = comparison.paired_flows(pairs)
        if daily:
            out["daily_metrics"] = comparison.daily_metrics(pairs)
    spikes: list[DataFrame | None] = [None, None]
    if mode == "independent_timespans":
        reference, candidate = primitives.prepared(reference), primitives.prepared(candidate)
        spikes = [composite.spikes_of(f, screening).where("status = 'candidate'") for f in (reference, candidate)]
    a, b = (comparison.signatures(f, x, signature_settings) for f, x in zip((reference, candidate), spikes, strict=True))
    parts = written(comparison.components(a, b, settings), "comparison")
    return out | {
        "comparison_components": parts, "comparison_composite": comparison.composite(parts, settings), "annual_differences": comparison.annual_differences(a["annual"], b["annual"]),
        "signature_summaries": comparison.signature_summaries(a["annual"], b["annual"]), "diagnostic_differences": comparison.diagnostic_differences(a["diagnostics"], b["diagnostics"]),
    }


def assess(series1: Sourced | DataFrame, series2: Sourced | DataFrame | None = None, settings: Settings | None = None, progress: Progress | None = None) -> dict[str, DataFrame]:
    """All tables that the settings ask for, of series at hand; nothing is written but what steps share.

    A station with a row that could not be read, without a date or not finite is in ``failures`` with the error's type and message and in
    no other table; the others go on. With ``run.continue_on_station_error = false`` the first failure is raised.
    The ``manifest`` has a row for every station. ``progress`` is told of each step.
    """
    log = Log(progress)
    settings = settings or Settings(run={"all_stations": True}, series1={"format": "parquet", "path": "memory", "units": "source units"})
    out, stations, _ = _assess(series1, series2, settings, log)
    return out | {"manifest": network.manifest(*stations, seconds=log.seconds())}


def _assess(series1: Sourced | DataFrame, series2: Sourced | DataFrame | None, c: Settings, log: Log, given: DataFrame | None = None) -> tuple[dict[str, DataFrame], tuple, DataFrame]:
    """The tables, what the manifest follows from, and the series that were assessed. ``given``: supplied metrics."""
    spark = (series1 if isinstance(series1, DataFrame) else series1.flow).sparkSession
    keep_on = bool(c.run.get("continue_on_station_error", True))
    sides = [x if isinstance(x, Sourced) else Sourced(x, {"format": "memory"}) for x in (series1, series2) if x is not None]
    used = {k: json.dumps(v, sort_keys=True, default=str) for k, v in c.effective().items()}
    everyone = written(sides[0].flow.select("station_id").distinct(), "stations")
    flows, failed = log.timed("isolate failures", lambda: failures.isolated(*[s.flow for s in sides], keep_on=keep_on))
    flow, second = flows[0], flows[1] if len(flows) > 1 else None
    status2 = readers.pair_status(everyone.withColumn("value", F.lit(None)), second)
    provenance = [s.without(failed.select("station_id").distinct()).table() for s in sides]
    out: dict[str, DataFrame] = {"pair_status": status2, "provenance": reduce(DataFrame.unionByName, provenance)}
    places = context_status = review = None
    every = flow
    if second is not None:
        every = flow.unionByName(second.join(flow.select("station_id").distinct(), "station_id", "left_semi"))
    if c.layers["layer1"]:
        every = primitives.prepared(every)
        out |= log.timed("screen", lambda: screen(every, c.layer1, c.layer2), used["layer1"])
    if c.layers["comparison"]:
        found = log.timed("compare", lambda: compare(flow, second, c.comparison.get("mode", "paired_overlap"), c.layer2.get("comparison"), bool(c.comparison.get("calculate_daily_metrics")), c.layer1, c.layer2), used["comparison"])
        out |= found
        unfit = found["unfit"].select("station_id", F.lit("series1").alias("series_slot"), F.lit("compare").alias("stage"), F.lit("ValueError").alias("error_type"), F.col("reason").alias("error_message"), F.lit(None).cast("long").alias("failed_rows"))
        failed = written(failed.unionByName(unfit.join(failed, "station_id", "left_anti")), "failures")
        if not keep_on:
            failures.stop(failed)
        if given is not None and c.comparison.get("provided_metrics", {}).get("include", DEFAULTS["comparison"]["provided_metrics"]["include"]):
            out["supplied_metrics"] = comparison.supplied_metrics(given)
    if c.layers["layer3"]:
        stations = context.validate_context(readers.context_csv(spark, c.context["path"])).where("rejection_reason = ''").withColumn("climate_code", F.lit(None).cast("string"))
        if c.context.get("cells"):
            legend = readers.climate_legend(spark, c.context["legend"])
            stations = context.attach_climate(stations.drop("climate_code"), spark.read.parquet(c.context["cells"]), legend, int(c.context["width"]), int(c.context["height"]))
        places = stations
        out |= {f"context_{k}": v for k, v in log.timed("context", lambda: context.network_context(flow, stations, c.layer3, screening=c.layer1, signature_settings=c.layer2, composite=out["composite"].where("series_slot = 'series1'")), used["layer3"]).items()}
        found = {k.removeprefix("context_"): v for k, v in out.items() if k.startswith("context_")}
        out |= {"layer3_summary": contract.context_summary(found, c.layer3), "layer3_evidence": contract.context_evidence(found, c.layer3)}
    if c.layers["layer1"]:
        known = {slot: {"name": s.get("name", ""), "role": s.get("role", ""), "units": s.get("units", "")} for slot, s in (("series1", c.series1), ("series2", c.series2))}
        compared = None
        if c.layers["comparison"]:
            compared = out["comparison_composite"].join(comparison.coverage(flow, second), "station_id", "left")
        out["station_summary"] = log.timed("summary", lambda: written(contract.station_summary(every, out["layer1_summary"], out["layer2_summary"] if c.layers["layer2"] else None, out.get("layer3_summary"), compared, known, places, out["provenance"]), "station_summary"))
        review = network.requires_review(out["station_summary"])
        context_status = out["station_summary"].where("series_slot = 'series1'").select("station_id", "layer3_status")
    out["failures"] = failed
    return out, (status2, flow, failed, review, context_status), every


def _shown(out: dict[str, DataFrame], detailed: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, dict[str, DataFrame]]]:
    """The series and tables of each layer's evidence report; tables without a series belong to the second one in comparisons, else to the first."""
    series, first, second = out["composite"].select("station_id", "series_slot"), F.lit("series1").alias("series_slot"), F.lit("series2").alias("series_slot")
    shown = {"layer1": (series, detailed), "layer2": (series, {n: out[n] for n in ("annual", "monthly", "events", "representative")})}
    if "comparison_components" in out:
        names = [n for n in ("comparison_components", "annual_differences", "signature_summaries", "diagnostic_differences", "daily_metrics", "supplied_metrics") if n in out]
        shown["comparison"] = (out["comparison_composite"].select("station_id", second), {n: out[n].select("station_id", second, *[c for c in out[n].columns if c != "station_id"]) for n in names})
    if "layer3_evidence" in out:
        df = out["layer3_evidence"]
        shown["layer3"] = (out["context_combined"].select("station_id", first), {"context_evidence": df.select("station_id", first, *[c for c in df.columns if c not in ("station_id", "series_slot")])})
    return shown


#: Sections whose settings shaped a table, by how its name begins; all others go by layer 1.
SECTIONS = {"context_": "layer3", "layer3_": "layer3", "comparison_": "comparison", "daily_": "comparison", "annual": "layer2", "monthly": "layer2", "events": "layer2", "representative": "layer2", "layer2_": "layer2", "supplied_": "comparison", "unfit": "comparison", "provenance": "series1", "pair_": "run", "manifest": "run", "failures": "run"}


def run(spark: SparkSession, settings: Settings, progress: Progress | None = None) -> dict[str, DataFrame]:
    """Runs and writes everything the settings ask for; gives the tables, the manifest among them.

    Tables go to a store (``sinks.store``) below ``output.directory``: earlier runs' rows of other stations stay, and the run
    counts from the moment its stations are committed, last. ``progress`` is told of each step and table.
    """
    log = Log(progress)
    names = [s.strip() for s in settings.run.get("station_ids", []) if s.strip()] or None
    if settings.run.get("station_file"):
        names = readers.station_file(Path(settings.run["station_file"]).read_text().splitlines())
    first = log.timed("open series1", lambda: read_series(spark, settings.series1, "series1", names))
    second = log.timed("open series2", lambda: read_series(spark, settings.series2, "series2", None)) if settings.series2.get("enabled") else None
    given = [m for m in (supplied(spark, settings.series1, "reference", names), supplied(spark, settings.series2, "candidate", names)) if m is not None] if settings.layers["comparison"] else []
    out, stations, every = _assess(first, second, settings, log, reduce(DataFrame.unionByName, given) if given else None)
    where = settings.output.get("directory")
    if not where:
        return out | {"manifest": network.manifest(*stations, seconds=log.seconds())}
    effective, run_id, detailed = settings.effective(), store.new_run(), {}
    if settings.layers["layer1"]:
        detailed = evidence.layer1_evidence(every, settings.layer1, out["candidates"])
        out |= {f"evidence_{n}": df for n, df in detailed.items()}
    used = {k: json.dumps(v, sort_keys=True, default=str) for k, v in effective.items()}
    for name, df in out.items():
        store.write(df, f"{where}/tables", name, run_id, log, used[next((v for k, v in SECTIONS.items() if name.startswith(k)), "layer1")])
    tables.write_settings(effective, spark, f"{where}/settings")
    if settings.layers["layer1"]:
        if settings.output.get("write_csv"):
            log.timed("csv", lambda: tables.write_csv({k: out[k] for k in ("components", "events", *[f"evidence_{n}" for n in detailed])}, f"{where}/csv"), used["output"])
        if settings.output.get("write_text", True):
            log.timed("reports", lambda: tables.write_text(reports.station_reports(out["composite"], out["components"], out["record"], out["availability"], out["provenance"]), f"{where}/reports"), used["output"])
            log.timed("network summary", lambda: evidence_text.write_in_order(evidence_text.network_lines(out["station_summary"], out["ranking"], out["triggers"]), f"{where}/network"), used["output"])
            for layer, (series, shown) in _shown(out, detailed).items():
                log.timed(f"{layer} evidence", lambda: evidence_text.write_reports(evidence_text.evidence_lines(series, shown, layer), f"{where}/evidence/{layer}"), used["output"])  # noqa: B023
        mode = settings.output.get("html_mode", "needs_review")
        if mode != "none":
            log.timed("pages", lambda: tables.write_text(pages.series_pages(every, out["composite"], out["components"], out["candidates"], out["missing_intervals"], out["plateaus"], mode), f"{where}/pages"), used["output"])
    out["manifest"] = written(network.manifest(*stations, seconds=log.seconds()), "manifest")
    store.write(out["manifest"], f"{where}/tables", "manifest", run_id, log, used["run"])
    if settings.layers["layer1"]:
        reports.status_lines(out["manifest"], out["status"]).coalesce(1).write.mode("overwrite").text(f"{where}/status")
    out["log"] = log.table(spark, run_id)
    if settings.output.get("write_log", True):
        out["log"].write.mode("append").parquet(f"{where}/log")
        store.log_lines(out["log"]).coalesce(1).write.mode("overwrite").text(f"{where}/log_text")
    store.commit(out["manifest"], f"{where}/tables", run_id)
    return out
