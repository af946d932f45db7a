"""Text reports, 80 columns wide, built as columns so that every station's is written by the task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 80


def _rule(sign: str = "-") -> str:
    return sign * WIDTH


def _field(label: str, value: Column) -> Column:
    left = f"  {label} "
    return F.concat(F.lit(left + "." * max(1, 48 - len(left)) + " "), F.coalesce(value.cast("string"), F.lit("not provided")))


def _part(title: str, lines: list[Column]) -> list[Column]:
    return [F.lit(""), F.lit(_rule()), F.lit(title), F.lit(_rule()), *lines]


def _number(c: str, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", F.col(c))


def _span(start: Column, end: Column) -> Column:
    """Days of a span, null where neither is known."""
    day = [F.date_format(x.cast("timestamp"), "d MMM yyyy") for x in (start, end)]
    return F.when(start.isNotNull() | end.isNotNull(), F.concat_ws(" to ", *[F.coalesce(d, F.lit("open")) for d in day]))


def station_reports(composite: DataFrame, components: DataFrame, record: DataFrame, availability: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """(name, text): a screening summary for each series, of bounded length.

    With ``provenance`` the requested timespan and the calendar of the source stand beside the selected and the valid days.
    """
    keys = ["station_id", "series_slot"]
    line = F.format_string("  %-22s %-15s %8s  weight %s", "check", "tier", F.coalesce(_number("raw_value", 3), F.lit("-")), "weight")
    checks = components.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("checks"))
    rows = composite.join(checks, keys).join(record, keys, "left").join(availability.select(*keys, "first_valid", "last_valid", "calendar_count"), keys, "left")
    asked: list[Column] = []
    if provenance is not None:
        rows = rows.join(provenance.select(*keys, "provenance"), keys, "left")
        p = F.col("provenance")
        full = F.when(p["requested_mode"] == "full", F.lit("full record"))
        short = F.when(F.length(p["path"]) > 32, F.concat(F.lit("..."), F.substring(p["path"], -29, 29))).otherwise(p["path"])
        asked = [_field("Input", short), _field("Requested timespan", F.coalesce(full, _span(p["requested_start"], p["requested_end"]))), _field("Source calendar", _span(p["source_start"], p["source_end"])), _field("Selected calendar", _span(p["selected_start"], p["selected_end"]))]
    status = F.concat("layer1_class", F.when(F.col("assessment_scope") == "Focused", " (selected checks only)").otherwise(""))
    parts = [
        F.lit(_rule("=")), F.lit("SCREENING SUMMARY".center(WIDTH)), F.lit(_rule("=")), F.lit(""),
        *_part("STATION", [_field("Station ID", F.col("station_id")), _field("Series", F.col("series_slot")), *asked, _field("First to last valid", F.concat_ws(" to ", F.col("first_valid").cast("date").cast("string"), F.col("last_valid").cast("date").cast("string"))), _field("Valid observations", F.col("valid_count"))]),
        *_part("FINAL ASSESSMENT", [
            _field("Assessment scope", F.col("assessment_scope")), _field("Enabled composite checks", F.concat_ws("/", "enabled_check_count", "total_composite_check_count")), _field("Assessable enabled checks", F.concat_ws("/", "assessable_checks", "enabled_check_count")),
            _field("Evidence coverage", F.concat(_number("evidence_coverage_percent", 1), F.lit("%"))), _field("Review status", status), _field("Score", F.col("layer1_score")), _field("Normalized score", F.concat(_number("layer1_score_percent", 1), F.lit("%"))),
        ]),
        *_part("FINDINGS", [F.col("checks")]),
        *_part("FLOW", [_field(label, _number(c, 3)) for label, c in (("Mean", "mean_flow"), ("Median", "median_flow"), ("Minimum", "minimum_flow"), ("Maximum", "maximum_flow"), ("Q05", "q05_low_flow"), ("Q95", "q95_high_flow"))]),
        F.lit(""), F.lit(_rule("=")), F.lit("This is a screening summary. A class that asks for review recommends inspection;"), F.lit("it does not mean that the data are wrong."), F.lit(_rule("=")),
    ]
    return rows.select(F.concat_ws("_", *keys).alias("name"), F.concat_ws("\n", *parts).alias("text"))


def status_lines(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """One tab-separated line per station: run status and the assessment of either series."""
    def said(c: str) -> Column:
        x = F.lower(F.col(c))
        return F.when(x.isin("needs review", "review"), "Needs review").when(x == "minor concerns", "Minor concerns").when(x == "no review needed", "No review required").otherwise("Not assessed")

    rows = manifest.join(index, "station_id", "left")
    return rows.select(F.concat_ws("\t", "station_id", "status", F.lit("series1"), said("series1_class"), F.lit("series2"), said("series2_class")).alias("value"), "station_id").orderBy("station_id").select("value")
