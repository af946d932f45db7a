"""Reports as lines of text: each line is a row, written in order by a sort within the partition of its report.

No row and no task ever holds a whole report, however much evidence a station has: tasks stream sorted lines to the file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.functions.numeric import ratio

WIDTH = 80
KEYS = ["station_id", "series_slot"]
#: What a line is sorted by within its report: group, record, place.
PLACE = ["part", "record", "place"]
#: Longest value beside its label, and the width of those below it.
BESIDE, BELOW = 72, 68


def _label(name: str) -> str:
    return name.replace("_", " ").capitalize()


def _field(label: str, value: Column, indent: int = 4) -> Column:
    left = " " * indent + label + " "
    return F.concat(F.lit(left + "." * max(1, 48 - len(left)) + " "), value)


def _text(c: str, kind: str) -> Column:
    """A value as a report shows it; null stays null, which leaves the line out."""
    x = F.col(f"`{c}`")
    if kind in ("double", "float"):
        return F.when(x == F.floor(x), F.format_string("%d", x.cast("long"))).otherwise(F.format_string("%.3f", x)) if kind == "double" else F.format_string("%.3f", x)
    if kind.startswith("timestamp") or kind == "date":
        return F.date_format(x, "d MMM yyyy")
    if kind.startswith(("array", "map", "struct")):
        return F.to_json(x)
    return x.cast("string")


def _wrapped(text: Column) -> Column:
    """A text in lines of at most ``BELOW`` characters, cut at blanks where there are any."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(\S{{{BELOW}}}|.{{1,{BELOW}}})(?:\s+|$)"), 1), lambda part: F.concat(F.lit(" " * 6), F.rtrim(part)))


def _records(df: DataFrame, part: int, order: Sequence[str]) -> DataFrame:
    """A line for each value that is given, records numbered where a series has several."""
    columns = [(c, t) for c, t in df.dtypes if c not in KEYS]
    w = Window.partitionBy(*KEYS)
    rows = df.withColumns({"record": F.row_number().over(w.orderBy(*(order or [F.to_json(c) if "map<" in t else F.col(c) for c, t in columns]))), "records": F.count(F.lit(1)).over(w)})
    lines = [F.array(F.when(F.col("records") > 1, F.concat(F.lit("  Record "), F.col("record").cast("string"))))]
    for c, kind in columns:
        text = _text(c, kind)
        long = F.concat(F.array(F.lit(" " * 4 + _label(c) + ":")), _wrapped(text))
        lines.append(F.when(text.isNotNull(), F.when(F.length(text) <= BESIDE, F.array(_field(_label(c), text))).otherwise(long)))
    lines.append(F.array(F.when(F.col("record") < F.col("records"), F.lit(""))))
    every = F.filter(F.flatten(F.array_compact(F.array(*lines))), lambda x: x.isNotNull())
    return rows.select(*KEYS, F.lit(part).alias("part"), "record", F.posexplode(every).alias("place", "value"))


def evidence_lines(series: DataFrame, tables: Mapping[str, DataFrame], title: str, orders: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Lines of an evidence report for each of ``series`` (station_id, series_slot): its tables one after the other.

    A series without any row says so. ``orders``: what the records of a table are sorted by, else all columns.
    """
    series = series.select(*KEYS).distinct()

    def fixed(of: DataFrame, part: int, lines: Sequence[Column | str]) -> DataFrame:
        texts = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
        return of.select(*KEYS, F.lit(part).alias("part"), F.lit(0).alias("record"), F.posexplode(texts).alias("place", "value"))

    double, single, found = "=" * WIDTH, "-" * WIDTH, None
    out = fixed(series, 0, [double, f"{title.upper()} EVIDENCE".center(WIDTH), double, "", _field("Station ID", F.col("station_id"), 2), _field("Series", F.col("series_slot"), 2)])
    for i, (name, df) in enumerate(tables.items(), 1):
        df = df.join(series, KEYS, "left_semi")
        some = df.select(*KEYS).distinct()
        out = out.unionByName(fixed(some, 2 * i, ["", single, name.replace("_", " ").upper(), single])).unionByName(_records(df, 2 * i + 1, (orders or {}).get(name, [])))
        found = some if found is None else found.unionByName(some)
    end = 2 * len(tables) + 2
    none = series if found is None else series.join(found.distinct(), KEYS, "left_anti")
    out = out.unionByName(fixed(none, end, ["", "  No detailed evidence was recorded."]))
    return out.unionByName(fixed(series, end + 1, ["", double, "End of evidence report.".center(WIDTH), double]))


def network_lines(summary: DataFrame, ranking: DataFrame, triggers: DataFrame) -> DataFrame:
    """Lines of the summary of a network: counts, the first twenty that ask for attention, triggers, and a block for each series.

    ``summary``: as ``contract.station_summary`` gives it. Sort by ``PLACE`` and the keys; only counts and the
    rows of checks are small, the blocks stay spread over tasks.
    """
    double, single = "=" * WIDTH, "-" * WIDTH
    grade = F.coalesce("layer1_class", F.lit("Not assessed"))
    worst = F.max(F.when(grade == "Needs review", 3).when(grade == "Minor concerns", 2).when(grade == "No review needed", 1).otherwise(0))
    levels = {3: "Needs review", 2: "Minor concerns", 1: "No review needed"}
    known = [F.count_if(grade == g).alias(f"s{k}") for k, g in levels.items()]
    stations = summary.groupBy("station_id").agg(worst.alias("w"), F.count(F.lit(1)).alias("n"), *known, F.count_if(~grade.isin(*levels.values())).alias("s0"))
    counts = stations.agg(F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"), *[F.count_if(F.col("w") == k).alias(f"w{k}") for k in range(4)], *[F.sum(f"s{k}").alias(f"s{k}") for k in range(4)])

    def number(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("string")

    head = [
        *map(F.lit, (double, "NETWORK SUMMARY".center(WIDTH), double, "")), _field("Unique stations", number("u"), 2), _field("Station-series assessments", number("n"), 2), F.lit(""), F.lit("  Physical stations"),
        _field("Needs review (one or more series)", number("w3")), _field("Minor concerns only", number("w2")), _field("No Layer 1 concerns", number("w1")), _field("Not assessed", number("w0")), F.lit(""), F.lit("  Independently assessed series"),
        _field("Needs review", number("s3")), _field("Minor concerns", number("s2")), _field("No review needed", number("s1")), _field("Not assessed", number("s0")),
    ]
    blank = [F.lit("").alias("station_id"), F.lit("").alias("series_slot")]

    def block(part: int, df: DataFrame, lines: list[Column], record: Column | None = None, keys: list | None = None) -> DataFrame:
        return df.select(*(keys or blank), F.lit(part).alias("part"), (F.lit(0) if record is None else record).cast("int").alias("record"), F.posexplode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("place", "value"))

    def titled(part: int, title: str, *more: str) -> DataFrame:
        return block(part, summary.sparkSession.range(1), [F.lit(x) for x in ("", single, title.upper(), single, *more)])

    def share(x: Column) -> Column:
        return F.when(x.isNotNull(), F.format_string("%.1f%%", x)).otherwise("-")

    percent = share(F.col("layer1_score_percent"))
    asking = ranking.where("attention_rank > 0")
    line = F.format_string("  %4d  %-20s  %-18s  %-17s  %7s", "attention_rank", F.substring("station_id", 1, 20), F.substring("series_slot", 1, 18), F.substring("layer1_class", 1, 17), percent)
    left = asking.agg(F.count(F.lit(1)).alias("k"))
    rest = F.when(F.col("k") == 0, F.lit("  No station-series assessments require Layer 1 attention.")).when(F.col("k") > 20, F.concat(F.lit("  "), (F.col("k") - 20).cast("string"), F.lit(" additional concerning station-series are in the ranking table.")))
    rate = share(100.0 * ratio(F.col("triggered_count"), F.col("assessable_count")))
    trigger = F.format_string("  %-25s%10d%7d%8d%11d%10s", F.upper(F.replace(F.col("check"), F.lit("_"), F.lit(" "))), "assessable_count", "tier1_count", "tier2_count", "triggered_count", rate)
    status = F.concat(grade, F.when(F.col("layer1_assessment_scope") == "Focused", " (selected checks only)").otherwise(""))

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("not provided"))

    each = [
        F.lit(""), F.lit(single), F.concat_ws("  -  ", "station_id", F.coalesce("series_name", "series_slot")), F.lit(single), _field("Series role", shown("series_role"), 2), _field("Layer 1 status", status, 2), _field("Assessment scope", shown("layer1_assessment_scope"), 2),
        _field("Enabled/total checks", F.concat_ws("/", shown("layer1_enabled_check_count"), shown("layer1_total_composite_check_count")), 2), _field("Layer 1 score", shown("layer1_score"), 2), _field("Layer 1 normalized score", percent, 2), _field("Layer 3 status", shown("layer3_status"), 2),
    ]
    if "layer3_context_agreement_class" in summary.columns:
        each.append(_field("Contextual agreement", F.col("layer3_context_agreement_class"), 2))
    parts = [
        block(0, counts, head), titled(1, "Stations requiring most attention", "  Rank  Station               Series              Status             Score"), block(2, asking.where("attention_rank <= 20"), [line], F.col("attention_rank")), block(3, left, [rest]),
        titled(4, "Layer 1 checks causing concerns", "  Trigger rate uses enabled, assessable station-series only.", "", "  Check                    Assessable  Tier 1  Tier 2  Triggered      Rate"), block(5, triggers, [trigger], F.col("place")),
        block(6, summary, each, keys=[F.col("station_id"), F.col("series_slot")]), block(7, summary.sparkSession.range(1), [F.lit(""), F.lit(double)]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_reports(lines: DataFrame, path: str) -> None:
    """A file for each series, ``path/name=<station>_<slot>``: its lines meet in one task and stream out in order."""
    named = lines.withColumn("name", F.concat_ws("_", *KEYS))
    named.repartition("name").sortWithinPartitions("name", *PLACE).select("name", "value").write.mode("overwrite").partitionBy("name").text(path)


def write_in_order(lines: DataFrame, path: str) -> None:
    """One long report as part files in their order."""
    lines.orderBy("part", *KEYS, "record", "place").select("value").write.mode("overwrite").text(path)
