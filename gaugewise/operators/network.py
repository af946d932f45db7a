"""Network-level counts, attention ranking, trigger rates and the manifest of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.functions.numeric import ratio
from gaugewise.functions.shared import written
from gaugewise.operators.primitives import KEYS

# Classes by how much attention they ask for.
PRIORITY = {"Needs review": 3, "Minor concerns": 2, "No review needed": 1, "Not assessable": 0}


def _priority():
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair]), F.col("layer1_class")), F.lit(0))


def assessment_counts(summary: DataFrame) -> DataFrame:
    """Series in each class, and stations by their worst class."""
    ranked = summary.withColumn("priority", _priority())
    worst = ranked.groupBy("station_id").agg(F.max_by("layer1_class", "priority").alias("layer1_class"))
    series = ranked.groupBy("layer1_class").agg(F.count(F.lit(1)).alias("series_count"))
    stations = worst.groupBy("layer1_class").agg(F.count(F.lit(1)).alias("station_count"))
    zero = F.lit(0).cast("long")
    return series.join(stations, "layer1_class", "full_outer").select("layer1_class", F.coalesce("series_count", zero).alias("series_count"), F.coalesce("station_count", zero).alias("station_count"))


def attention_ranking(summary: DataFrame) -> DataFrame:
    """Series in the order in which they ask for attention; only those of concern have a rank, others 0.

    A range partitioning sorts the series of concern, and each task's first rank follows from the
    numbers of rows before it, so that no task holds them all.
    """
    rows = summary.withColumn("priority", _priority()).select(*KEYS, "layer1_class", "layer1_score_percent", "priority")
    order = [F.desc("priority"), F.desc_nulls_last("layer1_score_percent"), F.asc("station_id"), F.asc("series_slot")]
    of_concern = rows.where("priority >= 2").repartitionByRange(*order).sortWithinPartitions(*order)
    # the id of a row holds its task's number above 33 bits, and its place in the task below
    placed = written(of_concern.withColumn("at", F.monotonically_increasing_id()).withColumns({"task": F.shiftright("at", 33), "place": F.col("at").bitwiseAND((1 << 33) - 1)}), "ranking")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    offsets = placed.groupBy("task").agg(F.count(F.lit(1)).alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = placed.join(F.broadcast(offsets), "task").select(*KEYS, "layer1_class", "layer1_score_percent", (F.col("offset") + F.col("place") + 1).cast("int").alias("attention_rank"))
    return ranked.unionByName(rows.where("priority < 2").select(*KEYS, "layer1_class", "layer1_score_percent", F.lit(0).alias("attention_rank")))


def trigger_summary(components: DataFrame) -> DataFrame:
    """How often each check is above Tier 3 among the series it could assess, most frequent first; repeated rows count once."""
    once = components.dropDuplicates([*KEYS, "check"])
    hit = F.col("assessable") & F.col("tier").isin("Tier 1", "Tier 2")
    s = once.groupBy("check").agg(F.count_if("assessable").alias("assessable_count"), F.count_if(hit & (F.col("tier") == "Tier 1")).alias("tier1_count"), F.count_if(hit & (F.col("tier") == "Tier 2")).alias("tier2_count"), F.count_if(hit).alias("triggered_count"))
    rate = ratio(100.0 * F.col("triggered_count"), F.col("assessable_count"))
    w = Window.orderBy(F.desc("triggered_count"), F.desc_nulls_last("trigger_rate_percent"), "check")  # one row per check
    return s.withColumn("trigger_rate_percent", rate).withColumn("place", F.row_number().over(w))


def manifest(stations: DataFrame, flow: DataFrame, failures: DataFrame | None = None, review: DataFrame | None = None, context: DataFrame | None = None, seconds: float | None = None) -> DataFrame:
    """One row per selected station: completed, skipped (no valid value) or failed, with the error's type and message.

    ``stations``: station_id and, if known, series2_status; ``failures``: as ``failures.station_failures`` gives them, the
    first of a station by stage ("load" before others) and slot counts. ``review``: station_id and review_required of the stations that were
    assessed; ``context``: station_id and layer3_status. ``seconds``: what the run took, of which each
    station has the share of its rows, as all are screened at once. A second series was not attempted
    where the first could not be assessed.
    """
    rows = flow.where("series_slot = 'series1'").groupBy("station_id").agg(F.count("value").alias("valid_count"), F.count(F.lit(1)).alias("n"))
    status2 = F.col("series2_status") if "series2_status" in stations.columns else F.lit("disabled")
    out = stations.groupBy("station_id").agg(F.max(status2).alias("series2")).join(rows, "station_id", "left")
    if failures is None:
        out = out.withColumn("f", F.lit(None).cast("struct<stage: string, error_type: string, error_message: string>"))
    else:
        first = F.min_by(F.struct("stage", "error_type", "error_message"), F.struct(F.col("stage") != "load", "series_slot"))
        out = out.join(failures.groupBy("station_id").agg(first.alias("f")), "station_id", "left")
    out = out.join(review.groupBy("station_id").agg(F.bool_or("review_required").alias("asks")), "station_id", "left") if review is not None else out.withColumn("asks", F.lit(False))
    out = out.join(context.groupBy("station_id").agg(F.min("layer3_status").alias("placed")), "station_id", "left") if context is not None else out.withColumn("placed", F.lit(None).cast("string"))
    valid = F.coalesce("valid_count", F.lit(0).cast("long"))
    unread = F.coalesce(F.col("f.stage") == "load", F.lit(False))
    status = F.when(unread, "failed").when(valid == 0, "skipped").when(F.col("f").isNotNull(), "failed").otherwise("completed")
    done, skipped = status == "completed", status == "skipped"
    every = 0 if seconds is None else rows.agg(F.sum("n")).first()[0]
    share = F.lit(seconds) * F.col("n") / F.lit(every or 1)
    return out.select(
        "station_id", status.alias("status"), F.when(unread | skipped, "not_attempted").otherwise(F.col("series2")).alias("series2_status"), (done & F.coalesce("asks", F.lit(False))).alias("review_required"),
        F.when(skipped, "NoValidSeries1Values").otherwise(F.col("f.error_type")).alias("error_type"), F.when(skipped, "no valid observations").otherwise(F.col("f.error_message")).alias("error_message"),
        F.when(done, F.coalesce("placed", F.lit("not_assessed"))).otherwise("not_assessed").alias("layer3_status"), valid.alias("valid_count"), *([] if seconds is None else [F.coalesce(share, F.lit(0.0)).alias("elapsed_seconds")]),
    )


def requires_review(summary: DataFrame) -> DataFrame:
    """Stations with a class that asks for review; "Strong review" of a comparison has a column of its own."""
    classes = [c for c in summary.columns if c.endswith("_class")]
    asks = F.exists(F.array(*[F.lower(F.col(c)) for c in classes]), lambda x: x.isin("needs review", "review"))
    strong = F.exists(F.array(*[F.lower(F.col(c)) for c in classes]), lambda x: x == "strong review")
    flags = summary.withColumns({"asks": F.coalesce(asks, F.lit(False)), "strong": F.coalesce(strong, F.lit(False))})
    return flags.groupBy("station_id").agg(F.bool_or("asks").alias("review_required"), F.bool_or("strong").alias("strong_review"))


def status_index(summary: DataFrame) -> DataFrame:
    """One line per station: the class of either series side by side."""
    def of(slot: str):
        return F.max(F.when(F.col("series_slot") == slot, F.col("layer1_class")))

    return summary.groupBy("station_id").agg(of("series1").alias("series1_class"), of("series2").alias("series2_class"))
