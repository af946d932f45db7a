"""Shared steps over flow(station_id, series_slot, ts, value, src_pos).

Every window is partitioned by station and slot, so one exchange serves all of them. Records are
taken as delivered: duplicates, disorder and nulls are evidence and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaugewise.functions.numeric import quantile, ratio
from gaugewise.functions.shared import once

KEYS = ["station_id", "series_slot"]
#: Source positions of a series that one task sorts.
STRETCH = 1 << 16


def P() -> WindowSpec:
    """All rows of a series."""
    return Window.partitionBy(*KEYS)


def ROWS() -> WindowSpec:
    """A series in the order of its positions."""
    return P().orderBy("pos")


def SO_FAR() -> WindowSpec:
    """From a series' first row to the current one."""
    return ROWS().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def flow_of(df: DataFrame, slot: str = "series1", order: str | None = None) -> DataFrame:
    """Adapts (station_id, ts, value) to a flow; NaN becomes null. ``order`` names the source position."""
    position = F.col(order).cast("long") if order else F.lit(None).cast("long")
    value = F.col("value").cast("double")
    return df.select(
        F.col("station_id").cast("string").alias("station_id"),
        F.lit(slot).alias("series_slot"),
        F.col("ts"),
        F.when(~F.isnan(value), value).alias("value"),
        position.alias("src_pos"),
    )


def prepared(flow: DataFrame) -> DataFrame:
    """The flow with its positions written once; tables that checks share are then written once, too.

    For operators that read a flow many times. Whatever is derived from the result is an ordinary flow.
    """
    if hasattr(flow, "prepared") or flow.isStreaming:
        return flow
    memo: dict = {}
    held = flow.select("*")
    held.prepared = memo
    out = positioned(held).select(flow.columns)
    out.prepared = memo
    return out


@once
def positioned(flow: DataFrame) -> DataFrame:
    """Adds pos (1.. in stable time order) and first_pos, last_pos of non-null values (null if none)."""
    out = flow.withColumn("pos", F.row_number().over(P().orderBy("ts", "src_pos")))
    given = F.when(F.col("value").isNotNull(), F.col("pos"))
    return out.withColumns({"first_pos": F.min(given).over(P()), "last_pos": F.max(given).over(P())})


def per_series(flow: DataFrame, **values: Column) -> DataFrame:
    """Adds aggregates of each series, handed to all tasks: unlike a window over a series, no task takes in all of its rows."""
    some = flow.groupBy(*KEYS).agg(*[v.alias(n) for n, v in values.items()]).withColumnsRenamed({k: f"{k}_of" for k in KEYS})
    same = F.col("station_id").eqNullSafe(F.col("station_id_of")) & F.col("series_slot").eqNullSafe(F.col("series_slot_of"))
    return flow.join(F.broadcast(some), same).drop(*[f"{k}_of" for k in KEYS])


def out_of_order(flow: DataFrame) -> DataFrame:
    """Of each series the rows earlier than the row before by source position; rows without one play no part.

    Stretches of STRETCH positions are sorted by themselves, then each one's first row meets the last of the stretch before.
    """
    placed = flow.where("src_pos is not null").withColumn("stretch", F.floor(F.col("src_pos") / STRETCH))
    back = F.col("ts") < F.lag("ts").over(Window.partitionBy(*KEYS, "stretch").orderBy("src_pos"))
    ends = placed.withColumn("back", back).groupBy(*KEYS, "stretch").agg(F.count_if("back").alias("n"), F.min_by("ts", "src_pos").alias("first"), F.max_by("ts", "src_pos").alias("last"))
    met = F.col("first") < F.lag("last").over(P().orderBy("stretch"))
    return ends.withColumn("met", met).groupBy(*KEYS).agg((F.sum("n") + F.count_if("met")).alias("out_of_order_rows"))


def valid_record(flow: DataFrame) -> DataFrame:
    """Rows from the first to the last non-null value; nulls between them stay."""
    return positioned(flow).where("pos between first_pos and last_pos").drop("first_pos", "last_pos")


def daily_step() -> Column:
    """True where the row before is exactly one day earlier."""
    return F.coalesce(F.col("ts") - F.lag("ts").over(ROWS()) == F.expr("interval 1 day"), F.lit(False))


def missing_intervals(flow: DataFrame) -> DataFrame:
    """Runs of null rows with their position: leading, internal, trailing, or all of a record without values."""
    rows = positioned(flow).withColumn("grp", F.col("pos") - F.row_number().over(Window.partitionBy(*KEYS, F.col("value").isNull()).orderBy("pos")))
    runs = rows.where("value is null").groupBy(*KEYS, "grp").agg(
        F.min(F.struct("pos", "ts"))["ts"].alias("start_ts"), F.max(F.struct("pos", "ts"))["ts"].alias("end_ts"),
        F.count(F.lit(1)).alias("missing_count"), F.min("pos").alias("at"), F.first("first_pos").alias("first_pos"), F.first("last_pos").alias("last_pos"),
    )
    position = F.when(F.col("first_pos").isNull(), "all").when(F.col("at") < F.col("first_pos"), "leading").when(F.col("at") > F.col("last_pos"), "trailing").otherwise("internal")
    return runs.select(*KEYS, "start_ts", "end_ts", "missing_count", (F.datediff("end_ts", "start_ts") + 1).alias("calendar_duration_days"), position.alias("position"))


def missingness(flow: DataFrame) -> DataFrame:
    """Null rows before, inside and after the valid record, and its rows."""
    null, pos, first, last = F.col("value").isNull(), F.col("pos"), F.col("first_pos"), F.col("last_pos")
    inside = pos.between(first, last)
    return positioned(flow).groupBy(*KEYS).agg(
        F.count_if(null & (pos < first)).alias("leading_missing"), F.count_if(null & inside).alias("internal_missing"),
        F.count_if(null & (pos > last)).alias("trailing_missing"), F.count_if(null).alias("total_missing"),
        F.count_if(inside).alias("record_rows"), F.count(F.lit(1)).alias("source_rows"),
    )


def summary(flow: DataFrame) -> DataFrame:
    """Count, extremes, quantiles, mean and dates of the non-null values."""
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return (
        flow.where("value is not null").groupBy(*KEYS)
        .agg(F.count("value").alias("n"), F.min("value").alias("minimum"), q.alias("q"), F.avg("value").alias("mean"), F.max("value").alias("maximum"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select(*KEYS, "n", "minimum", F.col("q")[0].alias("q05"), F.col("q")[1].alias("median"), "mean", F.col("q")[2].alias("q95"), "maximum", "first_ts", "last_ts")
    )


@once
def monthly_statistics(flow: DataFrame, minimum_valid_days: int = 10) -> DataFrame:
    """Every calendar month of the valid record: days with a value, and median, q25, q75, q90 of values clipped at 0.

    Values of one day collapse to their median; months of fewer than ``minimum_valid_days`` days have nulls.
    """
    day = F.col("ts").cast("date")
    # the days of valid_record, where undated rows come first, without a position for every row
    given = F.col("value").isNotNull()
    inside = per_series(flow, lo=F.min(F.when(given, F.col("ts"))), hi=F.max(F.when(given, F.col("ts"))), undated=F.bool_or(given & F.col("ts").isNull()))
    inside = inside.where((F.col("undated") | (F.col("ts") >= F.col("lo"))) & (F.col("ts") <= F.col("hi")))
    # equal values of a day are counted before they meet
    daily = inside.groupBy(*KEYS, day.alias("d"), "value").agg(F.count(F.lit(1)).alias("n")).groupBy(*KEYS, "d").agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("v"))
    month = F.trunc("d", "month")
    clipped = F.when(F.col("v").isNotNull(), F.greatest("v", F.lit(0.0)))
    stats = daily.groupBy(*KEYS, month.alias("month")).agg(F.count("v").alias("valid_days"), F.percentile(clipped, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9)])).alias("q"))
    bounds = daily.groupBy(*KEYS).agg(F.min(month).alias("first"), F.max(month).alias("last"))
    spine = bounds.select(*KEYS, F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month"))
    enough = F.coalesce(F.col("valid_days"), F.lit(0)) >= minimum_valid_days
    return spine.join(stats, [*KEYS, "month"], "left").select(
        *KEYS, "month", F.coalesce("valid_days", F.lit(0)).cast("long").alias("valid_days"),
        *[F.when(enough, F.col("q")[i]).alias(n) for i, n in enumerate(("q25", "median", "q75", "q90"))],
    )


def log_offset(flow: DataFrame) -> DataFrame:
    """A tenth of the 10 % quantile of the positive values, 1e-6 at least."""
    low = quantile(F.when(F.col("value") > 0, F.col("value")), 0.1)
    return flow.groupBy(*KEYS).agg(F.greatest(F.coalesce(low * 0.1, F.lit(1e-6)), F.lit(1e-6)).alias("log_offset"))


def availability(flow: DataFrame) -> DataFrame:
    """Calendar bounds, rows with and without value, first and last valid time."""
    given = F.when(F.col("value").isNotNull(), F.col("ts"))
    return flow.groupBy(*KEYS).agg(
        F.min("ts").alias("calendar_start"), F.max("ts").alias("calendar_end"), F.count(F.lit(1)).alias("calendar_count"),
        F.count("value").alias("valid_count"), F.count_if(F.col("value").isNull()).alias("missing_count"), F.min(given).alias("first_valid"), F.max(given).alias("last_valid"),
    )


def pair_availability(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Two series of each station on their joint calendar: common rows, pairs, one-sided rows by where they lie."""
    a = reference.select("station_id", "ts", F.col("value").alias("a"), F.lit(True).alias("in_a"))
    b = candidate.select("station_id", "ts", F.col("value").alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, ["station_id", "ts"], "full_outer")
    w = Window.partitionBy("station_id")
    for x in "ab":
        given = F.when(F.col(x).isNotNull(), F.col("ts"))
        both = both.withColumns({f"first_{x}": F.min(given).over(w), f"last_{x}": F.max(given).over(w)})

    def one(x: str, y: str) -> dict[str, Column]:
        only = F.col(x).isNotNull() & F.col(y).isNull()
        ts, first, last = F.col("ts"), F.col(f"first_{y}"), F.col(f"last_{y}")
        side = "reference" if x == "a" else "candidate"
        return {
            f"{side}_only": F.count_if(only), f"{side}_only_before": F.count_if(only & (ts < first)),
            f"{side}_only_within": F.count_if(only & ts.between(first, last)), f"{side}_only_after": F.count_if(only & (ts > last)),
        }

    counts = {
        "common_rows": F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()),
        "paired_valid": F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()),
    } | one("a", "b") | one("b", "a")
    return both.groupBy("station_id").agg(*[c.alias(n) for n, c in counts.items()])


def percent(part: Column, whole: Column) -> Column:
    return ratio(part * 100.0, whole)
