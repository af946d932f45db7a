"""Check 10: slow drift of the annual level, by epochs of consecutive years."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.config import LAYER1, overlay
from gaugewise.functions.arrays import array_median, let, neighbours
from gaugewise.functions.numeric import median, ratio
from gaugewise.functions.shared import once
from gaugewise.operators.primitives import KEYS, log_offset, monthly_statistics, prepared, valid_record


@once
def annual_levels(flow: DataFrame, settings: dict[str, Any] | None = None) -> DataFrame:
    """Median of the month-of-year anomalies of each year in log space; null with too few months."""
    c = overlay(LAYER1["epoch_drift"], settings)
    months = monthly_statistics(flow, int(c["minimum_valid_days_per_month"])).join(log_offset(valid_record(flow)), KEYS)
    months = months.withColumn("level", F.ln(F.col("median") + F.col("log_offset")))
    usual = median(F.col("level")).over(Window.partitionBy(*KEYS, F.month("month")))
    reference = median(F.col("level")).over(Window.partitionBy(*KEYS))
    rows = months.withColumns({"anomaly": F.col("level") - usual, "reference": reference})
    years = rows.groupBy(*KEYS, F.year("month").alias("year")).agg(F.count("anomaly").alias("valid_months"), median(F.col("anomaly")).alias("x"), F.first("reference").alias("reference"), F.first("log_offset").alias("log_offset"))
    level = F.when(F.col("valid_months") >= c["minimum_valid_months_per_year"], F.col("x"))
    return years.select(*KEYS, "year", "valid_months", level.alias("level_anomaly"), (F.exp(F.col("reference") + level) - F.col("log_offset")).alias("display_level"), "reference", "log_offset")


def _runs(annual: DataFrame, c: dict[str, Any]) -> DataFrame:
    """Years with a level in runs of consecutive years that are long enough; run numbers from 1."""
    w = Window.partitionBy(*KEYS).orderBy("year")
    rows = annual.where("level_anomaly is not null").withColumn("g", F.col("year") - F.row_number().over(w))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "g"))).where(F.col("n") >= c["minimum_valid_annual_levels"])
    return rows.withColumn("run", F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("g"))).drop("g")


def noise_scale(runs: DataFrame, floor: float) -> DataFrame:
    """Size of ordinary differences between neighbouring years."""
    w = Window.partitionBy(*KEYS, "run").orderBy("year")
    d = runs.withColumn("d", F.abs(F.col("level_anomaly") - F.lag("level_anomaly").over(w))).where("d is not null")
    half = d.groupBy(*KEYS).agg(median(F.col("d")).alias("half"))
    ordinary = d.join(half, KEYS).where("d <= half")
    centre = ordinary.groupBy(*KEYS).agg(median(F.col("d")).alias("centre"))
    spread = ordinary.join(centre, KEYS).groupBy(*KEYS).agg(F.first("centre").alias("centre"), median(F.abs(F.col("d") - F.col("centre"))).alias("mad"))
    return spread.select(*KEYS, F.greatest(F.col("centre") + 1.4826 * F.col("mad"), F.lit(floor)).alias("noise"))


def epochs(flow: DataFrame, settings: dict[str, Any] | None = None) -> DataFrame:
    """Balanced epochs of each run with their Theil-Sen line, change score and state.

    The slope is the median of all pairwise slopes, the intercept median(y) - slope * median(x).
    """
    c = overlay(LAYER1["epoch_drift"], settings)
    runs = _runs(annual_levels(flow, c), c)
    n = F.floor(F.col("n") / int(c["epoch_years"])).cast("int")
    # n years in k epochs: the first n mod k of them have one year more
    place = F.row_number().over(Window.partitionBy(*KEYS, "run").orderBy("year")) - 1
    rows = runs.withColumns({"k": n, "i": place}).where("k >= 1").withColumns({"size": F.floor(F.col("n") / F.col("k")), "more": F.col("n") % F.col("k")})
    edge = F.col("more") * (F.col("size") + 1)
    rows = rows.withColumn("part", F.when(F.col("i") < edge, F.floor(F.col("i") / (F.col("size") + 1))).otherwise(F.col("more") + F.floor((F.col("i") - edge) / F.col("size"))).cast("int"))
    rows = rows.select(*KEYS, "run", "part", "year", F.col("level_anomaly").alias("y"))
    group = [*KEYS, "run", "part"]
    pairs = rows.join(rows.select(*group, F.col("year").alias("year2"), F.col("y").alias("y2")), group).where("year2 > year")
    slope = pairs.groupBy(*group).agg(median((F.col("y2") - F.col("y")) / (F.col("year2") - F.col("year"))).alias("slope"))
    lines = rows.groupBy(*group).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("years"), median(F.col("y")).alias("my"), median(F.col("year")).alias("mx")).join(slope, group)
    scored = lines.join(noise_scale(runs, c["annual_noise_floor_log"]), KEYS).withColumn("change_score", ratio(F.abs("slope") * F.greatest(F.col("last_year") - F.col("first_year"), F.lit(1)), F.col("noise")))
    moved = F.col("change_score") >= c["meaningful_epoch_change_score"]
    state = F.when(~moved, "stable").when(F.col("slope") > 0, "rising").otherwise("falling")
    return scored.select(
        *KEYS, "run", F.row_number().over(Window.partitionBy(*KEYS).orderBy("run", "part")).alias("epoch"), "first_year", "last_year", "years", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "change_score", state.alias("state")
    )


def epoch_drift(flow: DataFrame, settings: dict[str, Any] | None = None) -> DataFrame:
    """Share of stable years, tier and dominant state; a series without an epoch is not assessed."""
    c = overlay(LAYER1["epoch_drift"], settings)
    s = epochs(flow, c).groupBy(*KEYS).agg(
        F.sum("years").alias("assessed_years"), F.count(F.lit(1)).alias("epochs"), ratio(F.sum(F.when(F.col("state") == "stable", F.col("years")).otherwise(0)), F.sum("years")).alias("stable_year_fraction"),
        F.collect_set(F.when(F.col("state") != "stable", F.col("state"))).alias("moves"),
    )
    out = valid_record(flow).select(*KEYS).distinct().join(s, KEYS, "left")
    share, done = F.col("stable_year_fraction"), F.col("epochs").isNotNull()
    tier = F.when(share >= c["tier_3_minimum_stable_fraction"], "Tier 3").when(share >= c["tier_2_minimum_stable_fraction"], "Tier 2").otherwise("Tier 1")
    dominant = F.when(F.size("moves") == 0, "stable").when(F.size("moves") == 1, F.get("moves", F.lit(0))).otherwise("mixed")
    none = F.lit(0).cast("long")
    return out.select(*KEYS, F.coalesce("assessed_years", none).alias("assessed_years"), F.coalesce("epochs", none).alias("epoch_count"), share, F.when(done, tier).alias("tier"), F.when(done, dominant).alias("dominant_state"), done.alias("assessed"))


def _slope(points: Column) -> Column:
    """Median of all pairwise slopes of an array of (e, x, y) by x; null for fewer than two."""
    return array_median(F.flatten(F.transform(points, lambda p, i: F.transform(F.slice(points, i + 2, F.size(points)), lambda q: (q["y"] - p["y"]) / (q["x"] - p["x"])))))


def _squares(points: Column) -> Column:
    """Squared distances from the Theil-Sen line of the points, summed."""

    def around(slope: Column) -> Column:
        base = array_median(F.transform(points, lambda p: p["y"])) - slope * array_median(F.transform(points, lambda p: p["x"]))
        return let(base, lambda b: F.aggregate(points, F.lit(0.0), lambda total, p: total + (p["y"] - b - slope * p["x"]) * (p["y"] - b - slope * p["x"])))

    return let(_slope(points), around)


def _part(points: Column, a: Column, b: Column) -> Column:
    """The points of the epochs from a up to but not b."""
    return F.filter(points, lambda p: (p["e"] >= a) & (p["e"] < b))


def _cuts(costs: Column, n: Column, parts: Column) -> Column:
    """Where to cut n epochs into so many parts at the least cost, the first such places on ties.

    ``costs``: (a, b, cost) of every part. Step k of the fold knows the best k parts of the first j
    epochs for every j, from the best k - 1 parts of fewer.
    """
    best = "struct<total: double, cuts: array<int>>"
    one = F.transform(F.filter(costs, lambda c: c["a"] == 0), lambda c: F.struct(c["cost"].alias("total"), F.array().cast("array<int>").alias("cuts")).cast(best))

    def more(before: Column, k: Column) -> Column:
        def least(j: Column) -> Column:
            last = F.filter(costs, lambda c: (c["b"] == j) & (c["a"] >= k - 1))
            ways = F.transform(last, lambda c: let(F.get(before, c["a"] - 1), lambda w: F.struct((w["total"] + c["cost"]).alias("total"), F.concat(w["cuts"], F.array(c["a"])).alias("cuts")).cast(best)))
            return F.array_min(ways)

        return F.transform(F.sequence(F.lit(1), n), least)

    steps = F.when(parts >= 2, F.sequence(F.lit(2), parts)).otherwise(F.array().cast("array<int>"))
    return F.get(F.aggregate(steps, one, more), n - 1)["cuts"]


def overview(flow: DataFrame, settings: dict[str, Any] | None = None) -> DataFrame:
    """A few longer lines for each run: the contiguous grouping of its epochs of least squared error, like neighbours joined.

    A run is one array of its years; parts, their costs, the best grouping and the joining are expressions over it.
    """
    c = overlay(LAYER1["epoch_drift"], settings)
    runs = _runs(annual_levels(flow, c), c)
    found = epochs(flow, c).select(*KEYS, "run", "epoch", "first_year", "last_year")
    rows = runs.join(found, [*KEYS, "run"]).where("year between first_year and last_year")
    rows = rows.withColumn("e", F.dense_rank().over(Window.partitionBy(*KEYS, "run").orderBy("epoch")) - 1)
    point = F.struct("e", F.col("year").cast("double").alias("x"), F.col("level_anomaly").alias("y"))
    rows = rows.groupBy(*KEYS, "run").agg(F.array_sort(F.collect_list(point)).alias("points"), (F.max("e") + 1).alias("n"))
    rows = rows.join(noise_scale(runs, c["annual_noise_floor_log"]), KEYS).withColumn("parts", F.least(F.lit(int(c["maximum_overview_slopes"])), F.ceil(F.col("n") / int(c["overview_epochs_per_segment"])).cast("int")))
    points, n = F.col("points"), F.col("n")
    costs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda a: F.transform(F.sequence(a + 1, n), lambda b: F.struct(a.alias("a"), b.alias("b"), _squares(_part(points, a, b)).alias("cost")))))
    # one part needs no costs
    rows = rows.withColumn("costs", F.when(F.col("parts") > 1, costs))
    rows = rows.withColumn("cuts", F.when(F.col("parts") > 1, _cuts(F.col("costs"), n, F.col("parts"))).otherwise(F.array().cast("array<int>")))
    edges = F.concat(F.array(F.lit(0)), "cuts", F.array(n))

    def state(part: Column, slope: Column) -> Column:
        span = F.greatest(F.element_at(part, -1)["x"] - part[0]["x"], F.lit(1.0))
        return F.when(F.abs(slope) * span / F.col("noise") < c["meaningful_epoch_change_score"], "stable").when(slope > 0, "rising").otherwise("falling")

    def lined(a: Column, b: Column) -> Column:
        part = _part(points, a, b)
        return let(part, lambda p: let(_slope(p), lambda slope: F.struct(a.alias("a"), b.alias("b"), state(p, slope).alias("state"), slope.alias("slope"), p[0]["x"].cast("int").alias("first_year"), F.element_at(p, -1)["x"].cast("int").alias("last_year"))))

    def join(done: Column, now: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        like = (F.size(done) > 0) & F.coalesce(last["state"] == now["state"], F.lit(False))
        return F.when(like, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), now["b"].alias("b"), now["state"].alias("state"))))).otherwise(F.concat(done, F.array(now)))

    rows = rows.select(*KEYS, "run", "points", "noise", neighbours(edges, lined).alias("parts"))
    short = F.transform("parts", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["state"].alias("state")))
    joined = F.aggregate(short, F.slice(short, 1, 0), join)
    out = rows.select(*KEYS, "run", F.posexplode(F.transform(joined, lambda p: lined(p["a"], p["b"]))).alias("i", "p"))
    return out.select(*KEYS, "run", (F.col("i") + 1).alias("overview"), "p.first_year", "p.last_year", "p.slope", "p.state")
