"""Check 9: shifts of level, high flow, seasonality or variability between calendar blocks.

Monthly statistics and block features are DataFrame aggregations. What is left of a series then, some
thirty blocks, is merged by a fold over their array; boundaries are dated by a join with the months around them.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.config import LAYER1, overlay
from gaugewise.functions.arrays import array_median, first_place, let, neighbours
from gaugewise.functions.numeric import median, quantile
from gaugewise.functions.shared import once
from gaugewise.operators.primitives import KEYS, log_offset, monthly_statistics, prepared, valid_record

# Features of a block and the least scale of each.
FLOORS = {"level_log": 0.1, "high_log": 0.15, "seasonal_amplitude_log": 0.15, "variability_log": 0.12}
FEATURES = list(FLOORS)


@once
def block_rule(flow: DataFrame, settings: dict[str, Any] | None = None) -> DataFrame:
    """First and last day of each valid record, its years, and the years of a block."""
    c = overlay(LAYER1["step_shift"], settings)
    day = F.col("ts").cast("date")
    years = (F.datediff("last_day", "first_day") + 1) / 365.2425
    short = F.greatest(F.lit(int(c["minimum_block_years"])), F.floor(years / c["short_record_divisor"]).cast("int"))
    return valid_record(flow).groupBy(*KEYS).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")).select(
        *KEYS, "first_day", "last_day", years.alias("record_years"), F.when(years >= c["long_record_min_years"], int(c["long_record_block_years"])).otherwise(short).alias("block_years")
    )


@once
def block_features(flow: DataFrame, settings: dict[str, Any] | None = None) -> DataFrame:
    """Calendar blocks with enough months and their four features in log space.

    Blocks start on 1 January of the first year; a month belongs to the block that its first day lies in.
    """
    c = overlay(LAYER1["step_shift"], settings)
    rule = block_rule(flow, c)
    first_year = F.year("first_day")
    blocks = rule.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.year("last_day") - first_year) / F.col("block_years")).cast("int"))))
    start = F.make_date(first_year + F.col("block") * F.col("block_years"), F.lit(1), F.lit(1))
    after = F.make_date(first_year + (F.col("block") + 1) * F.col("block_years"), F.lit(1), F.lit(1))
    blocks = blocks.select(*KEYS, "block", "block_years", F.greatest(start, "first_day").alias("start"), F.least(F.date_sub(after, 1), "last_day").alias("end"))
    months = monthly_statistics(flow, int(c["minimum_valid_days_per_month"])).where("median is not null").join(log_offset(valid_record(flow)), KEYS)
    logs = months.select(*KEYS, "month", *[F.ln(F.col(q) + F.col("log_offset")).alias(q) for q in ("median", "q25", "q75", "q90")])
    inside = (F.col("month") >= F.col("start")) & (F.col("month") <= F.col("end"))
    rows = blocks.join(logs, KEYS).where(inside)
    expected = F.months_between(F.trunc("end", "month"), F.trunc("start", "month")).cast("int") + 1
    one = [*KEYS, "block", "block_years", "start", "end"]
    climate = rows.groupBy(*one, F.month("month").alias("m")).agg(median(F.col("median")).alias("x")).groupBy(*KEYS, "block").agg((quantile(F.col("x"), 0.9) - quantile(F.col("x"), 0.1)).alias("seasonal_amplitude_log"))
    found = rows.groupBy(*one).agg(
        F.count(F.lit(1)).alias("valid_months"), F.count_distinct(F.month("month")).alias("calendar_months"), median(F.col("median")).alias("level_log"), median(F.col("q90")).alias("high_log"), median(F.col("q75") - F.col("q25")).alias("variability_log")
    ).withColumn("coverage", F.col("valid_months") / expected)
    kept = found.where((F.col("coverage") >= c["minimum_block_coverage"]) & (F.col("calendar_months") >= c["minimum_calendar_months"]))
    return kept.join(climate, [*KEYS, "block"]).select(*one, "coverage", "valid_months", *FEATURES)


def _spread(differences: Column, floor: float) -> Column:
    """Size of ordinary differences: the lesser half's median and its deviation, at least ``floor``."""
    return let(
        let(differences, lambda d: let(array_median(d), lambda half: F.filter(d, lambda x: x <= half))),
        lambda d: let(array_median(d), lambda centre: F.greatest(F.lit(floor), centre + 1.4826 * array_median(F.transform(d, lambda x: F.abs(x - centre))))),
    )


def _far(a: Column, b: Column, scales: Column) -> Column:
    """The largest of the features' differences between two segments, in scales."""
    return F.array_max(F.zip_with(F.zip_with(a["x"], b["x"], lambda x, y: F.abs(x - y)), scales, lambda d, s: d / s))


def _joined(a: Column, b: Column) -> Column:
    w = a["w"] + b["w"]
    return F.struct(a["start"].alias("start"), w.alias("w"), F.zip_with(a["x"], b["x"], lambda x, y: (x * a["w"] + y * b["w"]) / w).alias("x"))


def _merged(blocks: Column, scales: Column, threshold: float) -> Column:
    """The segments left when the closest neighbours, the first on ties, have been joined until none are closer than ``threshold``.

    A fold with as many steps as there are neighbours: a step that finds none close enough changes nothing.
    """

    def step(segments: Column, _: Column) -> Column:
        gaps = neighbours(segments, lambda a, b: _far(a, b, scales))
        return let(
            gaps,
            lambda g: let(F.array_min(g), lambda least: F.when(
                least < threshold,
                let(first_place(g, least), lambda i: F.concat(F.slice(segments, 1, i), F.array(_joined(F.get(segments, i), F.get(segments, i + 1))), F.slice(segments, i + 3, F.size(segments)))),
            ).otherwise(segments)),
        )

    return F.aggregate(F.sequence(F.lit(1), F.size(blocks)), blocks, step)


def segments(flow: DataFrame, settings: dict[str, Any] | None = None) -> DataFrame:
    """Segments of like blocks of each series, and the features' scales; series of fewer than three blocks have none."""
    c = overlay(LAYER1["step_shift"], settings)
    block = F.struct("block", "start", F.col("valid_months").cast("double").alias("w"), F.array(*FEATURES).alias("x"))
    rows = block_features(flow, c).groupBy(*KEYS).agg(F.max("block_years").alias("block_years"), F.array_sort(F.collect_list(block)).alias("blocks")).where("size(blocks) >= 3")
    blocks = F.transform("blocks", lambda b: F.struct(b["start"].alias("start"), b["w"].alias("w"), b["x"].alias("x")))

    def moves(i: int) -> Column:
        return neighbours(F.col("blocks"), lambda a, b: F.abs(b["x"][i] - a["x"][i]))

    scales = F.array(*[_spread(moves(i), floor) for i, floor in enumerate(FLOORS.values())])
    rows = rows.select(*KEYS, "block_years", blocks.alias("blocks"), scales.alias("scales"))
    return rows.select(*KEYS, "block_years", "scales", _merged(F.col("blocks"), F.col("scales"), c["structural_threshold"]).alias("segments"))


def _candidates(flow: DataFrame, c: dict[str, Any]) -> DataFrame:
    """Changes between segments; those of one direction that follow each other closely are one, dated by the first."""
    signed = F.zip_with(F.zip_with(F.col("b.x"), F.col("a.x"), lambda y, x: y - x), F.col("scales"), lambda d, s: d / s)
    edges = segments(flow, c).select(*KEYS, "block_years", "scales", F.inline(neighbours(F.col("segments"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    edges = edges.select(*KEYS, "block_years", F.col("b.start").alias("at"), signed.alias("signed")).withColumn("score", F.transform("signed", F.abs))
    turn = F.signum(F.get("signed", first_place(F.col("score"), F.array_max("score"))))
    w = Window.partitionBy(*KEYS).orderBy("at")
    edges = edges.withColumn("turn", turn)
    near = F.datediff("at", F.lag("at").over(w)) <= 366 * F.col("block_years") * c["consolidation_max_block_widths"]
    new = F.when((F.col("turn") == F.lag("turn").over(w)) & near, 0).otherwise(1)
    edges = edges.withColumn("new", new).withColumn("candidate", F.sum("new").over(w))
    return edges.groupBy(*KEYS, "candidate").agg(
        F.max("block_years").alias("block_years"), F.min("at").alias("at"), F.count(F.lit(1)).cast("int").alias("n"), F.array(*[F.max(F.col("score")[i]) for i in range(len(FEATURES))]).alias("score")
    )


def _refined(found: DataFrame, flow: DataFrame, c: dict[str, Any]) -> DataFrame:
    """``found`` with a ``date``: for shifts of level the month start nearby whose median anomaly before and after differs most, the first on ties."""
    months = monthly_statistics(flow, int(c["minimum_valid_days_per_month"])).join(log_offset(valid_record(flow)), KEYS)
    months = months.select(*KEYS, "month", F.ln(F.col("median") + F.col("log_offset")).alias("level")).where("level is not null")
    usual = median(F.col("level")).over(Window.partitionBy(*KEYS, F.month("month")))
    anomaly = months.select(*KEYS, F.col("month").alias("beside"), (F.col("level") - usual).alias("anomaly"))
    reach = F.greatest(F.lit(1), F.bround(F.col("block_years") * 12 * F.lit(float(c["refinement_block_fraction"])), 0).cast("int"))
    around = found.where(F.col("score")[FEATURES.index("level_log")] >= c["structural_threshold"]).select(*KEYS, "candidate", "at", reach.alias("reach"))
    dates = around.select(*KEYS, "candidate", "reach", F.explode(F.transform(F.sequence(-F.col("reach"), F.col("reach")), lambda k: F.add_months("at", k))).alias("date"))
    beside = dates.select("*", F.explode(F.transform(F.sequence(-F.col("reach"), F.col("reach") - 1), lambda k: F.struct(k.alias("k"), F.add_months("date", k).alias("beside")))).alias("m")).select(*KEYS, "candidate", "reach", "date", "m.*")
    before, after = F.when(F.col("k") < 0, F.col("anomaly")), F.when(F.col("k") >= 0, F.col("anomaly"))
    gains = beside.join(anomaly, [*KEYS, "beside"]).groupBy(*KEYS, "candidate", "reach", "date").agg(F.count(before).alias("n_before"), F.count(after).alias("n_after"), F.abs(median(after) - median(before)).alias("gain"))
    enough = F.greatest(F.lit(3), F.ceil(F.col("reach") / 2))
    best = gains.where((F.col("n_before") >= enough) & (F.col("n_after") >= enough)).groupBy(*KEYS, "candidate").agg(F.min_by("date", F.struct(-F.col("gain"), "date")).alias("best"))
    return found.join(best, [*KEYS, "candidate"], "left").withColumn("date", F.coalesce("best", "at")).drop("best")


@once
def boundaries(flow: DataFrame, settings: dict[str, Any] | None = None) -> DataFrame:
    """Dated boundaries between regimes, before tiering; series of fewer than three blocks have none.

    A refined date that does not come after the one before it gives way to the block's first day.
    """
    c = overlay(LAYER1["step_shift"], settings)
    found = _refined(_candidates(flow, c), flow, c)
    rows = found.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("date", "candidate", "at", "n", "score"))).alias("found"))

    def place(done: Column, x: Column) -> Column:
        late = F.size(done) > 0
        date = F.when(late & (x["date"] <= F.get(done, F.size(done) - 1)["date"]), x["at"]).otherwise(x["date"])
        return F.concat(done, F.array(F.struct(date.alias("date"), x["candidate"].alias("candidate"), x["at"].alias("at"), x["n"].alias("n"), x["score"].alias("score"))))

    dated = F.aggregate("found", F.slice("found", 1, 0), place)
    out = rows.select(*KEYS, F.posexplode(dated).alias("i", "f"))
    return out.select(
        *KEYS, (F.col("i") + 1).alias("boundary"), F.col("f.date").alias("boundary_date"), F.col("f.at").alias("approximate_date"), F.array_max("f.score").alias("structural_score"), F.col("f.n").alias("collapsed_edge_count"),
        *[F.col("f.score")[i].alias(f"score_{name}") for i, name in enumerate(FEATURES)],
    )


@once
def tiered_boundaries(flow: DataFrame, settings: dict[str, Any] | None = None) -> DataFrame:
    """Boundaries with the medians of the regimes beside them and the tier of the change.

    A change without a median on either side is Tier 2, as neither bound holds.
    """
    c = overlay(LAYER1["step_shift"], settings)
    flow = prepared(flow)
    found = boundaries(flow, c)
    w = Window.partitionBy(*KEYS).orderBy("boundary")
    rule = block_rule(flow, c).select(*KEYS, "first_day", "last_day")
    spans = found.join(rule, KEYS).withColumns({"from_day": F.coalesce(F.lag("boundary_date").over(w), "first_day"), "to_day": F.coalesce(F.lead("boundary_date").over(w), F.date_add("last_day", 1))})
    months = monthly_statistics(flow, int(c["minimum_valid_days_per_month"])).select(*KEYS, "month", F.col("median").alias("x"))
    at = F.col("boundary_date")

    def side(low: Column, high: Column) -> Column:
        return median(F.when((F.col("month") >= low) & (F.col("month") < high), F.col("x")))

    medians = spans.join(months, KEYS).groupBy(*KEYS, "boundary").agg(side(F.col("from_day"), at).alias("before_median"), side(at, F.col("to_day")).alias("after_median"))
    v = F.when(F.col("value").isNotNull(), F.greatest("value", F.lit(0.0)))
    bounds = valid_record(flow).groupBy(*KEYS).agg(quantile(v, c["tier_3_maximum_quantile"]).alias("low_bound"), quantile(v, c["tier_1_minimum_quantile"]).alias("high_bound"))
    change = F.abs(F.col("after_median") - F.col("before_median"))
    tier = F.when(change <= F.col("low_bound"), "Tier 3").when(change >= F.col("high_bound"), "Tier 1").otherwise("Tier 2")
    return found.join(medians, [*KEYS, "boundary"]).join(bounds, KEYS).select(*found.columns, "before_median", "after_median", change.alias("absolute_median_change"), "low_bound", "high_bound", tier.alias("tier"))


def step_shift(flow: DataFrame, settings: dict[str, Any] | None = None) -> DataFrame:
    """Score and tier of each series; fewer than three blocks are not assessed."""
    c = overlay(LAYER1["step_shift"], settings)
    flow = prepared(flow)
    tier = F.col("tier")
    points = F.when(tier == "Tier 1", c["tier_1_points"]).when(tier == "Tier 2", c["tier_2_points"]).otherwise(c["tier_3_points"])
    scored = tiered_boundaries(flow, c).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_if(tier != "Tier 3").alias("retained"), F.avg(points.cast("double")).alias("score"))
    blocks = block_features(flow, c).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("blocks"))
    out = block_rule(flow, c).join(blocks, KEYS, "left").join(scored, KEYS, "left")
    done = F.coalesce("blocks", F.lit(0)) >= 3
    score = F.coalesce("score", F.lit(0.0))
    grade = F.when(score > c["composite_tier_1_above_score"], "Tier 1").when(score >= c["composite_tier_2_minimum_score"], "Tier 2").otherwise("Tier 3")
    none = F.lit(0).cast("long")
    return out.select(
        *KEYS, F.coalesce("retained", none).alias("value"), F.coalesce("n", none).alias("boundary_count"), F.coalesce("blocks", none).alias("block_count"), "record_years", "block_years",
        F.when(done, score).alias("step_shift_score"), F.when(done, grade).alias("tier"), done.alias("assessed"),
    )
