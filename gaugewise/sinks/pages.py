"""Self-contained HTML pages with inline SVG, one per series, made where the series is."""

from __future__ import annotations

import html

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.operators.primitives import KEYS

#: Classes that a page is written for, by mode.
MODES = {
    "all": ["Needs review", "Minor concerns", "No review needed", "Not assessable"], "concerns_and_review": ["Needs review", "Minor concerns"], "needs_review": ["Needs review"], "review_only": ["Needs review"], "none": [],
}


def _svg(ts: np.ndarray, value: np.ndarray, marks: list[tuple[float, str]], spans: list[tuple[float, float, str]], width: int = 960, height: int = 320) -> str:
    ok = np.isfinite(value)
    if not ok.any():
        return "<p>No values.</p>"
    low, high, a, b = min(0.0, value[ok].min()), value[ok].max() or 1.0, ts.min(), max(ts.max(), ts.min() + 1)

    def x(t: float) -> float:
        return 10 + (t - a) / (b - a) * (width - 20)

    def y(v: float) -> float:
        return height - 10 - (v - low) / (high - low or 1) * (height - 20)

    parts = [f'<rect x="{x(s):.1f}" y="0" width="{max(1.0, x(e) - x(s)):.1f}" height="{height}" fill="{c}" opacity="0.25"/>' for s, e, c in spans]
    pen, path = False, []
    for t, v, good in zip(ts, value, ok, strict=True):
        if good:
            path.append(f"{'L' if pen else 'M'}{x(t):.1f} {y(v):.1f}")
        pen = bool(good)
    parts.append(f'<path d="{"".join(path)}" fill="none" stroke="#1f4e79" stroke-width="1"/>')
    at = dict(zip(ts, value, strict=True))
    parts += [f'<circle cx="{x(t):.1f}" cy="{y(at.get(t, 0.0)):.1f}" r="4" fill="{c}"/>' for t, c in marks]
    return f'<svg viewBox="0 0 {width} {height}" width="100%">{"".join(parts)}</svg>'


def series_pages(flow: DataFrame, composite: DataFrame, components: DataFrame, candidates: DataFrame, missing: DataFrame, plateaus: DataFrame, mode: str = "needs_review") -> DataFrame:
    """(name, text): hydrograph with its findings and the table of checks, for the classes of ``mode``.

    A page holds one series; every series is drawn in its own task.
    """
    chosen = composite.where(F.col("layer1_class").isin(MODES[mode])) if MODES[mode] else composite.where(F.lit(False))
    day = F.unix_micros(F.col("ts").cast("timestamp")) / 8.64e10
    rows = flow.join(chosen.select(*KEYS, "layer1_class", "layer1_score_percent"), KEYS)

    def nested(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy(*KEYS).agg(F.to_json(F.collect_list(F.struct(*columns))).alias(name))

    def days(c: str):
        return (F.unix_micros(F.col(c).cast("timestamp")) / 8.64e10).alias(c)

    extra = nested(components, "checks", "check", "tier", "raw_value", "contribution")
    marks = nested(candidates.where("status = 'candidate'").select(*KEYS, days("ts"), "type"), "marks", "ts", "type")
    gaps = nested(missing.where("position = 'internal'").select(*KEYS, days("start_ts"), days("end_ts")), "gaps", "start_ts", "end_ts")
    flats = nested(plateaus.select(*KEYS, days("start_ts"), days("end_ts")), "flats", "start_ts", "end_ts")
    notes = chosen.select(*KEYS)
    for part in (extra, marks, gaps, flats):
        notes = notes.join(part, KEYS, "left")
    # the findings ride on a row of their own, so that no series repeats them
    points = rows.select(*KEYS, "layer1_class", "layer1_score_percent", day.alias("day"), "value", *[F.lit(None).cast("string").alias(c) for c in ("checks", "marks", "gaps", "flats")])
    notes = notes.select(*KEYS, F.lit(None).cast("string").alias("layer1_class"), F.lit(None).cast("double").alias("layer1_score_percent"), F.lit(None).cast("double").alias("day"), F.lit(None).cast("double").alias("value"), "checks", "marks", "gaps", "flats")

    def page(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        note = pdf[pdf.day.isna()].iloc[0]
        pdf = pdf[pdf.day.notna()].sort_values("day")

        def load(c: str) -> list[dict]:
            return json.loads(note[c]) if isinstance(note[c], str) else []

        marks = [(m["ts"], "#c00000" if m["type"] == "spike" else "#7030a0") for m in load("marks")]
        spans = [(g["start_ts"], g["end_ts"] + 1, "#ff9900") for g in load("gaps")] + [(g["start_ts"], g["end_ts"] + 1, "#00b050") for g in load("flats")]
        table = "".join(f"<tr><td>{html.escape(str(c.get('check')))}</td><td>{html.escape(str(c.get('tier')))}</td><td>{c.get('raw_value', '')}</td><td>{c.get('contribution', '')}</td></tr>" for c in load("checks"))
        title = html.escape(" / ".join(keys))
        grade = html.escape(str(pdf.layer1_class.iloc[0]))
        text = f"<!doctype html><meta charset='utf-8'><title>{title}</title><h1>{title}</h1><p>{grade}</p>{_svg(pdf.day.to_numpy(float), pdf.value.to_numpy(float), marks, spans)}<table><tr><th>check</th><th>tier</th><th>value</th><th>contribution</th></tr>{table}</table>"
        return pd.DataFrame({"name": ["_".join(keys)], "text": [text]})

    return points.unionByName(notes).groupBy(*KEYS).applyInPandas(page, "name string, text string")
