"""Where a flow comes from, carried beside it through reads and selections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.operators.primitives import KEYS
from gaugewise.sources import readers

#: What is said of a source, in this order.
ORIGIN = ("path", "format", "variable", "station_coordinate", "time_coordinate", "unit")


@dataclass(frozen=True)
class Sourced:
    """A flow, its origin, the span that was asked for and what was done to it."""

    flow: DataFrame
    origin: dict[str, str] = field(default_factory=dict)
    whole: DataFrame | None = None
    span: tuple[str, str | None, str | None] = ("full", None, None)
    steps: tuple[str, ...] = ()

    def stations(self, requested: Sequence[str] | None) -> Sourced:
        """The requested stations; one that is absent is an error."""
        if not requested:
            return self
        keep = readers.select_stations(self.flow, list(requested))
        whole = self.whole if self.whole is None else readers.select_stations(self.whole, list(requested))
        return replace(self, flow=keep, whole=whole, steps=(*self.steps, "selected stations"))

    def timespan(self, start: str | None, end: str | None) -> Sourced:
        """Rows from the first to the last day; rows whose date could not be read stay, with their error."""
        keep = readers.select_timespan(self.flow, start, end)
        if "error" in self.flow.columns:
            inside = F.coalesce(readers.inside(start, end), F.lit(False))
            keep = self.flow.where(inside | F.col("ts").isNull())
        return replace(self, flow=keep, whole=self.flow if self.whole is None else self.whole, span=("range", start, end), steps=(*self.steps, "selected timespan"))

    def became(self, flow: DataFrame, step: str) -> Sourced:
        """The same source after a further step."""
        return replace(self, flow=flow, steps=(*self.steps, step))

    def without(self, stations: DataFrame) -> Sourced:
        """The same source without some stations."""
        whole = self.whole if self.whole is None else self.whole.join(stations, "station_id", "left_anti")
        return replace(self, flow=self.flow.join(stations, "station_id", "left_anti"), whole=whole)

    def table(self) -> DataFrame:
        """A row for each series: a struct of its origin, the requested, source, selected and valid spans, and the steps.

        The source is read once: what was selected is told by its dates. A series without a row in the span has no selected bounds.
        """
        whole = self.flow if self.whole is None else self.whole
        chosen: Column = F.lit(True) if self.whole is None else F.coalesce(readers.inside(*self.span[1:]), F.lit(False))
        ts, given = F.col("ts"), chosen & F.col("value").isNotNull()
        spans = whole.groupBy(*KEYS).agg(
            F.min("ts").alias("source_start"), F.max("ts").alias("source_end"), F.count(F.lit(1)).alias("source_count"), F.min(F.when(chosen, ts)).alias("selected_start"), F.max(F.when(chosen, ts)).alias("selected_end"),
            F.count_if(chosen).alias("selected_count"), F.min(F.when(given, ts)).alias("first_valid"), F.max(F.when(given, ts)).alias("last_valid"), F.count_if(given).alias("valid_count"),
        )
        said = [F.lit(self.origin.get(k)).cast("string").alias(k) for k in ORIGIN]
        asked = [F.lit(x).cast("string").alias(n) for n, x in zip(("requested_mode", "requested_start", "requested_end"), self.span, strict=True)]
        steps = F.array(*map(F.lit, self.steps)).cast("array<string>").alias("transformations")
        return spans.select(*KEYS, F.struct(*said, *asked, *[c for c in spans.columns if c not in KEYS], steps).alias("provenance"))
