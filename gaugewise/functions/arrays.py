"""Small steps over the array of a row, as expressions: what a series has a few dozen of needs no group of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def array_median(xs: Column) -> Column:
    """Median of an array without nulls; null if it is empty."""
    return let(F.array_sort(xs), lambda s: F.when(F.size(s) > 0, (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2))


def first_place(xs: Column, of: Column) -> Column:
    """Where ``of`` first stands in an array, from 0."""
    return (F.array_position(xs, of) - 1).cast("int")


def neighbours(xs: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of each two neighbours; empty for fewer than two elements."""
    return F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), f)
