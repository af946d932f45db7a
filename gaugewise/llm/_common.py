"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewise.functions.shared import drop_written, shared_dir, written  # noqa: F401

#: Bytes of a word after lower-casing A-Z: digits, a-z and everything beyond ASCII.
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
WORD_TABLE = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if (b + 32 if 0x41 <= b <= 0x5A else b) in _KEPT else 0x20
    for b in range(256)
)
_WORD = re.compile(r"[^\W\d_]")


def word_bytes(text: str | None) -> list[bytes]:
    """The lower-cased words of a text as UTF-8; none for a null."""
    return text.encode("utf-8", "replace").translate(WORD_TABLE).split() if text else []


def has_letter(text: str | None) -> bool:
    """A letter is what Unicode calls one: not a numeral such as a superscript, a fraction or a Roman number sign."""
    return bool(text) and any(m[0].isalpha() for m in _WORD.finditer(text))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which the worker gives memory that it does not use any more back.

    Python workers outlive their tasks; what one stage has freed but kept would count beside the next one's.
    """

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        gc.freeze()  # what is left are modules for the most part, which the next task's collection need not go through
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return task


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
