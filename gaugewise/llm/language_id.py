"""Language identification by hierarchical discrimination.

The language family is predicted first, then one-versus-one linear support vector machines separate
the languages within it. Features are the square roots of a text's hashed letter n-grams (1 to 3
bytes of the lower-cased letters, other signs as one blank), scaled to length 1. All machines are
linear, so a text of any length costs one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewise.llm._common import col, has_letter

DIMS = 1 << 13
#: Bytes of text whose n-grams are counted at once: what a task holds does not grow with a text.
CHUNK = 1 << 20
#: Training takes at most this many texts of each language, those of the lowest hash.
SAMPLE_PER_LANGUAGE = 1000
# Families of languages by ISO 639-1 code; any other language is a family by itself.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "sd", "ur"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "semitic": ["am", "ar", "he", "mt"],
}
FAMILY = {language: family for family, languages in FAMILIES.items() for language in languages}
#: ASCII letters and bytes beyond ASCII stay, all else is a blank.
_LETTERS = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 0x20 for b in range(256))


def features(texts: list[str | None], dims: int = DIMS, chunk: int = CHUNK) -> np.ndarray:
    """Rows of length 1 (0 for texts without a letter)."""
    data = [f" {t.lower()} ".encode("utf-8", "replace").translate(_LETTERS) if t else b"" for t in texts]
    ends = np.cumsum([len(x) for x in data])
    b = np.frombuffer(b"".join(data) + bytes(2), dtype=np.uint8)
    out, shift = np.zeros(len(texts) * dims, dtype=np.float32), 32 - (dims.bit_length() - 1)
    for at in range(0, len(b) - 2, chunk):
        here = np.arange(at, min(at + chunk, len(b) - 2))
        text = np.searchsorted(ends, here, side="right")
        code, places = np.zeros(len(here), dtype=np.int64), []
        for size in (1, 2, 3):
            code = code << 8 | b[here + size - 1]
            place = text * dims + (((code + (size << 24)) * 2654435761 & 0xFFFFFFFF) >> shift)
            places.append(place[here + size <= ends[text]])
        out += np.bincount(np.concatenate(places), minlength=len(out))
    out = np.sqrt(out.reshape(len(texts), dims))
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out / np.where(norm > 0, norm, 1)


def slices(column: pa.Array, rows: int = 64, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of few rows and few bytes; a longer text is a slice by itself."""
    start, held = 0, 0
    for i, x in enumerate(column):
        n = len(x.as_buffer()) if x.is_valid else 0
        if i > start and (i - start == rows or held + n > size):
            yield start, i - start
            start, held = i, 0
        held += n
    if len(column) > start:
        yield start, len(column) - start


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """A linear machine for y in {-1, 1}: squared hinge loss, classes balanced, accelerated gradient."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b, pw, pb = np.zeros(x.shape[1], dtype=np.float32), 0.0, np.zeros(x.shape[1], dtype=np.float32), 0.0
    rate = 1 / (4 * c + 1)
    for t in range(steps):
        m = t / (t + 3)
        zw, zb = w + m * (w - pw), b + m * (b - pb)
        g = weight * np.maximum(0, 1 - y * (x @ zw + zb)) * y * 2 * c
        pw, pb = w, b
        w, b = zw - rate * (zw - x.T @ g), zb + rate * float(g.sum())
    return w, b


@dataclass
class Machine:
    """Pairwise machines over families, and over the languages of each family."""

    languages: list[str]
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    @staticmethod
    def family(language: str) -> str:
        return FAMILY.get(language, language)

    def names(self) -> list[str]:
        return sorted({self.family(x) for x in self.languages})

    def _choose(self, x: np.ndarray, names: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The place of the winner of all duels (most duels, then the widest margins), and its share."""
        wins, margins = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        sure = np.ones((len(x), len(names)))
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                w, b = self.pairs[kind + a, kind + names[j]]
                m = x @ w + b
                p = 1 / (1 + np.exp(-np.clip(4 * m, -500, 500)))
                wins[:, i] += m >= 0
                wins[:, j] += m < 0
                margins[:, i] += m
                margins[:, j] -= m
                sure[:, i] = np.minimum(sure[:, i], p)
                sure[:, j] = np.minimum(sure[:, j], 1 - p)
        best = (wins + np.tanh(margins) * 0.4).argmax(1)
        return best, sure[np.arange(len(x)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        seen = np.asarray([has_letter(t) for t in texts], dtype=bool)
        out, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages or not seen.any():
            return out, score
        at = np.flatnonzero(seen)
        x = features([texts[i] for i in at])
        families = self.names()
        family, p = self._choose(x, families, "family ")
        for f, name in enumerate(families):
            mine = np.flatnonzero(family == f)
            if len(mine):
                inside = sorted(y for y in self.languages if self.family(y) == name)
                language, q = self._choose(x[mine], inside, "")
                for i, k, s in zip(at[mine], language, p[mine] * q, strict=True):
                    out[i], score[i] = inside[k], s
        return out, score


def train(docs: DataFrame, use: Column | None = None, text: str = "text", lang: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Machine:
    """Fits the machines on texts with a letter and a non-null language.

    ``use``: which rows may be learned from. At most ``sample_per_language`` texts of each language
    are taken, by the hash of the text, repeated texts once; what is collected is their features.
    One scan finds the hashes, each task keeping few of a language, another reads those texts.
    """
    rows = docs.where(F.lit(True) if use is None else use).where(col(text).isNotNull() & col(lang).isNotNull())
    rows = rows.select(F.xxhash64(col(text)).alias("mark"), col(lang).cast("string").alias("lang"), col(text).cast("string").alias("text"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's least hashes of each language: at most ``sample_per_language``, each once."""
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            ok = np.asarray([has_letter(x.as_py()) for x in batch.column(2)], dtype=bool)
            marks, langs = batch.column(0).to_numpy()[ok], np.asarray(batch.column(1).to_pylist(), dtype=object)[ok]
            for language in set(langs):
                mine = np.concatenate([held.get(language, marks[:0]), marks[langs == language]])
                held[language] = np.unique(mine)[:sample_per_language]
        names = [k for k, v in held.items() for _ in v]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*held.values(), np.zeros(0, np.int64)])), pa.array(names, pa.string())], ["mark", "lang"])

    place = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    chosen = rows.mapInArrow(least, "mark long, lang string").distinct().withColumn("place", place).where(F.col("place") <= sample_per_language)
    # at most sample_per_language hashes of each language
    sample = rows.join(F.broadcast(chosen.select("mark", "lang")), ["mark", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n in slices(batch.column(2)):
                part = batch.slice(i, n)
                x = features(part.column(2).to_pylist())
                places = [np.flatnonzero(r).astype("<u2").tobytes() for r in x]
                values = [r[r > 0].astype("<f2").tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["mark", "lang", "places", "values"])

    found = sample.select("mark", "lang", "text").mapInArrow(run, "mark long, lang string, places binary, values binary").dropDuplicates(["mark", "lang"])
    pdf = found.toPandas().sort_values(["lang", "mark"])
    x = np.zeros((len(pdf), DIMS), dtype=np.float32)
    for i, (p, v) in enumerate(zip(pdf["places"], pdf["values"], strict=True)):
        x[i, np.frombuffer(p, "<u2")] = np.frombuffer(v, "<f2")
    own = pdf.lang.to_numpy()
    machine = Machine(sorted(set(own)))
    family = np.asarray([machine.family(y) for y in own])

    def duels(kind: str, names: list[str], of: np.ndarray) -> None:
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                at = np.flatnonzero((of == a) | (of == b))
                machine.pairs[kind + a, kind + b] = fit_svm(x[at], np.where(of[at] == a, 1.0, -1.0).astype(np.float32))

    duels("family ", machine.names(), family)
    for name in machine.names():
        duels("", sorted(y for y in machine.languages if machine.family(y) == name), own)
    return machine


def identify(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1) of each whole text.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned. All rows stay;
    columns called like the new ones are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # DIMS weights for each pair of languages
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n in slices(batch.column(at)):
                part = batch.slice(i, n)
                language, score = shared.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(language, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))
