"""Toxicity: a factorization machine over hashed terms.

A term is a lower-cased word, hashed to one of ``TERMS`` buckets; a document has or has not a term.
The score is sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>), so that two terms together can
mean what neither means alone. All terms of a bounded sample are weighed. Those enter the machine
whose evidence is beyond chance: evidence of their own against the label, or evidence of a pair of
them against what the machine so far expects. Interacting pairs are sought among all terms at once,
by power iteration on the matrix of residuals over co-occurring terms; the search repeats with the
refitted machine until no further pair is found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewise.llm._common import col, word_bytes

TERMS = 1 << 20
#: Training takes at most this many rows of each label, those of the lowest hash of their id.
SAMPLE_PER_LABEL = 6000
#: Evidence that the label depends on a term, -ln of the Chernoff bound: by chance one of TERMS terms exceeds it once in 20 corpora.
LEAST_EVIDENCE = 17.0
#: The same for a pair of terms, of which there are some 10**8.
LEAST_PAIR_EVIDENCE = 22.5
#: A pair can have that evidence only if both terms are in this many rows.
LEAST_ROWS = 25
FACTORS = 8


def terms(text: str | None) -> np.ndarray:
    """The sorted buckets of a text's distinct words."""
    words = set(word_bytes(text))
    return np.unique(np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % TERMS)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Sparse:
    """Rows of 0 and 1 as the columns of the ones, row after row, and the row of each."""

    columns: np.ndarray
    row: np.ndarray
    n: int

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sparse:
        sizes = [len(r) for r in rows]
        return cls(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes), len(rows))

    def only(self, keep: np.ndarray) -> Sparse:
        """The columns ``keep``, numbered in their order."""
        place = np.full(TERMS, -1)
        place[keep] = np.arange(len(keep))
        at = place[self.columns] >= 0
        return Sparse(place[self.columns[at]], self.row[at], self.n)

    def distinct(self, y: np.ndarray, weight: np.ndarray) -> tuple[Sparse, np.ndarray, np.ndarray]:
        """Equal rows once, with their weights added and the weighted mean of their labels."""
        cuts = np.searchsorted(self.row, np.arange(self.n + 1))
        at: dict[bytes, int] = {}
        which = np.asarray([at.setdefault(self.columns[a:b].tobytes(), len(at)) for a, b in zip(cuts, cuts[1:], strict=False)], dtype=np.int64)
        total = np.bincount(which, weight)
        return Sparse.of([np.frombuffer(k, np.int64) for k in at]), np.bincount(which, weight * y) / np.maximum(total, 1e-300), total

    def by_row(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values, self.n)

    def margins(self, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """w0 + w.x + ((x V)^2 - x^2 V^2) / 2, and x V."""
        own = v[self.columns]
        s = np.stack([self.by_row(f) for f in own.T], 1) if v.shape[1] else np.zeros((self.n, 0))
        return w0 + self.by_row(w[self.columns]) + 0.5 * ((s * s).sum(1) - self.by_row((own * own).sum(1))), s


@dataclass
class Machine:
    """Weights and factors of the terms ``chosen`` (sorted)."""

    chosen: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.chosen):
            return np.full(len(texts), _sigmoid(self.w0))
        rows = []
        for x in texts:
            t = terms(x)
            at = np.minimum(np.searchsorted(self.chosen, t), len(self.chosen) - 1)
            rows.append(at[self.chosen[at] == t])
        return _sigmoid(Sparse.of(rows).margins(self.w0, self.w, self.v)[0])


def fit(x: Sparse, n_terms: int, y: np.ndarray, weight: np.ndarray, factors: int = FACTORS, steps: int = 600, rate: float = 0.05, decay: float = 1e-6, seed: int = 0):
    """w0, w, v by Adam on the weighted logistic loss, with L2 decay."""
    rng = np.random.default_rng(seed)
    x, y, weight = x.distinct(y, weight / weight.sum())
    base = float(np.clip((weight * y).sum(), 1e-4, 1 - 1e-4))
    params = [np.array([np.log(base / (1 - base))]), np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, factors))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        w0, w, v = params
        margin, s = x.margins(w0[0], w, v)
        g = weight * (_sigmoid(margin) - y)
        gx = np.bincount(x.columns, g[x.row], n_terms)
        gs = np.stack([np.bincount(x.columns, f[x.row], n_terms) for f in (g[:, None] * s).T], 1)
        grads = [np.array([g.sum()]), gx + decay * w, gs - gx[:, None] * v + decay * v]
        for p, m, q, d in zip(params, first, second, grads, strict=True):
            m += 0.1 * (d - m)
            q += 0.01 * (d * d - q)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.99**t)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def telling_terms(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Terms whose own evidence against the label is LEAST_EVIDENCE or more."""
    share = y.mean()
    a, b = np.bincount(x.columns, y[x.row], TERMS), np.bincount(x.columns, 1 - y[x.row], TERMS)
    n = np.maximum(a + b, 1)
    evidence = a * np.log(np.maximum(a, 1e-9) / (n * share)) + b * np.log(np.maximum(b, 1e-9) / (n * (1 - share)))
    return np.flatnonzero(evidence >= LEAST_EVIDENCE)


def telling_pairs(x: Sparse, residual: np.ndarray, spread: np.ndarray, seed: int = 0, vectors: int = 8, rounds: int = 8, wide: int = 32) -> np.ndarray:
    """Terms of pairs whose rows' residuals add up to more than chance allows; ``spread``: the residuals' variances.

    A row's residual times the products of its terms, each over the root of its number of rows,
    makes a matrix over all terms; interacting pairs stand out in its leading vectors. The ``wide``
    largest terms of each are then tested pair by pair.
    """
    count = np.bincount(x.columns, minlength=TERMS)
    able = np.flatnonzero(count >= LEAST_ROWS)
    if len(able) < 2:
        return able[:0]
    z = x.only(able)
    scale = 1 / np.sqrt(count[able])
    own = scale[z.columns]
    size = z.by_row(own * own)
    pull = residual / np.maximum(1, size / max(np.median(size), 1e-12))  # long rows have many pairs
    diagonal = np.bincount(z.columns, pull[z.row] * own * own, len(able))
    u = np.random.default_rng(seed).normal(size=(len(able), min(vectors, len(able))))
    for _ in range(rounds):
        u, _ = np.linalg.qr(u)
        u = np.stack([np.bincount(z.columns, own * (z.by_row(own * f[z.columns]) * pull)[z.row], len(able)) - diagonal * f for f in u.T], 1)
    seen = np.unique(np.argsort(-np.abs(u), axis=0)[:wide])
    some = x.only(able[seen])
    dense = np.zeros((x.n, len(seen)), dtype=np.float32)
    dense[some.row, some.columns] = 1
    total, variance = dense.T @ (dense * residual[:, None]), dense.T @ (dense * spread[:, None])
    np.fill_diagonal(total, 0)
    i, _ = np.nonzero(total * total >= 2 * LEAST_PAIR_EVIDENCE * np.maximum(variance, 1e-9))
    return able[seen[np.unique(i)]]


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [terms(x.as_py()).astype("<i4").tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["label", "mark", "terms"])


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", use: Column | None = None,
    sample_per_label: int = SAMPLE_PER_LABEL,
) -> Machine:
    """Fits a machine on the documents that ``labels`` marks 0 or 1.

    ``use``: which rows of ``labels`` may be learned from. At most ``sample_per_label`` rows of each
    label are taken; labels of one key that differ, and those of texts that repeat, count once, with
    their mean. Rows with a null label, key or text are left out. The share of label 1 among all rows
    that may be used sets the score's level. Without any row, every score is 0.5 or less; without
    telling terms, all are equal.
    """
    given = labels.where(col(label).isin(0, 1) & col(key).isNotNull() & (F.lit(True) if use is None else use))
    given = given.groupBy(col(key).alias("id")).agg(F.avg(col(label)).alias("label"))
    toxic = F.col("label") >= 0.5
    shares = {r[0]: r[1] for r in given.groupBy(toxic).count().collect()}
    some = [given.where(c).orderBy(F.xxhash64("id"), "id").limit(sample_per_label) for c in (~toxic, toxic)]
    sample = F.broadcast(some[0].unionByName(some[1]))  # at most twice sample_per_label ids
    rows = docs.where(col(text).isNotNull()).select(col(key).alias("id"), col(text).cast("string").alias("text")).join(sample, "id")
    told = rows.select("label", "text", F.xxhash64("text").alias("mark")).mapInArrow(_term_rows, "label double, mark long, terms binary")
    told = told.groupBy("mark").agg(F.avg("label").alias("label"), F.first("terms").alias("terms")).toPandas().sort_values("mark")
    y = told.label.to_numpy(dtype=np.float64)
    prior = shares.get(True, 0) / max(1, sum(shares.values()))
    if not len(y) or y.min() >= 0.5 or y.max() < 0.5:
        level = float(np.clip(prior, 1e-4, 0.5))
        return Machine(np.zeros(0, np.int64), float(np.log(level / (1 - level))), np.zeros(0), np.zeros((0, FACTORS)))
    x = Sparse.of([np.frombuffer(t, "<i4") for t in told.terms])
    weight = np.where(y >= 0.5, prior / max(1e-9, y.mean()), (1 - prior) / max(1e-9, 1 - y.mean()))
    chosen = telling_terms(x, y)
    while True:
        mine = x.only(chosen)
        # pairs are judged in the sample as it is, the machine in the end at the corpus's level
        expected = _sigmoid(mine.margins(*fit(mine, len(chosen), y, np.ones(len(y))))[0])
        more = np.setdiff1d(telling_pairs(x, y - expected, expected * (1 - expected)), chosen)
        if not len(more):
            return Machine(chosen, *fit(mine, len(chosen), y, weight))
        chosen = np.union1d(chosen, more)


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the machine's score of each whole text, 0 to 1; a null text scores as an empty one.

    A column called ``name`` is replaced; all rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most TERMS terms, FACTORS + 1 numbers each
    docs = docs.drop(name)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                values = pa.array(shared.value.scores(part.column(at).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
