"""Benchmark decontamination with an FM-index over each shard of training text.

A task takes the documents it reads in shards of about ``SHARD_WORDS`` words. A shard's words become
symbols: benchmark words have their own, all others share one; stretches of benchmark words shorter
than the shortest window can hold none and are left out, and one separator stands between the
stretches that stay. The shard's suffix array gives its Burrows-Wheeler transform, kept as a wavelet
matrix with ranks at every level, and every ``SAMPLE``-th suffix position. All windows of the
benchmark are searched backwards at once; occurrences are located from the sampled positions and
merged into spans of words. The text is read once, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewise.llm._common import col, trimmed, word_bytes, WORD_TABLE, written

WINDOW = 10
SHARD_WORDS = 1 << 17
SAMPLE = 16
#: Bytes of benchmark text that one pass takes; a larger benchmark takes more passes.
BLOCK_BYTES = 8 << 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``, whose last symbol is its only 0; by doubling, re-sorting only ties."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, dtype=np.int64)])
    for i in range(width):
        key = key << bits | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        suffixes = order[at]
        beyond = suffixes + width
        nextrank = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
        by = np.lexsort((nextrank, rank[suffixes]))
        suffixes, group, nextrank = suffixes[by], rank[suffixes][by], nextrank[by]
        order[at] = suffixes
        new[at] = np.concatenate([[True], (group[1:] != group[:-1]) | (nextrank[1:] != nextrank[:-1])])
        rank[suffixes] = np.maximum.accumulate(np.where(new[at], at, 0))
        width *= 2


class FMIndex:
    """Counts and locates patterns of symbols > 0 in an array of symbols > 0."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n, self.sample = len(text), sample
        self.levels = max(1, int(text.max()).bit_length())
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))])
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (bwt >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        held = order % sample == 0
        self.held = np.concatenate([[0], np.cumsum(held, dtype=np.int32)])
        self.positions = order[held]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the transform before ``at``."""
        low, high = np.zeros_like(at), at
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            bit = symbol >> level & 1 == 1
            a, b = ones[low], ones[high]
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
            out = out << 1 | bit
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each row of ``patterns``, by backward search."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for i in reversed(range(patterns.shape[1])):
            c = patterns[alive, i]
            low[alive] = self.starts[c] + self.rank(c, low[alive])
            high[alive] = self.starts[c] + self.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of the suffixes at ``rows``, walking back to a sampled one."""
        out, walk, steps, at = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), 0, rows.copy()
        while len(walk):
            held = self.held[at + 1] > self.held[at]
            out[walk[held]] = self.positions[self.held[at[held]]] + steps
            walk, at, steps = walk[~held], at[~held], steps + 1
            c = self.symbol(at)
            at = self.starts[c] + self.rank(c, at)
        return out


class Phrases:
    """The distinct windows of some benchmark items, as symbols."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        starts, sizes, owner, at = [], [], [], 0
        ids = []
        for item, text in items:
            mine = np.asarray([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in word_bytes(text)], dtype=np.int32)
            if len(mine):
                ids.append(mine)
                starts.append(at + np.arange(max(1, len(mine) - window + 1), dtype=np.int64))
                sizes.append(min(window, len(mine)))
                owner.append(number[item])
                at += len(mine)
        counts = [len(x) for x in starts]
        symbols = np.concatenate([*ids, np.zeros(0, np.int32)])
        starts = np.concatenate([*starts, np.zeros(0, np.int64)])
        size, who = np.repeat(np.asarray(sizes, np.int64), counts), np.repeat(np.asarray(owner, np.int32), counts)
        #: By length: distinct windows, and the items of window i at owners[cuts[i] : cuts[i + 1]].
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(size).tolist():
            mine = size == n
            rows = symbols[starts[mine][:, None] + np.arange(n)]
            order = np.lexsort((who[mine], *rows.T[::-1]))
            rows, owners = rows[order], who[mine][order]
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:] != rows[:-1]).any(1)
            pair = new.copy()
            pair[1:] |= owners[1:] != owners[:-1]
            self.by_length.append((rows[new], owners[pair], np.append(np.flatnonzero(new[pair]), pair.sum())))
        self.shortest = int(size.min()) if len(size) else 0

    def occurrences(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """For documents' words (as symbols, one after another, ending at ``ends``): starts and ends of all
        occurrences as word numbers, and the items found in each document."""
        items: list[set[str]] = [set() for _ in ends]
        starts, stops = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        known = words > 1
        edge = np.ones(len(words) + 1, dtype=bool)
        edge[1:-1] = known[1:] != known[:-1]
        edge[ends[ends < len(words)]] = True
        cuts = np.flatnonzero(edge)
        first, last = cuts[:-1], cuts[1:]
        stays = (last - first >= self.shortest) & known[first] if len(words) else np.zeros(0, dtype=bool)
        if not self.shortest or not stays.any():
            return starts[0], stops[0], items
        first, size = first[stays], (last - first)[stays]
        into = np.concatenate([[0], np.cumsum(size + 1)])  # each stretch and a separator
        symbols = np.ones(into[-1], dtype=np.int64)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        number = np.zeros(into[-1], dtype=np.int64)
        number[np.repeat(into[:-1], size) + inside] = np.repeat(first, size) + inside
        symbols[np.repeat(into[:-1], size) + inside] = words[np.repeat(first, size) + inside]
        index = FMIndex(symbols)
        top = len(index.starts) - 1
        for patterns, owners, cuts in self.by_length:
            able = np.flatnonzero((patterns < top).all(1))
            low, high = index.search(patterns[able].astype(np.int64))
            count = high - low
            which = np.repeat(able, count)
            if not len(which):
                continue
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            at = number[index.locate(rows)]
            starts.append(at)
            stops.append(at + patterns.shape[1])
            pairs = np.unique(np.stack([np.searchsorted(ends, at, side="right"), which], 1), axis=0)
            for doc, w in pairs.tolist():
                items[doc].update(self.items[i] for i in owners[cuts[w] : cuts[w + 1]])
        return np.concatenate(starts), np.concatenate(stops), items

    def spans(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Per text: its words, merged spans of hit words [start, end), items found."""
        get, all_words = self.vocabulary.get, [word_bytes(t) for t in texts]
        sizes = np.asarray([len(w) for w in all_words], dtype=np.int64)
        ends = np.cumsum(sizes)
        words = np.fromiter((get(w, 1) for ws in all_words for w in ws), dtype=np.int64, count=int(sizes.sum()))
        starts, stops, items = self.occurrences(words, ends)
        merged: list[list[tuple[int, int]]] = [[] for _ in texts]
        if len(starts):
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, stops, -1)
            hit = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
            from_, to = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
            for a, b in zip(from_.tolist(), to.tolist(), strict=True):  # a stretch of hits may go on in the next document
                doc = int(np.searchsorted(ends, a, side="right"))
                while a < b:
                    stop = min(b, int(ends[doc]))
                    if stop > a:
                        base = int(ends[doc] - sizes[doc])
                        merged[doc].append((a - base, stop - base))
                    a, doc = max(a, stop), doc + 1
        return sizes.tolist(), merged, items


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    data = text.encode("utf-8", "replace")
    word = np.frombuffer(data.translate(WORD_TABLE), dtype=np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.astype(np.int8), [0]])))
    begins, stops = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : begins[a]])
        at = int(stops[b - 1])
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(_SPAN)),
    ]
)


def _scan(shared, at_text: int, clean: bool, again: bool, shard_words: int):
    """Adds what is found to each row; with ``again``, to what an earlier pass has found. ``clean``: cuts it out instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in batches:
            size, begin = 0, 0
            for i, x in enumerate(batch.column(at_text)):
                size += len(x.as_buffer()) // 6 + 1 if x.is_valid else 1
                if size >= shard_words or i == batch.num_rows - 1:
                    yield shard(phrases, batch.slice(begin, i + 1 - begin))
                    size, begin = 0, i + 1

    def shard(phrases: Phrases, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(at_text).to_pylist()
        n_words, spans, items = phrases.spans(texts)
        if clean:
            todo = [i for i, s in enumerate(spans) if s]
            while todo:  # what a cut brings together may be a window too
                for i in todo:
                    texts[i] = cut_spans(texts[i], spans[i])
                _, more, _ = phrases.spans([texts[i] for i in todo])
                spans = dict(zip(todo, more, strict=True))
                todo = [i for i in todo if spans[i]]
            columns = list(part.columns)
            columns[at_text] = pa.array(texts, part.schema.field(at_text).type)
            return pa.RecordBatch.from_arrays(columns, part.schema.names)
        columns, names = list(part.columns), part.schema.names
        if again:
            *columns, before_items, before_spans = columns[:-4] + columns[-2:]
            names = names[:-4]
            items = [a | set(b) for a, b in zip(items, before_items.to_pylist(), strict=True)]
            spans = [_union(a, [(x["start"], x["stop"]) for x in b]) for a, b in zip(spans, before_spans.to_pylist(), strict=True)]
        hits = [sum(b - a for a, b in s) for s in spans]
        new = [pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(i) for i in items], pa.list_(pa.string())), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], SPANS)]
        return pa.RecordBatch.from_arrays([*columns, *new], [*names, *FOUND.names])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text, spans: the texts without their spans."""
    for batch in batches:
        texts = [cut_spans(t, [(x["start"], x["stop"]) for x in s]) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, batch.schema.field(1).type)], ["row", "text"])


def _blocks(spark: SparkSession, benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int):
    """The benchmark's windows in blocks of bounded size, each collected by itself."""
    rows = benchmark.select(F.coalesce(col(item_id).cast("string"), F.lit("")).alias("item"), col(text).cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        yield spark.sparkContext.broadcast(Phrases([(r.item, r.text) for r in part], window)), b == blocks - 1


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids as strings) and spans of hit words [start, stop).

    A null or empty text has no words, so no hits. Items without words never occur; items of one id
    are one item, a null id is the empty string. All rows stay, repeated ones too; columns of ``docs``
    that are called like the new ones are replaced.
    """
    spark = docs.sparkSession
    out = docs.drop(*FOUND.names)
    schema = T.StructType([*out.schema.fields, *FOUND.fields])
    at = out.columns.index(text)
    for i, (shared, last) in enumerate(_blocks(spark, benchmark, item_id, item_text, window, block_bytes)):
        out = out.mapInArrow(trimmed(_scan(shared, at, False, i > 0, shard_words)), schema)
        out = out if last else written(out, "contamination")
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` with every occurring window cut out of ``text``; cuts repeat until none occurs.

    All rows and columns stay; texts without hits are untouched, nulls stay null, and a text that is
    nothing but hits keeps only its signs. Over the blocks of a larger benchmark, the spans of all
    blocks are found on one text before any is cut, and what was cut is searched again by all blocks.
    """
    spark, at = docs.sparkSession, docs.columns.index(text)
    shared, last = next(_blocks(spark, benchmark, item_id, item_text, window, block_bytes))
    if last:
        return docs.mapInArrow(trimmed(_scan(shared, at, True, False, shard_words)), docs.schema)
    todo = docs.select(F.struct(*map(col, docs.columns)).alias("row"), col(text).alias("text"))
    done = []
    while True:
        found = written(find_contamination(todo, benchmark, window, "text", item_id, item_text, block_bytes, shard_words), "contamination")
        done.append(found.where("n_hit = 0").select("row", "text"))
        hit = found.where("n_hit > 0").select("row", "text", "spans")
        if hit.isEmpty():
            break
        todo = written(hit.mapInArrow(trimmed(_cut), todo.schema), "decontaminated")
    out = reduce(DataFrame.unionByName, done)
    return out.select(*[(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
