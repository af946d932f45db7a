"""Token counts: each distinct pre-token is cut into pieces once, then joined to the documents' pre-token frequencies.

1. Pre-tokens of all documents with the number of documents they occur in (summed per task first).
2. Pieces of each distinct pre-token, written as a table.
3. The most frequent pre-tokens, at most ``common`` of them, go to every task; a document sums
   those itself. The others are joined by a shuffle on the pre-token and summed by document. So
   neither a frequent pre-token nor an endless vocabulary lands in one place.

No token ids are kept; only the number of pieces of a pre-token is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.llm._common import col, fresh, written

COMMON = 2**17
SPECIAL = "<|endoftext|>"
# Letters and numbers up to U+024F, whose classes no Unicode version has changed.
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
#: Anything else than tab, line feed, carriage return, printable Latin up to U+024F and common punctuation.
ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ–—‘’“”…]")

_loaded: dict = {}


def tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def pre_tokens(text: str, path: str) -> list[str]:
    """A text's pre-tokens; those of unusual signs as the library cuts them. A special string is one by itself."""
    out: list[str] = []
    for i, part in enumerate(text.split(SPECIAL)):
        if i:
            out.append(SPECIAL)
        if ODD.search(part):
            out += [part[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(part)]
        else:
            out += PLAIN.findall(part)
    return out


def _vocabulary(text: str, path: str, flush: int = 300_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece_text", "n_docs"])

        for batch in batches:
            for x in batch.column(0):
                if (value := x.as_py()) is not None:
                    seen.update(set(pre_tokens(value, path)))
                if len(seen) > flush:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                counts = [len(e) for e in tok.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int32())], ["piece_text", "n_docs", "n_pieces"])

    return run


def _frequencies(path: str, shared, names: list[str]):
    """Per document a row with its bytes and the pieces of its common pre-tokens, then a row for each rare pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows, texts, counts, sizes = [], [], [], []
                for i, x in enumerate(part.column(2)):
                    value = x.as_py() or ""
                    total, rare = 0, []
                    for p in pre_tokens(value, path):
                        n = known(p)
                        if n is None:
                            rare.append(p)
                        else:
                            total += n
                    some = Counter(rare)
                    rows += [i] * (1 + len(some))
                    texts.append(f"\0{at + i}")  # no pre-token: spreads these rows over the join's tasks
                    texts += some
                    counts.append(total)
                    counts += some.values()
                    sizes.append(len(value.encode("utf-8", "replace")))
                    sizes += [None] * len(some)
                keys = part.select([0, 1]).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names)

    return run


def piece_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Each distinct pre-token of ``docs`` once: piece_text, n_docs, n_pieces."""
    seen = docs.select(col(text).cast("string")).mapInArrow(_vocabulary(text, path), "piece_text string, n_docs long")
    distinct = seen.groupBy("piece_text").agg(F.sum("n_docs").alias("n_docs"))
    return distinct.mapInArrow(_pieces(path), "piece_text string, n_docs long, n_pieces int")


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", common: int = COMMON) -> DataFrame:
    """One row for each row of ``docs``: ``key``, n_bytes, n_tokens.

    ``path``: the tokenizer's file. A null or empty text has 0 bytes and 0 tokens; a null key is a
    key like another. Rows that share a key are told apart by the hash of their text, and rows alike
    in both are counted and given back as often. Other columns play no part.
    """
    spark = docs.sparkSession
    pieces = written(piece_table(docs, path, text), "pieces")
    level = F.floor(8 * F.log2("n_docs")).cast("int")
    lowest, total = None, 0
    for at, n in sorted(((r[0], r[1]) for r in pieces.groupBy(level).count().collect()), reverse=True):
        total += n
        if total > common:
            break
        lowest = at
    frequent = F.lit(False) if lowest is None else level >= lowest
    few = pieces.where(frequent).select("piece_text", "n_pieces").toPandas()
    shared = spark.sparkContext.broadcast(dict(zip(few.piece_text, few.n_pieces.tolist(), strict=True)))
    mark, piece, n, size = fresh(docs.select(col(key)), "text_mark", "piece_text", "n", "size")
    kind = docs.schema[key].dataType.simpleString()
    parts = docs.select(col(key), F.xxhash64(col(text)).alias(mark), col(text).cast("string")).mapInArrow(
        _frequencies(path, shared, [key, mark, piece, n, size]), f"`{key}` {kind}, `{mark}` long, `{piece}` string, `{n}` long, `{size}` long"
    )
    rest = pieces.where(~frequent).select(col("piece_text").alias(piece), "n_pieces")
    rows = F.count(col(size))
    return (
        parts.join(rest, piece, "left")
        .groupBy(col(key), col(mark))
        .agg(
            F.max(col(size)).alias("n_bytes"),
            (F.sum(F.when(col(size).isNotNull(), col(n)).otherwise(col(n) * F.col("n_pieces"))) / rows).cast("long").alias("n_tokens"),
            F.sequence(F.lit(1).cast("long"), rows).alias(mark + "s"),
        )
        .withColumn(mark, F.explode(col(mark + "s")))
        .select(col(key), "n_bytes", "n_tokens")
    )
