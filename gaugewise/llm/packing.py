"""Packing: cost-balanced sequences of at most ``capacity`` tokens.

A document's token ids are cut into pieces of ``capacity``, each a sequence by itself; the piece
that is left is packed with those of other documents. Documents are dealt over windows of about
``window_bytes`` of text by the hash of key and text, so that neither windows nor sequences depend on
files or partitions. A window's sequences get capacities that add up to exactly its tokens: full
ones, and powers of two for what is over, which need no padding. Its pieces come in descending cost,
linear * length + quadratic * length**2, each to the sequence of lowest cost that can hold it; if none
can, the sequence of lowest cost that has room left takes what it can, and the rest goes on.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.llm._common import col, fresh, trimmed
from gaugewise.llm.token_count import SPECIAL, pre_tokens, tokenizer

CAPACITY = 2048
END_ID = 1
#: Text of a window, on average: a million tokens, some 500 sequences.
WINDOW_BYTES = 4 << 20
#: Cost of a piece: LINEAR * n + QUADRATIC * n * n. Attention costs as much as the rest at 4096 tokens.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 1 << 18


class _Pieces(dict):
    """Pre-token to the bytes of its ids, by the library's model; the first REMEMBERED stay in memory."""

    def __init__(self, path: str):
        super().__init__()
        tok = tokenizer(path)
        self.model, self.special = tok.model, tok.token_to_id(SPECIAL)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printable]
        #: The model's letters: printable bytes as they are, the others from U+0100 on in their order.
        self.letters = {b: b for b in printable} | {b: 0x100 + i for i, b in enumerate(rest)}

    def __missing__(self, piece: str) -> bytes:
        if piece == SPECIAL:
            ids = [self.special]
        else:
            ids = [t.id for t in self.model.tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(self.letters))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < REMEMBERED:
            self[piece] = out
        return out


_known: dict[str, _Pieces] = {}


def token_ids(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The texts' ids as the library gives them without added special tokens, pre-token by pre-token."""
    if path not in _known:
        _known[path] = _Pieces(path)
    get = _known[path].__getitem__
    return [np.frombuffer(b"".join(map(get, pre_tokens(t or "", path))), dtype="<u4") for t in texts]


def cost(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * n + quadratic * n * n


def capacities(total: int, capacity: int) -> list[int]:
    """Capacities that add up to ``total``: full ones, then falling powers of two."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in the piece, length, sequence, offset in the sequence) for pieces of these lengths."""
    room = np.asarray(capacities(sum(lengths), capacity), dtype=np.int64)
    size, load = room.copy(), np.zeros(len(room))
    out = []
    for i in sorted(range(len(lengths)), key=lambda i: (-cost(lengths[i], linear, quadratic), i)):
        start, left = 0, lengths[i]
        while left:
            fits = room >= left
            s = int(np.where(fits if fits.any() else room > 0, load, np.inf).argmin())
            n = min(left, int(room[s]))
            out.append((i, start, n, s, int(size[s] - room[s])))
            room[s] -= n
            load[s] += cost(n, linear, quadratic)
            start, left = start + n, left - n
    return out


_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
DDL = "`start` long, `length` long, `ids` binary, `doc_tokens` long, `sequence_id` long, `offset` long"


def _encoded(path: str, end_id: int, names: list[str]):
    """key, window, mark and text to key, window, mark, tokens and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [x.tobytes() + end for x in token_ids(part.column(3).to_pylist(), path)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names)

    return run


def _packed(capacity: int, most: int, names: list[str], digest: bool):
    """Pieces of the rows of whole windows, which come one after another in descending order of tokens left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # key, start, ids, tokens of the document
        window, sequence, held, rows, kind = None, 0, 0, [], None

        def give(key, start, ids, total, sequence, offset):
            data = ids.tobytes()
            rows.append((key, start, len(ids), zlib.crc32(data).to_bytes(4, "big") if digest else data, total, sequence, offset))

        def flush():
            nonlocal sequence, held
            for i, start, n, s, offset in pack([len(w[2]) for w in waiting], capacity):
                key, at, ids, total = waiting[i]
                give(key, at + start, ids[start : start + n], total, sequence + s, offset)
            sequence += len(capacities(held, capacity))
            waiting.clear()
            held = 0

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], _FIELDS, strict=True))], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, own, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(4), strict=True):
                if own != window or held >= most:  # rows alike in key and text may fill a window beyond measure
                    flush()
                    sequence = sequence if own == window else own << 32
                    window = own
                ids = np.frombuffer(data.as_buffer(), dtype="<u4")
                whole = len(ids) // capacity * capacity
                for at in range(0, whole, capacity):
                    give(key.as_py(), at, ids[at : at + capacity], len(ids), sequence, 0)
                    sequence += 1
                if whole < len(ids):
                    waiting.append((key.as_py(), whole, ids[whole:].copy(), len(ids)))
                    held += len(ids) - whole
                if len(rows) >= 256:
                    yield batch_of()
        if kind is not None:
            flush()
            yield batch_of()

    return run


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id",
    window_bytes: int = WINDOW_BYTES, digest: bool = False,
) -> DataFrame:
    """One row per piece: ``key``, start, length, ids, doc_tokens, sequence_id, offset.

    ``path``: the tokenizer's file. A document's tokens are its ids and then ``end_id``; ids are
    unsigned 32-bit little-endian, with ``digest`` their CRC-32 (4 bytes, big-endian) instead. A
    null text counts as empty: one token. Each row is a document, repeated keys and null keys
    included; rows alike in key and text are interchangeable. An empty table has no pieces. Every
    sequence is full or as long as a power of two. The same rows give the same sequences in any layout.
    """
    names = [key, *(n for n, _ in _FIELDS)]
    kind = docs.schema[key].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(col(text).cast("string")) + 1)).first()[0] or 0
    windows = max(1, round(total / window_bytes))
    window, mark, tokens, ids = fresh(docs.select(col(key)), "window", "mark", "tokens", "token_ids")
    hashed = F.xxhash64(col(key).cast("string"), col(text))
    given = docs.select(col(key), F.pmod(hashed, F.lit(windows)).alias(window), hashed.alias(mark), col(text).cast("string").alias("text"))
    encoded = given.mapInArrow(trimmed(_encoded(path, end_id, [key, window, mark, tokens, ids])), f"`{key}` {kind}, `{window}` long, `{mark}` long, `{tokens}` long, `{ids}` binary")
    left = col(tokens) % capacity
    dealt = encoded.repartition(col(window)).sortWithinPartitions(col(window), left.desc(), col(mark))
    return dealt.mapInArrow(trimmed(_packed(capacity, 2 * window_bytes, names, digest)), f"`{key}` {kind}, {DDL}")


def id_digest(column: str = "ids"):
    """The digest of ``pack_documents(digest=True)`` as a long."""
    return F.conv(F.hex(col(column)), 16, 10).cast("long")
