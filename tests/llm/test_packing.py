from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugewise.llm import packing
from gaugewise.llm.queries import op9_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_pack_is_whole_and_unpadded(lengths):
    out = packing.pack(lengths, 64)
    for i, n in enumerate(lengths):
        parts = sorted((s, k) for p, s, k, _, _ in out if p == i)
        assert sum(k for _, k in parts) == n and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:], strict=False))
    room = defaultdict(list)
    for _, _, k, s, o in out:
        room[s].append((o, k))
    sizes = [sum(k for _, k in v) for v in room.values()]
    assert all(sorted(v)[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(sorted(v), sorted(v)[1:], strict=False)) for v in room.values())
    assert sum(lengths) == sum(sizes) and all(s == 64 or s & (s - 1) == 0 for s in sizes) and sum(s == 64 for s in sizes) == sum(lengths) // 64


def test_costs_are_balanced():
    lengths = np.random.default_rng(0).integers(20, 900, 3000).tolist()
    load, cuts = defaultdict(float), 0
    for _, _, n, s, _ in packing.pack(lengths, 2048):
        load[s] += packing.cost(n)
        cuts += 1
    full = np.asarray([v for s, v in load.items()][: sum(lengths) // 2048])
    naive, at = defaultdict(float), 0
    for n in lengths:
        naive[at // 2048] += packing.cost(n)
        at += n
    assert np.std(full) < 0.5 * np.std(list(naive.values())) and cuts - len(lengths) < 0.25 * len(lengths)


def back(df):
    """Documents' ids, in the order of pieces; checks the sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in df.collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 2048
        pieces[r.doc_id, r.doc_tokens].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for v in sequences.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(n for _, n in v) <= 2048
    return pieces, sequences


def test_round_trip(docs_from, sample):
    rows = [(None, None), (1, ""), (2, "long text " * 30_000), (3, "<|endoftext|> 日本"), (4, "x y")]
    df = docs_from(rows).unionByName(sample.withColumn("doc_id", F.col("doc_id") + 1000)).withColumn("offset", F.lit("mine")).withColumn("ids", F.lit("mine"))
    pieces, _ = back(packing.pack_documents(df, PATH, window_bytes=60_000))
    assert len(pieces) == df.count()
    for r in df.collect():
        want = [*TOK.encode(r.text or "", add_special_tokens=False).ids, 1]
        got = sorted(pieces[r.doc_id, len(want)], key=lambda p: p[0])
        assert np.concatenate([p[1] for p in got]).tolist() == want and [p[0] for p in got] == np.cumsum([0, *[len(p[1]) for p in got[:-1]]]).tolist()


def test_query_digests(spark, sf, sample):
    ids = {r.doc_id: np.asarray([*TOK.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in sample.collect()}
    seen = defaultdict(int)
    for r in op9_packing(spark, sf).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
    assert seen == {k: len(v) for k, v in ids.items()}


def test_repeated_and_empty(docs_from):
    assert packing.pack_documents(docs_from([]), PATH).count() == 0
    got = packing.pack_documents(docs_from([(1, "same text")] * 3), PATH).collect()
    assert sum(r.length for r in got) == 3 * got[0].doc_tokens


def test_layout_does_not_matter(docs_from, sample):
    """Other files, partitions and order give the same sequences."""
    def rows(df):
        return sorted((r.doc_id, r.start, r.length, r.sequence_id, r.offset, bytes(r.ids)) for r in packing.pack_documents(df, PATH, window_bytes=50_000).collect())

    a = rows(sample)
    assert a == rows(sample.repartition(7, "source")) == rows(sample.orderBy(F.desc("doc_id")).coalesce(1))
    assert len({r[3] >> 32 for r in a}) > 5


def test_ids_are_the_librarys(sample):
    texts = [r.text for r in sample.collect()] + ["<|endoftext|>a", "日本 \u3000x", "", None, "a\r\n  b\t'll ½", "\x85 \u200b"]
    for t, got in zip(texts, packing.token_ids(texts, PATH), strict=True):
        assert got.tolist() == TOK.encode(t or "", add_special_tokens=False).ids


def test_a_window_of_repeated_rows_is_cut(docs_from):
    got = packing.pack_documents(docs_from([(1, "same text")] * 300), PATH, window_bytes=100).collect()
    assert sum(r.length for r in got) == 300 * got[0].doc_tokens
    room = defaultdict(int)
    for r in got:
        room[r.sequence_id] += r.length
    assert len({r.sequence_id >> 32 for r in got}) == 1 and all(n == 2048 or n & (n - 1) == 0 for n in room.values())
