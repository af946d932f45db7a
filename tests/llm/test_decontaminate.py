from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugewise.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=10):
    owners = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for text in texts:
        w = words(text)
        hit, found = np.zeros(len(w), dtype=bool), set()
        for n in {len(k) for k in owners}:
            for i in range(len(w) - n + 1):
                if who := owners.get(tuple(w[i : i + n])):
                    hit[i : i + n] = True
                    found |= who
        out.append((len(w), int(hit.sum()), sorted(found)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=60), st.integers(1, 5))
def test_index(symbols, sample):
    text = np.asarray(symbols)
    index = d.FMIndex(text, sample)
    assert d.suffix_array(np.append(text, 0)).tolist() == sorted(range(len(text) + 1), key=lambda i: [*symbols[i:], 0])
    for n in (1, 2, 3):
        patterns = np.unique(np.asarray([symbols[i : i + n] for i in range(len(symbols) - n + 1)] + [[1] * n]), axis=0)
        low, high = index.search(patterns)
        for p, a, b in zip(patterns.tolist(), low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(symbols) - n + 1) if symbols[i : i + n] == p]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab c.", max_size=60), min_size=1, max_size=6), st.lists(st.text(alphabet="ab c", max_size=14), max_size=4))
def test_spans(texts, benchmark):
    items = [(str(i % 3), t) for i, t in enumerate(benchmark)]
    n, spans, found = d.Phrases(items, 3).spans(texts)
    got = [(a, sum(y - x for x, y in s), sorted(f)) for a, s, f in zip(n, spans, found, strict=True)]
    assert got == brute(texts, items, 3)
    for t, s in zip(texts, spans, strict=True):
        if s:
            kept = [w for i, w in enumerate(words(t)) if not any(a <= i < b for a, b in s)]
            assert words(d.cut_spans(t, s)) == kept


def test_tables(spark, sample, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = d.find_contamination(sample, benchmark, shard_words=5000).orderBy("doc_id").collect()
    want = brute([r.text for r in rows], [(str(r.item_id), r.text) for r in benchmark.collect()])
    assert [(r.n_words, r.n_hit, list(r["items"])) for r in rows] == want and sum(w[1] for w in want) > 0
    blocks = d.find_contamination(sample, benchmark, block_bytes=2000).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, list(r["items"]), [tuple(s) for s in r.spans]) for r in blocks] == [(r.n_words, r.n_hit, list(r["items"]), [tuple(s) for s in r.spans]) for r in rows]
    clean = d.decontaminate(sample, benchmark)
    assert clean.columns == sample.columns and d.find_contamination(clean, benchmark).agg(F.sum("n_hit")).first()[0] == 0
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert all(texts[r.doc_id] == r.text for r in rows if not r.n_hit) and all(len(words(texts[r.doc_id])) <= r.n_words - r.n_hit for r in rows)
    assert {i: t for i, t in texts.items()} == {r.doc_id: r.text for r in d.decontaminate(sample, benchmark, block_bytes=2000).collect()}


def test_edges(spark, docs_from):
    bench = spark.createDataFrame([(1, "Alpha beta"), (1, "gamma DELTA"), (2, None), (3, ""), (4, "..."), (None, "omega"), (5, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    long = "filler " * 50_000 + " ".join(f"W{i}" for i in range(11)) + " filler" * 5
    rows = [(1, None), (2, ""), (None, "alpha, BETA"), (3, "beta alpha"), (3, "x gamma delta omega"), (3, "x gamma delta omega"), (4, long), (5, "?!"), (6, "alpha\xa0beta")]
    df = docs_from(rows).withColumn("n_hit", F.lit("old")).withColumn("item_id", F.lit(7))
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in d.find_contamination(df, bench).collect())
    assert got == sorted([("1", 0, 0, []), ("2", 0, 0, []), ("None", 2, 2, ["1"]), ("3", 2, 0, []), ("3", 4, 3, ["", "1"]), ("3", 4, 3, ["", "1"]), ("4", 50_016, 11, ["5"]), ("5", 0, 0, []), ("6", 1, 0, [])])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.find_contamination(df, empty).agg(F.sum("n_hit")).first()[0] == 0 and d.find_contamination(docs_from([]), bench).count() == 0
    cut = {str(r.doc_id): r.text for r in d.decontaminate(docs_from([(1, "a alpha x beta b"), (2, "alpha gamma delta beta c"), (3, None)]), bench).collect()}
    assert cut["1"] == "a alpha x beta b" and words(cut["2"]) == ["c"] and cut["3"] is None


def test_blocks_do_not_change_results(spark, docs_from):
    bench, rows = [], []
    for k in range(6):
        w = [f"k{k}w{i}" for i in range(36)]
        bench += [(f"a{k}", " ".join(w[:30])), (f"b{k}", " ".join(w[20:35]))]  # they overlap in a text
        rows.append((k, "before " + " ".join(w) + " after"))
        bench += [(f"c{k}", " ".join(f"k{k}c{i}" for i in range(12))), (f"d{k}", " ".join(f"k{k}d{i}" for i in range(12)))]
        inner, outer = ([f"k{k}{x}{i}" for i in range(12)] for x in "cd")
        rows.append((100 + k, " ".join(outer[:6] + inner + outer[6:]) + " x"))  # a cut brings a window together
        rows.append((200 + k, " ".join(inner[:6] + outer + inner[6:]) + " x"))
    docs, bench = docs_from([*rows, (900, None), (901, "")]).withColumn("spans", F.lit("mine")), spark.createDataFrame(bench, "item_id string, text string")
    one = {r.doc_id: r.text for r in d.decontaminate(docs, bench).collect()}
    out = d.decontaminate(docs, bench, block_bytes=400)
    assert out.columns == docs.columns and {r.spans for r in out.collect()} == {"mine"}
    assert {r.doc_id: r.text for r in out.collect()} == one and all(words(one[k]) == ["before", f"k{k}w35", "after"] and words(one[100 + k]) == words(one[200 + k]) == ["x"] for k in range(6))
