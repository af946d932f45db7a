from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugewise.llm import packing, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
ODD = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "it's we'll I'D", "  two  spaces \n\n\t end  ", "naïve Ünï ñ", "日本語 テキスト", "😀😀 x", "x​y\xa0z ", "½ ² 12³", "\x00\x1c\x1f\x85", "…–“q”", "é", "ǅ ʰ ɐ", "a" * 3000, "\r\n\r\n x"]


def ids(text):
    return TOK.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_pre_tokens_and_ids(text):
    pieces = token_count.pre_tokens(text, PATH)
    assert "".join(pieces) == text and sum(len(ids(p)) for p in pieces) == len(ids(text))
    assert packing.token_ids([text], PATH)[0].tolist() == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(alphabet="ab 'st\n\t.1é", max_size=40))
def test_any_text(text):
    assert sum(len(ids(p)) for p in token_count.pre_tokens(text, PATH)) == len(ids(text))
    assert packing.token_ids([text], PATH)[0].tolist() == ids(text)


@pytest.mark.parametrize("common", [0, 50, 2**17])
def test_counts(docs_from, sample, common):
    rows = [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "null id"), (1, ""), (1, "twice"), (1, "twice"), (7, None), (5, "very long " * 20_000)]
    df = docs_from(rows).unionByName(sample.limit(60).withColumn("doc_id", F.col("doc_id") + 100_000)).withColumn("n", F.lit(1)).withColumn("piece_text", F.lit("mine"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_count.count_tokens(df, PATH, common=common).collect())
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(ids(r.text or ""))) for r in df.collect())
    assert got == want


def test_empty(docs_from):
    assert token_count.count_tokens(docs_from([]), PATH).count() == 0
    assert [tuple(r) for r in token_count.count_tokens(docs_from([(1, None)]), PATH).collect()] == [(1, 0, 0)]
