from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugewise.llm import sharding
from gaugewise.llm.queries import op1_sharding


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 10**6))
def test_permutation_and_walks(n, seed):
    x = np.arange(n, dtype=np.int64)
    p = sharding.permute(x, n, seed)
    steps = 0
    while (p >= n).any():
        p = np.where(p < n, p, sharding.permute(p, n, seed))
        steps += 1
    assert sorted(p) == list(range(n)) and steps == sharding.walks(n, seed)


def test_columns_follow_the_arrays(spark):
    for n, seed in ((1, 0), (17, 3), (1000, 5), (10**9 + 7, 1)):
        x = [i for i in (0, 1, 5, n // 2, n - 1) if i < n]
        got = [r[0] for r in spark.createDataFrame([(i,) for i in x], "i long").select(sharding.permuted(F.col("i"), n, seed)).collect()]
        want = sharding.permute(np.asarray(x), n, seed)
        while (want >= n).any():
            want = np.where(want < n, want, sharding.permute(want, n, seed))
        assert got == want.tolist()


def test_query(spark, sf, sample):
    rows = {r.doc_id: r for r in op1_sharding(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in sample.collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        data = (texts[i] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "rows") and r.grown_shard is None
    by: dict[int, list[int]] = {}
    for r in rows.values():
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_layout_does_not_matter(sample):
    def places(df, seed=7):
        return {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df.select("doc_id"), 5, seed).collect()}

    a = places(sample)
    assert a == places(sample.repartition(7).orderBy(F.desc("doc_id"))) and a != places(sample, 8)


def test_order_is_mixed(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    rows = sorted(((r.shard, r.slot), r.doc_id) for r in sharding.shard(df, 1).collect())
    ids = np.asarray([i for _, i in rows])
    assert abs(np.corrcoef(ids, np.arange(2000))[0, 1]) < 0.08 and (np.diff(ids) == 1).mean() < 0.01


def test_edges(spark, docs_from, tmp_path):
    assert sharding.shard(docs_from([])).count() == 0
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, "x" * 200_000), (2, "")]
    df = docs_from(rows).withColumn("bucket", F.lit("mine")).withColumn("offset", F.lit(1)).withColumn("Shard", F.lit(9))
    got = sharding.shard(df, 4).collect()
    assert len(got) == 6 and sorted((r.shard, r.slot) for r in got) == [(k, s) for k in range(4) for s in range(2 if k < 2 else 1)] and all(r.bucket == "mine" for r in got)
    with pytest.raises(ValueError):
        sharding.shard(df, 0)
    sharding.write_shards(docs_from(rows), str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 6 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1}
    assert math.isqrt(6) == 2


def test_written_shards_are_files_in_slot_order(spark, docs_from, tmp_path):
    """A shard is several files, whose names are in the order of its slots."""
    import pyarrow.parquet as pq

    sharding.write_shards(docs_from([(i, f"t{i}") for i in range(400)]), str(tmp_path / "out"), 2, partitions=7)
    files = {k: sorted((tmp_path / "out" / f"shard={k}").glob("*.parquet")) for k in (0, 1)}
    assert all(len(f) >= 3 for f in files.values())
    for paths in files.values():
        slots = [s for p in paths for s in pq.ParquetFile(p).read(columns=["slot"])["slot"].to_pylist()]
        assert slots == list(range(200))
