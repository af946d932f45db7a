"""Sharding: a keyed Feistel permutation over global row numbers.

Rows are numbered 0..N-1 by (bucket of the key, key, hash of the row), so that the numbering
follows from the data and not from files or partitions. A Feistel network over pairs (l, r) with
l, r < side, side = ceil(sqrt(N)), permutes 0..side**2-1; numbers that leave 0..N-1 walk along
their cycle until they are back. A row's shard and slot are the remainder and the quotient of its
permuted number by the number of shards: any reader can compute where row i went.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.llm._common import col, fresh

PRIME = 2**31 - 1
ROUNDS = 4
#: Rows are numbered within this many buckets of the key's hash, at once.
BUCKETS = 4096


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    keys = []
    for i in range(rounds):
        d = hashlib.sha256(f"feistel/{seed}/{i}".encode()).digest()
        keys.append(tuple(1 + int.from_bytes(d[j : j + 8], "big") % (PRIME - 1) for j in (0, 8, 16)))
    return keys


def side_of(n: int) -> int:
    side = math.isqrt(max(n, 1))
    return side if side * side >= n else side + 1


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """One pass of the network over 0..side**2-1, for arrays."""
    side = side_of(n)
    left, right = x // side, x % side
    for add, mul, inc in round_keys(seed):
        y = (right + add) % PRIME
        y = y * y % PRIME
        left, right = right, (left + (y * mul + inc) % PRIME % side) % side
    return left * side + right


def _back(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    side = side_of(n)
    left, right = x // side, x % side
    for add, mul, inc in reversed(round_keys(seed)):
        y = (left + add) % PRIME
        y = y * y % PRIME
        left, right = (right - (y * mul + inc) % PRIME % side) % side, left
    return left * side + right


def walks(n: int, seed: int) -> int:
    """The longest walk outside 0..n-1 that a number of 0..n-1 takes.

    Only the 2 sqrt(n) + 1 numbers at most between n and side**2 are looked at.
    """
    outside, steps = np.arange(n, side_of(n) ** 2, dtype=np.int64), 0
    outside = outside[_back(outside, n, seed) < n] if len(outside) else outside
    while len(outside):
        outside, steps = permute(outside, n, seed), steps + 1
        outside = outside[outside >= n]
    return steps


def permuted(number: Column, n: int, seed: int) -> Column:
    """The permuted place of a row number, 0..n-1 to 0..n-1; n up to 2**52, where double quotients are exact."""
    number, side, steps = number.cast("long"), side_of(n), walks(n, seed)
    keys = F.array(*[F.array(*[F.lit(k).cast("long") for k in key]) for key in round_keys(seed)])

    def once(x: Column) -> Column:
        def turn(acc: Column, key: Column) -> Column:
            y = (acc["r"] + key[0]) % PRIME
            return F.transform(
                F.array(y * y % PRIME),
                lambda z: F.struct(acc["r"].alias("l"), ((acc["l"] + (z * key[1] + key[2]) % PRIME % side) % side).alias("r")),
            )[0]

        rest = x % F.lit(side).cast("long")
        start = F.struct(((x - rest) / side).cast("long").alias("l"), rest.alias("r"))
        return F.aggregate(keys, start, turn, lambda acc: acc["l"] * side + acc["r"])

    first = once(number)
    if not steps:
        return first
    return F.transform(
        F.array(first),
        lambda p: F.when(p < n, p).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.lit(steps)), p, lambda q, _: F.when(q < n, q).otherwise(once(q)))
        ),
    )[0]


def numbered(df: DataFrame, key: str, name: str, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """``df`` with gapless global row numbers from 0, and their count.

    Two scans: the first counts the rows of each bucket (at most ``buckets`` rows reach the driver),
    the second ranks the rows inside their bucket. The bucket follows from the whole row, so that a
    key of many rows, null too, spreads over buckets. No task ever holds all rows.
    """
    spark = df.sparkSession
    bucket, offset, rank = fresh(df, "bucket", "offset", "rank")
    whole = F.xxhash64(col(key).cast("string"), *[col(c) for c in df.columns])
    dealt = df.withColumn(bucket, F.pmod(whole, F.lit(buckets)).cast("int"))
    counts = {r[0]: r[1] for r in dealt.groupBy(bucket).count().collect()}
    rows, total = [], 0
    for b in sorted(counts):
        rows.append((b, total))
        total += counts[b]
    offsets = F.broadcast(spark.createDataFrame(rows, f"`{bucket}` int, `{offset}` long"))
    inside = Window.partitionBy(bucket).orderBy(col(key), F.xxhash64(*[col(c) for c in df.columns]))
    out = dealt.withColumn(rank, F.row_number().over(inside)).join(offsets, bucket)
    return out.withColumn(name, col(offset) + col(rank) - 1).drop(bucket, offset, rank), total


def shard(df: DataFrame, shards: int = 16, seed: int = 0, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in its shard).

    Shard sizes differ by one row at most. The same rows, seed and number of shards give the same
    shards and slots in any layout; another seed gives another order. Columns of ``df`` called
    shard or slot are replaced. A null key is a key like another; rows alike in all columns are
    interchangeable and each gets a place; an empty table stays empty.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    df = df.drop("shard", "slot")
    (number,) = fresh(df, "row_number")
    rows, total = numbered(df, key, number, buckets)
    (place,) = fresh(rows, "place")
    placed = rows.withColumn(place, permuted(col(number), max(total, 1), seed))
    return placed.withColumns(
        {"shard": (col(place) % shards).cast("int"), "slot": ((col(place) - col(place) % shards) / shards).cast("long")}
    ).drop(number, place)


def write_shards(df: DataFrame, path: str, shards: int = 16, seed: int = 0, key: str = "doc_id", partitions: int | None = None) -> None:
    """Writes the rows as ``path/shard=k``; a shard's files, in the order of their names, hold it in the order of its slots.

    Rows are dealt by ranges of (shard, slot) over ``partitions`` tasks, the shuffle partitions unless given, so that
    a shard of any size is many files and no task holds more than its range.
    """
    placed = shard(df, shards, seed, key)
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
