"""Merkle dataset manifest: a digest tree per group of rows, a tree over the groups, and each row's proof.

Leaves are range-sorted by group and key into an RDD. A first pass counts each partition's first and last
group, which gives every partition the place of its first leaf; a second one streams the leaves and builds
all aligned subtrees that lie in the partition, keeping at most a run of siblings per level. Runs of siblings that
a partition edge cuts are left ragged: their parts meet by coordinate (group, level, run), and what
they give climbs level by level, a few runs for each partition. Proofs go down again: a run takes the siblings
of its parent run and hands them on with its own. The groups' subroots are leaves of a last tree built alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewise.llm._common import col, written

#: Siblings of a run.
FAN = 16
#: Subroots sorted by one task at least.
SUBROOTS_A_TASK = 50_000
STEP = "array<struct<before: array<string>, after: array<string>>>"


def leaf_digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the columns' values: ``-`` for a null, else UTF-8 byte count, colon and value."""
    values = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]).cast("binary"), 256)


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level up to the root and left to right, as one text."""
    return F.array_join(F.flatten(F.transform(proof, lambda s: F.concat(s["before"], s["after"]))), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof: equal to the true one only if the leaf is unchanged."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(F.array_join(s["before"], ""), node, F.array_join(s["after"], "")).cast("binary"), 256))


def digest_of(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes of a level over ``n`` leaves, which are level 0."""
    return -(-n // FAN**level)


def depth(n: int) -> int:
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def _add(pending: list[list], level: int, place: int, node: str, item: object, total: int | None) -> Iterator[tuple]:
    if level == len(pending):
        pending.append([place, [], []])
    held = pending[level]
    if not held[1]:
        held[0] = place
    held[1].append(node)
    held[2].append(item)
    if (place + 1) % FAN == 0 or (total is not None and place + 1 == width(total, level)):
        if total is None or width(total, level) > 1:
            yield from _close(pending, level, total)


def _close(pending: list[list], level: int, total: int | None) -> Iterator[tuple]:
    first, children, items = pending[level]
    pending[level] = [0, [], []]
    whole = first % FAN == 0 and (len(children) == FAN or first + len(children) == width(total, level))
    yield level + 1, first // FAN, first, children, items if level == 0 else None, total, whole
    if whole:
        yield from _add(pending, level + 1, first // FAN, digest_of(children), None, total)


def subtrees(leaves: Iterable[tuple[str, object]], start: int, total: int | None) -> Iterator[tuple]:
    """Runs of siblings of consecutive leaves (digest, item) of one group: level, run, place of the first child, children, items (level 1), total, whole.

    ``start``: the place of the first leaf; ``total``: all leaves of the group, None if they all are here. A run
    is whole if all its children are here. Level 0 is the subroot, where it can be known here.
    """
    pending, place = [], start
    for node, item in leaves:
        yield from _add(pending, 0, place, node, item, total)
        place += 1
    n = place if total is None else total
    level = 0
    while level < len(pending):
        if width(n, level) == 1:
            if start == 0 and place == n:
                if n == 1:
                    yield 1, 0, 0, pending[0][1], pending[0][2], n, True
                yield 0, 0, 0, pending[level][1], None, n, True
            return
        if pending[level][1]:
            yield from _close(pending, level, n)
        level += 1


def _counts(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Of a sorted partition with rows: its first and last group with their rows here, its groups, its longest group."""
    edge, groups, most, last = None, 0, 0, None
    for group, run in groupby(rows, key=lambda r: r[0]):
        last = (group, sum(1 for _ in run))
        edge, groups, most = edge or last, groups + 1, max(most, last[1])
    if edge:
        yield edge, last, groups, most


def _placed(counts: list[tuple]) -> tuple[dict[int, tuple[int, dict[str, int]]], dict[str, int]]:
    """For each partition the place of its first leaf and the totals of groups that go beyond it; then those totals."""
    totals: dict[str, int] = {}
    parts: dict[str, int] = {}
    starts: dict[int, int] = {}
    for pid, (first, last, _, _) in counts:
        starts[pid] = totals.get(first[0], 0)
        for group, n in dict([first, last]).items():
            totals[group], parts[group] = totals.get(group, 0) + n, parts.get(group, 0) + 1
    crossing = {g: n for g, n in totals.items() if parts[g] > 1}
    return {pid: (starts[pid], {g: crossing[g] for g in (first[0], last[0]) if g in crossing}) for pid, (first, last, _, _) in counts}, crossing


def _tree(leaves: DataFrame, partitions: int, upper: bool = True) -> DataFrame:
    """``leaves`` (``grp`` string, ``key``, ``leaf``, ``item``; a written table) as key, leaf, item, ``subroot``, ``root`` and ``proof``."""
    spark = leaves.sparkSession
    order = ["grp", "key", "leaf", "tie"]
    ranged = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    rdd = ranged.select("grp", "key", "leaf", "item").rdd
    counts = sorted(rdd.mapPartitionsWithIndex(lambda pid, rows: ((pid, c) for c in _counts(rows))).collect())
    key, item = leaves.schema["key"].dataType, leaves.schema["item"].dataType
    if not counts:
        return leaves.select("key", "leaf", "item", F.lit("").alias("subroot"), F.lit("").alias("root"), F.lit(None).cast(STEP).alias("proof")).limit(0)
    places, crossing = _placed(counts)

    def build(pid: int, rows: Iterable[tuple]) -> Iterator[tuple]:
        start, totals = places.get(pid, (0, {}))
        for group, run in groupby(rows, key=lambda r: r[0]):
            for level, at, first, children, items, total, whole in subtrees(((r[2], (r[1], r[3])) for r in run), start, totals.get(group)):
                yield group, level, at, first, children, items, total, "ragged" if not whole else "leaves" if level == 1 else "inner"
            start = 0

    fields = [("grp", T.StringType()), ("level", T.IntegerType()), ("run", T.LongType()), ("first", T.LongType()), ("children", T.ArrayType(T.StringType()))]
    fields += [("items", T.ArrayType(T.StructType([T.StructField("key", key), T.StructField("item", item)]))), ("total", T.LongType()), ("kind", T.StringType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    built = written(spark.createDataFrame(rdd.mapPartitionsWithIndex(build), schema, verifySchema=False), "merkle", "kind")
    node = F.sha2(F.array_join("children", "").cast("binary"), 256)
    inner = built.where("kind = 'inner'")
    levels = {1: built.where("kind = 'leaves'").select("grp", "run", "children", "items")}
    heads = inner.where("level = 0").select("grp", F.get("children", F.lit(0)).alias("subroot"), "total")
    top = max(depth(n) for n in (*crossing.values(), *(c[3] for _, c in counts)))
    for level in range(2, top + 1):
        levels[level] = inner.where(F.col("level") == level).select("grp", "run", "children", "items")
    climbing = None
    for level in range(1, depth(max(crossing.values(), default=1)) + 1):
        parts = built.where((F.col("kind") == "ragged") & (F.col("level") == level)).select("grp", "run", "total", "first", "children", "items")
        parts = parts if climbing is None else parts.unionByName(climbing)
        parts = parts.groupBy("grp", "run").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("first", "children", "items"))).alias("parts"))
        met = written(parts.select("grp", "run", "total", F.flatten("parts.children").alias("children"), F.flatten("parts.items").alias("items")), f"merkle-{level}")
        levels[level] = levels[level].unionByName(met.drop("total"))
        over = F.col("total") > FAN**level
        heads = heads.unionByName(met.where(~over).select("grp", node.alias("subroot"), "total"))
        run = F.col("run")
        climbing = met.where(over).select("grp", F.floor(run / FAN).alias("run"), "total", run.alias("first"), F.array(node).alias("children"), F.lit(None).cast(schema["items"].dataType).alias("items"))
    if upper:
        groups = sum(c[2] for _, c in counts)
        subroots = written(heads.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("subroot").alias("leaf"), "total", F.lit(None).cast("string").alias("item")), "subroots")
        above = _tree(subroots, min(partitions, width(groups, 0) // SUBROOTS_A_TASK + 1), upper=False)
        heads = subroots.select(F.col("key").alias("grp"), "total").join(above.select(F.col("key").alias("grp"), F.col("leaf").alias("subroot"), "root", "proof"), "grp")
    else:
        heads = heads.select("grp", "total", "subroot", F.col("subroot").alias("root"), F.array().cast(STEP).alias("proof"))
    rank = sum((F.when(F.col("total") > FAN**k, 1).otherwise(0) for k in range(16)), F.lit(0))
    heads = heads.select("grp", rank.alias("depth"), F.lit(0).cast("long").alias("over"), F.lit(None).cast("array<string>").alias("over_children"), "subroot", "root", "proof")

    def step(children: Column, at: Column) -> Column:
        return F.array(F.struct(F.slice(children, 1, at).alias("before"), F.slice(children, at + 2, FAN).alias("after"))).cast(STEP)

    for level in range(max(top, 1), 0, -1):
        ends = heads.where(F.col("depth") == level if level > 1 else F.col("depth") <= 1).withColumn("lone", F.col("depth") == 0).drop("depth")
        over = ends if level == max(top, 1) else over.withColumn("lone", F.lit(False)).unionByName(ends)
        at = (F.col("run") % FAN).cast("int")
        runs = levels[level].withColumn("over", F.floor(F.col("run") / FAN)).join(over, ["grp", "over"])
        runs = runs.withColumn("proof", F.when(F.col("over_children").isNull(), F.col("proof")).otherwise(F.concat(step(F.col("over_children"), at), "proof")))
        if level > 1:
            over = runs.select("grp", F.col("run").alias("over"), F.col("children").alias("over_children"), "subroot", "root", "proof")
    out = runs.select("*", F.posexplode("items").alias("at", "one"))
    proof = F.when(F.col("lone"), F.col("proof")).otherwise(F.concat(step(F.col("children"), F.col("at")), "proof"))
    return out.select("one.key", F.get("children", F.col("at")).alias("leaf"), "one.item", "subroot", "root", proof.alias("proof"))


def manifest(df: DataFrame, columns: list[str], group: str = "source", key: str = "doc_id", carry: Column | None = None) -> DataFrame:
    """A row for each row of ``df``: ``key``, ``leaf``, ``item``, ``subroot``, ``root`` and ``proof``.

    The leaf is ``leaf_digest`` of ``columns``. In a group leaves ascend by key, nulls first, then by digest; groups ascend bytewise, null first.
    While a level has several nodes, every 16 consecutive ones become their digest, the last run with what is
    left, be it one. A proof's steps hold the siblings before and after, from the leaf's level up to
    the root; a lone leaf has none in its group. ``item`` is ``carry``, an expression of ``df``. Repeated rows are leaves of
    their own; an empty table has no rows; other columns are not read. The leaves and the runs of the tree
    are written to the shared folder before this returns; the driver gets four numbers and two group names per partition.
    """
    spark = df.sparkSession
    name = col(group).cast("string")
    rows = df.select(F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("grp"), col(key).alias("key"), leaf_digest(*[col(c) for c in columns]).alias("leaf"), (F.lit(None).cast("string") if carry is None else carry).alias("item"))
    return _tree(written(rows, "leaves"), int(spark.conf.get("spark.sql.shuffle.partitions")))
