from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gaugewise.llm import merkle, queries


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes: list[str], at: int) -> tuple[str, list[tuple[list[str], list[str]]]]:
    """Root of the nodes and the siblings of the one at ``at``."""
    steps = []
    while len(nodes) > 1:
        first = at // 16 * 16
        steps.append((nodes[first:at], nodes[at + 1 : first + 16]))
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], at // 16
    return nodes[0], steps


def by_hand(rows):
    """rows: (doc_id, text, lang, source, n_chars) to sorted results of the query."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]))
    leaves = {s: [(leaf(r[0], r[3], r[2], r[4], r[1]), r) for r in sorted(groups[s], key=order)] for s in names}
    subroots = [climb([d for d, _ in leaves[s]], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        nodes = [d for d, _ in leaves[s]]
        for at, (d, (i, t, lang, _, n)) in enumerate(leaves[s]):
            root, above = climb(subroots, k)
            steps = climb(nodes, at)[1] + above
            node = leaf(i, s, lang, n, t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else d
            for before, after in steps:
                node = h(*before, node, *after)
            out.append((i, d, subroots[k], root, h(*[x for b, a in steps for x in b + a]), node, node == root))
    return sorted(map(str, out))


def query(spark, rows, monkeypatch, partitions):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit("mine"))
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        return sorted(str(tuple(r)) for r in queries.op12_merkle_manifest(spark, "").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def rows_of(sizes: dict, start: int = 0) -> list[tuple]:
    out, i = [], start
    for source, n in sizes.items():
        for _ in range(n):
            out.append((i, f"Text {i} Ä", None if i % 7 == 0 else "en", source, i))
            i += 1
    return out


@pytest.mark.parametrize(("sizes", "partitions"), [({"a": 700, "b": 1, "c": 16, "d": 17, None: 3, "": 2, "\U00010000": 5, "￿": 40}, 5), ({"a": 300}, 7), ({"a": 256, "b": 257}, 3), ({f"s{i}": 1 + i % 3 for i in range(40)}, 4)])
def test_against_brute_force(spark, monkeypatch, sizes, partitions):
    rows = rows_of(sizes)
    assert query(spark, rows, monkeypatch, partitions) == by_hand(rows)


def test_odd_tables(spark, monkeypatch):
    """Null ids, nulls in all columns, empty and long texts, ties of ids, repeated rows, one row, no row."""
    rows = [(None, None, None, None, None)] * 2 + [(None, "A", None, "s", 1), (5, "", "", "", 0), (5, "x" * 200_000 + "Q", "en", "s", 3)] + [(5, "Same", "en", "s", 4)] * 40 + [(5, "Other", "en", "s", 5)]
    assert query(spark, rows, monkeypatch, 3) == by_hand(rows)
    assert query(spark, rows[:1], monkeypatch, 3) == by_hand(rows[:1])
    assert query(spark, [], monkeypatch, 3) == []


def test_parts_of_any_cut(spark):
    """Whole runs and ragged parts of a group cut anywhere are the runs of its tree."""
    for n, cut in [(1, 0), (16, 3), (17, 16), (300, 16), (300, 255), (4097, 1000), (4097, 4096)]:
        leaves = [(h(str(i)), i) for i in range(n)]
        pieces = [*merkle.subtrees(leaves[:cut], 0, n), *merkle.subtrees(leaves[cut:], cut, n)] if cut else list(merkle.subtrees(leaves, 0, None))
        whole = [p for p in pieces if p[6] and p[0] > 0]
        assert len({p[:2] for p in whole}) == len(whole)
        level, nodes = 1, [d for d, _ in leaves]
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            assert all(p[3] == runs[p[1]] for p in whole if p[0] == level)
            ragged = [p for p in pieces if not p[6] and p[0] == level]
            assert len(ragged) <= 2 and all(p[3] == nodes[p[2] : p[2] + len(p[3])] for p in ragged)
            level, nodes = level + 1, [h(*r) for r in runs]
        if not cut:
            assert [p[3] for p in pieces if p[0] == 0] == [nodes]


def test_proofs_tell_changes(spark, docs_from):
    """A proof folds to the root from its leaf and from no other."""
    docs = docs_from([(i, f"t{i}", None, f"s{i % 3}") for i in range(100)])
    rows = merkle.manifest(docs, ["doc_id", "text"], carry=F.concat("text", F.lit("!"))).select("root", merkle.fold(F.col("leaf"), F.col("proof")).alias("same"), merkle.fold(merkle.leaf_digest(F.col("key"), F.col("item")), F.col("proof")).alias("other")).collect()
    assert len(rows) == 100 and len({r.root for r in rows}) == 1 and all(r.same == r.root != r.other for r in rows)


def test_layout_does_not_matter(spark, docs_from):
    docs = docs_from([(i % 50, f"t{i}", None, f"s{i % 2}") for i in range(400)])
    roots = {merkle.manifest(d, ["doc_id", "text"]).first().root for d in (docs, docs.repartition(7), docs.orderBy(F.desc("text")))}
    assert len(roots) == 1
