from __future__ import annotations

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gaugewise.llm import filter_audit

NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def by_hand(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic)."""
    fails = []
    for i, t, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        bad["E"] = any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append({k for k, v in bad.items() if v})
    out = {}
    for part in {s or "" for _, _, s in docs}:
        mine = [(f, {q for j, q, _ in labels if i is not None and j == i}, {x for j, _, x in labels if i is not None and j == i}) for (i, _, s), f in zip(docs, fails) if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                kept = [x for x in left if name not in x[0]]
                total[name] += len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), sum(name in x[0] for x in mine) - len(gone), sum(x[0] == {name} for x in mine), sum(1 in x[1] for x in gone), sum(1 in x[2] for x in gone)]
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels, **more):
    d = spark.createDataFrame([(*r, "mine", "x") for r in docs], "doc_id long, text string, source string, mask string, N string")
    rows = filter_audit.audit_filters(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **more).collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[n] for n in NAMES) for r in rows}
    assert len(out) == len(rows)
    return out


LONG = " ".join(f"w{i}" for i in range(200))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (3, LONG, "a"), (None, LONG, "a"), (None, LONG, None), (4, None, "a"), (5, "", "a"), (5, "", "a"), (6, "AB c", None), (7, "50% of it", ""),
    (8, "w " * 300, "a"), (9, "w\tw\nw\x0bw\x0cw\rw w w #" * 60, "b"), (10, LONG + " ABCDEFGHIJKLMNOPQRSTUVWXYZ", "b"), (11, LONG + "&" + "X" * 50_000, "b"), (12, "\U0001f600" * 10 + " A", "c"), (12, "\U0001f600" * 10 + " A", "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 1), (5, 1, None), (8, 0, 1), (99, 1, 1), (11, 1, 1), (11, 1, 1)]


def test_against_brute_force(spark):
    got, want = audited(spark, DOCS, LABELS), by_hand(DOCS, LABELS)
    assert got == want and len(got) == 600 * len({s or "" for _, _, s in DOCS})


def test_edges_of_the_tests(spark):
    half = " ".join([f"w{i}" for i in range(100)] * 2)
    docs = [(1, half, "a"), (2, half + " w1", "a"), (3, half[:-2] + "XY" + " " * (100 - len(half) % 100), "a"), (4, LONG.rsplit(" ", 1)[0], "a")]
    assert audited(spark, docs, LABELS) == by_hand(docs, LABELS)


def test_empty_tables(spark):
    assert audited(spark, [], LABELS) == {}
    assert audited(spark, DOCS[:3], []) == by_hand(DOCS[:3], [])


def test_other_filters(spark, docs_from):
    """Any tests, without repeats; a null test does not fail."""
    docs, labels = docs_from([(1, "aa"), (2, None), (3, "b"), (4, "b")]), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    counted = filter_audit.cells(docs, labels, {"P": F.col("text") == "b", "Q": F.length("text") < 3})
    rows = {(r.filter_order, r.step): r for r in filter_audit.interactions(counted, ["P", "Q"]).collect()}
    assert (rows["PQ", 1].removed, rows["PQ", 2].removed, rows["PQ", 2].redundant, rows["PQ", 2].kept, rows["QP", 1].removed, rows["QP", 1].good_lost, rows["QP", 2].shapley) == (2, 1, 2, 1, 3, 1, 2)
    with pytest.raises(ValueError):
        filter_audit.interactions(counted, list("ABCDEFGH"))


def test_copies_shrink_before_they_meet(spark):
    """A text of many copies reaches the window as a row per kind."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    counted = {(r.part, r["mask"]): r.n for r in filter_audit.cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), filter_audit.text_tests(F.col("text")), "E").collect()}
    assert counted == {("s0", 1): 1, ("s0", 17): 1333, ("s1", 17): 1333, ("s2", 17): 1333}
