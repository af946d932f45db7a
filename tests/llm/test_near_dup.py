from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewise.llm import near_dup as n


def text(rng, size):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(size))


def edited(rng, t, edits):
    w = t.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def similarity(a, b):
    """Longest common subsequence of the labelled five-word runs, by the plain table."""
    x, y = n.labelled_kmers(a).tolist(), n.labelled_kmers(b).tolist()
    row = [0] * (len(y) + 1)
    for p in x:
        before = 0
        for j, q in enumerate(y, 1):
            row[j], before = (before + 1 if p == q else max(row[j], row[j - 1])), row[j]
    return row[-1] / (len(x) + len(y) - row[-1]) if x and y else 0.0


def classes(rows, least=0.8):
    by = {}
    for i, t in rows:
        by.setdefault(t, []).append(i)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    for t, ids in by.items():
        for i in ids:
            if t is not None:
                join(min(ids), i)
    kept = [(min(ids), t) for t, ids in by.items() if t]
    for (i, a), (j, b) in combinations(kept, 2):
        if similarity(a, b) >= least:
            join(i, j)
    return {i: find(i) for i, _ in rows}


def test_alignment():
    rng = random.Random(1)
    for _ in range(60):
        a = text(rng, rng.randrange(5, 80))
        b = edited(rng, a, rng.randrange(0, 4)) + (" x y z" if rng.random() < 0.5 else "")
        want = similarity(a, b)
        assert n.aligned_similarity(n.labelled_kmers(a), n.labelled_kmers(b)) == pytest.approx(want if want >= 0.8 else 0.0)
    half = text(rng, 100).split()
    moved = " ".join(half[50:] + half[:50])
    assert n.aligned_similarity(n.labelled_kmers(" ".join(half)), n.labelled_kmers(moved)) == 0.0


def test_sketches_keep_order():
    rng = random.Random(2)
    a = n.labelled_kmers(text(rng, 300))
    assert (n.sketches(a, 64) == n.sketches(a, 64)).all() and (n.sketches(a, 64) == n.sketches(a[::-1], 64)).mean() < 0.1
    ones = [np.mean(n.sketches(a, 256) == n.sketches(np.concatenate([a[k:], n.labelled_kmers(text(rng, k + 4))]), 256)) for k in (10, 60, 200)]
    assert ones[0] > 0.8 and ones[0] > ones[1] > ones[2]


def test_groups_against_brute_force(docs_from):
    rng = random.Random(3)
    rows = [(i, text(rng, rng.randrange(1, 200))) for i in range(60)]
    passage = text(rng, 40)
    rows += [(100 + i, passage + " " + text(rng, 60)) for i in range(40)]  # alike in a passage only
    base = text(rng, 150)
    rows += [(200 + i, edited(rng, base, 1)) for i in range(40)]  # one large group of near copies
    rows += [(300 + i, base) for i in range(20)]  # exact copies
    rows += [(400 + i, edited(rng, rows[i][1], i % 5)) for i in range(60)]
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in n.near_duplicates(docs_from(rows)).collect()}
    assert got == classes(rows) and len({got[i] for i, _ in rows if 200 <= i < 320}) == 1


def test_recall_near_the_threshold(docs_from):
    rng = random.Random(4)
    rows, linked = [], 0
    for i in range(150):
        a = text(rng, 200)
        b = edited(rng, a, 4)
        rows += [(2 * i, a), (2 * i + 1, b)]
        linked += similarity(a, b) >= 0.8
    got = {r.doc_id: r.class_id for r in n.near_duplicates(docs_from(rows)).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(150)) == linked and 100 < linked


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (150, 200), (100, 150), (300, 299), (5, 5)]
    got = {r.id: r.class_id for r in n.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[200] == got[150] == 100 and got[300] == 299
    assert n.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contracted_stretches():
    rng = np.random.default_rng(12)
    u, v = rng.permutation(500)[:200], rng.permutation(500)[:200]
    ids, least = n.contracted(u, v)
    known = {}
    for _ in range(200):
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            known[a] = known[b] = min(known.get(a, a), known.get(b, b))
    assert dict(zip(ids.tolist(), least.tolist(), strict=True)) == {i: c for i, c in known.items() if i != c} and len(ids) == len(set(ids.tolist()))


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_take_few_tasks(spark, monkeypatch, few):
    """A long chain that lies in four partitions, with shuffles of 40: rounds and shuffles are few."""
    monkeypatch.setattr(n, "FEW_IDS", few)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    chain = spark.range(0, 3000, 1, 4).selectExpr("id as a", "id + 1 as b")

    def tasks():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalTasks()

    try:
        for k, x in conf.items():
            spark.conf.set(k, x)
        before = tasks()
        got = {r.id: r.class_id for r in n.components(chain).collect()}
        took = tasks() - before
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert got == dict.fromkeys(range(1, 3001), 0)
    assert took < (400 if few else 600), took


def test_edges(docs_from):
    assert n.near_duplicates(docs_from([])).count() == 0
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "A b"), (6, "a, B!"), (7, "?"), (8, "!"), (9, long), (10, long + " more"), (10, long + " more"), (None, "a b")]
    df = docs_from(rows).withColumn("class_id", F.lit("mine")).withColumn("id", F.lit(0)).withColumn("digest", F.lit("d"))
    got = sorted((r.doc_id, r.class_id) for r in n.near_duplicates(df).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9), (10, 9), (10, 9)]
    kept = n.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "5", "7", "8", "9", "None"])
    assert sorted(r.doc_id for r in n.keep_one(docs_from([(1, "x y"), (1, "x y"), (1, None)])).collect()) == [1]


def test_a_star_is_one_class(docs_from):
    rng = random.Random(5)
    base = text(rng, 150).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 1001):  # three words apart are changed: alike to the original, not to each other
        w = list(base)
        for at in (rng.randrange(5, 45), rng.randrange(55, 95), rng.randrange(105, 145)):
            w[at] = f"e{i}x{at}"
        rows.append((i, " ".join(w)))
    sims = [n.aligned_similarity(n.labelled_kmers(rows[0][1]), n.labelled_kmers(t)) for _, t in rows[1:]]
    apart = [n.aligned_similarity(n.labelled_kmers(rows[i][1]), n.labelled_kmers(rows[i + 1][1])) for i in range(1, 1000)]
    assert 0.8 <= min(sims) and max(sims) < 0.82 and sum(x > 0 for x in apart) < 100
    family = text(rng, 150).split()
    # a template without its original: all pairs share keys, none is alike
    rows += [(2000 + i, " ".join(f"f{i}x{j}" if j % 30 == 7 else w for j, w in enumerate(family))) for i in range(60)]
    got = {r.doc_id: r.class_id for r in n.near_duplicates(docs_from(rows)).collect()}
    assert {got[i] for i in range(1001)} == {0} and all(got[2000 + i] == 2000 + i for i in range(60))


def test_parity_refutes_without_loss():
    rng = random.Random(6)
    for _ in range(200):
        a = text(rng, rng.randrange(5, 400))
        x, y = n.labelled_kmers(a), n.labelled_kmers(edited(rng, a, rng.randrange(0, 30)))
        differ = len(np.setxor1d(x, y))
        assert sum(int(v).bit_count() for v in (n.parity(x) ^ n.parity(y)).view(np.uint64)) <= differ


def test_paths_are_equal(docs_from, monkeypatch):
    """The same classes whether copies and verified texts meet in joins or their keys go to all tasks."""
    rng = random.Random(8)
    rows = [(i, f"copy {text(random.Random(i % 7), 20)}") for i in range(60)] + [(100 + i, text(rng, 20)) for i in range(20)] + [(200, None)]
    rows += [(300 + i, edited(rng, "near " * 3 + text(random.Random(9), 150), 1)) for i in range(12)]
    cold = sorted(map(tuple, n.near_duplicates(docs_from(rows)).collect()))
    monkeypatch.setattr(n, "HOT_COPIES", 3)
    monkeypatch.setattr(n, "FEW_IDS", 0)
    assert cold == sorted(map(tuple, n.near_duplicates(docs_from(rows)).collect())) and {c for _, c in cold} == {*range(7), *range(100, 120), 200, 300}


def test_a_task_leaves_little_to_collect():
    """Collections at the ends of tasks pass over what the worker keeps for good."""
    import gc

    from gaugewise.llm._common import trimmed

    gc.unfreeze()
    assert list(trimmed(lambda batches: batches)(iter([1, 2]))) == [1, 2] and gc.get_freeze_count() > 0
    gc.unfreeze()


def test_rows_at_home_are_no_representatives(docs_from, monkeypatch):
    """Of a family of 600 only the rows outside its largest class are dealt over tasks."""
    from pyspark.sql.classic.dataframe import DataFrame

    alias, dealt = DataFrame.alias, []

    def counted(df, name):
        if name == "chosen":
            dealt.append(df.count())
        return alias(df, name)

    monkeypatch.setattr(DataFrame, "alias", counted)
    rng = random.Random(10)
    base = text(rng, 150)
    rows = [(i, edited(rng, base, 1) if i % 8 else " ".join(f"f{i}x{j}" if j % 30 == 7 else w for j, w in enumerate(base.split()))) for i in range(600)]
    got = {r.doc_id: r.class_id for r in n.near_duplicates(docs_from(rows)).collect()}
    assert {got[i] for i, _ in rows if i % 8} == {1} and all(got[i] == i for i in range(0, 600, 8))
    assert 0 < sum(dealt) < 2 * len(rows)


@pytest.mark.parametrize("pairs", [4, 1 << 18])
def test_every_pair_of_a_key_is_settled(spark, monkeypatch, pairs):
    """A class that outgrows its key's home, in several rounds and over several tasks."""
    monkeypatch.setattr(n, "GROWTH", 2)
    monkeypatch.setattr(n, "SALT_PAIRS", pairs)
    rng = random.Random(11)
    words, other = text(rng, 200).split(), text(rng, 100)
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(16)]  # a chain: alike to the next two alone
    rows += [(100 + i, edited(rng, other, 1)) for i in range(3)] + [(200 + i, text(rng, 100)) for i in range(3)]
    signed = [(i, len(k), n.parity(k).tolist()) for i, k in ((i, n.labelled_kmers(t)) for i, t in rows)]
    links = spark.createDataFrame([(100, 101), (101, 102)], "a long, b long")
    crowded = spark.createDataFrame([(band, 7, i) for i, _ in rows for band in range(2)], "band int, key long, id long")
    got = n.crowded_links(crowded, links, n.components(links), spark.createDataFrame(signed, "id long, size int, bits array<long>"), spark.createDataFrame(rows, "id long, text string"))[1]
    known = {r.id: r.class_id for r in got.collect()}
    assert {i: known.get(i, i) for i, _ in rows} == classes(rows)
