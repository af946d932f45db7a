from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from gaugewise.llm import line_dedup


def plain(line):
    return " ".join(line.replace("\t", " ").split(" ")).strip() if line.strip() else ""


def brute(rows, min_sites):
    sites = defaultdict(set)
    for _, text, _, source in rows:
        for line in (text or "").split("\n"):
            if " ".join(line.split()):
                sites[" ".join(line.split())].add(source)
    return {
        (i, text): None if text is None else "\n".join(x for x in text.split("\n") if len(sites.get(" ".join(x.split()), ())) < min_sites)
        for i, text, _, _ in rows
    }


def test_thresholds_are_exact(docs_from):
    rows = []
    for spread in (1, 8, 9, 10, 11, 12, 40, 300):
        rows += [(1000 * spread + k, f"own {spread} {k}\n  line of {spread}  sites \n\nlast {spread} {k}", None, f"site{k}") for k in range(spread)]
    rows += [(1, "hot line\nhot line", None, "site0")] * 30
    got = {(r.doc_id, r.n_lines): r.text for r in line_dedup.dedup_lines(docs_from(rows), 10).collect()}
    want = brute(rows, 10)
    assert len(got) == len({r[:2] for r in rows})
    for (i, text), kept in want.items():
        assert got[(i, len(text.split("\n")))] == kept


def test_edges(docs_from, spark):
    assert line_dedup.dedup_lines(docs_from([])).count() == 0
    rows = [(1, None, None, "a"), (2, "", None, "b"), (None, "x\ny", None, None), (3, "x\nz", None, "c"), (3, "x\nz", None, "c"), (3, "q\nx", None, "d"), (4, "\n".join(f"l{i}" for i in range(50_000)) + "\nx", None, "e")]
    df = docs_from(rows).withColumn("line", F.lit("keep")).withColumn("text_mark", F.lit(5)).withColumn("removed_lines", F.lit("gone"))
    got = line_dedup.dedup_lines(df, 4).collect()
    assert len(got) == 7 and all(r.line == "keep" and r.text_mark == 5 for r in got)
    by = sorted((str(r.doc_id), r.text if r.text is None else r.text[:9], r.n_lines, r.removed_lines) for r in got)
    assert by == [("1", None, 0, []), ("2", "", 1, []), ("3", "q", 2, ["x"]), ("3", "z", 2, ["x"]), ("3", "z", 2, ["x"]), ("4", "l0\nl1\nl2\n", 50_001, ["x"]), ("None", "y", 2, ["x"])]


def test_paths_are_equal(spark, sample, docs_from, monkeypatch):
    """The same rows whether few boilerplate lines go to all tasks or many are joined."""
    extra = docs_from([(9001, None), (9002, ""), (9003, "\n\n"), (None, "x\ny")])
    df = sample.unionByName(extra)
    for by_text in (False, True):
        a = sorted(map(str, line_dedup.dedup_lines(df, 4, by_text=by_text).collect()))
        with monkeypatch.context() as m:
            m.setattr(line_dedup, "FEW_KEYS", 0)
            assert a == sorted(map(str, line_dedup.dedup_lines(df, 4, by_text=by_text).collect()))
        assert any("removed_lines=['" in x for x in a)


def test_the_pipeline_keeps_a_copied_text(docs_from, spark, sf):
    copied = "\n".join(f"a line of the copied text {i}" for i in range(30)) + "\nboilerplate"
    rows = [(i, copied, "en", f"copy{i}") for i in range(20)] + [(100 + i, f"own {i}\nboilerplate", "en", f"site{i}") for i in range(10)]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, docs_from(rows), sf).collect()}
    assert all(got[i] == copied.removesuffix("\nboilerplate") for i in range(20)) and all(got[100 + i] == f"own {i}" for i in range(10))
