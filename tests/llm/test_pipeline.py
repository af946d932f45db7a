from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugewise.llm import decontaminate, line_dedup, near_dup, queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf)
        outs.append(kept.toPandas())
    toxic, lines, near, clean, packed = outs
    for pdf in (toxic, lines, near, clean):
        assert list(pdf.columns) == docs.columns
    assert 0.8 * docs.count() < len(toxic) <= docs.count() and sum(labels.get(i) == 0 for i in toxic.doc_id) > 0.97 * sum(v == 0 for v in labels.values())
    assert set(lines.doc_id) == set(toxic.doc_id) and (lines.n_chars == lines.text.str.len()).all()
    frame = spark.createDataFrame(lines)
    groups = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame).collect()}
    assert sorted(near.doc_id) == sorted({g for g in groups.values()})
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert set(clean.doc_id) == set(near.doc_id) and decontaminate.find_contamination(spark.createDataFrame(clean), bench).agg(F.sum("n_hit")).first()[0] == 0
    assert set(packed.doc_id) == set(clean.doc_id) and (packed.groupby("sequence_id").length.sum() <= 2048).all()
    assert line_dedup.dedup_lines(spark.createDataFrame(toxic)).where("size(removed_lines) > 0").count() == (lines.sort_values("doc_id").text.values != toxic.sort_values("doc_id").text.values).sum()


def test_run_is_the_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).toPandas()
    assert (rows.groupby(["doc_id", "start"]).size() == 1).all() and (rows.groupby("doc_id").length.sum() == rows.groupby("doc_id").doc_tokens.first()).all()


def test_stages_on_odd_tables(spark, sf, docs_from):
    """Empty tables, null ids and texts, repeated rows, and columns called like those that stages add."""
    extra = docs_from([(None, None), (None, "some words"), (1, ""), (2, "fine words here"), (2, "fine words here"), (3, "x " * 5000)])
    for name in ("toxic_score", "N_Lines", "removed_lines", "class_id", "spans", "score"):
        extra = extra.withColumn(name, F.lit("mine"))
    for docs in (extra, extra.limit(0)):
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf)
            assert kept.columns == docs.columns
        rows = kept.collect()
        assert all(v == "mine" for r in rows for c, v in r.asDict().items() if c not in ("doc_id", "text", "lang", "source", "n_chars"))
        assert sorted(str(r.doc_id) for r in rows) == ([] if docs is not extra else ["1", "2", "3", "None", "None"])
        packed = corpus_pipeline.pack(spark, kept, sf).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in rows} and all(len(r["ids"]) == 4 * r.length for r in packed)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    a, b = (x[sorted(x.columns)].astype(object).where(x.notna(), None) for x in (a, b))
    assert sorted(map(str, a.values.tolist())) == sorted(map(str, b.values.tolist())) and len(a)


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert np.isfinite(len(queries.ORACLE_SQL))
