from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewise.llm import language_id, toxicity

SF = "/root/testdata/sf0.1"


def test_machine_is_a_factorization():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=6), rng.normal(size=(6, 3))
    rows = [[], [2], [0, 3, 5]]
    got, _ = toxicity.Sparse.of([np.asarray(r, dtype=np.int64) for r in rows]).margins(0.3, w, v)
    for row, m in zip(rows, got, strict=True):
        assert m == pytest.approx(0.3 + sum(w[i] for i in row) + sum(v[i] @ v[j] for k, i in enumerate(row) for j in row[k + 1 :]))


@pytest.mark.parametrize("kind", ["both", "alike"])
def test_pairs_are_learned(spark, docs_from, kind):
    """Two words as frequent in clean texts as in toxic ones, that tell only together, among many words that do not."""
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        toxic = (a and b) if kind == "both" else a == b
        docs.append((i, " ".join([f"w{rng.randrange(3000)}" for _ in range(25)] + ["insult"] * a + ["group"] * b)))
        labels.append((i, int(toxic)))
    docs, labels = docs_from(docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, labels, use=F.col("doc_id") < 2000)
    got = toxicity.score(docs, machine).join(labels, "doc_id").where("doc_id >= 2000").agg(F.avg((F.col("score").__ge__(0.5).cast("int") == F.col("toxic")).cast("double"))).first()[0]
    assert got > 0.99 and set(toxicity.terms("insult group")) == set(machine.chosen)


def test_telling_terms_have_no_limit():
    rng = np.random.default_rng(2)
    y = (np.arange(6000) % 2).astype(float)
    rows = [np.sort(rng.choice(np.arange(3000) + (0 if t else 5000), 60, replace=False)) for t in y]
    assert len(toxicity.telling_terms(toxicity.Sparse.of(rows), y)) > 5000


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    machine = toxicity.train(docs, labels, use=~held)
    rows = toxicity.score(docs, machine).where(held).join(labels, "doc_id").select("toxic", "score").collect()
    y, s = np.asarray([r.toxic for r in rows]), np.asarray([r.score for r in rows])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert (s[y == 0] < 0.5).mean() > 0.99 and (s[y == 1] >= 0.5).mean() > 0.75 and auc > 0.85


def test_toxicity_edges(spark, docs_from):
    rng = random.Random(0)
    docs = docs_from([(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(20)) + (" awful" if i % 5 == 0 else "")) for i in range(300)] + [(1000, None), (None, "awful"), (1001, ""), (1002, "fine " * 50_000 + "awful"), (1002, "awful")])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(0, 1), (None, 1), (1000, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    df = docs.withColumn("label", F.lit("mine")).withColumn("terms", F.lit(1)).withColumn("score", F.lit("old"))
    got = toxicity.score(df, machine).collect()
    assert len(got) == 305 and all(0 <= r.score <= 1 and r.label == "mine" for r in got) and all((r.score >= 0.5) == ("awful" in (r.text or "")) for r in got)
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score < 0.5 for r in toxicity.score(docs, none).collect()} == {True}
    assert len(toxicity.train(docs_from([]), labels).chosen) == 0 and toxicity.score(docs_from([]), machine).count() == 0
    alone = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, alone).where("score >= 0.5").count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    machine = language_id.train(docs, use=~held)
    right = language_id.identify(docs.where(held), machine).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("lang_score"), F.max("lang_score")).first()
    assert right[0] > 0.99 and 0 <= right[1] <= right[2] <= 1
    assert set(machine.names()) == {"germanic", "romance"} and set(machine.pairs) == {("family germanic", "family romance"), ("de", "en"), ("es", "fr")}


def test_language_edges(spark, docs_from):
    words = {"en": "the and with that", "de": "und der nicht schön", "xx": "zzq qqz zqz"}
    rows = [(i, f"{words[k]} " * (1 + i % 7) + str(i), k, "s") for i, k in enumerate(list(words) * 30)]
    rows += [(500, None, "en", "s"), (501, "", "de", "s"), (502, "123 ...", "en", "s"), (None, words["en"], None, None), (503, f"{words['de']} " * 20_000, None, "s"), (504, "É", None, "s"), (504, "É", None, "s"), (505, "² ½ Ⅷ ①", "en", "s")]
    docs = docs_from(rows)
    machine = language_id.train(docs)
    df = docs.withColumn("mark", F.lit("mine")).withColumn("lang_score", F.lit("old"))
    got = language_id.identify(df, machine).collect()
    assert len(got) == len(rows) and machine.languages == ["de", "en", "xx"] and all(r.mark == "mine" for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].lang_score == 0 for i in (500, 501, 502, 505)) and by[503].lang_pred == "de" and by[504].lang_pred in machine.languages
    assert all(by[i].lang_pred == k for i, _, k, _ in rows[:90])
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(docs.limit(0))).collect()} == {"und"}
    assert language_id.identify(docs_from([]), machine).count() == 0
    only = language_id.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.identify(docs, only).collect()} == {"en", "und"}


def test_duels_against_brute_force():
    """Family, then every pair of its languages, one text after another."""
    rng = random.Random(3)
    words = {x: [f"{x}{rng.choice('aeiou')}{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{x[0]}" for _ in range(30)] for x in ("da", "de", "en", "sv", "fr", "it", "qq")}
    texts = [(x, " ".join(rng.choice(words[x]) for _ in range(8))) for x in words for _ in range(20)]
    x, own = language_id.features([t for _, t in texts]), np.asarray([a for a, _ in texts])
    machine = language_id.Machine(sorted(words))
    family = np.asarray([machine.family(a) for a in own])
    for kind, of, names in [("family ", family, machine.names()), *(("", own, [a for a in sorted(words) if machine.family(a) == f]) for f in machine.names())]:
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                at = (of == a) | (of == b)
                machine.pairs[kind + a, kind + b] = language_id.fit_svm(x[at], np.where(of[at] == a, 1.0, -1.0).astype(np.float32))

    def winner(row, names, kind):
        wins, margin = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                w, c = machine.pairs[kind + a, kind + b]
                m = float(sum(p * q for p, q in zip(row.tolist(), w.tolist(), strict=True) if p)) + c
                wins[a if m >= 0 else b] += 1
                margin[a] += m
                margin[b] -= m
        return max(names, key=lambda a: (wins[a] + 0.4 * np.tanh(margin[a])))

    new = [" ".join(rng.choice(words[rng.choice(list(words))]) for _ in range(6)) for _ in range(60)]
    want = []
    for row in language_id.features(new):
        f = winner(row, machine.names(), "family ")
        want.append(winner(row, [a for a in sorted(words) if machine.family(a) == f], ""))
    assert machine.predict(new)[0] == want


def test_features_do_not_depend_on_chunks():
    texts = ["The quick brown fox " * 40, "", None, "é" * 33, "x"]
    assert np.allclose(language_id.features(texts), language_id.features(texts, chunk=7))
    import pyarrow as pa

    assert list(language_id.slices(pa.array(["a" * 50, None, "b" * 60, "c", "d"]), 2, 100)) == [(0, 2), (2, 2), (4, 1)]
