"""A corpus pipeline: each stage works on all that its predecessor kept, as documents.

Toxic documents go, boilerplate lines go, one document of each near-duplicate class stays, benchmark
passages are cut out, and what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewise.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from gaugewise.llm._common import fresh, table, written

#: SQL cannot train, align or tokenise; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _beside(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stage`` gives without the columns ``names`` that it adds; columns of ``docs`` called so stand aside and stay."""
    aside = {c: fresh(docs, f"own_{c}")[0] for c in docs.columns if c.lower() in names}
    out = stage(docs.withColumnsRenamed(aside)).drop(*names)
    return out.withColumnsRenamed({v: k for k, v in aside.items()})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Labels of rows whose crc32(doc_id) mod 5 is 0 are not learned from."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), use=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return _beside(docs, ("toxic_score",), lambda d: toxicity.score(d, machine, name="toxic_score").where("toxic_score < 0.5"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sources are cut; every document stays. Copies of one text count as one source."""
    return _sized(_beside(docs, ("n_lines", "removed_lines"), lambda d: line_dedup.dedup_lines(d, by_text=True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return near_dup.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of occurring benchmark windows are cut; every document stays."""
    return _sized(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: a row for each piece of a document, with its ids (unsigned 32-bit little-endian) and their CRC-32."""
    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, what each keeps written as Parquet in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
