"""A corpus pipeline in stages; each takes (spark, docs, sf_dir) and returns the documents it keeps.

Language ID drops documents without a language, near-dedup keeps one document of each group, decontamination
drops documents that hold a benchmark item, the secret scan blanks what it finds, and packing lays the tokens of
what is left into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.llm import secrets
from medialake.llm.decontaminate import contaminated
from medialake.llm.language_id import identify
from medialake.llm.near_dedup import near_duplicates
from medialake.llm.packing import pack
from medialake.storage import stored

LEAST_SCORE = 1 / 3
ROW = "_row_of_stage"


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a row number of its own in ``ROW``: the id where every row has one of its own, else a stored numbering."""
    ids = docs.groupBy("doc_id").count()
    if ids.where("count > 1 or doc_id is null").limit(1).count():
        return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    return docs.withColumn(ROW, F.col("doc_id").cast("long"))


def _asked(rows: DataFrame) -> DataFrame:
    """What operators see: the row number as id."""
    return rows.select(F.col(ROW).alias("doc_id"), "text", "lang")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose number isn't in ``gone``, which is written first: if its size allows, Spark broadcasts it and no text moves."""
    return rows.join(stored(gone.select(F.col("doc_id").alias(ROW)).distinct(), "gone"), ROW, "left_anti").drop(ROW)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts as well), and those of which no language holds a third.

    Decided for each row, whatever its id. If no row has a language and a text, nothing can be learned and all rows stay.
    """
    if not docs.where("lang is not null and text is not null").limit(1).count():
        return docs
    rows = _rows(docs)
    found = identify(_asked(rows))
    return _without(rows, found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id (or the first row, where ids are null or
    repeated): five-word shingles, a similarity of 0.8. Null and empty texts have no copies and stay; repeated rows are copies."""
    rows = _rows(docs)
    return _without(rows, near_duplicates(_asked(rows), shingle=5, percent=80).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each row whose text holds a benchmark item, word for word or edited. Null and empty texts hold none and stay."""
    rows = _rows(docs)
    return _without(rows, contaminated(_asked(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark that names its kind; all rows stay, null and empty texts as they are. Equal texts are scanned once."""
    _, ledger = secrets.scan(docs, hint=None)  # texts are distinct by now
    findings = ledger.where(F.size("found") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("_found_of_stage"))
    found = stored(findings.withColumnRenamed("blob", "_blob_of_stage"), "found")
    redacted = secrets.redacted(F.col("text"), F.col("_found_of_stage"))
    return docs.withColumn("_blob_of_stage", secrets.address(F.col("text"))).join(found, "_blob_of_stage", "left").withColumn("text", redacted).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays whole documents, by their tokens, into sequences of 4096."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("language ID", language_id), ("near dedup", near_dedup), ("decontamination", decontamination), ("secret scan", secret_scan), ("best-fit packing", packing)]
ORACLE_SQL = None  # tokenisers are beyond SQL; tests/llm holds the stages against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
