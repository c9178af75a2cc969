"""The pipeline's stages, each on its own input, and the whole of it."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from medialake.llm import secrets

R = random.Random(4)
WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st", "lm", "")]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def ids(df):
    return sorted(r.doc_id if r.doc_id is not None else -1 for r in df.collect())


def test_stages(spark, tmp_path):
    item, long = prose(30), prose(100)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    docs = frame(spark, [(0, long), (1, long + " end"), (2, "12 34 !"), (3, None), (4, prose(50) + " " + item + " x"), (5, prose(40) + " token=abcdefgh1 " + "AKIA" + "Z" * 16), (6, prose(9000)), (None, prose(30)), (7, prose(20)), (7, prose(20))])
    docs = pipeline.language_id(spark, docs, sf)
    assert ids(docs) == [-1, 0, 1, 4, 5, 6, 7, 7]
    docs = pipeline.near_dedup(spark, docs, sf)
    assert ids(docs) == [-1, 0, 4, 5, 6, 7, 7]  # one id, two texts: both stay
    docs = pipeline.decontamination(spark, docs, sf)
    assert ids(docs) == [-1, 0, 5, 6, 7, 7]
    docs = pipeline.secret_scan(spark, docs, sf)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(map(str, text)) == ["0", "5", "6", "7", "None"] and text[0] == long
    assert text[5].endswith("[assign] [access]") and "AKIA" not in text[5]
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    packed = pipeline.packing(spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {None, 0, 5, 6, 7} and len([r for r in packed if r.doc_id == 6]) > 1


def test_rows_are_decided_one_by_one(spark, tmp_path):
    item = prose(30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [prose(40) for _ in range(4)]
    rows = [(None, "12 34"), (None, texts[0]), (7, "12 34"), (7, texts[1]), (7, texts[2] + " " + item), (7, texts[1]), (8, texts[3] + " token=abcdefgh1"), (9, None), (9, "")]
    docs = frame(spark, rows).selectExpr("*", "'b' as blob", "1 as found", "2 as `count`", "3 as component_id")
    docs = pipeline.language_id(spark, docs, str(tmp_path))
    assert sorted(r.text for r in docs.collect()) == sorted([texts[0], texts[1], texts[1], texts[2] + " " + item, texts[3] + " token=abcdefgh1"])
    docs = pipeline.near_dedup(spark, docs, str(tmp_path))
    assert sorted(r.text for r in docs.collect()) == sorted([texts[0], texts[1], texts[2] + " " + item, texts[3] + " token=abcdefgh1"])
    docs = pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(r.text for r in docs.collect()) == sorted([texts[0], texts[1], texts[3] + " token=abcdefgh1"])
    docs = pipeline.secret_scan(spark, docs, str(tmp_path))
    assert sorted(r.text for r in docs.collect()) == sorted([texts[0], texts[1], texts[3] + " [assign]"])
    assert {(r.blob, r.found, r["count"], r.component_id) for r in docs.collect()} == {("b", 1, 2, 3)}


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, prose(20)), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.language_id(spark, docs, "").count() == 2


def test_redaction_of_overlaps(spark):
    df = spark.createDataFrame([(1, "a token=" + "0123456789abcdef" * 2 + " é hex " + "f" * 30)], "doc_id long, text string")
    found, _ = secrets.scan(df)
    out = df.crossJoin(found.select("found")).select(secrets.redacted(df.text, found.found).alias("t")).first().t
    assert re.fullmatch(r"a \[assign\] é hex \[hex\]", out)


def test_whole_pipeline(spark):
    rows = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame(spark, [(1, "a")]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
