"""The log of changes against a plain dictionary: batches, replays, late rows, compaction."""

import random

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from medialake.streaming.changes import ChangeLog, touched_rows

SCHEMA = StructType().add("k", LongType()).add("at", IntegerType()).add("text", StringType()).add("note", StringType())


def plain(batches):
    rows = [(n, *r) for n, batch in enumerate(batches) for r in batch]
    out = {}
    for k in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == k]
        text = max(mine, key=lambda r: (r[2], r[0], str(r[3])))
        said = [r for r in mine if r[4]]
        out[k] = (k, text[2], text[3], min(said, key=lambda r: (r[0], r[2]))[4] if said else text[4])
    return out


@pytest.fixture
def log(tmp_path):
    return ChangeLog(f"file://{tmp_path}/table", SCHEMA, "k", "at", ("note",), 4)


def held(log, spark):
    rows = [tuple(r) for r in log.current(spark).collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r for r in rows}


def test_batches_replays_and_compaction(spark, log):
    rnd = random.Random(7)
    batches, serial = [], 0
    for n in range(5):
        batch = []
        for k in rnd.sample(range(40), 12 if n else 40):
            serial += 1
            batch.append((k, serial if rnd.random() < 0.8 else serial - 60, f"t{serial}", rnd.choice([None, "", f"n{serial}"])))
        batches.append(batch)
        for _ in range(1 + (n == 3)):  # the fourth is replayed
            log.add(spark.createDataFrame(batch, SCHEMA), n)
        assert held(log, spark) == plain(batches)
        if n in (1, 3):
            assert log.compact(spark) and held(log, spark) == plain(batches)
    assert {r.number: r.rows for r in touched_rows(spark, log).collect()} == {n: len(b) for n, b in enumerate(batches)}


def test_only_touched_buckets_are_compacted(spark, log):
    log.add(spark.createDataFrame([(k, 1, "a", None) for k in range(40)], SCHEMA), 0)
    assert log.compact(spark) == [0, 1, 2, 3] and log.compact(spark) == []
    log.add(spark.createDataFrame([(3, 2, "b", "x"), (3, 1, "late", "y")], SCHEMA), 1)
    assert len(log.compact(spark)) == 1
    rows = held(log, spark)
    assert len(rows) == 40 and rows[3] == (3, 2, "b", "y") and rows[4] == (4, 1, "a", None)


def test_a_snapshot_without_commit_does_not_count(spark, log):
    log.add(spark.createDataFrame([(1, 1, "a", None)], SCHEMA), 0)
    broken = spark.createDataFrame([(1, 9, "broken", "z", 0)], "k long, at int, text string, note string, _bucket int")
    broken.write.partitionBy("_bucket").parquet(f"{log.base}/snapshot/_number=5")
    assert held(log, spark) == {1: (1, 1, "a", None)}


def test_stream_resumes(spark, log, tmp_path):
    inbox = f"file://{tmp_path}/inbox"
    for part in range(3):
        spark.createDataFrame([(part, part, f"a{part}", None), (9, part, f"b{part}", f"n{part}")], SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        if part:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
            log.ingest(stream, f"file://{tmp_path}/state").awaitTermination()
    rows = held(log, spark)
    assert rows[9][:3] == (9, 2, "b2") and set(rows) == {0, 1, 2, 9} and touched_rows(spark, log).count() == 3
