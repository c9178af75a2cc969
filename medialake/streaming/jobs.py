"""Streams over the same rows as the batch operators; the batch results stay the truth for late data."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.storage import shared_dir


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream has to give now, as a stored table: it runs until its input is used up (its state in the shared folder).

    In ``update`` and ``complete`` mode each batch is a table of its own with its number in ``_batch``.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/rows").outputMode(mode).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/rows/{epoch}")

    writer.foreachBatch(keep).outputMode(mode).start().awaitTermination()
    return spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in stream.dtypes)}, _batch int").parquet(f"{base}/rows/*")


def files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream; the table may be one file or a folder, hence the pattern, which takes both."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")


def sessions(stream: DataFrame, key: str, ts: str, late: str = "1 day", gap: str = "3 hours") -> DataFrame:
    """Gap sessions of a stream, closed by the watermark: key, start_at, closes_at (the last row's end of gap), size."""
    window = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(F.col(key), window.alias("w")).agg(F.count("*").alias("size")).select(key, F.col("w.start").alias("start_at"), F.col("w.end").alias("closes_at"), "size")


def heartbeats(stream: DataFrame, job: str = "job_id", order: str = "turn") -> DataFrame:
    """The latest heartbeat of each job, for update mode."""
    return stream.groupBy(job).agg(F.max(order).alias("latest"), F.count("*").alias("beats"))


def stale(beats: DataFrame, now: DataFrame, limit: int, job: str = "job_id") -> DataFrame:
    """Jobs by their latest heartbeat over all batches of ``heartbeats``, and whether ``now`` (one row, one value) is more than ``limit`` past it."""
    last = beats.groupBy(job).agg(F.max("latest").alias("latest"), F.max_by("beats", "_batch").alias("beats"))
    met = last.join(F.broadcast(now.toDF("_now")), F.lit(True))  # one row
    return met.withColumn("stale", F.col("_now") - F.col("latest") > limit).drop("_now")


def unseen_content(stream: DataFrame, ts: str, content: str, late: str = "1 day") -> DataFrame:
    """Rows whose content hash hasn't occurred within the watermark."""
    return stream.withColumn("content_sha256", F.sha2(content, 256)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["content_sha256"])


def incremental_ingest(stream: DataFrame, target: str, key: str, preserve: list[str], checkpoint: str, versions: Callable[[int], str] | None = None):
    """Merges each micro-batch into a new version of a Parquet table; a batch that is replayed gives the same version.

    Returns the started query. Version ``n`` lies in ``target/v=n``; readers take the highest complete one. Of several rows of a key in
    one batch the one that comes last by all its columns counts.
    """
    from medialake.operators.curation import latest, upserted

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        path = versions or (lambda n: f"{target}/v={n}")
        new = latest(batch.withColumn("_at", F.to_json(F.struct(*batch.columns))), [key], ["_at"]).drop("_at")
        merged = new if epoch == 0 else upserted(spark.read.parquet(path(epoch - 1)), new, key, preserve).drop("kept_only")
        merged.write.mode("overwrite").parquet(path(epoch))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_events(stream: DataFrame, key: str, ts: str, gap_s: int = 3 * 3600, late: str | None = "1 day") -> DataFrame:
    """A stateful open event for each key: key, start_at, end_at, size, emitted when a later row leaves a larger gap.

    With ``late`` the watermark closes an event as well, once it has passed the event's end by the gap, and rows before the watermark
    are dropped; without, only a later row does. A late row within the gap widens the open event, one before it is an event of its own.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    gap = gap_s * 10**9

    def update(k, batches, state: GroupState):
        if state.hasTimedOut:
            start, end, size = state.get
            state.remove()
            yield pd.DataFrame([(*k, pd.Timestamp(start), pd.Timestamp(end), size)], columns=[key, "start_at", "end_at", "size"])
            return
        runs = [state.get] if state.exists else []
        runs = sorted(runs + [(t, t, 1) for b in batches for t in b[ts].astype("datetime64[ns]").astype("int64").tolist()])
        merged = [list(runs[0])]
        for start, end, size in runs[1:]:
            if start - merged[-1][1] > gap:
                merged.append([start, end, size])
            else:
                merged[-1][1:] = [max(end, merged[-1][1]), merged[-1][2] + size]
        state.update(tuple(merged[-1]))
        if late:
            state.setTimeoutTimestamp(max((merged[-1][1] + gap) // 10**6 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*k, pd.Timestamp(s), pd.Timestamp(e), n) for s, e, n in merged[:-1]], columns=[key, "start_at", "end_at", "size"])

    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, F.col(ts).cast("timestamp").alias(ts))
    rows = rows.withWatermark(ts, late) if late else rows
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, start_at timestamp, end_at timestamp, size long", "start long, finish long, size long", "append", timeout)
