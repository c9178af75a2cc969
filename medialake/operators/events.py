"""Time-ordered operators: gap sessions, day events, interval naming and neighbours. Keys, times and ids are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def gap_session_starts(df: DataFrame, key: str, ts: str, row_id: str, gap_s: int = 3 * HOUR) -> DataFrame:
    """``df`` with the ``session_start`` of each row: a gap of more than ``gap_s`` starts a new session; rows without a time are left out."""
    return dealt_sessions(df, key, ts, row_id, gap_s).drop("_k", "_day")


def dealt_sessions(df: DataFrame, key: str, ts: str, row_id: str, gap_s: int = 3 * HOUR) -> DataFrame:
    """``gap_session_starts`` with ``_k``, the key in a struct, and ``_day``, by which the rows are dealt.

    Windows are per key and day; a table of days carries sessions over midnight, so a key that holds
    a third of all rows is still divided by days. Rows are dealt once: a day's rows, its ends and what it
    carries lie by the same (key, day), the key in a struct, which is never null and so is met by plain equality.
    """
    rows = df.where(F.col(ts).isNotNull()).withColumn("_k", F.struct(key)).withColumn("_day", F.to_date(ts))
    inside = Window.partitionBy("_k", "_day").orderBy(ts, row_id)
    across = Window.partitionBy("_k").orderBy("_day")
    far = lambda later, earlier: seconds(F.col(later)) - seconds(F.col(earlier)) > gap_s
    # Starts after a day's first row need only that day.
    rows = rows.withColumn("_before", F.lag(ts).over(inside)).withColumn("_start", F.when(far(ts, "_before"), F.col(ts))).drop("_before")
    days = rows.groupBy("_k", "_day").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.max("_start").alias("_inner"))
    days = days.withColumn("_before", F.lag("_last").over(across)).withColumn("_opened", F.when(F.col("_before").isNull() | far("_first", "_before"), F.col("_first")))
    days = days.withColumn("_carried", F.last(F.coalesce("_inner", "_opened"), True).over(across.rowsBetween(Window.unboundedPreceding, -1)))
    days = days.select("_k", "_day", F.coalesce("_opened", "_carried").alias("_open"))
    rows = rows.withColumn("_start", F.max("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(days, ["_k", "_day"]).withColumn("session_start", F.coalesce("_start", "_open")).drop("_start", "_open")


def gap_sessions(df: DataFrame, key: str, ts: str, row_id: str, gap_s: int = 3 * HOUR) -> DataFrame:
    """One row for each session: key, start_at, end_at, size, span_minutes, event_key."""
    found = gap_session_starts(df, key, ts, row_id, gap_s).groupBy(key, "session_start").agg(F.max(ts).alias("end_at"), F.count("*").alias("size"))
    found = found.withColumn("span_minutes", (F.unix_micros(F.col("end_at").cast("timestamp")) - F.unix_micros(F.col("session_start").cast("timestamp"))) / 6e7)
    return found.withColumnRenamed("session_start", "start_at").withColumn("event_key", event_key(F.col(key), F.col("start_at"), F.col("size")))


def event_key(channel: Column, start: Column, size: Column) -> Column:
    return F.concat(F.lit("ev-"), channel.cast("string"), F.lit("-"), F.date_format(start, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.lpad(size.cast("string"), 4, "0"))


def day_events(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows that only know their day: one event for each key and day."""
    return df.where(F.col(ts).isNotNull()).groupBy(key, F.to_date(ts).alias("day")).agg(F.count("*").alias("size"))


def upper_median(values: Column) -> Column:
    """The upper of the two middle values of an array."""
    return F.element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1)


def session_metrics(sessions: DataFrame) -> DataFrame:
    """Events, rows, single-row events, upper median and largest size, over all sessions; ranks of sizes come from a histogram."""
    sizes = sessions.groupBy("size").agg(F.count("*").alias("n"))
    ranked = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("size"))).crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("events"))))  # one row
    return ranked.agg(
        F.max("events").alias("events"), F.sum(F.col("n") * F.col("size")).alias("assets"), F.sum(F.when(F.col("size") == 1, F.col("n")).otherwise(0)).alias("singles"),
        F.min(F.when(F.col("upto") > F.floor(F.col("events") / 2), F.col("size"))).alias("median_size"), F.max("size").alias("largest"),
    )


def overlapping(events: DataFrame, spans: DataFrame, least: float = 0.5) -> DataFrame:
    """The name whose span covers the largest share (at least ``least``) of an event on its channel; ties go to the earlier, then smaller name.

    events: event_key, channel, start_at, end_at; spans: name, channel, start_at, end_at. Both are dealt by channel
    and day, so the range condition only meets neighbours. An event without length needs to lie inside.
    """
    days = lambda df: F.explode(F.sequence(F.to_date("start_at"), F.greatest(F.to_date("start_at"), F.to_date("end_at"))))
    e = events.select("event_key", "channel", F.col("start_at").alias("e0"), F.col("end_at").alias("e1"), days(events).alias("day"))
    s = spans.select("name", "channel", F.col("start_at").alias("s0"), F.col("end_at").alias("s1"), days(spans).alias("day"))
    share = (F.least(seconds(F.col("e1")), seconds(F.col("s1"))) - F.greatest(seconds(F.col("e0")), seconds(F.col("s0")))) / (seconds(F.col("e1")) - seconds(F.col("e0")))
    share = F.when(F.col("e0") == F.col("e1"), F.when((F.col("s0") <= F.col("e0")) & (F.col("e0") <= F.col("s1")), 1.0).otherwise(0.0)).otherwise(share)
    met = e.join(s, ["channel", "day"]).withColumn("share", share).where(F.col("share") >= least).select("event_key", "name", "s0", "share").distinct()
    best = Window.partitionBy("event_key").orderBy(F.desc("share"), "s0", "name")
    return met.withColumn("n", F.row_number().over(best)).where("n = 1").select("event_key", "name", F.round("share", 6).alias("share"))


def within(rows: DataFrame, spans: DataFrame, ts: str = "taken_at", channel: str = "channel") -> DataFrame:
    """Rows whose time lies in a span of their channel (both ends included), with the span's name."""
    s = spans.select("name", F.col(channel), "start_at", "end_at", F.explode(F.sequence(F.to_date("start_at"), F.to_date("end_at"))).alias("_day"))
    return rows.withColumn("_day", F.to_date(ts)).join(s, [channel, "_day"]).where((F.col(ts) >= F.col("start_at")) & (F.col(ts) <= F.col("end_at"))).drop("_day", "start_at", "end_at")


def near_pairs(left: DataFrame, right: DataFrame, row_id: str, ts: str, window_s: int) -> DataFrame:
    """Pairs (left id, right id, seconds apart) at most ``window_s`` apart, by time buckets."""
    bucket = F.floor(seconds(F.col(ts)) / window_s)
    a = left.select(F.col(row_id).alias("left_id"), F.col(ts).alias("t"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    b = right.select(F.col(row_id).alias("right_id"), F.col(ts).alias("u"), bucket.alias("b"))
    apart = F.abs(seconds(F.col("t")) - seconds(F.col("u")))
    return a.join(b, "b").where((F.col("left_id") != F.col("right_id")) & (apart <= window_s)).select("left_id", "right_id", F.round(apart, 3).alias("apart_s"))


def neighbours(sessions: DataFrame, key: str, least_h: float = 3.0, most_h: float = 12.0) -> DataFrame:
    """Consecutive sessions of a key more than ``least_h`` and at most ``most_h`` apart, scored by closeness."""
    order = Window.partitionBy(key).orderBy("start_at")
    gap = (seconds(F.lead("start_at").over(order)) - seconds(F.col("end_at"))) / HOUR
    scored = sessions.withColumn("next_key", F.lead("event_key").over(order)).withColumn("gap_h", gap)
    scored = scored.where((F.col("gap_h") > least_h) & (F.col("gap_h") <= most_h))
    return scored.select("event_key", "next_key", F.round("gap_h", 4).alias("gap_h"), F.round(1 + (most_h - F.col("gap_h")) / most_h, 4).alias("score"))


def wrong_clocks(rows: DataFrame, album: str, model: str, ts: str, least_album: int = 8, least_group: int = 3, days: int = 365, spread_days: int = 2) -> DataFrame:
    """Groups of one album and camera whose times lie far from the album's: album, model, n, verdict, offset_days.

    The reference time is the upper median of the album's majority year (at least half of its rows). Strays lie more
    than ``days`` from it; a camera with ``least_group`` of them is reported, with a constant offset if their spread
    is at most ``spread_days``, else as fallen back.
    """
    year = F.year(ts)
    years = rows.groupBy(album, year.alias("year")).agg(F.count("*").alias("n"))
    per_album = years.groupBy(album).agg(F.sum("n").alias("total"), F.max_by("year", F.struct("n", "year")).alias("year"), F.max("n").alias("most")).where((F.col("total") >= least_album) & (F.col("most") * 2 >= F.col("total")))
    good = rows.join(per_album.select(album, "year", "most"), album)
    rank = F.row_number().over(Window.partitionBy(album).orderBy(ts))
    centre = good.where(year == F.col("year")).withColumn("rank", rank).where(F.col("rank") == F.floor(F.col("most") / 2) + 1).select(album, F.col(ts).alias("centre"))
    away = good.join(centre, album).withColumn("off", (seconds(F.col(ts)) - seconds(F.col("centre"))) / 86400).where(F.abs("off") > days)
    found = away.groupBy(album, model).agg(F.count("*").alias("n"), F.min("off").alias("least"), F.max("off").alias("most"), F.expr("percentile(off, 0.5)").alias("middle")).where(F.col("n") >= least_group)
    constant = F.col("most") - F.col("least") <= spread_days
    return found.select(album, model, "n", F.when(constant, "constant").otherwise("fallen back").alias("verdict"), F.when(constant, F.round("middle", 4)).alias("offset_days"))
