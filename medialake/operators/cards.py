"""Event cards and suggestions: summaries of sessions, and which of them may belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.operators.events import HOUR, dealt_sessions, event_key, seconds


def cards(rows: DataFrame, key: str, ts: str, row_id: str, lists: list[str], gap_s: int = 3 * HOUR, cover: int = 8) -> DataFrame:
    """One row for each gap session: key, start_at, end_at, size, span_minutes, event_key, ``cover`` first ids, and for
    each column of ``lists`` its distinct values in order of appearance.

    A session is first told for each of its days, where its rows lie already: what a list holds is distinct and a cover is cut
    before anything is gathered, so no session's rows meet as a whole and only these pieces are dealt again.
    """
    piece = ["_k", "_day", "session_start"]
    at = dealt_sessions(rows, key, ts, row_id, gap_s)
    ranked = lambda *by: F.row_number().over(Window.partitionBy(*piece, *by).orderBy(ts, row_id))
    at = at.withColumns({"_n": ranked(), **{f"_n_{name}": ranked(name) for name in lists}})
    told = lambda value: F.struct(F.col(ts).alias("t"), F.col(row_id).alias("i"), F.col(value).alias("x"))
    held = [F.collect_list(F.when(F.col("_n") <= cover, told(row_id))).alias("cover")]
    held += [F.collect_list(F.when((F.col(f"_n_{name}") == 1) & F.col(name).isNotNull(), told(name))).alias(name) for name in lists]
    pieces = at.groupBy(*piece).agg(F.max(ts).alias("end_at"), F.count("*").alias("size"), *held)
    ordered = lambda name: F.transform(F.array_sort(F.flatten(F.collect_list(name))), lambda s: s["x"])
    out = pieces.groupBy("_k", "session_start").agg(
        F.max("end_at").alias("end_at"), F.sum("size").alias("size"), F.slice(ordered("cover"), 1, cover).alias("cover"), *(F.array_distinct(ordered(name)).alias(name) for name in lists)
    )
    out = out.select(F.col(f"_k.{key}").alias(key), F.col("session_start").alias("start_at"), "end_at", "size", "cover", *lists)
    minutes = (seconds(F.col("end_at")) - seconds(F.col("start_at"))) / 60
    return out.withColumn("span_minutes", minutes).withColumn("event_key", event_key(F.col(key), F.col("start_at"), F.col("size")))


def neighbour_suggestions(events: DataFrame, key: str, telling, least_h: float = 3.0, most_h: float = 12.0) -> DataFrame:
    """Consecutive cards of a key that may be one: event_key, next_key, gap_h, score, photos.

    One point, two for each shared person (three at most), 1.5 for a shared folder that tells something (``telling``) or
    0.4 if only one side has such a folder, and up to one for closeness. Left out: pairs with neither telling folders
    nor shared persons, and pairs that lie in one telling folder already.
    """
    order = Window.partitionBy(key).orderBy("start_at")
    lead = lambda name: F.lead(name).over(order)
    pairs = events.select("*", *(lead(x).alias(f"next_{x}") for x in ("event_key", "start_at", "folder", "person", "size")))
    pairs = pairs.withColumn("gap_h", (seconds(F.col("next_start_at")) - seconds(F.col("end_at"))) / HOUR).where((F.col("gap_h") > least_h) & (F.col("gap_h") <= most_h))
    a, b = F.filter("folder", telling), F.filter("next_folder", telling)
    shared = F.size(F.array_intersect("person", "next_person"))
    every = F.array_union("folder", "next_folder")
    organised = (F.size(every) == 1) & telling(every[0])
    folders = F.when(F.arrays_overlap(a, b), 1.5).when((F.size(a) > 0) | (F.size(b) > 0), 0.4).otherwise(0.0)
    score = 1.0 + 2.0 * F.least(shared, F.lit(3)) + folders + (most_h - F.col("gap_h")) / most_h
    kept = pairs.where(((F.size(a) > 0) | (F.size(b) > 0) | (shared > 0)) & ~F.coalesce(organised, F.lit(False)))
    return kept.select("event_key", F.col("next_event_key").alias("next_key"), F.round("gap_h", 4).alias("gap_h"), F.round(score, 3).alias("score"), (F.col("size") + F.col("next_size")).alias("photos"))


def folder_suggestions(events: DataFrame, telling) -> DataFrame:
    """Cards spread over folders: event_key, reason (several telling ones, both kinds, several that tell nothing), score, photos."""
    named = F.size(F.filter("folder", telling))
    dump = F.size("folder") - named
    reason = F.when(dump == 0, "split_named").when(named > 0, "dump_plus_named").otherwise("split_dump")
    return events.where(F.size("folder") > 1).select("event_key", reason.alias("reason"), F.round(2 + F.col("size") / 100, 3).alias("score"), F.col("size").alias("photos"))


def telling(name: Column) -> Column:
    """Whether a folder's name says something."""
    return ~name.rlike(r"(?i)^(camera|dcim|download)$")
