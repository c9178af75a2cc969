"""Folds over ordered rows, where what became of the rows before decides the next one; and the coalescing of event cards, which is such a fold."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from medialake.operators.events import HOUR, seconds
from medialake.storage import stored

Step = Callable[[Any, Any], tuple[Any, Any]]


def fold(rows: DataFrame, keys: list[str], order: list[str], step: Step, name: str, kind: str) -> DataFrame:
    """``rows`` with a column ``name``: for the rows of a key in ``order``, ``step(state, row)`` gives the next state and the row's value.

    The state is None before a key's first row. A key's rows stream through one task in sorted order and only the state is held,
    so keys should be runs that were cut where no state can matter. Null keys are one key.
    """
    schema = StructType([*rows.schema.fields, StructField(name, _parse_datatype_string(kind))])

    def run(batches):
        current, state = None, None
        for df in batches:
            values, at = [], [df.columns.get_loc(k) for k in keys]
            for row in df.itertuples(index=False):
                key = tuple(None if pd.isna(row[i]) else row[i] for i in at)
                if key != current:
                    current, state = key, None
                state, value = step(state, row)
                values.append(value)
            yield df.assign(**{name: pd.Series(values, dtype=object, index=df.index)})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def quiet_runs(rows: DataFrame, key: str, start: str, end: str, row_id: str, gap_s: float, name: str = "run") -> DataFrame:
    """``rows`` with ``name``, the start of its run: a run ends where nothing of the key lasts until ``gap_s`` before the next start.

    The latest end so far is kept within each (key, day) and carried over days by a table of them, so a key that holds a third
    of all rows is not one window. Key and day lie in structs, which are never null: rows and days are dealt alike
    and met by plain equality. Rows without a start are runs of their own (null).
    """
    dealt = rows.withColumn("_k", F.struct(key)).withColumn("_on", F.struct(F.to_date(start)))
    inside = Window.partitionBy("_k", "_on").orderBy(start, row_id)
    over_days = Window.partitionBy("_k").orderBy("_on")
    earlier = over_days.rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_last", F.coalesce(end, start))
    days = dealt.groupBy("_k", "_on").agg(F.max("_last").alias("_last"))
    days = days.select("_k", "_on", F.max("_last").over(earlier).alias("_carried"))
    met = dealt.withColumn("_before", F.max("_last").over(inside.rowsBetween(Window.unboundedPreceding, -1))).join(days, ["_k", "_on"])
    met = met.withColumn("_before", F.greatest("_carried", "_before"))
    met = met.withColumn("_fresh", F.when(F.col("_before").isNull() | (seconds(F.col(start)) - seconds(F.col("_before")) > gap_s), F.col(start)))
    last = met.groupBy("_k", "_on").agg(F.max("_fresh").alias("_held"))
    last = last.select("_k", "_on", F.last("_held", True).over(earlier).alias("_held"))
    met = met.withColumn("_fresh", F.max("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return met.join(last, ["_k", "_on"]).withColumn(name, F.coalesce("_fresh", "_held")).select(*rows.columns, name)


def _joins(generic: Callable[[str], bool], gap_s: float) -> Step:
    """Whether a card joins the series before it. State: head, folder, path, name, end and whether it can be joined at all.

    A series of more than one folder or path, or that knows only its day, never grows, so of each a card tells the only value and how many there are.
    """

    def step(state, card):
        name = card.name if isinstance(card.name, str) and card.name else None
        start, end = (None if x is None or x != x else int(x) for x in (card.start_us, card.end_us))
        single = card.folders <= 1 and card.paths <= 1 and not card.day_level
        folder, path = card.one_folder if card.folders == 1 else None, card.one_path if card.paths == 1 else None
        if state is not None and single and start is not None:
            head, folder0, path0, name0, end0, single0 = state
            agree = not (name and name0 and name != name0) and not (folder and folder0 and folder != folder0) and not (path and path0 and path != path0)
            if single0 and end0 is not None and agree and (folder or folder0) and not generic(folder0 or folder) and start - end0 <= gap_s * 1e6:
                return (head, folder0 or folder, path0 or path, name0, end0 if end is None else max(end0, end), True), head
        return (card.event_key, folder, path, name, end, single), card.event_key

    return step


def coalesce(cards: DataFrame, key: str, generic: Callable[[str], bool], gap_s: float = 12 * HOUR) -> DataFrame:
    """``cards`` (event_key, ``key``, start_at, end_at, folder, path, name, day_level) with ``series``, the event_key of the card that heads it.

    A card joins the series before it if both lie in one and the same telling folder, under one path at most, no more than ``gap_s``
    after what has come so far ended, neither knows only its day, and their names do not differ. The series keeps its head's name, so a
    card without a name never gives it one. Cards are taken by start, ties by event_key; those without a start stay alone.
    """
    cards = stored(cards, "cards")
    asked = quiet_runs(cards, key, "start_at", "end_at", "event_key", gap_s, "_run")
    # The fold gets numbers and texts: lists are slow to hand to Python.
    told = lambda name: F.filter(F.array_distinct(F.coalesce(name, F.array().cast("array<string>"))), lambda x: x != "")
    some = lambda name: [F.size(told(name)).alias(f"{name}s"), F.get(told(name), F.lit(0)).alias(f"one_{name}")]
    slim = asked.select(key, "_run", "event_key", F.unix_micros(F.col("start_at").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end_at").cast("timestamp")).alias("end_us"), *some("folder"), *some("path"), "name", F.coalesce("day_level", F.lit(False)).alias("day_level"))
    return cards.join(fold(slim, [key, "_run"], ["start_us", "event_key"], _joins(generic, gap_s), "series", "string").select("event_key", "series"), "event_key")


def merged(cards: DataFrame, key: str, lists: list[str], cover: int = 8) -> DataFrame:
    """One row for each series of ``coalesce``: key, series, name, day_level, parts, size, start_at, end_at, ``cover`` first ids, and the distinct values of ``lists`` in order.

    A series starts with its head's own lists, so only the cards that joined it are taken apart; their values are distinct before they are
    gathered. cards also has size and cover, its first ids.
    """
    cards, every = stored(cards, "parts"), [*lists, "cover"]
    own = lambda name, of: F.col(f"{of}.{name}")
    heads, rest = cards.where("event_key = series").alias("h"), cards.where("event_key <> series")
    total = rest.groupBy("series").agg(F.first(key).alias(key), F.count("*").alias("parts"), F.sum("size").alias("size"), F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"))
    for name in every:
        each = rest.select("series", "start_at", "event_key", F.posexplode(name).alias("_i", "_x")).groupBy("series", "_x").agg(F.min(F.struct("start_at", "event_key", "_i")).alias("_at"))
        if name == "cover":
            each = each.withColumn("_n", F.row_number().over(Window.partitionBy("series").orderBy("_at"))).where(F.col("_n") <= cover)
        held = each.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_l")).select("series", F.col("_l._x").alias(name))
        total = total.join(held, "series", "left")
    met = heads.join(total.alias("r"), F.col("h.series") == F.col("r.series"), "full")
    either = lambda name: F.coalesce(own(name, "h"), own(name, "r")).alias(name)
    size, none = F.coalesce(own("size", "h") + own("size", "r"), own("size", "h"), own("size", "r")), lambda name: F.array().cast(dict(cards.dtypes)[name])
    joined = lambda name: F.array_distinct(F.concat(*(F.coalesce(own(name, of), none(name)) for of in "hr")))
    return met.select(
        either(key), either("series"), own("name", "h").alias("name"), own("day_level", "h").alias("day_level"), (F.when(own("event_key", "h").isNotNull(), 1).otherwise(0) + F.coalesce(own("parts", "r"), F.lit(0))).alias("parts"), size.alias("size"),
        F.least(own("start_at", "h"), own("start_at", "r")).alias("start_at"), F.greatest(own("end_at", "h"), own("end_at", "r")).alias("end_at"), *(joined(name).alias(name) for name in lists), F.slice(joined("cover"), 1, cover).alias("cover"),
    )


def sources(rows: DataFrame, of: Column, path: str, folder: str, row_id: str, order: str) -> DataFrame:
    """Where the rows of each series come from: series, path, folder, size and ids in order. One row a source: a path, or a folder without one."""
    told = rows.withColumn("series", of).withColumn("_place", F.coalesce(F.nullif(F.col(path), F.lit("")), F.concat(F.lit("folder "), F.col(folder)), F.lit("")))
    grouped = told.groupBy("series", "_place").agg(F.max(path).alias("path"), F.min(folder).alias("folder"), F.count("*").alias("size"), F.min(F.struct(order, row_id)).alias("first"))
    return grouped.select("series", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("folder", F.lit("")).alias("folder"), "size", F.col(f"first.{row_id}").alias("first_id"))
