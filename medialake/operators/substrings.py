"""Which texts hold which words as a part: by equality on runs of letters, so that no pair is met that shares none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.storage import stored

FEW = 100_000  # rows that a broadcast may have
RUN = 6  # letters of the longest run


def sized(df: DataFrame, few: int = FEW) -> DataFrame:
    """A stored table as one side of a join: broadcast if it has few rows, else sorted and merged.

    Counted, as Spark's own guess doesn't see that ``explode`` makes more rows, nor how far files unfold in memory, and may send the other, far larger side to the driver.
    """
    return F.broadcast(df) if df.limit(few + 1).count() <= few else df.hint("merge")


def runs(text: Column, lengths: list[int]) -> Column:
    """The distinct substrings of ``text`` of these lengths."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(of, lengths)))


def starts(words: Column, lengths: list[int]) -> Column:
    """The distinct starts of ``words`` (an array) of these lengths."""
    of = lambda w: F.filter(F.transform(F.array(*map(F.lit, lengths or [1])), lambda n: F.when(F.length(w) >= n, F.substring(w, F.lit(1), n))), lambda x: x.isNotNull())
    return F.array_distinct(F.flatten(F.transform(words, of)))


def lengths_of(df: DataFrame, *columns: str) -> list[int]:
    """The distinct lengths of these columns' texts; few."""
    return sorted(r[0] for r in df.select(F.explode(F.array(*(F.length(c) for c in columns))).alias("n")).where("n > 0").distinct().collect())


def holding(parts: DataFrame, texts: DataFrame, run: int = RUN) -> DataFrame:
    """(part, side, id) for each of ``parts`` (part, side) that is a part of one of the ``texts`` (id, x, side) of its side.

    A part of up to ``run`` letters meets the texts by itself, a longer one by that of its runs of so many letters that the fewest texts hold.
    """
    parts = stored(parts.where("part <> ''").distinct(), "parts")
    most = F.least(F.length("part"), F.lit(run))
    lengths = sorted(r[0] for r in parts.select(most.alias("n")).distinct().collect())
    if not lengths:
        return parts.join(texts.select("side", "id").limit(0), "side")
    cut = F.transform(F.sequence(F.lit(1), F.length("part") - most + 1), lambda i: F.substring("part", i, most))
    keys = stored(parts.select("part", "side", F.explode(F.array_distinct(cut)).alias("run")), "keys")
    wanted = stored(keys.select("run", "side").distinct(), "wanted")
    held = stored(texts.select("id", "x", "side", F.explode(runs(F.col("x"), lengths)).alias("run")).join(sized(wanted), ["run", "side"], "left_semi"), "held")
    often = stored(held.groupBy("run", "side").count(), "often")
    # A part with a run that no text holds is a part of none.
    counted = keys.join(sized(often), ["run", "side"], "left").groupBy("part", "side").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "run")).alias("r"))
    rarest = stored(counted.where("r.n > 0").select("part", "side", F.col("r.run").alias("run")), "rarest")
    return held.join(sized(rarest), ["run", "side"]).where(F.col("x").contains(F.col("part"))).select("part", "side", "id").distinct()
