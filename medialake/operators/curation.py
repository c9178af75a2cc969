"""Change sets: merges, plans and re-derived columns; each gives a table, none touches a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: str, preserve: list[str]) -> DataFrame:
    """New rows over old ones by key; ``preserve`` columns keep the old value where there is one. Rows only in old stay (kept_only)."""
    o = old.select([F.col(c).alias(f"old_{c}") for c in old.columns])
    both = new.withColumn("_new", F.lit(True)).join(o, F.col(key) == F.col(f"old_{key}"), "full")
    fresh = F.coalesce("_new", F.lit(False))
    pick = lambda c: F.coalesce(f"old_{c}", c) if c in preserve else F.coalesce(c, f"old_{c}") if c == key else F.when(fresh, F.col(c)).otherwise(F.col(f"old_{c}"))
    return both.select(*(pick(c).alias(c) for c in new.columns), (~fresh).alias("kept_only"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def verdicts(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """How many rows of a recomputed column are ok, missing, to do or diverging."""
    verdict = F.when(new.isNull(), "missing").when(old.isNull(), "todo").when(old.eqNullSafe(new), "ok").otherwise("diverging")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def collision_free(rows: DataFrame, folder: str, name: str, row_id: str) -> DataFrame:
    """``target`` names in a folder: later rows of one name get the least free ``-1``, ``-2`` before the suffix; no target is there twice."""
    stem, dot = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    numbered = r"^(.*)-([1-9][0-9]{0,8})$"
    taken = rows.select(F.col(folder).alias("_folder"), stem.alias("_stem"), dot.alias("_dot")).distinct().where(F.col("_stem").rlike(numbered))
    taken = taken.groupBy("_folder", F.concat(F.regexp_extract("_stem", numbered, 1), "_dot").alias("_name")).agg(F.array_sort(F.collect_set(F.regexp_extract("_stem", numbered, 2).cast("int"))).alias("_taken"))
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy(row_id)) - 1
    met = rows.withColumn("_n", n).join(taken, F.col(folder).eqNullSafe(F.col("_folder")) & (F.col(name) == F.col("_name")), "left")
    # The n-th number that isn't taken.
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_n"), lambda k, t: F.when(t <= k, k + 1).otherwise(k))
    return met.withColumn("target", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("-"), free.cast("string"), dot))).drop("_n", "_taken", "_folder", "_name")
