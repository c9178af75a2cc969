"""Pages, samples and thinning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of ``df`` in a total order, with the ``total`` number of rows."""
    total = df.agg(F.count("*").alias("total"))  # one row
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def seeded_sample(df: DataFrame, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """The same ``n`` rows on every run: those with the smallest MD5 of seed and id."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(row_id).cast("string")))).limit(n)


def thinned(df: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """At most ``cap`` rows of each group, evenly spread over its order."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    keep = (F.col("_n") <= cap) | (F.floor((F.col("_i") + 1) * cap / F.col("_n")) > F.floor(F.col("_i") * cap / F.col("_n")))
    return ranked.where(keep).drop("_i", "_n")
