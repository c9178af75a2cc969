"""Rule files and album sidecars as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDECAR = "location string, date_range struct<start string>, people array<string>, type string"


def path_rules(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a rule file as (path, include): ``#`` starts a comment line, a leading ``-`` excludes. No include at all is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    rules = lines.select(F.regexp_replace("line", r"^-\s*", "").alias("path"), (~F.col("line").startswith("-")).alias("include"))
    if not rules.where("include").limit(1).count():
        raise ValueError("the rule file includes nothing")
    return rules


def nearest_sidecar(rows: DataFrame, path: str, sidecars: DataFrame, levels: int = 3) -> DataFrame:
    """``rows``, each as often as it is there, with the parsed JSON of the nearest of their parent directories' sidecars (dir, body); malformed JSON is null."""
    own = F.regexp_replace(path, "/[^/]*$", "")
    parts = F.split("_own", "/")
    up = F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - k + 1, F.lit(0))), "/").alias("dir")))
    met = rows.select(own.alias("_own")).distinct().withColumn("_up", F.explode(up)).join(sidecars.select(F.col("dir").alias("_dir"), "body"), F.col("_up.dir") == F.col("_dir"), "left")
    best = met.groupBy("_own").agg(F.min_by("body", F.when(F.col("body").isNotNull(), F.col("_up.depth")).otherwise(99)).alias("_body"))
    return rows.withColumn("_own", own).join(best, "_own", "left").withColumn("sidecar", F.from_json("_body", SIDECAR)).drop("_own", "_body")
