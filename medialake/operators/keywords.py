"""Words that tell clusters of captions apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions.text import distinct_stems
from medialake.storage import stored

WORD = "[a-zA-ZÄÖÜäöüß]{4,}"


def name_tokens(names: DataFrame) -> DataFrame:
    """(word): the parts of four letters and more of all names (name), in lower case."""
    return names.where("name is not null").select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit(WORD), F.lit(0))).alias("word")).distinct()


def ranked_terms(rows: DataFrame, cluster: str, caption: str, names: DataFrame, stop: DataFrame, least: int = 3, share: float = 0.05, common: float = 0.2) -> DataFrame:
    """(cluster, term, score, rank): the words of each cluster by p * ln(p / q), p being the share of the cluster's captions that hold the word and q that of all.

    Captions without a word that counts aren't counted. Left out: words of ``stop`` (word), words in fewer than ``least`` captions of the cluster or less
    than ``share`` of them, words in more than ``common`` of all captions, and ``names`` (word), also with an s behind them. Ties go to the later word. Only counts are shuffled; rows without a
    cluster or caption are left out.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(caption), F.lit(WORD), F.lit(0)))
    each = rows.where(F.col(cluster).isNotNull() & F.col(caption).isNotNull()).withColumn("_row", F.monotonically_increasing_id()).select(F.col(cluster).alias("cluster"), "_row", F.explode(words).alias("term"))
    stored_words = stored(each.join(stop.select(F.col("word").alias("term")).distinct(), "term", "left_anti"), "words")
    here = stored(stored_words.groupBy("cluster", "term").agg(F.count("*").alias("seen")), "seen")
    local = stored_words.select("cluster", "_row").distinct().groupBy("cluster").agg(F.count("*").alias("local"))
    total = local.agg(F.sum("local").alias("all"))  # one row
    spread = here.groupBy("term").agg(F.sum("seen").alias("everywhere"))
    bare = F.regexp_replace("term", "s$", "")
    said = here.join(names.select(F.col("word").alias("term")).distinct(), "term", "left_anti").withColumn("_bare", bare).join(names.select(F.col("word").alias("_bare")).distinct(), "_bare", "left_anti").drop("_bare")
    met = said.where(F.col("seen") >= least).join(local, "cluster").join(spread, "term").crossJoin(F.broadcast(total))
    p, q = F.col("seen") / F.col("local"), F.col("everywhere") / F.col("all")
    scored = met.where((p >= share) & (q <= common)).select("cluster", "term", F.round(p * F.log(p / q), 9).alias("score"))
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), F.desc("term"))
    return scored.withColumn("rank", F.row_number().over(order))  # at most 1 / share words for each word of a caption


def cluster_terms(ranked: DataFrame, most: int = 4) -> DataFrame:
    """(cluster, terms): of each cluster's ranked words the first ``most`` of which none is a form of one before it; all words are looked at."""
    lists = ranked.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_l"))
    return lists.select("cluster", distinct_stems(F.transform("_l", lambda x: x["term"]), most).alias("terms"))
