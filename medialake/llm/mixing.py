"""Mixing sources to target weights: hash-threshold histograms over a table of sizes and keys, no sort of the documents.

Each document has a key, a hash of its id and text. A source whose target is ``times`` its size and some words more takes
every document ``times`` times, and once more those whose key lies below the source's threshold. To find the threshold,
words are summed by source and by the first hex digits of the key; the bucket in which the rest of the budget ends is
divided by the next digits that tell its documents apart, and so on until it holds one. Thresholds are nested: a larger target takes all that a
smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.storage import stored

DIGITS = 3  # of the key that a round adds: 4,096 buckets
RANGE = 100_000  # sources of one range


def n_words(text: Column) -> Column:
    """Number of runs of other than white space, without an array of them; null: 0."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "w")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by ``order``) and, for each of ``sums``, ``before_<name>``, its sum over the rows before.

    Rows are dealt in ranges; only sums of ranges meet in one place.
    """
    dealt = stored(rows.repartitionByRange(rows.count() // RANGE + 1, *order).withColumn("_range", F.spark_partition_id()).withColumn("_one", F.lit(1)), "ranges")
    names = ["_one", *sums]
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(*(F.sum(x).alias(x) for x in names))
    ranges = ranges.select("_range", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"_of_{x}") for x in names))  # one row a range
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = {x: F.coalesce(F.sum(x).over(inside), F.lit(0)) + F.col(f"_of_{x}") for x in names}
    return dealt.join(ranges, "_range").select(*rows.columns, before["_one"].alias("rank"), *(before[x].alias(f"before_{x}") for x in sums))


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: words shared by weight, none above ``most`` times its size.

    Sources by code point, null last, weigh ``weights`` in turn. All words are shared; what a source can't take is shared
    again by weight. Sources fill up in the order of size over weight, so the level at which the others stop follows from
    running sums: it is that of the first source which doesn't fill up.
    """
    named = running(sources, [F.col("source").isNull(), F.col("source")], []).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    named = named.drop("rank").withColumn("most", F.col("source_size") * F.lit(float(most)))
    total = named.agg(F.sum("source_size"), F.sum("weight")).first()
    words, weight = float(total[0] or 0), float(total[1] or 1)
    filled = stored(running(named, [F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")], ["most", "weight"]), "filled")
    level = (words - F.col("before_most")) / (weight - F.col("before_weight"))
    stop = filled.where(F.col("most") >= level * F.col("weight")).agg(F.min(F.struct("rank", level.alias("level")))).first()[0]
    full = F.lit(True) if stop is None else F.col("rank") < stop["rank"]
    return filled.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.col("weight") * F.lit(float(stop["level"]) if stop else 0.0)).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each ``_s`` of ``budgets`` (_s, rest; rest above 0 and below the source's words) ``_upto``: keys below it are taken.

    rows: _s, _key (unique hex digits of one length), size. The document in which the budget ends is taken if that is nearer.
    A round sums by source and bucket, at most 4,096 a source, and goes on with the rows of the boundary buckets alone.
    """
    cut = budgets.select("_s", "rest", F.lit(0).cast("long").alias("_before"))
    rows = rows.withColumn("_digits", F.lit(DIGITS))
    shared = F.length(F.regexp_extract(F.concat_ws("|", "_least", "_most"), r"^([0-9a-f]*)[0-9a-f]*\|\1", 1))  # digits that all keys of a bucket begin with
    while True:
        rows = rows.withColumn("_bucket", F.substring(F.col("_key"), F.lit(1), F.col("_digits")))
        sums = rows.groupBy("_s", "_bucket").agg(F.sum("size").alias("_words"), F.count("*").alias("_n"), F.min("_key").alias("_least"), F.max("_key").alias("_most"))
        earlier = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        met = sums.withColumn("_inside", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).join(cut, "_s")
        met = met.withColumn("_before", F.col("_before") + F.col("_inside")).where((F.col("_before") <= F.col("rest")) & (F.col("rest") < F.col("_before") + F.col("_words")))
        cut = stored(met.select("_s", "rest", "_before", "_bucket", "_n", (shared + DIGITS).alias("_digits")), "boundary")
        rows = stored(rows.drop("_digits").join(cut.select("_s", "_bucket", "_digits"), ["_s", "_bucket"]).drop("_bucket"), "inside")
        if not cut.where("_n > 1").limit(1).count():
            break
        cut = cut.select("_s", "rest", "_before")
    nearer = 2 * (F.col("rest") - F.col("_before")) > F.col("size")
    return cut.drop("_digits").join(rows, "_s").select("_s", F.when(nearer, F.concat("_key", F.lit("~"))).otherwise(F.col("_key")).alias("_upto"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, row_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """``row_id``, the columns ``keep``, size, source_size, target, times, taken for each row: how often the mix takes it.

    A document's size is its number of words. ``taken`` is ``times`` (0 to ``most``) whole documents; a source misses its
    target by at most half of the document in which its budget ends. Null and empty texts have no words and take none; a
    null source is a source, the last; a source without words has the target 0; null ids are like empty ones. Keys hash id
    and text, so reruns agree; only rows alike in both tie, which of them is taken makes no difference. An empty table gives an empty result.
    Extra columns are not read but for ``keep``, whose names must differ from those of the result. Texts are read once.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(row_id).cast("string"), F.lit("")), F.lit(":"), body).cast("binary"))
    row = F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0")  # parts rows that are alike
    name = F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source)))
    rows = stored(docs.select(row_id, *keep, F.col(source).alias("_source"), name.alias("_s"), n_words(F.col(text)).alias("size"), F.concat(key, row).alias("_key")), "sizes")
    sources = stored(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")), "sources")
    plan = targets(sources, weights, most)
    times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("int")
    plan = plan.withColumn("_times", times).withColumn("rest", F.col("target") - F.col("_times") * F.col("source_size"))
    plan = stored(plan.withColumn("_s", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))), "plan")
    upto = thresholds(rows.select("_s", "_key", "size"), plan.where("rest > 0 and source_size > 0").select("_s", "rest"))
    plan = stored(plan.join(upto, "_s", "left").select("_s", "source_size", "target", "_times", "_upto"), "plan")
    times = F.col("_times") + F.when(F.col("_key") < F.col("_upto"), 1).otherwise(0)
    return rows.join(plan, "_s").select(row_id, *keep, "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def drawn(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix`` as often as it is taken."""
    return mixed.where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("_copy")
