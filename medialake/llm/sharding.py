"""Shards of near equal bytes by sampled splitters, in SQL expressions only.

Records are ordered by the hash of their text, then by id, so that equal texts are neighbours. A sample of keys,
drawn with weights by size, gives the quantile boundaries of ranges; ranges that turn out overfull are subdivided,
also inside a group of equal texts. Sums over ranges give every record its place in the whole order, and the
order is cut into shards of equal bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.storage import stored


def shard(docs: DataFrame, shards: int = 8, ranges: int | None = None, sample: int | None = None, rows_each: int = 1_000_000) -> DataFrame:
    """Puts each row into a shard: ``doc_id, size, text_crc32, shard, slot``.

    Size: UTF-8 bytes of the text (null: none) plus 1. The bytes of two shards differ by at most two records;
    ``slot`` is gapless from 0 in each shard. There are ``ranges`` ranges (default: 256, or so many that a mean one has
    ``rows_each`` records); ``sample`` is the expected number of keys drawn (default: 50,000, or 200 a range). An overfull range
    holds more than twice the mean; it is subdivided by the hash of the id. A range at most twice the mean is
    the largest thing that one task sorts.

    Null texts count as empty; null ids are ordinary ids, but of many records without one each has a hash of its own; repeated rows are rows of their own. Empty table: empty
    result. Other columns are ignored.
    """
    body = F.coalesce("text", F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("key"), F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id")).alias("salt")), "records")
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    side = int((ranges or max(256, n // rows_each)) ** 0.5 + 0.999)
    ranges = side * side
    sample = sample or max(50_000, 200 * ranges)
    # A record is drawn with a chance in proportion to its size, decided by a hash of the record.
    chance = F.least(F.lit(1.0), F.col("size") * (sample / total))
    drawn = rows.where(F.pmod(F.xxhash64("salt", "key", F.lit("draw")), F.lit(1 << 53)) / F.lit(float(1 << 53)) < chance)
    cuts = drawn.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts")).first()["cuts"] or []
    cuts += [2**63 - 1] * (ranges - len(cuts))
    coarse, fine = F.array(*map(F.lit, cuts[side - 1 :: side])), F.array(*map(F.lit, cuts))
    part = F.size(F.filter(coarse, lambda x: x < F.col("key")))
    inner = F.size(F.filter(F.slice(fine, F.least(part, F.lit(side - 1)) * side + 1, side), lambda x: x < F.col("key")))
    ranged = rows.withColumn("range", F.least(part, F.lit(side - 1)) * side + inner)

    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    pieces = sums.select("range", F.when(F.col("bytes") > 2 * total / ranges, F.ceil(F.col("bytes") * ranges / F.lit(total))).otherwise(1).cast("int").alias("pieces"))
    pieces = {r["range"]: r["pieces"] for r in pieces.where("pieces > 1").collect()}  # fewer than ``ranges`` rows
    split = F.coalesce(F.create_map(*(F.lit(x) for kv in pieces.items() for x in kv))[F.col("range")], F.lit(1)) if pieces else F.lit(1)
    divided = ranged.withColumn("piece", F.pmod(F.col("salt"), split).cast("int"))

    unit = ["range", "piece"]  # fewer than three times ``ranges`` units
    units = divided.groupBy(*unit).agg(F.sum("size").alias("unit_bytes"), F.count("*").alias("unit_rows"))
    before = Window.orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)
    units = units.select(*unit, F.coalesce(F.sum("unit_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("unit_rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy(*unit).orderBy("key", "doc_id", "size")
    placed = divided.withColumn("sum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(inside))
    placed = placed.join(units, unit).withColumn("place", F.col("rows_before") + F.col("n") - 1)
    middle = F.col("bytes_before") + F.col("sum") - (F.col("size") + 1) / 2
    placed = stored(placed.withColumn("shard", F.least(F.floor(middle * shards / F.lit(total)), F.lit(shards - 1)).cast("int")).select("doc_id", "size", "text_crc32", "shard", "place"), "placed")
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}  # one row for each shard
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.create_map(*(F.lit(x) for kv in firsts.items() for x in kv))[F.col("shard")]).alias("slot"))
