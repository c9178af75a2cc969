"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments of at most 16 bits; an inverted index maps each (segment, value) to the distinct
codes that have it. Queries probe all values within a radius of their own segment value, the radius growing by
one each round. When all segments have been probed up to radius r, every code within a distance of
segments * (r + 1) - 1 has been met; a query is finished when its k-th verified distance is at most that.

Equal codes are one entry of the index. Of the rows of a code only the k smallest ids can be among the k
nearest, and row_number() <= k keeps them before the shuffle, so that a code that a third of all rows share
costs each task k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.storage import stored

SEGMENT = 16


def sign_code(vector: Column, bits: int) -> Column:
    """Sign bits of a vector's first ``bits`` numbers, as an array of 16-bit segments; missing or null numbers count as 0."""
    segments = []
    for at in range(0, bits, SEGMENT):
        bit = [F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << (i - at))).otherwise(F.lit(0)) for i in range(at, min(bits, at + SEGMENT))]
        total = bit[0]
        for b in bit[1:]:
            total = total + b
        segments.append(total)
    return F.array(*segments)


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def top_k(codes: DataFrame, queries: DataFrame, k: int, bits: int) -> DataFrame:
    """The ``k`` rows of ``codes`` (id, code) nearest to each row of ``queries`` (id, code): ``query_id, rank, id, distance``.

    Exact; ties go to the smaller id; a query finds itself if it is among the codes. Rows with a null id or code
    are left out. Repeated rows are rows of their own. Fewer than ``k`` codes: all of them. Empty tables: empty
    result.
    """
    spark = codes.sparkSession
    segments = -(-bits // SEGMENT)
    rows = codes.where("id is not null and code is not null")
    heads = stored(rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    index = stored(heads.select(F.posexplode("code").alias("segment", "value"), "code", "ids"), "index")
    asked = queries.where("id is not null and code is not null").select("id", "code")
    # Equal query codes are searched once.
    open_ = stored(asked.select(F.col("code").alias("wanted")).distinct().withColumn("far", F.lit(bits)), "wanted")
    masks = spark.range(1 << min(bits, SEGMENT)).select(F.col("id").cast("int").alias("mask"), F.bit_count("id").alias("flips"))  # 65,536 rows at most
    done, met = None, None
    for radius in range(SEGMENT + 1):
        if not open_.limit(1).count():
            break
        probes = open_.select("wanted", F.posexplode("wanted").alias("segment", "own"), F.lit(radius).alias("flips"), "far").join(F.broadcast(masks), "flips").select("wanted", "far", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        # Codes farther than the k-th that is known already are no use.
        index_ = index.withColumnsRenamed({"segment": "segment_", "value": "value_"})
        useful = (F.col("segment") == F.col("segment_")) & (F.col("value") == F.col("value_")) & (distance(F.col("wanted"), F.col("code")) <= F.col("far"))
        new = probes.join(index_, useful).select("wanted", "code", "ids", distance(F.col("wanted"), F.col("code")).alias("distance"))
        met = stored((new if met is None else met.join(open_.select("wanted"), "wanted", "left_semi").union(new)).dropDuplicates(["wanted", "code"]).withColumn("n", F.row_number().over(Window.partitionBy("wanted").orderBy("distance", F.col("ids")[0]))).where(F.col("n") <= k).drop("n"), "met")
        best = met.select("wanted", F.explode("ids").alias("id"), "distance").withColumn("rank", F.row_number().over(Window.partitionBy("wanted").orderBy("distance", "id"))).where(F.col("rank") <= k)
        covered = segments * (radius + 1) - 1 if radius < SEGMENT else bits
        state = best.groupBy("wanted").agg(F.max("distance").alias("most"), F.count("*").alias("n"))
        state = stored(open_.join(state, "wanted", "left").select("wanted", F.when(F.col("n") == k, F.col("most")).otherwise(F.lit(bits)).alias("far"), F.coalesce(F.col("n") == k, F.lit(False)).alias("full")), "state")
        finished = F.col("full") & (F.col("far") <= covered) if radius < SEGMENT else F.lit(True)
        over = state.where(finished).select("wanted")
        ended = best.join(over, "wanted", "left_semi")
        done = ended if done is None else done.union(ended)
        open_ = state.where(~finished).select("wanted", "far")
    if done is None:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0).alias("distance")).limit(0)
    return asked.select(F.col("id").alias("query_id"), F.col("code").alias("wanted")).join(done, "wanted").select("query_id", "rank", "id", "distance")
