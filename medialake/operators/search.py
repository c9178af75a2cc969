"""Exact searches from many stated queries: queries in blocks of bounded size, the best of each block and task before any shuffle."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.storage import shared_dir, stored

CELLS = 4_000_000  # scores that a task holds at once
BATCH = 4_000  # rows that are scored at once


class Best:
    """The ``k`` best rows of each of ``n`` queries so far: ties to 9 places go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, 0), -np.inf)
        self.id = np.zeros((n, 0), np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate([self.score, score], 1)
        held = np.concatenate([self.id, np.broadcast_to(ids, (len(score), len(ids)))], 1)
        if score.shape[1] > self.k:
            order = np.lexsort((held, -np.round(score, 9)), axis=1)[:, : self.k]
            score, held = np.take_along_axis(score, order, 1), np.take_along_axis(held, order, 1)
        self.score, self.id = score, held

    def rows(self, ids: np.ndarray):
        for at in range(0, len(ids), 200):
            query, place = np.nonzero(np.isfinite(self.score[at : at + 200]))
            if len(query):
                yield pd.DataFrame({"query_id": ids[at + query], "id": self.id[at + query, place], "score": self.score[at + query, place]})


def _best(shared, k: int, least: float | None):
    def run(batches):
        ids, wanted = shared.value
        best = Best(len(ids), k)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                own = part["id"].to_numpy()
                score = wanted @ np.stack(part["v"].to_numpy()).T
                score[ids[:, None] == own[None, :]] = -np.inf
                if least is not None:
                    score[score < least] = -np.inf
                best.add(score, own)
        yield from best.rows(ids)

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def gathered(spark, parts, schema: str) -> DataFrame:
    """The rows of many data frames, each written to one table in turn, so that no plan grows with their number."""
    path = f"{shared_dir(spark).rstrip('/')}/gathered-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def nearest(queries: DataFrame, rows: DataFrame, k: int, least: float | None = None, block: int = 2000) -> DataFrame:
    """The ``k`` rows (id, v) nearest to each query (id, v) by dot product of unit vectors: ``query_id, id, score, rank``.

    A query is never its own answer; ties to 9 places go to the smaller id. Null ids or vectors are left out. Only a
    ``block`` of queries (fewer if ``k`` is large) is collected and broadcast at a time; a task keeps the ``k`` best of each query over all its
    rows and sends on no more.
    """
    spark = rows.sparkSession
    asked = queries.where("id is not null and v is not null").select("id", "v").distinct()
    size = max(1, min(block, CELLS // (k + BATCH)))
    n = -(-asked.count() // size) or 1
    schema = "query_id long, id long, score double"

    def parts():
        for part in range(n):
            mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == part) if n > 1 else asked
            mine = mine.orderBy("id").collect()  # about ``size`` rows
            if mine:
                shared = spark.sparkContext.broadcast((np.array([r["id"] for r in mine], np.int64), np.array([r["v"] for r in mine], float)))
                yield rows.where("id is not null and v is not null").select("id", "v").mapInPandas(_best(shared, k, least), schema)

    found = list(parts()) if n == 1 else [gathered(spark, parts(), schema)]
    return ranked(found[0] if found else spark.createDataFrame([], schema), k)


def counted(queries: DataFrame, rows: DataFrame, least: float, block: int = 2000) -> DataFrame:
    """(query_id, n): how many ``rows`` (id, v; unit vectors) other than itself have a dot product of at least ``least`` with each query (id, v); tasks send one number a query.

    Null ids or vectors are left out; a query without such rows has 0.
    """
    spark = rows.sparkSession
    asked = queries.where("id is not null and v is not null").select("id", "v").distinct()
    n = -(-asked.count() // block) or 1

    def parts():
        for part in range(n):
            mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == part).orderBy("id").collect()  # about ``block`` rows
            if mine:
                shared = spark.sparkContext.broadcast((np.array([r["id"] for r in mine], np.int64), np.array([r["v"] for r in mine], float)))
                yield rows.where("id is not null and v is not null").select("id", "v").mapInPandas(_above(shared, least), "query_id long, n long")

    found = gathered(spark, parts(), "query_id long, n long") if asked.limit(1).count() else spark.createDataFrame([], "query_id long, n long")
    return found.groupBy("query_id").agg(F.sum("n").alias("n"))


def _above(shared, least: float):
    def run(batches):
        ids, wanted = shared.value
        n = np.zeros(len(ids), np.int64)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                near = wanted @ np.stack(part["v"].to_numpy()).T >= least
                n += near.sum(1) - (near & (ids[:, None] == part["id"].to_numpy()[None, :])).sum(1)
        yield pd.DataFrame({"query_id": ids, "n": n})

    return run


def thinned(ids: DataFrame, of: list[str], order: str, most: int = 64) -> DataFrame:
    """At most ``most`` rows of each group, evenly over its order: of n rows those at i * n / most, rounded down."""
    whole = Window.partitionBy(*of)
    at, n = F.col("_at"), F.col("_of")
    placed = ids.withColumn("_at", F.row_number().over(whole.orderBy(order)) - 1).withColumn("_of", F.count("*").over(whole))
    step = F.ceil(at * most / n)
    return placed.where((n <= most) | ((step < most) & (F.floor(step * n / most) == at))).drop("_at", "_of")


def like_examples(examples: DataFrame, rows: DataFrame, k: int, strategy: str = "average", least: float | None = None, most: int = 64, block: int = 256) -> DataFrame:
    """The ``k`` rows (id, v; unit vectors) most like each request's examples: ``query_id, id, score, rank``.

    examples: request (long), id, positive (boolean), place. Of each side at most ``most`` examples count, thinned evenly by place. ``average``: cosine with the mean of
    the positive ones less the mean of the negative ones; ``best``: the greatest dot product with a positive one less the greatest with a
    negative one. One positive example alone asks for its neighbours. No example of a request, thinned out or not, is among its
    answers. Requests without a positive example that has a vector, and null ids or vectors, are left out. A ``block`` of requests is
    broadcast at a time, at most ``2 * most`` vectors each; which requests a row is an example of comes to it by a join.
    """
    spark = rows.sparkSession
    given = examples.where("request is not null and id is not null").select("request", "id", "positive", "place").distinct()
    kept = thinned(given, ["request", "positive"], "place", most).join(rows.where("v is not null").select("id", "v"), "id")
    kept = stored(kept.select("request", "positive", "id", "v"), "examples")
    requests = stored(kept.where("positive").select("request").distinct(), "requests")
    n = -(-requests.count() // block) or 1
    schema = "query_id long, id long, score double"
    own = given.groupBy("id").agg(F.collect_set("request").alias("own"))
    marked = rows.where("id is not null and v is not null").select("id", "v").join(own, "id", "left")

    def parts():
        for part in range(n):
            mine = requests.where(F.pmod(F.xxhash64("request"), F.lit(n)) == part)
            asked = sorted(r["request"] for r in mine.collect())  # about ``block``
            if asked:
                sides = {(q, side): [] for q in asked for side in (True, False)}
                for r in kept.join(mine, "request").select("request", "positive", "v").collect():
                    sides[r["request"], r["positive"]].append(r["v"])
                shared = spark.sparkContext.broadcast((np.array(asked, np.int64), {side: np.array(v, float) for side, v in sides.items()}))
                yield marked.mapInPandas(_like(shared, k, strategy, least), schema)

    return ranked(gathered(spark, parts(), schema) if requests.limit(1).count() else spark.createDataFrame([], schema), k)


def _like(shared, k: int, strategy: str, least: float | None):
    def run(batches):
        requests, sides = shared.value
        best, at_request = Best(len(requests), k), {int(q): i for i, q in enumerate(requests)}
        if strategy == "average":
            wanted = []
            for q in requests:
                plus, minus = sides[q, True], sides[q, False]
                v = plus.mean(0) - (minus.mean(0) if len(minus) else 0)
                size = np.sqrt(v @ v)
                wanted.append(v / size if size > 0 else v)
            wanted = np.array(wanted)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                v = np.stack(part["v"].to_numpy()).T
                if strategy == "average":
                    score = wanted @ v
                else:
                    score = np.array([(sides[q, True] @ v).max(0) - ((sides[q, False] @ v).max(0) if len(sides[q, False]) else 0) for q in requests])
                if least is not None:
                    score[score < least] = -np.inf
                for row, own in enumerate(part["own"]):
                    if own is not None:
                        score[[at_request[q] for q in own if q in at_request], row] = -np.inf
                best.add(score, part["id"].to_numpy())
        yield from best.rows(requests)

    return run


def nearest_join(left: DataFrame, right: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """The ``k`` rows of ``right`` nearest to every row of ``left`` (id, v; unit vectors): ``query_id, id, score, rank``.

    Both sides are dealt in blocks and each pair of blocks is one task, so neither side passes through the driver or
    one task as a whole; at most ``k`` rows of each pair of blocks and query are shuffled. Ties to 9 places go to the smaller id.
    """
    sides = [side.where("id is not null and v is not null").select("id", "v") for side in (left, right)]
    n, m = (max(1, -(-side.count() // block)) for side in sides)
    dealt = lambda side, mine, parts, other, others: side.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    a, b = dealt(sides[0], "i", n, "j", m), dealt(sides[1], "j", m, "i", n).toDF("other", "w", "to", "from")

    def met(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        own, out = y["other"].to_numpy(), []
        for query, row in zip(x["id"], np.stack(x["v"].to_list()) @ np.stack(y["w"].to_list()).T, strict=True):
            order = np.lexsort((own, -np.round(row, 9)))[:k]
            out.append(pd.DataFrame({"query_id": query, "id": own[order], "score": row[order]}))
        return pd.concat(out)

    found = a.groupBy("i", "j").cogroup(b.groupBy("from", "to")).applyInPandas(met, "query_id long, id long, score double")
    return ranked(found, k)
