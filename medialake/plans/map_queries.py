"""Registered queries over the map: islands of points, and more like sets of examples."""

from pyspark.sql import functions as F

from medialake.operators import cells as K
from medialake.operators import islands as I
from medialake.operators import search as S
from medialake.operators import vectors as V
from medialake.registry import query, table

PLANE = "SELECT vec_id, round(list_sum(list_filter(embedding, lambda v, i: i % 2 = 1)), 6) AS x, round(list_sum(list_filter(embedding, lambda v, i: i % 2 = 0)), 6) AS y FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"


def plane(spark, sf_dir):
    """Each vector's place in a plane: the sums of its numbers at odd and at even places."""
    total = lambda odd: F.aggregate(F.filter(F.col("embedding").cast("array<double>"), lambda v, i: i % 2 == odd), F.lit(0.0), lambda s, v: s + v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total(0), 6).alias("x"), F.round(total(1), 6).alias("y"))


@query(
    "vc15_density_islands",
    f"""
    WITH RECURSIVE p AS ({PLANE}),
    d AS (SELECT a.vec_id AS a, b.vec_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.1 * 0.1),
    c AS (SELECT a AS id FROM d GROUP BY a HAVING count(*) >= 5),
    e AS (SELECT a, b FROM d WHERE a IN (FROM c) AND b IN (FROM c)),
    r AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    k AS (SELECT a AS id, min(b) AS island FROM r GROUP BY a),
    n AS (SELECT a AS id, arg_min(b, (d, b)) AS nearest FROM d WHERE a NOT IN (FROM c) AND b IN (FROM c) GROUP BY a),
    m AS (SELECT id, true AS core, island FROM k UNION ALL SELECT n.id, false, island FROM n JOIN k ON nearest = k.id),
    s AS (SELECT island FROM m GROUP BY island HAVING count(*) >= 60)
    SELECT vec_id, coalesce(core, false) AS core, s.island FROM p LEFT JOIN m ON vec_id = m.id LEFT JOIN s USING (island)
    """,
)
def vc15(spark, sf_dir):
    return I.islands(plane(spark, sf_dir), "vec_id", "x", "y", radius=0.1, least=5, smallest=60)


# Requests: for each label, every tenth id of that label as examples, and ids in between of the next label as counter-examples.
EXAMPLES = """WITH u AS (SELECT vec_id AS id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
    g AS (SELECT CASE WHEN id % 10 = 0 THEN label ELSE (label + 9) % 10 END AS request, id, id % 10 = 0 AS positive, v FROM u WHERE id % 5 = 0),
    t AS (SELECT *, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY request, positive) AS n FROM g WINDOW w AS (PARTITION BY request, positive ORDER BY id)),
    k AS (SELECT request, positive, v FROM t WHERE n <= 64 OR nth IN (SELECT CAST(floor(i * t.n / 64) AS BIGINT) FROM range(64) r(i)))"""
AVERAGE = """, c AS (SELECT request, positive, i, avg(v[i]) AS m FROM k, range(1, 65) r(i) GROUP BY ALL),
    d AS (SELECT request, i, sum(CASE WHEN positive THEN m ELSE -m END) AS m FROM c GROUP BY ALL), q AS (SELECT request, list(m ORDER BY i) AS q FROM d WHERE request IN (SELECT request FROM k WHERE positive) GROUP BY request),
    s AS (SELECT request, id, list_dot_product(q, v) / sqrt(list_dot_product(q, q)) AS s FROM q, u WHERE (request, id) NOT IN (SELECT request, id FROM g))"""
BEST = """, p AS (SELECT request, u.id, max(list_dot_product(k.v, u.v)) AS s FROM k, u WHERE positive GROUP BY ALL), m AS (SELECT request, u.id, max(list_dot_product(k.v, u.v)) AS s FROM k, u WHERE NOT positive GROUP BY ALL),
    s AS (SELECT request, id, p.s - coalesce(m.s, 0) AS s FROM p LEFT JOIN m USING (request, id) WHERE (request, id) NOT IN (SELECT request, id FROM g))"""
ANSWERS = ", r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(s, 9) DESC, id) AS rank FROM s) SELECT request, id AS vec_id, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM r WHERE rank <= 20"


def _like_examples(spark, sf_dir, strategy):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", V.normed(F.col("embedding").cast("array<double>")).alias("v"))
    request = F.when(F.col("id") % 10 == 0, F.col("label")).otherwise((F.col("label") + 9) % 10).cast("long")
    examples = rows.where("id % 5 = 0").select(request.alias("request"), "id", (F.col("id") % 10 == 0).alias("positive"), F.col("id").alias("place"))
    return S.like_examples(examples, rows, 20, strategy).select(F.col("query_id").alias("request"), F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query("vc3_example_sets_average", EXAMPLES + AVERAGE + ANSWERS)
def vc3_average(spark, sf_dir):
    """More like each label's examples and less like its counter-examples: one mean vector for each request."""
    return _like_examples(spark, sf_dir, "average")


@query("vc3_example_sets_best", EXAMPLES + BEST + ANSWERS)
def vc3_best(spark, sf_dir):
    """The same requests, each row against every example."""
    return _like_examples(spark, sf_dir, "best")


# Near copies: every fifth vector again with its first number a tenth smaller, every tenth a third time as it is.
COPIES = "SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, {near} FROM embeddings WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id + 2000000, embedding FROM embeddings WHERE vec_id % 10 = 0"


@query(
    "vc9_near_copies",
    f"""
    WITH RECURSIVE c AS ({COPIES.format(near="list_prepend(embedding[1] * 0.9, embedding[2:])").replace("embedding FROM", "CAST(embedding AS DOUBLE[]) AS embedding FROM").replace("embedding[1] * 0.9", "CAST(embedding[1] AS DOUBLE) * 0.9").replace("embedding[2:]", "CAST(embedding[2:] AS DOUBLE[])")}),
    u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS v FROM c),
    e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND list_dot_product(a.v, b.v) >= 0.95),
    r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
    SELECT x AS vec_id, min(y) AS head FROM r GROUP BY x
    """,
)
def vc9_copies(spark, sf_dir):
    """Stacks of near copies, each row with the head of its stack; no pairs."""
    table(spark, sf_dir, "embeddings").selectExpr("vec_id", "cast(embedding as array<double>) as embedding").createOrReplaceTempView("embeddings")
    near = "transform(embedding, (x, i) -> CASE WHEN i = 0 THEN x * 0.9D ELSE x END)"
    return K.stack_members(spark.sql(COPIES.format(near=near)), "embedding", "vec_id", 0.95)


UNITS = "WITH u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"


def _units(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", V.normed(F.col("embedding").cast("array<double>")).alias("v"))


@query("vc1_filtered_top_k", UNITS + ", s AS (SELECT q.vec_id AS query_id, u.vec_id, list_dot_product(q.v, u.v) AS s FROM u q, u WHERE q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id AND u.label <> 3 AND list_dot_product(q.v, u.v) >= 0.05), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM r WHERE rank <= 20")
def vc1_many(spark, sf_dir):
    """The 20 nearest rows of other labels than one, with a least score, of every row whose id is divisible by 100."""
    rows = _units(spark, sf_dir)
    found = S.nearest(rows.where("id % 100 = 0").select("id", "v"), rows.where("label <> 3").select("id", "v"), 20, least=0.05)
    return found.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query("vc5_lookalikes_of_many", UNITS + ", s AS (SELECT q.vec_id AS query_id, count(*) FILTER (q.vec_id <> u.vec_id AND list_dot_product(q.v, u.v) >= 0.2) AS n FROM u q, u WHERE q.vec_id % 100 = 0 GROUP BY 1) SELECT query_id, least(n, 5) AS shown, n > 5 AS capped, n FROM s")
def vc5_many(spark, sf_dir):
    """How many rows look like each row whose id is divisible by 100, and how many of them are shown."""
    rows = _units(spark, sf_dir).select("id", "v")
    n = S.counted(rows.where("id % 100 = 0"), rows, 0.2)
    return n.select("query_id", F.least("n", F.lit(5).cast("long")).alias("shown"), (F.col("n") > 5).alias("capped"), "n")
