"""Registered queries over vectors."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from medialake.operators import vectors as V
from medialake.registry import query, table
from medialake.sources.views import faces, oracle, view

COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _first(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@query("vc1_top_k", f"SELECT e.vec_id, round({COS.format(a='e.embedding', b='q.embedding')}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label <> 3 ORDER BY {COS.format(a='e.embedding', b='q.embedding')} DESC, e.vec_id LIMIT 20")
def vc1(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("label <> 3").withColumn("v", F.col("embedding").cast("array<double>"))
    return V.top_k(rows, _first(spark, sf_dir), "v", "vec_id", 20).select("vec_id", F.round("score", 6).alias("score"))


@query("vc5_lookalikes", f"SELECT count(*) AS n, count(*) > 5 AS capped FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id % 3 <> 0 AND {COS.format(a='e.embedding', b='q.embedding')} >= 0.2")
def vc5(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 3 <> 0").withColumn("v", F.col("embedding").cast("array<double>"))
    query_vector = F.array(*map(F.lit, _first(spark, sf_dir)))
    return rows.where(V.cosine(F.col("v"), query_vector) >= 0.2).agg(F.count("*").alias("n")).withColumn("capped", F.col("n") > 5)


CENTRES = """c AS (SELECT person_id, i, avg(x / norm) AS x FROM (SELECT f.person_id, unnest(range(1, 65)) AS i, unnest(CAST(e.embedding AS DOUBLE[])) AS x, sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS norm FROM v_faces f JOIN embeddings e ON f.face_id = e.vec_id WHERE f.person_id LIKE 'p%') GROUP BY 1, 2),
    m AS (SELECT person_id, list(x ORDER BY i) AS v FROM c GROUP BY 1), u AS (SELECT person_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM m)"""


@query("ag17_person_centroids", oracle("v_faces", "").rstrip() + ", " + CENTRES + " SELECT person_id, list_transform(v, lambda x: round(x, 6)) AS centroid FROM u")
def ag17(spark, sf_dir):
    named = faces(spark, sf_dir).where("person_id like 'p%'")
    return V.centroids(named, "person_id", "vector").select("person_id", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query("vc6_known_candidates", oracle("v_faces", "").rstrip() + ", " + CENTRES + """, s AS (SELECT f.face_id, u.person_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), u.v) AS score FROM v_faces f JOIN embeddings e ON f.face_id = e.vec_id, u WHERE f.person_id IS NULL),
    b AS (SELECT face_id, person_id, score, row_number() OVER (PARTITION BY face_id ORDER BY score DESC) AS n FROM s WHERE score >= 0.15)
    SELECT person_id, count(*) AS n, round(max(score), 5) AS best, round(min(score), 5) AS worst FROM b WHERE n = 1 GROUP BY 1 HAVING count(*) >= 3""")
def vc6(spark, sf_dir):
    all_faces = faces(spark, sf_dir)
    centres = V.centroids(all_faces.where("person_id like 'p%'"), "person_id", "vector")
    best = V.nearest_centroid(all_faces.where("person_id is null"), centres, "vector", "face_id", "person_id", 0.15)
    return best.groupBy("person_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 5).alias("best"), F.round(F.min("score"), 5).alias("worst")).where("n >= 3")


PAIRS = f"p AS (SELECT a.vec_id AS a, b.vec_id AS b, {COS.format(a='a.embedding', b='b.embedding')} AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS.format(a='a.embedding', b='b.embedding')} >= 0.35)"


@query("vc9_similar_pairs", f"WITH {PAIRS} SELECT a, b, round(score, 5) AS score FROM p")
def vc9_pairs(spark, sf_dir):
    return V.similar_pairs(table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")), "v", "vec_id", 0.35).select("a", "b", F.round("score", 5).alias("score"))


@query("vc9_stacks", f"WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a) SELECT x AS vec_id, min(y) AS stack FROM r GROUP BY x")
def vc9(spark, sf_dir):
    return V.stacks(table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")), "v", "vec_id", 0.35)


@query("vc8_average_linkage")
def vc8(spark, sf_dir):
    return V.average_linkage(table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")), "v", "vec_id", 0.35)


@query("vc10_stack_heads", f"WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a), s AS (SELECT x AS vec_id, min(y) AS stack FROM r GROUP BY x) SELECT stack, vec_id AS head FROM (SELECT s.*, row_number() OVER (PARTITION BY stack ORDER BY label DESC, s.vec_id) AS n FROM s JOIN embeddings USING (vec_id)) WHERE n = 1")
def vc10(spark, sf_dir):
    member = vc9(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return member.groupBy("stack").agg(F.max_by("vec_id", F.struct("label", -F.col("vec_id"))).alias("head"))


@query("vc11_medoids", "WITH u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings), c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM u) GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY 1) SELECT label, vec_id AS medoid FROM (SELECT u.label, vec_id, row_number() OVER (PARTITION BY u.label ORDER BY list_dot_product(v, c) DESC, vec_id) AS n FROM u JOIN m ON u.label = m.label) WHERE n = 1")
def vc11(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("v", V.normed(F.col("embedding").cast("array<double>")))
    centres = V.centroids(rows, "label", "v")
    w = Window.partitionBy("label").orderBy(F.desc(V.dot(F.col("v"), F.col("centroid"))), "vec_id")
    return rows.join(centres, "label").withColumn("n", F.row_number().over(w)).where("n = 1").select("label", F.col("vec_id").alias("medoid"))


@query("ex7_norms", "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def ex7(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(V.dot(v, v)), 6).alias("norm"))


@query("ex9_unit_square", "WITH m AS (SELECT min(embedding[1]) AS x0, min(embedding[2]) AS y0, greatest(max(embedding[1]) - min(embedding[1]), max(embedding[2]) - min(embedding[2])) AS s, max(embedding[1]) - min(embedding[1]) AS w, max(embedding[2]) - min(embedding[2]) AS h FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)) SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) - x0) / s + (1 - w / s) / 2, 5) AS x, round((CAST(embedding[2] AS DOUBLE) - y0) / s + (1 - h / s) / 2, 5) AS y FROM embeddings, m")
def ex9(spark, sf_dir):
    xy = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("px"), F.col("embedding")[1].cast("double").alias("py"))
    box = xy.agg(F.min("px").alias("x0"), F.min("py").alias("y0"), (F.max("px") - F.min("px")).alias("w"), (F.max("py") - F.min("py")).alias("h")).withColumn("s", F.greatest("w", "h"))
    fit = lambda p, o, side: F.round((F.col(p) - F.col(o)) / F.col("s") + (1 - F.col(side) / F.col("s")) / 2, 5)
    return xy.crossJoin(F.broadcast(box)).select("vec_id", fit("px", "x0", "w").alias("x"), fit("py", "y0", "h").alias("y"))  # the box is one row
