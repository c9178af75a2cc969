"""Registered queries over boxes, clusters, runs of sessions and listings."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions import geometry as G
from medialake.operators import events as E
from medialake.operators import vectors as V
from medialake.plans.event_queries import sessions_sql
from medialake.registry import query, table
from medialake.sources.views import oracle, view

c = F.col
BOX = "SELECT face_id, face_id % 50 AS x1, face_id % 40 AS y1, face_id % 50 + px AS x2, face_id % 40 + px AS y2, face_id % 8 + 1 AS o FROM v_faces"


def _boxes(spark, sf_dir):
    f = c("face_id")
    return view(spark, sf_dir, "v_faces").select("face_id", (f % 50).alias("x1"), (f % 40).alias("y1"), (f % 50 + c("px")).alias("x2"), (f % 40 + c("px")).alias("y2"), (f % 8 + 1).alias("o"))


@query(
    "pr40_upright_boxes",
    oracle("v_faces", f"""SELECT face_id, least(a, p) AS x1, least(b, q) AS y1, greatest(a, p) AS x2, greatest(b, q) AS y2 FROM (SELECT face_id,
    CASE o WHEN 1 THEN x1 WHEN 2 THEN 400 - x1 WHEN 3 THEN 400 - x1 WHEN 4 THEN x1 WHEN 5 THEN y1 WHEN 6 THEN 300 - y1 WHEN 7 THEN 300 - y1 ELSE y1 END AS a, CASE o WHEN 1 THEN y1 WHEN 2 THEN y1 WHEN 3 THEN 300 - y1 WHEN 4 THEN 300 - y1 WHEN 5 THEN x1 WHEN 6 THEN x1 ELSE 400 - x1 END AS b,
    CASE o WHEN 1 THEN x2 WHEN 2 THEN 400 - x2 WHEN 3 THEN 400 - x2 WHEN 4 THEN x2 WHEN 5 THEN y2 WHEN 6 THEN 300 - y2 WHEN 7 THEN 300 - y2 ELSE y2 END AS p, CASE o WHEN 1 THEN y2 WHEN 2 THEN y2 WHEN 3 THEN 300 - y2 WHEN 4 THEN 300 - y2 WHEN 5 THEN x2 WHEN 6 THEN x2 ELSE 400 - x2 END AS q FROM ({BOX}))"""),
)
def pr40(spark, sf_dir):
    new = G.upright([c("x1"), c("y1"), c("x2"), c("y2")], c("o"), F.lit(400), F.lit(300))
    return _boxes(spark, sf_dir).select("face_id", *(x.alias(n) for x, n in zip(new, ("x1", "y1", "x2", "y2"), strict=True)))


@query("ex6_box_overlap", oracle("v_faces", f"SELECT a.face_id, round(CAST(i AS DOUBLE) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i), 6) AS iou FROM (SELECT a.*, b.face_id AS other FROM ({BOX}) a JOIN ({BOX}) b ON a.face_id + 1 = b.face_id) a JOIN ({BOX}) b ON b.face_id = a.other, LATERAL (SELECT greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i)"))
def ex6(spark, sf_dir):
    a = _boxes(spark, sf_dir)
    b = a.select((c("face_id") - 1).alias("face_id"), *(c(x).alias(f"b{x}") for x in ("x1", "y1", "x2", "y2")))
    return a.join(b, "face_id").select("face_id", F.round(G.iou([c(x) for x in ("x1", "y1", "x2", "y2")], [c(f"b{x}") for x in ("x1", "y1", "x2", "y2")]), 6).alias("iou"))


@query("pr30_decimal_degrees", "SELECT o_orderkey, round((o_orderkey % 90 + o_custkey % 60 / 60.0 + o_orderkey % 60 / 3600.0) * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END, 6) AS lat FROM orders")
def pr30(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(G.decimal_degrees(c("o_orderkey") % 90, c("o_custkey") % 60, c("o_orderkey") % 60, F.when(c("o_orderstatus") == "F", "S").otherwise("N")), 6).alias("lat"))


@query("ag21_tag_dictionary", oracle("v_assets", "SELECT tag, count(*) AS n FROM (SELECT unnest([lang, folder]) AS tag FROM v_assets) GROUP BY tag HAVING count(*) >= 40"))
def ag21(spark, sf_dir):
    return view(spark, sf_dir, "v_assets").select(F.explode(F.array("lang", "folder")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).where("n >= 40")


@query("ag20_cluster_centres", "WITH p AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), m AS (SELECT label, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM p GROUP BY 1) SELECT label, n, round(any_value(cx), 5) AS cx, round(any_value(cy), 5) AS cy, round(avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))), 5) AS spread, arg_min(vec_id, pow(x - cx, 2) + pow(y - cy, 2)) AS cover FROM p JOIN m USING (label) GROUP BY label, n")
def ag20(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("label", "vec_id", c("embedding")[0].cast("double").alias("x"), c("embedding")[1].cast("double").alias("y"))
    m = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))
    away = F.pow(c("x") - c("cx"), F.lit(2)) + F.pow(c("y") - c("cy"), F.lit(2))
    return p.join(m, "label").groupBy("label", "n").agg(F.round(F.first("cx"), 5).alias("cx"), F.round(F.first("cy"), 5).alias("cy"), F.round(F.avg(F.sqrt(away)), 5).alias("spread"), F.min_by("vec_id", away).alias("cover"))


@query("tx3_fallback_terms", oracle("v_assets", "SELECT folder, tag, n FROM (SELECT folder, tag, count(*) AS n, row_number() OVER (PARTITION BY folder ORDER BY count(*) DESC, tag) AS k FROM (SELECT folder, unnest([lang, coalesce(kind, 'photo')]) AS tag FROM v_assets) GROUP BY 1, 2) WHERE k <= 3"))
def tx3(spark, sf_dir):
    tags = view(spark, sf_dir, "v_assets").select("folder", F.explode(F.array(c("lang"), F.coalesce("kind", F.lit("photo")))).alias("tag")).groupBy("folder", "tag").agg(F.count("*").alias("n"))
    return tags.withColumn("k", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("n"), "tag"))).where("k <= 3").drop("k")


@query("tx7_label_diff", "WITH o AS (SELECT label, concat('t', CAST(label AS VARCHAR)) AS title FROM embeddings WHERE label <> 2 GROUP BY 1), n AS (SELECT label, concat('t', CAST(label - label % 4 AS VARCHAR)) AS title FROM embeddings WHERE label <> 5 GROUP BY 1) SELECT coalesce(o.label, n.label) AS label, o.title IS NOT DISTINCT FROM n.title AS same FROM o FULL JOIN n ON o.label = n.label")
def tx7(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    old = labels.where("label <> 2").select("label", F.concat(F.lit("t"), c("label").cast("string")).alias("old"))
    new = labels.where("label <> 5").select("label", F.concat(F.lit("t"), (c("label") - c("label") % 4).cast("string")).alias("new"))
    return old.join(new, "label", "full").select("label", c("old").eqNullSafe(c("new")).alias("same"))


@query("vc12_zero_shot_tags", "WITH u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings), g AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM u) GROUP BY 1, 2), m AS (SELECT label AS tag, list(x ORDER BY i) AS m FROM g GROUP BY 1), s AS (SELECT vec_id, tag, list_cosine_similarity(v, m) AS s FROM u, m), p AS (SELECT vec_id, tag, exp(10 * s) / sum(exp(10 * s)) OVER (PARTITION BY vec_id) AS p FROM s) SELECT vec_id, tag, round(p, 5) AS p FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, tag) AS k FROM p) WHERE k <= 5 AND p >= 0.12")
def vc12(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("v", V.normed(c("embedding").cast("array<double>")))
    concepts = V.centroids(rows, "label", "v").withColumnRenamed("label", "tag")
    parts = -(-concepts.count() // 20_000) or 1  # so many concepts are broadcast at once
    met = [rows.select("vec_id", "v").join(F.broadcast(concepts.where(F.pmod(F.xxhash64("tag"), F.lit(parts)) == k)), F.lit(True)) for k in range(parts)]
    scored = reduce(DataFrame.union, met).select("vec_id", "tag", F.exp(10 * V.cosine(c("v"), c("centroid"))).alias("e"))
    share = scored.withColumn("p", c("e") / F.sum("e").over(Window.partitionBy("vec_id")))
    return share.withColumn("k", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("p"), "tag"))).where("k <= 5 and p >= 0.12").select("vec_id", "tag", F.round("p", 5).alias("p"))


@query("wn4_coalesced_sessions", sessions_sql(", r AS (SELECT *, CASE WHEN epoch_us(start_at) - epoch_us(max(end_at) OVER (PARTITION BY key ORDER BY start_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) <= 43200000000 THEN 0 ELSE 1 END AS fresh FROM k), g AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY start_at) AS run FROM r) SELECT key, min(start_at) AS start_at, max(end_at) AS end_at, CAST(sum(size) AS BIGINT) AS size, count(*) AS parts FROM g GROUP BY key, run").replace("g AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY start_at) AS run", "h AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY start_at) AS run").replace("AS parts FROM g", "AS parts FROM h"))
def wn4(spark, sf_dir):
    s = E.gap_sessions(view(spark, sf_dir, "v_stream"), "key", "taken_at", "asset_id")
    w = Window.partitionBy("key").orderBy("start_at")
    gap = E.seconds(c("start_at")) - E.seconds(F.max("end_at").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    runs = s.withColumn("fresh", F.when(gap <= 12 * 3600, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w))
    return runs.groupBy("key", "run").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.sum("size").alias("size"), F.count("*").alias("parts")).drop("run")


@query("wn13_shifted_clocks", oracle("v_clock", "SELECT asset_id, taken_at + INTERVAL '5' HOUR AS taken_at FROM v_clock WHERE model LIKE '1-%' AND album LIKE '3 %'"))
def wn13(spark, sf_dir):
    return view(spark, sf_dir, "v_clock").where("model like '1-%' and album like '3 %'").select("asset_id", F.expr("taken_at + INTERVAL '5' HOUR").alias("taken_at"))


@query("jn4_ghost_rows", "WITH l AS (SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 4 <> 0), u AS (SELECT n_chars, count(*) AS n, min(source) AS source FROM l GROUP BY 1) SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'live' WHEN u.n = 1 AND u.source = d.source THEN 'duplicate' WHEN u.n = 1 THEN 'migrate' ELSE 'gone' END AS verdict, count(*) AS n FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN u ON u.n_chars = d.n_chars GROUP BY 1")
def jn4(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    listing = d.where("doc_id % 4 <> 0")
    unique = listing.groupBy("n_chars").agg(F.count("*").alias("n"), F.min("source").alias("there"))
    met = d.join(listing.select("doc_id", F.lit(True).alias("live")), "doc_id", "left").join(unique, "n_chars", "left")
    verdict = F.when(c("live"), "live").when((c("n") == 1) & (c("there") == c("source")), "duplicate").when(c("n") == 1, "migrate").otherwise("gone")
    return met.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("jn10_map_against_table", oracle("v_assets", "SELECT e.vec_id, a.asset_id IS NULL AS deleted, a.trashed_at IS NOT NULL AS trashed FROM embeddings e LEFT JOIN v_assets a ON e.vec_id * 3 = a.asset_id WHERE a.asset_id IS NULL OR a.trashed_at IS NOT NULL"))
def jn10(spark, sf_dir):
    a = view(spark, sf_dir, "v_assets").select("asset_id", "trashed_at", F.lit(True).alias("live"))
    met = table(spark, sf_dir, "embeddings").select("vec_id", (c("vec_id") * 3).alias("asset_id")).join(a, "asset_id", "left")
    return met.where("live is null or trashed_at is not null").select("vec_id", c("live").isNull().alias("deleted"), c("trashed_at").isNotNull().alias("trashed"))


@query("cu11_prune_plan", oracle("v_paths v_faces", "SELECT CASE WHEN starts_with(path, '/mnt/photo/Fotos/') THEN 'covered' WHEN f.n IS NOT NULL THEN 'protected' ELSE 'prune' END AS verdict, count(*) AS n FROM v_paths LEFT JOIN (SELECT photo_id, count(*) AS n FROM v_faces WHERE person_id LIKE 'p%' GROUP BY 1) f ON f.photo_id = asset_id GROUP BY 1"))
def cu11(spark, sf_dir):
    named = view(spark, sf_dir, "v_faces").where("person_id like 'p%'").select(c("photo_id").alias("asset_id"), F.lit(True).alias("named")).distinct()
    verdict = F.when(c("path").startswith("/mnt/photo/Fotos/"), "covered").when(c("named"), "protected").otherwise("prune")
    return view(spark, sf_dir, "v_paths").join(named, "asset_id", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("vc14_kmeans")
def vc14(spark, sf_dir):
    """Clusters of vectors after a projection to their ten main axes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(c("embedding").cast("array<double>")).alias("raw"))
    flat = PCA(k=10, inputCol="raw", outputCol="features").fit(rows).transform(rows)
    return KMeans(k=12, seed=7, predictionCol="cluster").fit(flat).transform(flat).select("vec_id", "cluster")
