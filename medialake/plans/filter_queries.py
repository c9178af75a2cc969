"""Registered queries over predicates and joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from medialake.functions import text as T
from medialake.operators import filters as P
from medialake.operators.paging import seeded_sample, thinned
from medialake.registry import query, table
from medialake.sources.views import oracle, view

TREE = {
    "op": "and",
    "children": [
        {"op": "or", "children": [{"field": "folder", "value": "src3"}, {"field": "lang", "value": "fr"}, {"field": "nonsense", "value": 1}]},
        {"op": "and", "children": [{"field": "toxic", "value": 0}]},
        {"op": "or", "children": []},
    ],
}
COLUMNS = {"folder": "folder", "lang": "lang", "toxic": "toxic", "person": "person_id"}


@query("fl1_query_tree", oracle("v_assets", "SELECT asset_id FROM v_assets WHERE (folder = 'src3' OR lang = 'fr') AND toxic = 0 AND trashed_at IS NULL"))
def fl1(spark, sf_dir):
    return view(spark, sf_dir, "v_assets").where(P.visible(P.tree(TREE, COLUMNS))).select("asset_id")


@query("fl3_fixed_search", oracle("v_assets", "SELECT asset_id, folder, kind FROM v_assets WHERE (person_id IN ('p1', 'p3') OR lang = 'de') AND coalesce(kind, 'photo') = 'photo' AND trashed_at IS NULL"))
def fl3(spark, sf_dir):
    any_of = P.tree({"op": "or", "children": [{"field": "person", "value": "p1"}, {"field": "person", "value": "p3"}, {"field": "lang", "value": "de"}]}, COLUMNS)
    return view(spark, sf_dir, "v_assets").where(P.visible(any_of & P.media_scope(["photo"]))).select("asset_id", "folder", "kind")


@query("fl4_media_scope", oracle("v_assets", "SELECT coalesce(kind, 'photo') AS kind, folder, count(*) AS n FROM v_assets WHERE folder IN ('src1', 'src2') GROUP BY 1, 2"))
def fl4(spark, sf_dir):
    return view(spark, sf_dir, "v_assets").where(F.col("folder").isin("src1", "src2") & P.media_scope(["photo", "video"])).groupBy(F.coalesce("kind", F.lit("photo")).alias("kind"), "folder").agg(F.count("*").alias("n"))


@query("fl5_visible", oracle("v_assets", "SELECT count(*) AS n FROM v_assets WHERE trashed_at IS NULL AND (lang = 'en' OR toxic = 1)"))
def fl5(spark, sf_dir):
    return view(spark, sf_dir, "v_assets").where(P.visible((F.col("lang") == "en") | (F.col("toxic") == 1))).agg(F.count("*").alias("n"))


@query(
    "fl6_token_resolution",
    """WITH t AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN left(c_name, 14) ELSE concat('zzz', CAST(c_custkey AS VARCHAR)) END AS token FROM customer),
    p AS (SELECT CAST(c_custkey AS VARCHAR) AS id, lower(c_name) AS name FROM customer),
    m AS (SELECT token, id, CASE WHEN lower(token) = name OR lower(token) = id THEN 1 WHEN starts_with(name, lower(token)) OR starts_with(id, lower(token)) OR starts_with(split_part(name, '#', 2), lower(token)) THEN 2 ELSE 3 END AS tier FROM t JOIN p ON contains(name, lower(token)) OR starts_with(id, lower(token))),
    b AS (SELECT token, min(tier) AS tier FROM m GROUP BY token)
    SELECT t.token, m.id, CAST(m.tier AS INT) AS tier FROM t LEFT JOIN b ON t.token = b.token LEFT JOIN m ON m.token = b.token AND m.tier = b.tier""",
)
def fl6(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    token = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.substring("c_name", 1, 14)).otherwise(F.concat(F.lit("zzz"), F.col("c_custkey").cast("string")))
    tokens = customers.select(token.alias("token")).distinct()
    return P.resolved(tokens, customers.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")))


@query("fl7_word_prefix", oracle("v_assets", "SELECT asset_id FROM v_assets WHERE regexp_matches(lower(caption), '(^|[^a-z0-9])than') AND regexp_matches(lower(caption), '(^|[^a-z0-9])ther')").replace("lower(caption)", "translate(lower(caption), 'äöüàáâãåçèéêëìíîïñòóôõùúûýÿ', 'aouaaaaaceeeeiiiinoooouuuyy')"))
def fl7(spark, sf_dir):
    return view(spark, sf_dir, "v_assets").where(T.word_prefix_match(F.col("caption"), ["than", "ther"])).select("asset_id")


@query("fl8_work_selection", oracle("v_assets", "SELECT asset_id FROM v_assets WHERE quality IS NULL AND length(caption) > 0 AND folder LIKE 'src1%' AND coalesce(kind, 'photo') <> 'video'"))
def fl8(spark, sf_dir):
    return view(spark, sf_dir, "v_assets").where(F.col("quality").isNull() & (F.length("caption") > 0) & F.col("folder").startswith("src1") & P.media_scope(["photo"])).select("asset_id")


@query("fl10_usable_faces", oracle("v_faces", "SELECT face_id FROM v_faces WHERE score >= 0.55 AND px >= 40"))
def fl10(spark, sf_dir):
    return view(spark, sf_dir, "v_faces").where((F.col("score").isNull() | (F.col("score") >= 0.55)) & (F.col("px").isNull() | (F.col("px") >= 40))).select("face_id")


@query("fl12_polygon", "SELECT vec_id FROM embeddings WHERE embedding[1] BETWEEN -0.2 AND 0.2 AND embedding[2] BETWEEN 0 AND 0.2 AND abs(embedding[1]) < 0.2 - embedding[2]")
def fl12(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return rows.where(P.in_polygon(F.col("x"), F.col("y"), [(-0.2, 0.0), (0.2, 0.0), (0.0, 0.2)])).select("vec_id")


@query("fl15_member_counts", oracle("v_assets", "SELECT folder, lang, count(*) AS n FROM v_assets WHERE trashed_at IS NULL GROUP BY GROUPING SETS ((folder), (lang))"))
def fl15(spark, sf_dir):
    view(spark, sf_dir, "v_assets").where(P.visible()).createOrReplaceTempView("shown")
    return spark.sql("SELECT folder, lang, count(*) AS n FROM shown GROUP BY folder, lang GROUPING SETS ((folder), (lang))")


@query("sc5_point_lookup", oracle("v_assets", "SELECT asset_id, folder FROM v_assets WHERE asset_id IN (SELECT item_id * 7 FROM benchmark)"))
def sc5(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 7).alias("asset_id"))
    return view(spark, sf_dir, "v_assets").join(wanted, "asset_id", "left_semi").select("asset_id", "folder")


NEW = "(SELECT * FROM documents WHERE doc_id % 2 = 0)"
OLD = "(SELECT * FROM documents WHERE doc_id % 3 = 0)"


@query("jn1_already_indexed", f"SELECT doc_id FROM {NEW} WHERE doc_id NOT IN (SELECT doc_id FROM {OLD})")
def jn1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where("doc_id % 2 = 0").join(docs.where("doc_id % 3 = 0"), "doc_id", "left_anti").select("doc_id")


@query("jn2_preserved_fields", f"SELECT n.doc_id, coalesce(nullif(CASE WHEN o.doc_id % 4 = 0 THEN '' WHEN o.doc_id IS NULL THEN NULL ELSE concat('old ', o.lang) END, ''), n.lang) AS lang, n.source FROM {NEW} n LEFT JOIN {OLD} o USING (doc_id)")
def jn2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("old "), F.col("lang"))).alias("kept"))
    return docs.where("doc_id % 2 = 0").join(old, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("kept", F.lit("")), "lang").alias("lang"), "source")


@query(
    "jn3_moved_files",
    """WITH old AS (SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 4 <> 1), listing AS (SELECT doc_id AS id FROM documents WHERE doc_id % 4 <> 2), fresh AS (SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 4 = 1),
    orphans AS (SELECT * FROM old WHERE id NOT IN (SELECT id FROM listing)), one AS (SELECT h, min(id) AS orphan FROM orphans GROUP BY h HAVING count(*) = 1), first AS (SELECT h, min(id) AS id FROM fresh GROUP BY h)
    SELECT id, orphan FROM first JOIN one USING (h)""",
)
def jn3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    orphans = docs.where("id % 4 <> 1").join(docs.where("id % 4 <> 2").select("id"), "id", "left_anti")
    one = orphans.groupBy("h").agg(F.min("id").alias("orphan"), F.count("*").alias("n")).where("n = 1")
    return docs.where("id % 4 = 1").groupBy("h").agg(F.min("id").alias("id")).join(one, "h").select("id", "orphan")


@query("jn8_faces_of_photos", oracle("v_faces", "SELECT photo_id, count(*) AS faces, count(DISTINCT person_id) FILTER (NOT starts_with(person_id, '_')) AS persons FROM v_faces WHERE photo_id IN (SELECT doc_id FROM documents) GROUP BY 1"))
def jn8(spark, sf_dir):
    faces = view(spark, sf_dir, "v_faces").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("photo_id")), "photo_id", "left_semi")
    return faces.groupBy("photo_id").agg(F.count("*").alias("faces"), F.countDistinct(F.when(~F.col("person_id").startswith("_"), F.col("person_id"))).alias("persons"))


@query("jn9_unproven_persons", oracle("v_assets v_faces", "SELECT asset_id, person_id FROM v_assets a WHERE person_id IS NOT NULL AND NOT starts_with(person_id, '_') AND NOT EXISTS (SELECT 1 FROM v_faces f WHERE f.photo_id = a.asset_id AND f.person_id = a.person_id)"))
def jn9(spark, sf_dir):
    on_photo = view(spark, sf_dir, "v_assets").where("person_id is not null and not startswith(person_id, '_')").select("asset_id", "person_id")
    return on_photo.join(view(spark, sf_dir, "v_faces").select(F.col("photo_id").alias("asset_id"), "person_id").distinct(), ["asset_id", "person_id"], "left_anti")


@query("jn11_rejected_pairs", "SELECT least(o_custkey, o_orderkey) AS a, greatest(o_custkey, o_orderkey) AS b FROM orders WHERE (least(o_custkey, o_orderkey), greatest(o_custkey, o_orderkey)) NOT IN (SELECT (least(l_orderkey, l_suppkey), greatest(l_orderkey, l_suppkey)) FROM lineitem)")
def jn11(spark, sf_dir):
    pair = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return pair(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").join(pair(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey"), ["a", "b"], "left_anti")


@query("jn14_artefact_audit", "WITH want AS (SELECT doc_id, md5(text) AS k FROM documents), have AS (SELECT md5(text) AS k, n_chars AS bytes FROM documents WHERE doc_id % 3 <> 0), got AS (SELECT k, count(*) AS n FROM have GROUP BY k) SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'present' ELSE 'duplicate' END AS state, count(*) AS n FROM want LEFT JOIN got USING (k) GROUP BY 1")
def jn14(spark, sf_dir):
    want = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k"))
    got = want.where("doc_id % 3 <> 0").groupBy("k").agg(F.count("*").alias("have"))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("have") == 1, "present").otherwise("duplicate")
    return want.join(got, "k", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("tk6_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(concat('7-', CAST(doc_id AS VARCHAR))) LIMIT 100")
def tk6(spark, sf_dir):
    return seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 7)


@query("tk5_thinned", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source FROM r WHERE n <= 20 OR floor((i + 1) * 20 / n) > floor(i * 20 / n)")
def tk5(spark, sf_dir):
    return thinned(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 20)


@query("tk4_unknown_faces", oracle("v_faces", "SELECT face_id FROM v_faces WHERE person_id IS NULL AND coalesce(frontality, 0.5) >= 0.3 ORDER BY round(coalesce(frontality, 0.5) * score * least(1.0, px / 80.0), 4) DESC, face_id LIMIT 60"))
def tk4(spark, sf_dir):
    quality = F.round(F.coalesce("frontality", F.lit(0.5)) * F.col("score") * F.least(F.lit(1.0), F.col("px") / 80), 4)
    rows = view(spark, sf_dir, "v_faces").where(F.col("person_id").isNull() & (F.coalesce("frontality", F.lit(0.5)) >= 0.3))
    return rows.orderBy(quality.desc(), "face_id").limit(60).select("face_id")


@query("tk7_weakest_faces", oracle("v_faces", "SELECT person_id, face_id FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY coalesce(score, 1.0), face_id) AS n FROM v_faces WHERE person_id IS NOT NULL) WHERE n <= 5"))
def tk7(spark, sf_dir):
    w = Window.partitionBy("person_id").orderBy(F.coalesce("score", F.lit(1.0)), "face_id")
    return view(spark, sf_dir, "v_faces").where("person_id is not null").withColumn("n", F.row_number().over(w)).where("n <= 5").select("person_id", "face_id")


@query("se2_selection_algebra", "(SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM documents WHERE source = 'src3') EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def se2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chosen = docs.where("lang = 'en'").select("doc_id").union(docs.where("source = 'src3'").select("doc_id")).distinct()
    return chosen.subtract(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))


@query("se1_union_by_name", "SELECT doc_id AS id, lang, CAST(NULL AS INT) AS label FROM documents UNION ALL SELECT vec_id, NULL, label FROM embeddings")
def se1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang").unionByName(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), allowMissingColumns=True)


@query("sc6_upsert", f"SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.n_chars ELSE n.n_chars END AS n_chars, coalesce(o.lang, n.lang) AS lang, n.doc_id IS NULL AS kept_only FROM {NEW} n FULL JOIN {OLD} o ON n.doc_id = o.doc_id")
def sc6(spark, sf_dir):
    from medialake.operators.curation import upserted

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return upserted(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 2 = 0"), "doc_id", preserve=["lang"])
