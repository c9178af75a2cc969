"""Registered queries over a new listing against the index, over all rows of both."""

from pyspark.sql import functions as F

from medialake.operators import cells as K
from medialake.operators import reingest as R
from medialake.plans.map_queries import COPIES
from medialake.registry import query, table
from medialake.sources.views import SQL, oracle, view

c = F.col
# The index holds all documents; the listing too, but for a few that are gone, a few that lie elsewhere now, a few that have other content, and some new ones.
SQL["v_catalog"] = f"SELECT d.doc_id AS asset_id, concat(f.dir, '/', f.name) AS path, md5(d.text) AS content, d.lang, d.source FROM documents d JOIN ({SQL['v_album_files']}) f ON d.doc_id = f.doc_id"
SQL["v_arrivals"] = f"""SELECT asset_id, CASE WHEN asset_id % 33 = 0 THEN concat('/mnt/photo/new/', CAST(asset_id AS VARCHAR(9)), '.jpg') ELSE path END AS path, CASE WHEN asset_id % 29 = 0 THEN md5(concat(content, 'changed')) ELSE content END AS content, lang, source FROM ({SQL['v_catalog']}) a WHERE asset_id % 40 <> 1
        UNION ALL SELECT asset_id + 20000000, concat('/mnt/photo/new/b', CAST(asset_id AS VARCHAR(9)), '.jpg'), CASE WHEN asset_id % 50 = 0 THEN content ELSE md5(concat(content, 'new')) END, lang, source FROM ({SQL['v_catalog']}) a WHERE asset_id % 25 = 0"""


def _both(spark, sf_dir):
    return view(spark, sf_dir, "v_arrivals"), view(spark, sf_dir, "v_catalog")


@query("jn1_unseen_files", oracle("v_catalog v_arrivals", "SELECT asset_id, path FROM v_arrivals WHERE path NOT IN (SELECT path FROM v_catalog)"))
def jn1_unseen(spark, sf_dir):
    """What a run would take up: listed files that the index doesn't have."""
    listing, index = _both(spark, sf_dir)
    return R.unseen(listing, index).select("asset_id", "path")


@query("jn3_moved_by_content", oracle("v_catalog v_arrivals", """, o AS (SELECT content, min(asset_id) AS asset_id, min(path) AS old_path FROM v_catalog WHERE path NOT IN (SELECT path FROM v_arrivals) GROUP BY 1 HAVING count(*) = 1), n AS (SELECT content, min(path) AS new_path FROM v_arrivals WHERE path NOT IN (SELECT path FROM v_catalog) GROUP BY 1)
    SELECT asset_id, old_path, new_path FROM o JOIN n USING (content)"""))
def jn3_moved(spark, sf_dir):
    """Rows whose file lies elsewhere now."""
    return R.moved(*_both(spark, sf_dir))


# The user's own fields, some of which are empty; what a run finds has captions for some.
OLD = """SELECT path, CASE WHEN asset_id % 3 = 0 THEN concat('old ', lang) WHEN asset_id % 3 = 1 THEN '' END AS caption, CASE WHEN asset_id % 5 <> 0 THEN 'llm' END AS caption_source, asset_id % 9 = 0 AS caption_locked, CASE WHEN asset_id % 4 = 0 THEN array('note', source) WHEN asset_id % 4 = 1 THEN array() END AS annotations,
    CASE WHEN asset_id % 7 = 0 THEN array('p1', 'p2') END AS person_ids, CASE WHEN asset_id % 7 = 0 THEN array('One', 'Two') END AS person_names, CASE WHEN asset_id % 6 = 0 THEN source WHEN asset_id % 6 = 1 THEN '' END AS event_name, asset_id % 11 = 0 AS event_excluded, CASE WHEN asset_id % 13 = 0 THEN TIMESTAMP '2025-01-01 00:00:00' END AS trashed_at FROM v_catalog"""
NEW = """SELECT asset_id, path, CASE WHEN asset_id % 2 = 0 THEN concat('new ', source) END AS caption, CASE WHEN asset_id % 2 = 0 THEN 'run' END AS caption_source, false AS caption_locked, array() AS annotations, array('guess') AS person_ids, array('Guess') AS person_names, CASE WHEN asset_id % 8 = 0 THEN 'found' END AS event_name, false AS event_excluded, CAST(NULL AS TIMESTAMP) AS trashed_at FROM v_arrivals"""


def _lists(sql: str, duck: bool) -> str:
    """Arrays as either engine writes them."""
    out = sql.replace("ELSE array()", "ELSE array()")
    if not duck:
        return out.replace("THEN array()", "THEN cast(array() AS array<string>)").replace("array() AS", "cast(array() AS array<string>) AS")
    return out.replace("THEN array()", "THEN []::VARCHAR[]").replace("array() AS", "[]::VARCHAR[] AS").replace("array('note', source)", "['note', source]").replace("array('p1', 'p2')", "['p1', 'p2']").replace("array('One', 'Two')", "['One', 'Two']").replace("array('guess')", "['guess']").replace("array('Guess')", "['Guess']")


@query("jn2_all_own_fields", oracle("v_catalog v_arrivals", f""", o AS ({_lists(OLD, True)}), n AS ({_lists(NEW, True)}),
    p AS (SELECT path, nullif(caption, '') AS caption, caption_source, caption_locked, annotations, person_ids, person_names, nullif(event_name, '') AS event_name, event_excluded, trashed_at FROM o WHERE coalesce(caption, '') <> '' OR caption_source IS NOT NULL OR caption_locked OR len(coalesce(annotations, [])) > 0 OR person_ids IS NOT NULL OR coalesce(event_name, '') <> '' OR event_excluded OR trashed_at IS NOT NULL)
    SELECT n.asset_id, CASE WHEN p.path IS NULL THEN n.caption WHEN p.caption_locked THEN p.caption ELSE coalesce(n.caption, p.caption) END AS caption, CASE WHEN p.path IS NULL THEN n.caption_source WHEN p.caption_locked THEN coalesce(p.caption_source, 'manual') WHEN n.caption IS NOT NULL THEN n.caption_source ELSE coalesce(p.caption_source, n.caption_source) END AS caption_source,
        coalesce(p.caption_locked, false) AS caption_locked, CASE WHEN p.path IS NULL THEN n.annotations ELSE coalesce(p.annotations, []) END AS annotations, CASE WHEN p.path IS NULL THEN n.person_ids ELSE coalesce(p.person_ids, []) END AS person_ids, CASE WHEN p.path IS NULL THEN n.person_names ELSE coalesce(p.person_names, []) END AS person_names,
        coalesce(p.event_name, n.event_name) AS event_name, coalesce(p.event_excluded, false) AS event_excluded, p.trashed_at FROM n LEFT JOIN p ON n.path = p.path"""))
def jn2_fields(spark, sf_dir):
    """All rows of a new run with the user's nine fields."""
    for name in ("v_catalog", "v_arrivals"):
        view(spark, sf_dir, name).createOrReplaceTempView(name)
    own = spark.sql(_lists(OLD, False)).withColumn("trashed_at", c("trashed_at").cast("timestamp_ntz"))
    fresh = spark.sql(_lists(NEW, False)).withColumn("trashed_at", c("trashed_at").cast("timestamp_ntz"))
    return R.kept_fields(fresh, own, "path").drop("path")


SQL["v_state"] = f"""SELECT asset_id, caption, quality, event_name, kind, asset_id % 3 = 0 AS gps, CASE WHEN asset_id % 7 = 0 THEN 1 ELSE 0 END AS persons, asset_id % 4 AS faces, asset_id % 5 = 0 AS in_stack, asset_id % 10 = 0 AS is_head, CASE WHEN quality = 1 THEN 'exif' ELSE 'folder' END AS date_source,
        CASE WHEN asset_id % 6 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' WHEN asset_id % 6 < 5 THEN TIMESTAMP '2020-01-01 10:00:00' END AS taken_at FROM ({SQL["v_assets"]}) a"""


@query("pr32_ten_flags", oracle("v_state", """SELECT asset_id, f AS flags, bit_count(f & 15) AS tidiness FROM (SELECT asset_id, CAST(persons + 2 * (coalesce(caption, '') <> '')::INT + 4 * (date_source = 'exif')::INT + 8 * (event_name IS NOT NULL)::INT + 16 * gps::INT + 32 * coalesce(taken_at = date_trunc('day', taken_at), false)::INT
    + 64 * (faces > 0 AND persons = 0)::INT + 128 * in_stack::INT + 256 * (in_stack AND is_head)::INT + 512 * coalesce(kind = 'video', false)::INT AS INT) AS f FROM v_state) q"""))
def pr32_all(spark, sf_dir):
    """Each asset's state in ten bits, and how tidy it is."""
    persons = F.array_repeat(F.lit("p"), c("persons").cast("int"))
    flags = R.state_flags(persons, c("caption"), c("date_source"), c("event_name"), c("gps"), c("taken_at"), c("faces"), c("in_stack"), c("is_head"), c("kind"))
    return view(spark, sf_dir, "v_state").select("asset_id", flags.alias("flags")).withColumn("tidiness", R.tidiness(c("flags")))


@query(
    "vc10_heads_by_evidence",
    f"""
    WITH RECURSIVE n AS ({COPIES.format(near="list_prepend(CAST(embedding[1] AS DOUBLE) * 0.9, CAST(embedding[2:] AS DOUBLE[]))").replace("embedding FROM", "CAST(embedding AS DOUBLE[]) AS embedding FROM")}),
    u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS v FROM n),
    e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND list_dot_product(a.v, b.v) >= 0.95), r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a), m AS (SELECT x AS vec_id, min(y) AS head FROM r GROUP BY x)
    SELECT head, arg_max(vec_id, (vec_id % 4 = 1, vec_id % 3 = 0, vec_id < 2000000, vec_id % 10, -vec_id)) AS shown FROM m GROUP BY head
    """,
)
def vc10_evidence(spark, sf_dir):
    """What a stack of near copies shows: persons first, then a caption, the camera's own, and the number of faces."""
    table(spark, sf_dir, "embeddings").selectExpr("vec_id", "cast(embedding as array<double>) as embedding").createOrReplaceTempView("embeddings")
    members = K.stack_members(spark.sql(COPIES.format(near="transform(embedding, (x, i) -> CASE WHEN i = 0 THEN x * 0.9D ELSE x END)")), "embedding", "vec_id", 0.95)
    return R.stack_heads(members, [c("vec_id") % 4 == 1, c("vec_id") % 3 == 0, c("vec_id") < 2_000_000, c("vec_id") % 10])


@query("jn8_galleries", oracle("v_faces", "SELECT label, count(*) AS faces, count(DISTINCT photo_id) AS photos, arg_min(face_id, (CASE WHEN face_id % 8 = 0 THEN 1.0 ELSE score END, face_id)) AS cover FROM v_faces WHERE person_id IS NULL GROUP BY label"))
def jn8_gallery(spark, sf_dir):
    """The gallery of each group of unnamed faces."""
    faces = view(spark, sf_dir, "v_faces").where("person_id is null").withColumn("score", F.when(c("face_id") % 8 != 0, c("score")))
    return R.gallery(faces, "label")


@query("jn8_photos_and_faces_of_persons", oracle("v_faces", "SELECT person_id, list(DISTINCT photo_id ORDER BY photo_id) AS photos, list(face_id ORDER BY score, face_id) AS weakest_first FROM v_faces WHERE person_id LIKE 'p%' GROUP BY person_id"))
def jn8_persons(spark, sf_dir):
    """The photos a person is on, and its faces, weakest first."""
    faces = view(spark, sf_dir, "v_faces").where("person_id like 'p%'")
    return faces.groupBy("person_id").agg(F.array_sort(F.collect_set("photo_id")).alias("photos"), F.transform(F.array_sort(F.collect_list(F.struct("score", "face_id"))), lambda x: x["face_id"]).alias("weakest_first"))


@query("jn8_photo_of_each_face", oracle("v_faces", "SELECT face_id, photo_id, d.source AS folder FROM v_faces LEFT JOIN documents d ON d.doc_id = photo_id"))
def jn8_photo(spark, sf_dir):
    """The photo of each face, with its folder if it is indexed."""
    photos = table(spark, sf_dir, "documents").select(c("doc_id").alias("photo_id"), c("source").alias("folder"))
    return view(spark, sf_dir, "v_faces").join(photos, "photo_id", "left").select("face_id", "photo_id", "folder")
