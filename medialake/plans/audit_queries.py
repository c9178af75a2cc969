"""Registered queries over audits: moved and lost files, artefacts, identities, foretold groups."""

from pyspark.sql import functions as F

from medialake.functions import paths as P
from medialake.operators import audits as A
from medialake.registry import query, table
from medialake.sources.views import SQL, faces, oracle, view

c = F.col
# Albums of seven. Every fifth has been renamed since it was indexed, every tenth stands there twice then, and of every fifteenth the new rows are in the index as well;
# every eleventh is gone, and so are single files.
SQL["v_album_files"] = "SELECT doc_id, CAST(floor(doc_id / 7) AS BIGINT) AS a, concat('/mnt/photo/Fotos/', source, '/album ', CAST(CAST(floor(doc_id / 7) AS BIGINT) AS VARCHAR(9))) AS dir, concat('IMG_', CAST(doc_id AS VARCHAR(9)), '.jpg') AS name FROM documents"
SQL["v_index"] = f"SELECT doc_id AS asset_id, concat(dir, '/', name) AS path FROM ({SQL['v_album_files']}) f UNION ALL SELECT doc_id + 10000000, concat(dir, ' neu/', name) FROM ({SQL['v_album_files']}) f WHERE a % 15 = 0"
SQL["v_listing"] = (
    f"SELECT concat(dir, CASE WHEN a % 5 = 0 THEN ' neu/' ELSE '/' END, name) AS path FROM ({SQL['v_album_files']}) f WHERE a % 11 <> 10 AND doc_id % 50 <> 1 UNION ALL SELECT concat(dir, ' zwei/', name) FROM ({SQL['v_album_files']}) f WHERE a % 10 = 0 AND doc_id % 3 <> 0"
)
GHOSTS = """, x AS (SELECT asset_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d, regexp_extract(path, '^(.*)/[^/]*/[^/]*$', 1) AS g, regexp_extract(path, '[^/]*$') AS n FROM v_index),
    s AS (SELECT x.*, path IN (SELECT path FROM v_listing) AS live, EXISTS (SELECT 1 FROM v_listing l WHERE starts_with(l.path, d || '/')) AS has_dir, EXISTS (SELECT 1 FROM v_listing l WHERE starts_with(l.path, g || '/')) AS has_above FROM x),
    h AS (SELECT regexp_extract(path, '^(.*)/[^/]*/[^/]*$', 1) AS g, regexp_extract(path, '[^/]*$') AS n, min(path) AS dest FROM v_listing GROUP BY 1, 2 HAVING count(*) = 1),
    v AS (SELECT asset_id, path, CASE WHEN live THEN 'live' WHEN has_dir OR NOT has_above OR dest IS NULL THEN 'gone' WHEN dest IN (SELECT path FROM v_index) THEN 'duplicate' ELSE 'migrate' END AS verdict, CASE WHEN NOT live AND NOT has_dir AND has_above THEN dest END AS dest FROM s LEFT JOIN h ON s.g = h.g AND s.n = h.n)"""


def _ghosts(spark, sf_dir):
    return A.ghosts(view(spark, sf_dir, "v_index"), view(spark, sf_dir, "v_listing"))


@query("jn4_moved_and_lost", oracle("v_index v_listing", "").rstrip() + GHOSTS + " SELECT asset_id, verdict, dest FROM v")
def jn4_paths(spark, sf_dir):
    """Each indexed row by what has become of its file, told by directories."""
    return _ghosts(spark, sf_dir).select("asset_id", "verdict", "dest")


@query("cu19_repair_plan", oracle("v_index v_listing", "").rstrip() + GHOSTS + """, f AS (SELECT CAST(floor(vec_id / 3) AS BIGINT) AS asset_id, count(*) AS faces FROM embeddings GROUP BY 1)
    SELECT v.asset_id, CASE WHEN verdict = 'migrate' THEN 'move' ELSE 'delete' END AS action, CASE WHEN verdict = 'migrate' THEN dest END AS dest, CASE WHEN verdict = 'migrate' THEN regexp_extract(dest, '([^/]*)/[^/]*$', 1) END AS folder, CASE WHEN verdict = 'migrate' THEN 0 ELSE coalesce(faces, 0) END AS faces FROM v LEFT JOIN f ON v.asset_id = f.asset_id WHERE verdict <> 'live'""")
def cu19_plan(spark, sf_dir):
    """What to do about rows whose file isn't where it was."""
    of = table(spark, sf_dir, "embeddings").select(F.floor(c("vec_id") / 3).alias("asset_id"))
    return A.repair_plan(_ghosts(spark, sf_dir), of).select("asset_id", "action", "dest", "folder", "faces")


# Artefacts lie under a key of the content or an older one of the path; some belong to faces, some to nothing.
SQL["v_expected"] = f"SELECT d.doc_id AS asset_id, sha256(d.text) AS by_content, md5(concat(f.dir, '/', f.name)) AS by_path, d.n_chars FROM documents d JOIN ({SQL['v_album_files']}) f ON d.doc_id = f.doc_id"
STOCK = """SELECT key, min(bytes) AS bytes FROM (SELECT by_content AS key, n_chars AS bytes FROM v_expected WHERE asset_id % 10 < 7 UNION ALL SELECT by_path, n_chars + 1 FROM v_expected WHERE asset_id % 10 IN (5, 6, 7)
    UNION ALL SELECT md5(concat('face', CAST(asset_id AS VARCHAR(9)))), 320 FROM v_expected WHERE asset_id % 17 = 0 UNION ALL SELECT md5(concat('gone', CAST(asset_id AS VARCHAR(9)))), 100 FROM v_expected WHERE asset_id % 19 = 0) q GROUP BY key"""
CLAIMS = f""", stock AS ({STOCK}), k AS (SELECT asset_id, CASE WHEN by_content IN (SELECT key FROM stock) THEN by_content WHEN by_path IN (SELECT key FROM stock) THEN by_path END AS held, by_content FROM v_expected),
    faces AS (SELECT md5(concat('face', CAST(asset_id AS VARCHAR(9)))) AS key FROM v_expected WHERE asset_id % 2 = 0),
    found AS (SELECT key, bytes, CASE WHEN key IN (SELECT held FROM k WHERE held IS NOT NULL) THEN 'good' WHEN key IN (SELECT by_content FROM v_expected UNION SELECT by_path FROM v_expected) THEN 'duplicate' WHEN key IN (FROM faces) THEN 'valid' ELSE 'orphan' END AS verdict FROM stock)"""


def _artefacts(spark, sf_dir):
    rows = view(spark, sf_dir, "v_assets").sparkSession.sql(SQL["v_expected"].replace("sha256(d.text)", "sha2(d.text, 256)"))
    rows.createOrReplaceTempView("v_expected")
    others = rows.where("asset_id % 2 = 0").select(F.md5(F.concat(F.lit("face"), c("asset_id").cast("string"))).alias("key"))
    return rows.select("asset_id", F.array("by_content", "by_path").alias("keys")), spark.sql(STOCK), others


@query("jn14_claims", oracle("v_expected", "").rstrip() + CLAIMS + " SELECT asset_id, CASE WHEN held IS NULL THEN 'missing' ELSE 'present' END AS verdict, coalesce(held, by_content) AS key FROM k")
def jn14_claims(spark, sf_dir):
    """Each asset's artefact, the first of its keys that is there."""
    expected, stock, _ = _artefacts(spark, sf_dir)
    return A.claims(expected, stock)


@query("jn14_artefacts", oracle("v_expected", "").rstrip() + CLAIMS + " SELECT key, bytes, verdict FROM found")
def jn14_artefacts(spark, sf_dir):
    """Each artefact by what claims it."""
    return A.artefacts(*_artefacts(spark, sf_dir))


@query("jn14_report", oracle("v_expected", "").rstrip() + CLAIMS + " SELECT verdict, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM found GROUP BY 1 UNION ALL SELECT 'missing', n, CAST(floor(n * (SELECT avg(bytes) FROM found WHERE verdict = 'good')) AS BIGINT) FROM (SELECT count(DISTINCT by_content) AS n FROM k WHERE held IS NULL) q")
def jn14_report(spark, sf_dir):
    """Numbers and bytes by verdict, and what the missing ones would take."""
    expected, stock, others = _artefacts(spark, sf_dir)
    return A.artefact_report(A.claims(expected, stock), A.artefacts(expected, stock, others))


def _uuid_sql(name: str) -> str:
    h = f"sha1(unhex('{P.DNS}') || encode({name}))"
    return f"concat({h}[1:8], '-', {h}[9:12], '-5', {h}[14:16], '-', translate({h}[17:17], '0123456789abcdef', '89ab89ab89ab89ab'), {h}[18:20], '-', {h}[21:32])"


@query("pr34_point_ids", oracle("v_paths", f"SELECT asset_id, sha256(path) AS uid, {_uuid_sql('sha256(path)')} AS point_id FROM v_paths"))
def pr34_points(spark, sf_dir):
    """Each path's identity and its point."""
    uid = F.sha2("path", 256)
    return view(spark, sf_dir, "v_paths").select("asset_id", uid.alias("uid"), P.point_id(uid).alias("point_id"))


@query("pr34_face_ids", oracle("v_faces", f"SELECT face_id, {_uuid_sql(chr(39) + 'photo ' + chr(39) + ' || photo_id || CASE WHEN face_id % 3 = 0 THEN ' + chr(39) + ':' + chr(39) + ' || (face_id % 7 + 0.5) ELSE ' + chr(39) * 2 + ' END || ' + chr(39) + ':' + chr(39) + ' || face_id % 3 || ' + chr(39) + ':[' + chr(39) + ' || px || ' + chr(39) + ', ' + chr(39) + ' || px + 1 || ' + chr(39) + ', ' + chr(39) + ' || 2 * px || ' + chr(39) + ', ' + chr(39) + ' || 3 * px || ' + chr(39) + ']' + chr(39))} AS point_id FROM v_faces"))
def pr34_faces(spark, sf_dir):
    """The point of each face; every third one lies on a video."""
    frame = F.when(c("face_id") % 3 == 0, c("face_id") % 7 + F.lit(0.5))
    box = F.array("px", c("px") + 1, c("px") * 2, c("px") * 3)
    return faces(spark, sf_dir).select("face_id", P.face_point_id(F.concat(F.lit("photo "), c("photo_id").cast("string")), c("face_id") % 3, box, frame).alias("point_id"))


@query("wn13_guarded_offsets", oracle("v_clock", "SELECT asset_id, taken_at AS old_at, taken_at + INTERVAL '5' HOUR + INTERVAL '30' SECOND AS new_at FROM v_clock WHERE model LIKE '1-%' AND album LIKE '% 1996'"))
def wn13_guarded(spark, sf_dir):
    """Groups of one album and camera moved by their offset, each with the number of rows that is expected of it."""
    rows = view(spark, sf_dir, "v_clock")
    groups = rows.where("model like '1-%' and album like '% 1996'").groupBy("album", "model").agg(F.count("taken_at").alias("expected")).withColumn("offset_s", F.lit(5 * 3600 + 30))
    return A.shifted(rows, groups, ["album", "model"], "taken_at", "asset_id")
