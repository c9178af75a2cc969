"""Registered queries over listings, spaces, people, dates as text, folds and pages."""

from pyspark.sql import functions as F

from medialake.functions import dates as D
from medialake.functions import places as PL
from medialake.functions import text as T
from medialake.operators import listing as L
from medialake.operators import search_form as S
from medialake.registry import query, table
from medialake.sources.views import SQL, oracle, view

c = F.col
SQL["v_scanned"] = f"SELECT asset_id, CASE WHEN asset_id % 12 = 0 THEN replace(path, '/mnt/photo/Fotos/', '/mnt/photo/Fotos/.thumbs/') WHEN asset_id % 12 = 5 THEN concat(path, '.txt') ELSE path END AS path, CASE WHEN asset_id % 9 = 0 THEN 12 ELSE size END AS size FROM ({SQL['v_paths']}) p"


@query("sc1_roots_and_excludes", oracle("v_scanned", r"SELECT path, max(size) AS size, max(CASE WHEN starts_with(path, '/mnt/photo/Fotos/src1/') THEN '/mnt/photo/Fotos/src1' WHEN starts_with(path, '/mnt/photo/Fotos/') THEN '/mnt/photo/Fotos' ELSE '/mnt/photo/Handys/src2' END) AS root FROM v_scanned WHERE (starts_with(path, '/mnt/photo/Fotos/') OR starts_with(path, '/mnt/photo/Handys/src2/')) AND NOT starts_with(path, '/mnt/photo/Fotos/src3/') AND NOT contains(path, '/.') AND NOT ends_with(path, '.txt') AND size >= 32 GROUP BY path"))
def sc1_roots(spark, sf_dir):
    """What a scan of three roots takes, two of which overlap, without an excluded directory."""
    return L.media_listing(view(spark, sf_dir, "v_scanned"), ["/mnt/photo/Fotos/src1", "/mnt/photo/Fotos/", "/mnt/photo/Handys/src2"], ["/mnt/photo/Fotos/src3"])


@query("pr4_space_index", oracle("v_paths", ", s AS (SELECT asset_id, CASE WHEN asset_id % 14 = 0 THEN NULL WHEN asset_id % 14 = 3 THEN '/mnt/photo/loose.jpg' ELSE path END AS path FROM v_paths), n AS (SELECT asset_id, CASE WHEN path LIKE '/mnt/photo/%/%' THEN split_part(path, '/', 4) ELSE '?' END AS space FROM s), f AS (SELECT space, row_number() OVER (ORDER BY min(asset_id)) - 1 AS place FROM n GROUP BY space) SELECT asset_id, CAST(place AS INT) AS place, space FROM n JOIN f USING (space)"))
def pr4_index(spark, sf_dir):
    """Each asset's space by its place in the order in which spaces occur."""
    path = F.when(c("asset_id") % 14 == 0, None).when(c("asset_id") % 14 == 3, "/mnt/photo/loose.jpg").otherwise(c("path"))
    names, places = L.indexed_spaces(view(spark, sf_dir, "v_paths").withColumn("path", path), "/mnt/photo", "asset_id")
    return places.join(names, "place").select("asset_id", "place", "space")


PINS = "SELECT DISTINCT person_id, CASE WHEN label % 3 = 0 THEN 'favorite' WHEN label % 3 = 1 THEN 'muted' END AS pin, concat('Al ', CAST(label AS VARCHAR(9))) AS alias FROM v_faces WHERE person_id LIKE 'p%' AND label < 8"


@query("ag2_people_list", oracle("v_faces", f", m AS ({PINS}), p AS (SELECT person_id, arg_min(CASE WHEN face_id % 2 = 0 THEN concat('Name ', 9 - label) END, face_id) FILTER (face_id % 2 = 0 OR true) AS name, count(*) AS faces, min(face_id) AS cover, arg_min(face_id % 2, face_id) AS odd FROM v_faces WHERE person_id LIKE 'p%' GROUP BY 1), q AS (SELECT p.person_id, CASE WHEN odd = 1 THEN p.person_id ELSE name END AS name, faces, cover, CASE WHEN alias IS NULL THEN [] ELSE [alias] END AS aliases, CASE pin WHEN 'favorite' THEN 0 WHEN 'muted' THEN 2 ELSE 1 END AS rank FROM p LEFT JOIN m ON m.person_id = p.person_id) SELECT *, row_number() OVER (ORDER BY rank, lower(name), person_id) AS place FROM q"))
def ag2_list(spark, sf_dir):
    """The people, favourites first and muted ones last."""
    faces = view(spark, sf_dir, "v_faces")
    faces.createOrReplaceTempView("v_faces")
    meta = spark.sql(PINS).select("person_id", "pin", F.array("alias").alias("aliases"))
    named = faces.withColumn("person_name", F.when(c("face_id") % 2 == 0, F.concat(F.lit("Name "), (9 - c("label")).cast("string"))))
    from pyspark.sql import Window

    order = Window.orderBy("rank", F.lower("name"), "person_id")  # a row a person
    return L.people_list(named, meta).withColumn("place", F.row_number().over(order).cast("long")).select("person_id", "name", "faces", "cover", "aliases", "rank", "place")


SQL["v_told_dates"] = f"SELECT asset_id, CASE asset_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '2014' WHEN 2 THEN '2014-13-01' ELSE concat(CAST(2010 + asset_id % 9 AS VARCHAR(9)), '-', lpad(CAST(1 + asset_id % 12 AS VARCHAR(9)), 2, '0'), '-', lpad(CAST(1 + asset_id % 28 AS VARCHAR(9)), 2, '0')) END AS date, CASE WHEN asset_id % 5 < 4 THEN CAST(asset_id % 5 AS DOUBLE) * 0.3 END AS confidence FROM ({SQL['v_paths']}) p"


@query("pr18_sure_dates", oracle("v_told_dates", f", d AS (SELECT *, try_cast(substr(date, 6, 2) AS INT) AS m, try_cast(substr(date, 9, 2) AS INT) AS day, coalesce(confidence, 1) AS sure FROM v_told_dates), n AS (SELECT *, {list(T.MONTHS)}[m] AS name FROM d) SELECT asset_id, CASE WHEN date IS NULL THEN NULL WHEN length(date) < 10 OR m NOT BETWEEN 1 AND 12 THEN left(date, 4) WHEN sure >= 0.9 THEN concat(day, '. ', name, ' ', left(date, 4)) WHEN sure >= 0.6 THEN concat(name, ' ', left(date, 4)) ELSE concat('um ', name, ' ', left(date, 4)) END AS text, CASE WHEN m IN (12, 1, 2) THEN 'Winter' WHEN m IN (3, 4, 5) THEN 'Frühling' WHEN m IN (6, 7, 8) THEN 'Sommer' WHEN m IN (9, 10, 11) THEN 'Herbst' END AS season FROM n"))
def pr18_dates(spark, sf_dir):
    """Dates as sure as they are, and their seasons."""
    return view(spark, sf_dir, "v_told_dates").select("asset_id", L.date_text(c("date"), c("confidence")).alias("text"), L.season_text(c("date")).alias("season"))


@query("pr14_any_bounds", oracle("v_told_dates", "SELECT asset_id, CASE WHEN length(date) = 4 THEN make_timestamp(CAST(date AS INT), 1, 1, 0, 0, 0) ELSE CAST(try_cast(date AS DATE) AS TIMESTAMP) END AS low, CASE WHEN length(date) = 4 THEN make_timestamp(CAST(date AS INT), 12, 31, 23, 59, 59) ELSE CAST(try_cast(date AS DATE) AS TIMESTAMP) + INTERVAL '23 hours 59 minutes 59 seconds' END AS high FROM v_told_dates"))
def pr14_any(spark, sf_dir):
    """The first and last second of years and days; what is neither has none."""
    bound = lambda end, name: D.date_bounds(c("date"), end).cast("timestamp_ntz").alias(name)
    return view(spark, sf_dir, "v_told_dates").select("asset_id", bound(False, "low"), bound(True, "high"))


@query("pr26_half_even_quality", oracle("v_faces", "SELECT face_id, round_even(coalesce(frontality, 0.5) * score * least(1.0, px / 80.0), 4) AS quality FROM v_faces"))
def pr26_half_even(spark, sf_dir):
    """Face quality, rounded half to even."""
    quality = F.coalesce("frontality", F.lit(0.5)) * c("score") * F.least(F.lit(1.0), c("px") / 80)
    return view(spark, sf_dir, "v_faces").select("face_id", F.bround(quality, 4).alias("quality"))


FOLDED = "translate(lower(t), 'äöü', '{0}')"


@query("ex5_four_folds", """WITH x AS (SELECT doc_id, concat(left(text, 80), ' Straße-Ärger_ÜBER é') AS t FROM documents), s AS (SELECT *, replace(replace(replace(replace(lower(t), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS spelled FROM x)
    SELECT doc_id, md5(translate(replace(lower(t), 'ß', 'ss'), 'äöü', 'aou')) AS for_search, md5(translate(trim(spelled), 'àáâãåçèéêëìíîïñòóôõùúûýÿ', 'aaaaaceeeeiiiinoooouuuyy')) AS for_places, md5(regexp_replace(trim(spelled), '[-_ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS for_tags, md5(spelled) AS for_pruning FROM s""")
def ex5(spark, sf_dir):
    """The same texts folded for search, places, tags and the pruning of tags, which differ."""
    text = F.concat(F.substring("text", 1, 80), F.lit(" Straße-Ärger_ÜBER é"))
    folds = {"for_search": S.match_fold(text), "for_places": PL.place_fold(text), "for_tags": T.tag_folded(text), "for_pruning": T.spelled_out(text)}
    return table(spark, sf_dir, "documents").select("doc_id", *(F.md5(x).alias(name) for name, x in folds.items()))


@query("ud6_frame_rows", oracle("v_paths", "SELECT asset_id, CAST(frame AS INT) AS frame, at_s FROM (SELECT asset_id, unnest(o) AS at_s, generate_subscripts(o, 1) - 1 AS frame FROM (SELECT asset_id, list_sort(list_distinct(CASE WHEN d < 3 THEN [round(d / 2, 3)] ELSE [round(d * 0.1, 3), round(d * 0.5, 3), round(d * 0.9, 3)] END)) AS o FROM (SELECT asset_id, size / 1000.0 AS d FROM v_paths WHERE path LIKE '%.mp4') q) q) q"))
def ud6(spark, sf_dir):
    """One row for each frame that is asked of a video."""
    d = c("size") / 1000.0
    offsets = F.when(d < 3, F.array(F.round(d / 2, 3))).otherwise(F.array(F.round(d * 0.1, 3), F.round(d * 0.5, 3), F.round(d * 0.9, 3)))
    return view(spark, sf_dir, "v_paths").where("path like '%.mp4'").select("asset_id", F.posexplode(F.sort_array(F.array_distinct(offsets))).alias("frame", "at_s"))


@query("tk1_clamped_page", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, 500 AS returned, true AS has_more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500 OFFSET 100")
def tk1(spark, sf_dir):
    """A page whose limit is above what is allowed."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return L.page_of(rows, [F.desc("o_totalprice"), "o_orderkey"], 100, 9999)
