"""Registered queries over dates, places, persons' boxes and grounded texts."""

from pyspark.sql import functions as F

from medialake.functions import dates as D
from medialake.functions import paths as P
from medialake.plans.column_queries import ALBUM, NAME
from medialake.registry import query, table
from medialake.sources.views import SQL, oracle, view

c = F.col
ZONE = "+01:00"
SQL["v_dated"] = f"""
        SELECT asset_id, path, size, CASE WHEN asset_id % 6 = 0 THEN concat('2019-', lpad(CAST(1 + asset_id % 12 AS VARCHAR(9)), 2, '0'), '-10T0', CAST(asset_id % 10 AS VARCHAR(9)), ':30:00Z') END AS exif,
            CASE WHEN asset_id % 10 = 1 THEN '2016' WHEN asset_id % 10 = 3 THEN '2016-07-04' WHEN asset_id % 10 = 7 THEN 'on 2014_02_03' END AS hint,
            CASE WHEN asset_id % 4 = 1 THEN 'folder_json' WHEN asset_id % 20 = 3 THEN 'folder' END AS hint_source,
            concat('2021-0', CAST(1 + asset_id % 9 AS VARCHAR(9)), '-15T23:1', CAST(asset_id % 10 AS VARCHAR(9)), ':00', CASE WHEN asset_id % 3 = 0 THEN '' ELSE 'Z' END) AS mtime,
            CASE WHEN asset_id % 2 = 0 THEN concat('2021-0', CAST(1 + asset_id % 7 AS VARCHAR(9)), '-11T22:50:00Z') END AS ctime,
            CASE WHEN asset_id % 5 = 0 THEN ' Berlin ' WHEN asset_id % 5 = 1 THEN '' END AS place, CASE WHEN asset_id % 7 = 0 THEN 'Rome' END AS place_hint, asset_id % 3 = 0 AS has_gps
        FROM ({SQL["v_paths"]}) p"""
LOCAL = "CASE WHEN {0} LIKE '%Z' THEN CAST(CAST(replace(replace({0}, 'T', ' '), 'Z', '') AS TIMESTAMP) + INTERVAL 1 HOUR AS DATE) ELSE CAST(left({0}, 10) AS DATE) END"
DAY = "((?:19|20)[0-9][0-9])[-_]([0-9][0-9])[-_]([0-9][0-9])"
SPELLED = "replace(regexp_extract({0}, '" + DAY + "'), '_', '-')"
DECIDED = f""", n AS (SELECT *, {NAME} AS name, {ALBUM} AS album, {LOCAL.format("mtime")} AS m_day, CASE WHEN ctime IS NOT NULL THEN {LOCAL.format("ctime")} END AS c_day FROM v_dated),
d AS (SELECT *, CASE WHEN exif IS NOT NULL THEN [left(exif, 10), 'exif', '1.0']
    WHEN hint IS NOT NULL THEN [CASE WHEN length(hint) = 4 THEN hint || '-01-01' ELSE {SPELLED.format("hint")} END, coalesce(hint_source, 'folder'), CASE WHEN hint_source = 'folder_json' THEN '0.9' ELSE '0.75' END]
    WHEN regexp_matches(name, '{DAY}') THEN [{SPELLED.format("name")}, 'filename', '0.7']
    WHEN regexp_matches(album, '\\b(19|20)[0-9][0-9]\\b') THEN [regexp_extract(album, '\\b((19|20)[0-9][0-9])\\b', 1) || '-01-01', 'folder', '0.8']
    ELSE [CAST(least(m_day, c_day) AS VARCHAR), 'file_time', '0.3'] END AS x FROM n)"""


def _decided(spark, sf_dir):
    rows = view(spark, sf_dir, "v_dated")
    day = D.decided(c("exif"), c("hint"), c("hint_source"), P.file_name(c("path")), P.album(c("path")), [c("mtime"), c("ctime")], ZONE)
    return rows.withColumn("x", day).select("*", "x.day", "x.source", "x.confidence")


@query("pr10_final_date", oracle("v_dated", "").rstrip() + DECIDED + " SELECT asset_id, x[1] AS day, x[2] AS source, CAST(x[3] AS DOUBLE) AS confidence FROM d")
def pr10(spark, sf_dir):
    return _decided(spark, sf_dir).select("asset_id", "day", "source", "confidence")


TAKEN = "CASE WHEN left(exif, 10) = x[1] THEN CAST(replace(replace(exif, 'T', ' '), 'Z', '') AS TIMESTAMP) WHEN m_day = CAST(x[1] AS DATE) THEN CAST(replace(replace(mtime, 'T', ' '), 'Z', '') AS TIMESTAMP) ELSE CAST(x[1] AS TIMESTAMP) END"


@query("pr11_taken_at", oracle("v_dated", "").rstrip() + DECIDED + f" SELECT asset_id, {TAKEN} AS taken_at FROM d")
def pr11(spark, sf_dir):
    return _decided(spark, sf_dir).select("asset_id", D.taken_at(c("day"), c("exif"), c("mtime"), ZONE).alias("taken_at"))


@query("pr33_day_number", oracle("v_dated", "").rstrip() + DECIDED + f" SELECT asset_id, CASE WHEN asset_id % 9 = 0 THEN -1 ELSE CAST(date_diff('day', DATE '1970-01-01', CAST({TAKEN} AS DATE)) AS INT) END AS day_number FROM d")
def pr33(spark, sf_dir):
    stamp = F.when(c("asset_id") % 9 != 0, D.taken_at(c("day"), c("exif"), c("mtime"), ZONE))
    return _decided(spark, sf_dir).select("asset_id", D.day_number(stamp).alias("day_number"))


@query("pr13_utc_and_local_day", oracle("v_dated", f"SELECT asset_id, CASE WHEN mtime LIKE '%Z' THEN CAST(replace(replace(mtime, 'T', ' '), 'Z', '') AS TIMESTAMP) END AS utc, {LOCAL.format('mtime')} AS local_day FROM v_dated"))
def pr13(spark, sf_dir):
    return view(spark, sf_dir, "v_dated").select("asset_id", D.utc(c("mtime")).alias("utc"), D.local_day(c("mtime"), ZONE).alias("local_day"))


@query("pr16_location", oracle("v_dated", "SELECT asset_id, coalesce(nullif(place, ''), place_hint) AS location, CASE WHEN place <> '' THEN 'given' WHEN place_hint IS NOT NULL THEN 'folder' WHEN has_gps THEN 'exif_gps' END AS source, lower(trim(coalesce(nullif(place, ''), place_hint))) AS location_key FROM v_dated"))
def pr16(spark, sf_dir):
    given = F.nullif("place", F.lit(""))
    location = F.coalesce(given, "place_hint")
    source = F.when(given.isNotNull(), "given").when(c("place_hint").isNotNull(), "folder").when(c("has_gps"), "exif_gps")
    return view(spark, sf_dir, "v_dated").select("asset_id", location.alias("location"), source.alias("source"), F.lower(F.trim(location)).alias("location_key"))


@query("sc12_file_times", oracle("v_dated", f"SELECT asset_id, size, CAST(replace(replace(mtime, 'T', ' '), 'Z', '') AS TIMESTAMP) AS modified, coalesce(least(m, k), m) AS oldest FROM (SELECT *, CAST(replace(replace(mtime, 'T', ' '), 'Z', '') AS TIMESTAMP) AS m, CAST(replace(replace(ctime, 'T', ' '), 'Z', '') AS TIMESTAMP) AS k FROM v_dated) q"))
def sc12(spark, sf_dir):
    at = lambda x: F.try_to_timestamp(F.regexp_replace(x, "Z$", ""))
    return view(spark, sf_dir, "v_dated").select("asset_id", "size", at("mtime").alias("modified"), F.least(at("mtime"), at("ctime")).alias("oldest"))


@query("pr7_longest_root", oracle("v_paths", "SELECT asset_id, root FROM (SELECT asset_id, root, row_number() OVER (PARTITION BY asset_id ORDER BY length(root) DESC) AS n FROM v_paths LEFT JOIN (SELECT DISTINCT concat('/mnt/photo/Fotos/', source) AS root FROM documents UNION SELECT '/mnt/photo') r ON starts_with(path, concat(root, '/'))) q WHERE n = 1"))
def pr7(spark, sf_dir):
    """Roots come from the table: a path's own directories are looked up among them, the longest first."""
    roots = table(spark, sf_dir, "documents").select(F.concat(F.lit("/mnt/photo/Fotos/"), "source").alias("root")).union(spark.sql("SELECT '/mnt/photo'")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rows = view(spark, sf_dir, "v_paths")
    best = rows.select("asset_id", F.explode(above).alias("root")).join(roots, "root").groupBy("asset_id").agg(F.max_by("root", F.length("root")).alias("root"))
    return rows.select("asset_id").join(best, "asset_id", "left")


@query("pr38_suggested_name", oracle("v_paths", f"SELECT asset_id, CASE WHEN g THEN '' WHEN regexp_matches(album, '(^|[^0-9])(19|20)[0-9][0-9]([^0-9]|$)') THEN album ELSE concat(album, ' ', CAST(2000 + asset_id % 20 AS VARCHAR)) END AS name FROM (SELECT asset_id, {ALBUM} AS album, regexp_matches({ALBUM}, '(?i)^(src[0-9]|camera|dcim|download|new folder|whatsapp images|sent|[0-9]{{3}}[A-Z_]+)$') AS g FROM v_paths) q"))
def pr38(spark, sf_dir):
    album, year = P.album(c("path")), (2000 + c("asset_id") % 20).cast("string")
    name = F.when(P.generic(album), "").when(album.rlike(r"(^|\D)(19|20)\d\d(\D|$)"), album).otherwise(F.concat_ws(" ", album, year))
    return view(spark, sf_dir, "v_paths").select("asset_id", name.alias("name"))


@query("pr17_keyword_tags", oracle("v_assets", "SELECT asset_id, list_sort(list_distinct(list_filter([lang, CASE WHEN contains(t, 'und') THEN 'joined' END, CASE WHEN contains(t, 'tion') THEN 'action' END, CASE WHEN contains(t, 'sch') THEN 'en' END], lambda x: x IS NOT NULL))) AS tags FROM (SELECT asset_id, lang, lower(caption) AS t FROM v_assets) q"))
def pr17(spark, sf_dir):
    from medialake.functions.text import with_keyword_tags

    needles = {"und": "joined", "tion": "action", "sch": "en"}
    return view(spark, sf_dir, "v_assets").select("asset_id", F.sort_array(with_keyword_tags(F.array_compact(F.array("lang")), c("caption"), needles)).alias("tags"))


MARKS = "SELECT face_id, px, CAST(face_id % 37 AS DOUBLE) AS lx, CAST(face_id % 11 AS DOUBLE) AS ly, CAST(face_id % 37 + face_id % 53 AS DOUBLE) AS rx, CAST(face_id % 7 AS DOUBLE) AS ry, CAST(face_id % 61 AS DOUBLE) AS nx, person_id, face_id % 400 AS x1, face_id % 1100 AS y1 FROM v_faces"


@query("pr25_frontality", oracle("v_faces", f"SELECT face_id, CASE WHEN e < 0.001 THEN 0.0 ELSE round(least(1.0, e / px / 0.4) * greatest(0.0, 1 - abs(nx - (lx + rx) / 2) / e / 0.75), 3) END AS frontality FROM (SELECT *, sqrt((rx - lx) ** 2 + (ry - ly) ** 2) AS e FROM ({MARKS}) m) q"))
def pr25(spark, sf_dir):
    from medialake.functions.geometry import frontality

    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    f = c("face_id")
    marks = F.array(point(f % 37, f % 11), point(f % 37 + f % 53, f % 7), point(f % 61, f * 0), point(f * 0, f * 0), point(f * 0, f * 0))
    box = F.array(F.lit(0.0), F.lit(0.0), c("px").cast("double"), c("px").cast("double"))
    return view(spark, sf_dir, "v_faces").select("face_id", F.round(frontality(marks, box), 3).alias("frontality"))


@query("pr27_face_state", oracle("v_faces", "SELECT face_id, CASE WHEN p IS NULL OR p = '' THEN 'open' WHEN p IN ('_skipped', '_ignored') THEN substr(p, 2) ELSE 'named' END AS state FROM (SELECT face_id, CASE WHEN face_id % 29 = 0 THEN '_skipped' WHEN face_id % 23 = 0 THEN '' ELSE person_id END AS p FROM v_faces) q"))
def pr27(spark, sf_dir):
    p = F.when(c("face_id") % 29 == 0, "_skipped").when(c("face_id") % 23 == 0, "").otherwise(c("person_id"))
    state = F.when(F.coalesce(p, F.lit("")) == "", "open").when(p.isin("_skipped", "_ignored"), F.substring(p, F.lit(2), F.length(p))).otherwise("named")
    return view(spark, sf_dir, "v_faces").select("face_id", state.alias("state"))


@query("pr28_reading_order", oracle("v_faces", f"SELECT photo_id, face_id, CAST(row_number() OVER (PARTITION BY photo_id ORDER BY bad, y, x1, face_id) AS INT) AS place FROM (SELECT m.face_id, f.photo_id, CASE WHEN m.face_id % 41 = 0 THEN 1 ELSE 0 END AS bad, CASE WHEN m.face_id % 41 = 0 THEN 0 ELSE floor((y1 + y1 + m.px) / 2 / 200) END AS y, CASE WHEN m.face_id % 41 = 0 THEN 0 ELSE x1 END AS x1 FROM ({MARKS}) m JOIN v_faces f ON m.face_id = f.face_id) q"))
def pr28(spark, sf_dir):
    from pyspark.sql import Window

    from medialake.functions.geometry import reading_order

    f = c("face_id")
    box = F.when(f % 41 != 0, F.array((f % 400), (f % 1100), (f % 400 + c("px")), (f % 1100 + c("px"))))
    place = F.row_number().over(Window.partitionBy("photo_id").orderBy(reading_order(box), "face_id"))
    return view(spark, sf_dir, "v_faces").select("photo_id", "face_id", place.alias("place"))


GROUNDED = "concat_ws(chr(10), CASE WHEN person_id IS NOT NULL AND NOT starts_with(person_id, '_') THEN concat('Persons: ', person_id) END, CASE WHEN asset_id % 3 = 0 THEN 'note a, note b' END, caption, concat_ws(', ', lang, folder), CASE WHEN event_name IS NOT NULL THEN concat_ws(' · ', event_name, CASE WHEN lower(folder) <> lower(event_name) THEN folder END) END, CASE WHEN person_id IS NULL OR starts_with(person_id, '_') THEN 'Maybe: p1, p2' END)"


@query("pr22_grounded_document", oracle("v_assets", f"SELECT asset_id, md5({GROUNDED}) AS doc FROM v_assets"))
def pr22(spark, sf_dir):
    from medialake.functions.text import grounded

    names = F.filter(F.array_compact(F.array("person_id")), lambda x: ~x.startswith("_"))
    notes = F.when(c("asset_id") % 3 == 0, F.array(F.lit("note a"), F.lit("note b")))
    head = F.when(c("event_name").isNotNull(), F.concat_ws(" · ", "event_name", F.when(F.lower("folder") != F.lower("event_name"), c("folder"))))
    doc = grounded(names, notes, c("caption"), F.array("lang", "folder"), head, F.array(F.lit("p1"), F.lit("p2")))
    return view(spark, sf_dir, "v_assets").select("asset_id", F.md5(doc).alias("doc"))


@query("ex2_annotations", oracle("v_assets", "SELECT asset_id, CASE asset_id % 3 WHEN 0 THEN [folder, 'New'] WHEN 1 THEN [lang] ELSE ['New'] END AS notes FROM v_assets WHERE asset_id % 3 <> 1 OR folder <> ''"))
def ex2(spark, sf_dir):
    """Adds, removes or replaces notes; only changed rows come back."""
    from medialake.functions.text import annotated

    mode, added = c("asset_id") % 3, F.array(F.lit("New"))
    now = F.when(mode == 0, F.array("folder")).when(mode == 1, F.array("folder", "lang")).otherwise(F.array("lang"))
    new = F.when(mode == 0, annotated(now, added, "add")).when(mode == 1, annotated(now, F.array(F.upper("folder")), "remove")).otherwise(annotated(now, added, "replace"))
    return view(spark, sf_dir, "v_assets").select("asset_id", now.alias("now"), new.alias("notes")).where(~c("now").eqNullSafe(c("notes"))).drop("now")


@query("ex3_clean_aliases", "SELECT c_custkey, list_filter([trim(c_name), trim(c_mktsegment)], lambda x: x <> '') AS aliases FROM customer")
def ex3(spark, sf_dir):
    from medialake.functions.text import ordered_distinct_by

    raw = F.array(F.concat(F.lit(" "), "c_name"), F.upper("c_name"), F.lit("  "), "c_mktsegment", F.lower("c_name"))
    clean = ordered_distinct_by(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != ""), F.lower)
    return table(spark, sf_dir, "customer").select("c_custkey", clean.alias("aliases"))


@query("jn12_rows_under_directory", oracle("v_paths", "SELECT asset_id, path FROM v_paths WHERE starts_with(path, '/mnt/photo/Fotos/src2/')"))
def jn12(spark, sf_dir):
    return view(spark, sf_dir, "v_paths").where(P.under(c("path"), "/mnt/photo/Fotos/src2")).select("asset_id", "path")


@query("fl13_folder_list", oracle("v_assets", "SELECT asset_id FROM v_assets WHERE folder IN (SELECT concat('src', CAST(item_id % 3 AS VARCHAR)) FROM benchmark)"))
def fl13(spark, sf_dir):
    folders = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (c("item_id") % 3).cast("string")).alias("folder")).distinct()
    return view(spark, sf_dir, "v_assets").join(folders, "folder", "left_semi").select("asset_id")


@query("se5_overlapping_roots", oracle("v_paths", "SELECT path, min(size) AS size FROM v_paths WHERE starts_with(path, '/mnt/photo/') GROUP BY path"))
def se5(spark, sf_dir):
    """Roots that overlap list a path twice; it is taken once."""
    rows = view(spark, sf_dir, "v_paths")
    both = rows.where(P.under(c("path"), "/mnt/photo/Fotos")).union(rows.where(P.under(c("path"), "/mnt/photo")))
    return both.groupBy("path").agg(F.min("size").alias("size"))


@query("se3_shared_members", "WITH p AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS p FROM orders GROUP BY 1) SELECT a.o_custkey AS a, b.o_custkey AS b, list_sort(list_intersect(a.p, b.p)) AS shared FROM p a JOIN p b ON b.o_custkey = a.o_custkey + 3")
def se3(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("p"))
    other = p.select((c("o_custkey") - 3).alias("a"), c("o_custkey").alias("b"), c("p").alias("q"))
    return p.select(c("o_custkey").alias("a"), "p").join(other, "a").select("a", "b", F.sort_array(F.array_intersect("p", "q")).alias("shared"))


@query("tk8_work_list", oracle("v_paths", "SELECT path FROM (SELECT path, asset_id FROM v_paths WHERE lower(path) LIKE '%.jpg' ORDER BY md5(concat('3-', CAST(asset_id AS VARCHAR))) LIMIT 200) q ORDER BY path"))
def tk8(spark, sf_dir):
    """A sample by a hash of the id, then in the order of paths."""
    rows = view(spark, sf_dir, "v_paths").where(P.suffix(c("path")) == "jpg")
    return rows.orderBy(F.md5(F.concat(F.lit("3-"), c("asset_id").cast("string")))).limit(200).select("path").orderBy("path")


@query("tk2_ids_only", oracle("v_assets", "SELECT asset_id FROM v_assets WHERE lang = 'en' AND trashed_at IS NULL ORDER BY asset_id LIMIT 200000"))
def tk2(spark, sf_dir):
    return view(spark, sf_dir, "v_assets").where("lang = 'en' and trashed_at is null").select("asset_id").orderBy("asset_id").limit(200_000)


@query("ex4_supported_tags", oracle("v_assets", "SELECT asset_id, list_filter(['ther', 'tionen', 'anderes', 'kkkk', 'ung'], lambda t: contains(f, t) OR (length(CASE WHEN length(t) > 6 AND regexp_matches(t, '(en|er|es)$') THEN left(t, length(t) - 2) ELSE t END) >= 4 AND contains(f, CASE WHEN length(t) > 6 AND regexp_matches(t, '(en|er|es)$') THEN left(t, length(t) - 2) ELSE t END))) AS kept FROM (SELECT asset_id, replace(replace(replace(replace(lower(caption), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS f FROM v_assets) q"))
def ex4(spark, sf_dir):
    from medialake.functions import text as T

    tags = F.array(*map(F.lit, ["ther", "tionen", "anderes", "kkkk", "ung"]))
    rows = view(spark, sf_dir, "v_assets").withColumn("f", T.spelled_out(c("caption")))
    return rows.select("asset_id", F.filter(tags, lambda t: T.supported(t, c("f"))).alias("kept"))


@query("ex11_titles", oracle("v_assets", "SELECT asset_id, CASE WHEN length(t) <= 40 AND len(string_split(t, ' ')) <= 5 THEN t END AS title FROM (SELECT asset_id, concat_ws(' ', folder, lang, CASE WHEN event_name IS NOT NULL THEN concat('at ', event_name, CASE WHEN asset_id % 3 = 0 THEN ' again' ELSE '' END) END) AS t FROM v_assets) q"))
def ex11(spark, sf_dir):
    from medialake.functions.text import clean_title

    event = F.when(c("event_name").isNotNull(), F.concat(F.lit("at \n "), "event_name", F.when(c("asset_id") % 3 == 0, "  again").otherwise("")))
    return view(spark, sf_dir, "v_assets").select("asset_id", clean_title(F.concat(F.lit(" - "), F.concat_ws("  ", "folder", "lang", event), F.lit(" .;"))).alias("title"))


@query("sc3_nearest_sidecar", oracle("v_paths", "SELECT asset_id, CASE WHEN starts_with(path, '/mnt/photo/Handys/') THEN CASE WHEN contains(path, '/WhatsApp Images/') THEN 'phone pictures' ELSE 'phones' END WHEN path LIKE '/mnt/photo/Fotos/src1/%' THEN 'first source' END AS location FROM v_paths"))
def sc3(spark, sf_dir):
    from medialake.sources.rules import nearest_sidecar

    docs = table(spark, sf_dir, "documents").select("source").distinct()
    phone = F.concat(F.lit("/mnt/photo/Handys/"), "source")
    body = lambda place: F.to_json(F.struct(F.lit(place).alias("location")))
    side = docs.select(phone.alias("dir"), body("phones").alias("body")).union(docs.select(F.concat(phone, F.lit("/WhatsApp Images")), body("phone pictures")))
    side = side.union(docs.where("source = 'src1'").select(F.concat(F.lit("/mnt/photo/Fotos/"), "source"), body("first source"))).union(docs.select(F.concat(F.lit("/mnt/photo/Fotos/"), "source", F.lit(" 2018")), F.lit("{broken")))
    return nearest_sidecar(view(spark, sf_dir, "v_paths").select("asset_id", "path"), "path", side).select("asset_id", c("sidecar.location").alias("location"))


@query("jn13_concept_match", oracle("v_assets", "SELECT asset_id, list_filter(['and', 'en', 'tion'], lambda t: regexp_matches(lower(caption), CASE t WHEN 'and' THEN '(and|und)' WHEN 'en' THEN '(en|ent)( |$)' ELSE 'tion[a-z]' END)) AS concepts FROM v_assets"))
def jn13(spark, sf_dir):
    """Concepts, each with a pattern, that a text holds."""
    patterns = {"and": "(and|und)", "en": "(en|ent)( |$)", "tion": "tion[a-z]"}
    held = F.array(*(F.when(F.lower("caption").rlike(p), name) for name, p in patterns.items()))
    return view(spark, sf_dir, "v_assets").select("asset_id", F.array_compact(held).alias("concepts"))


@query("fl11_map_mask", oracle("v_assets", "SELECT asset_id FROM v_assets WHERE event_name IS NULL AND coalesce(kind, 'photo') <> 'video' AND folder NOT IN ('src4') AND asset_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def fl11(spark, sf_dir):
    """What the map shows: untouched photos of the spaces that are on, without hidden ids."""
    hidden = table(spark, sf_dir, "labels").where("toxic = 1").select(c("doc_id").alias("asset_id"))
    rows = view(spark, sf_dir, "v_assets").where(c("event_name").isNull() & (F.coalesce("kind", F.lit("photo")) != "video") & ~c("folder").isin("src4"))
    return rows.select("asset_id").join(hidden, "asset_id", "left_anti")


@query("ag22_work_suggestions", oracle("v_assets", "SELECT folder, CAST(count(*) FILTER (event_name IS NULL AND person_id IS NULL) AS BIGINT) AS open_rows, count(*) AS n FROM v_assets GROUP BY folder ORDER BY open_rows DESC, folder LIMIT 5"))
def ag22(spark, sf_dir):
    """The five folders with most untouched rows."""
    open_ = F.count_if(c("event_name").isNull() & c("person_id").isNull())
    return view(spark, sf_dir, "v_assets").groupBy("folder").agg(open_.alias("open_rows"), F.count("*").alias("n")).orderBy(F.desc("open_rows"), "folder").limit(5)


@query("ag26_sources_table", oracle("v_paths", "SELECT root, count(*) AS n FROM (SELECT DISTINCT concat('/mnt/photo/Fotos/', source) AS root FROM documents) r JOIN v_paths ON starts_with(path, concat(root, '/')) GROUP BY root"))
def ag26(spark, sf_dir):
    """Rows under each root; a path is dealt to its own directories, so roots and paths meet by equal keys."""
    roots = table(spark, sf_dir, "documents").select(F.concat(F.lit("/mnt/photo/Fotos/"), "source").alias("root")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return view(spark, sf_dir, "v_paths").select(F.explode(above).alias("root")).groupBy("root").count().withColumnRenamed("count", "n").join(roots, "root")


OCCASION = "CASE WHEN event_name IS NOT NULL THEN event_name WHEN NOT regexp_matches(folder, '(?i)^(src[0-9]|camera|dcim|download|new folder|whatsapp images|sent|[0-9]{3}[A-Z_]+)$') THEN folder END"


@query("pr19_occasion", oracle("v_assets", f"SELECT asset_id, {OCCASION.replace('folder END', 'trim(folder) END')} AS occasion FROM (SELECT asset_id, event_name, CASE WHEN asset_id % 3 = 0 THEN folder ELSE concat('Walk ', lang) END AS folder FROM v_assets) q"))
def pr19(spark, sf_dir):
    """The given name, else the folder without a date around it, unless that says nothing."""
    from medialake.functions.text import occasion

    folder = F.when(c("asset_id") % 3 == 0, c("folder")).when(c("asset_id") % 3 == 1, F.concat(F.lit("2018-05-03 Walk "), "lang")).otherwise(F.concat(F.lit("Walk "), "lang", F.lit(" 2018-05")))
    return view(spark, sf_dir, "v_assets").select("asset_id", occasion(c("event_name"), folder, P.generic).alias("occasion"))


@query("pr23_public_persons", oracle("v_assets", "SELECT asset_id, CASE WHEN person_id IS NULL OR starts_with(person_id, '_') THEN [] WHEN asset_id % 2 = 0 THEN [concat('Name ', person_id)] ELSE [person_id] END AS persons FROM v_assets"))
def pr23(spark, sf_dir):
    """Names where there are any, else ids; those that start with an underscore are no persons."""
    ids = F.array_compact(F.array("person_id"))
    names = F.when((c("asset_id") % 2 == 0) & ~F.coalesce(c("person_id").startswith("_"), F.lit(False)), F.transform(ids, lambda x: F.concat(F.lit("Name "), x))).otherwise(F.array().cast("array<string>"))
    said = F.when(F.size(names) > 0, names).otherwise(ids)
    return view(spark, sf_dir, "v_assets").select("asset_id", F.filter(said, lambda x: ~x.startswith("_")).alias("persons"))


@query("pr24_primary_face", oracle("v_faces", "SELECT photo_id, arg_max(face_id, (px * (px + face_id % 7), -face_id)) AS face_id, max(px * (px + face_id % 7)) AS area FROM v_faces GROUP BY photo_id"))
def pr24(spark, sf_dir):
    """The largest face of each photo, the smaller id of equals."""
    area = c("px") * (c("px") + c("face_id") % 7)
    faces = view(spark, sf_dir, "v_faces").withColumn("area", area)
    return faces.groupBy("photo_id").agg(F.max_by("face_id", F.struct("area", -c("face_id"))).alias("face_id"), F.max("area").alias("area"))


@query("se4_ordered_distinct", "SELECT o_custkey, list(o_orderpriority ORDER BY first_at, o_orderpriority) AS kinds FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_at FROM orders GROUP BY 1, 2) q GROUP BY o_custkey")
def se4(spark, sf_dir):
    """Distinct values in order of first appearance; they are distinct before they are gathered."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("at"))
    return first.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("at", "o_orderpriority"))).alias("x")).select("o_custkey", c("x.o_orderpriority").alias("kinds"))


@query("ex10_spread", "WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), m AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY label) SELECT vec_id, round(x + 0.4 * (cx - x), 6) AS x, round(y + 0.4 * (cy - y), 6) AS y FROM p JOIN m USING (label)")
def ex10(spark, sf_dir):
    """Points pushed by a share towards the centre of their cluster."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", "label", c("embedding")[0].cast("double").alias("x"), c("embedding")[1].cast("double").alias("y"))
    centres = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    to = lambda a, b: F.round(c(a) + 0.4 * (c(b) - c(a)), 6).alias(a)
    return p.join(centres, "label").select("vec_id", to("x", "cx"), to("y", "cy"))
