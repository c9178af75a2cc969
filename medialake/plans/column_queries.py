"""Registered queries over derived columns."""

from pyspark.sql import functions as F

from medialake.functions import paths as P
from medialake.functions import text as T
from medialake.registry import query
from medialake.sources.views import oracle, view

ROOT = "/mnt/photo"
NAME = "regexp_extract(path, '[^/]*$')"
DIRS = "regexp_replace(path, '/[^/]*$', '')"
LAST = "regexp_extract(regexp_replace(path, '/[^/]*$', ''), '[^/]*$')"
ALBUM = f"CASE WHEN regexp_matches({LAST}, '(?i)^([0-9]{{3}}[A-Z_]{{3,8}}|DCIM|Camera|Sent)$') THEN regexp_extract(path, '([^/]*)/[^/]*/[^/]*$', 1) ELSE {LAST} END"


def paths_query(name, spark_columns, sql_columns, where=None, sql_where=None):
    body = f"SELECT asset_id, {sql_columns} FROM v_paths" + (f" WHERE {sql_where}" if sql_where else "")

    @query(name, oracle("v_paths", body))
    def run(spark, sf_dir):
        rows, path = view(spark, sf_dir, "v_paths"), F.col("path")
        return (rows.where(where(path)) if where else rows).select("asset_id", *spark_columns(path))

    return run


paths_query("sc1_media_listing", lambda path: [path, F.col("size")], "path, size", lambda path: P.scannable(path, F.col("size")), "lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('mp4','mov','m4v','avi','mkv','3gp','mts','webm','jpg','jpeg','png','heic','webp','tif','tiff','cr2','gif','bmp') AND size >= 32")
paths_query("sc8_prefix_scan", lambda path: [path], "path", lambda path: path.startswith("/mnt/photo/Fotos/") & path.contains("walk"), "starts_with(path, '/mnt/photo/Fotos/') AND contains(path, 'walk')")
paths_query(
    "pr1_channel", lambda path: [P.channel(path).alias("channel")],
    f"CASE WHEN starts_with(lower({NAME}), 'screenshot') THEN 'screenshot' WHEN regexp_matches({NAME}, '^(IMG|VID|AUD)-[0-9]{{8}}-WA[0-9]+') THEN CASE WHEN contains(lower(path), '/sent/') THEN 'sent' ELSE 'whatsapp' END WHEN contains(lower(path), '/download/') THEN 'download' ELSE 'camera' END AS channel",
)
paths_query("pr2_kind", lambda path: [P.kind(path).alias("kind")], "CASE WHEN lower(path) LIKE '%.mp4' THEN 'video' ELSE 'photo' END AS kind")
paths_query("pr4_space", lambda path: [P.space(path, ROOT).alias("space")], "split_part(path, '/', 4) AS space")
paths_query("pr5_under_root", lambda path: [P.under(P.collapsed(F.concat(path, F.lit("/../x/./y"))), "/mnt/photo/Fotos").alias("inside")], "starts_with(path, '/mnt/photo/Fotos/') AS inside")
paths_query("pr6_album", lambda path: [P.album(path).alias("album")], f"{ALBUM} AS album")
paths_query("pr8_sequence", lambda path: [P.sequence(path).alias("seq")], f"try_cast(regexp_extract({NAME}, '(?:IMG_|DSC_?|WA)([0-9]{{3,6}})(?:[^0-9]|$)', 1) AS INT) AS seq")
paths_query(
    "pr9_date_hint", lambda path: [P.date_hint(path).alias("hint"), P.folder_year(path).alias("year")],
    f"CASE asset_id % 8 WHEN 6 THEN left({NAME}, 10) WHEN 3 THEN NULL WHEN 7 THEN NULL WHEN 4 THEN NULL ELSE regexp_replace(regexp_extract({NAME}, '((19|20)[0-9]{{6}})', 1), '(....)(..)(..)', '\\1-\\2-\\3') END AS hint, CASE WHEN asset_id % 8 = 4 THEN 2018 END AS year",
)
paths_query("pr36_rebase", lambda path: [P.rebased(path, "/mnt/photo/Handys", "/data/phones").alias("path")], "CASE WHEN starts_with(path, '/mnt/photo/Handys/') THEN concat('/data/phones', substr(path, 18)) ELSE path END AS path")
paths_query("pr39_generic_album", lambda path: [P.generic(P.album(path)).alias("generic")], f"regexp_matches({ALBUM}, '(?i)^(src[0-9]|camera|dcim|download|new folder|whatsapp images|sent|[0-9]{{3}}[A-Z_]+)$') AS generic")
paths_query("fl14_name_ok", lambda path: [P.name_ok(P.file_name(path)).alias("ok")], "true AS ok")
paths_query("pr34_identity", lambda path: [F.sha2("path", 256).alias("uid")], "sha256(path) AS uid")
paths_query("sc11_detail", lambda path: [P.file_name(path).alias("file_name"), P.suffix(path).alias("suffix"), P.folder(path).alias("folder"), F.coalesce(F.nullif(F.col("size"), F.lit(0)), F.lit(-1)).alias("size")], f"{NAME} AS file_name, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS suffix, {DIRS} AS folder, coalesce(nullif(size, 0), -1) AS size")


@query("pr3_common_root", oracle("v_paths", "SELECT '/mnt/photo' AS root, count(*) AS n FROM v_paths"))
def pr3(spark, sf_dir):
    return view(spark, sf_dir, "v_paths").agg(P.common_root(F.col("path")).alias("root"), F.count("*").alias("n"))


PREFIX = "list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i)))"


@query("pr3_roots_by_group", oracle("v_paths", f"SELECT k, regexp_replace(left(a, {PREFIX}), '/[^/]*$', '') AS root, n FROM (SELECT concat({DIRS}, CASE WHEN asset_id % 3 = 0 THEN CAST(asset_id AS VARCHAR) END) AS k, min(path) AS a, max(path) AS b, count(*) AS n FROM v_paths GROUP BY 1) q"))
def pr3_groups(spark, sf_dir):
    """The common root of the paths of each directory; every third path is a group of its own and has its parent as root."""
    k = F.concat(P.folder(F.col("path")), F.when(F.col("asset_id") % 3 == 0, F.col("asset_id").cast("string")).otherwise(""))
    return view(spark, sf_dir, "v_paths").groupBy(k.alias("k")).agg(P.common_root(F.col("path")).alias("root"), F.count("*").alias("n"))


@query("sc9_scan_preview", oracle("v_paths", "SELECT CASE WHEN starts_with(path, '/mnt/photo/Fotos/src1/') THEN '/mnt/photo/Fotos/src1' WHEN starts_with(path, '/mnt/photo/Fotos/') THEN '/mnt/photo/Fotos' ELSE '/mnt/photo' END AS root, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM v_paths GROUP BY 1"))
def sc9(spark, sf_dir):
    roots = ["/mnt/photo/Fotos/src1", "/mnt/photo/Fotos", "/mnt/photo"]  # longest first
    root = F.coalesce(*(F.when(P.under(F.col("path"), r), r) for r in roots))
    return view(spark, sf_dir, "v_paths").groupBy(root.alias("root")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("fl9_rule_coverage", oracle("v_paths", "SELECT asset_id, starts_with(path, '/mnt/photo/Fotos/') AND NOT starts_with(path, '/mnt/photo/Fotos/src3/') AS covered FROM v_paths"))
def fl9(spark, sf_dir):
    rules = spark.createDataFrame([("/mnt/photo/Fotos", True), ("/mnt/photo/Fotos/src3", False)], "root string, include boolean")
    rows = view(spark, sf_dir, "v_paths")
    hit = rows.select("asset_id", "path").join(F.broadcast(rules), F.col("path").startswith(F.concat("root", F.lit("/"))), "left")  # a rule list is a parameter
    return hit.groupBy("asset_id").agg((F.coalesce(F.max(F.col("include")), F.lit(False)) & ~F.coalesce(F.max(~F.col("include")), F.lit(False))).alias("covered"))


DATED = "(SELECT *, date_add(DATE '2015-01-01', CAST(asset_id % 900 AS INT)) AS d FROM v_assets)"


@query("pr18_season_header", oracle("v_assets", f"SELECT asset_id, concat_ws(' · ', strftime(d, '%d.%m.%Y'), CASE WHEN month(d) IN (12,1,2) THEN 'winter' WHEN month(d) < 6 THEN 'spring' WHEN month(d) < 9 THEN 'summer' ELSE 'autumn' END, event_name, folder) AS header FROM {DATED}".replace("date_add(DATE '2015-01-01', CAST(asset_id % 900 AS INT))", "DATE '2015-01-01' + CAST(asset_id % 900 AS INT)")))
def pr18(spark, sf_dir):
    rows = view(spark, sf_dir, "v_assets").withColumn("d", F.expr("date_add(DATE '2015-01-01', cast(asset_id % 900 AS int))"))
    return rows.select("asset_id", T.header(F.date_format("d", "dd.MM.yyyy"), T.season(F.month("d")), F.col("event_name"), F.col("folder")).alias("header"))


# Each caption with a phrase that tells a date or a year, by id, and the date of its row.
TOLD = """SELECT asset_id, concat(caption, CASE asset_id % 9 WHEN 0 THEN ', aufgenommen im Juni 2008' WHEN 1 THEN ' WM 2014 Trikot' WHEN 2 THEN ' Das Foto wurde am 3. Mai 2019 aufgenommen.' WHEN 3 THEN ' vom 3.10.1999 , dann' WHEN 4 THEN ' im März 2011.'
    WHEN 5 THEN ', entgenommen am 24. dezember 2015' WHEN 6 THEN ' Das Foto entstand 2003 in der Stadt.' WHEN 7 THEN ' Abi  2017 ,,' ELSE '' END) AS caption, CASE WHEN asset_id % 4 < 3 THEN concat(CAST(2013 + asset_id % 5 AS VARCHAR(9)), '-05-01') END AS date FROM v_assets"""


def _cleaned_sql() -> str:
    out = "caption"
    for pattern in T.DATE_PHRASES:
        out = f"regexp_replace({out}, '(?i){pattern}', '', 'g')"
    out = f"CASE WHEN date IS NULL THEN {out} ELSE regexp_replace({out}, concat('\\s*\\b', left(date, 4), '\\b'), '', 'g') END"
    out = f"regexp_replace(regexp_replace({out}, '(?i){T.EMPTY_SENTENCE}', '', 'g'), '\\s{{2,}}', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({out}, '\\s+([.,])', '\\1', 'g'), '[.]{{2,}}', '.', 'g'), '[,]{{2,}}', ',', 'g'), ' ,')"


@query("pr21_caption_clean", oracle("v_assets", f"SELECT asset_id, md5({_cleaned_sql()}) AS clean FROM ({TOLD}) t"))
def pr21(spark, sf_dir):
    view(spark, sf_dir, "v_assets").createOrReplaceTempView("v_assets")
    return spark.sql(TOLD).select("asset_id", F.md5(T.caption_clean(F.col("caption"), F.col("date"))).alias("clean"))


@query("pr35_slugs", "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def pr35(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", T.slug(F.col("c_name")).alias("slug"))


@query("pr32_state_flags", oracle("v_assets", "SELECT asset_id, f AS flags, bit_count(f & 15) AS tidiness FROM (SELECT asset_id, CAST((event_name IS NOT NULL)::INT + 2 * (person_id IS NOT NULL AND NOT starts_with(person_id, '_'))::INT + 4 * (quality IS NOT NULL)::INT + 8 * (length(caption) > 0)::INT + 16 * (trashed_at IS NOT NULL)::INT AS INT) AS f FROM v_assets)"))
def pr32(spark, sf_dir):
    marks = [F.col("event_name").isNotNull(), F.coalesce(~F.col("person_id").startswith("_"), F.lit(False)), F.col("quality").isNotNull(), F.length("caption") > 0, F.col("trashed_at").isNotNull()]
    flags = sum((F.when(m, 1 << k).otherwise(0) for k, m in enumerate(marks)), F.lit(0))
    return view(spark, sf_dir, "v_assets").select("asset_id", flags.alias("flags")).withColumn("tidiness", F.bit_count(F.col("flags").bitwiseAND(15)))


@query("pr26_face_quality", oracle("v_faces", "SELECT face_id, round(coalesce(frontality, 0.5) * score * least(1.0, px / 80.0), 4) AS quality, CASE WHEN person_id IS NULL THEN 'open' WHEN person_id = '_ignored' THEN 'ignored' ELSE 'named' END AS state FROM v_faces"))
def pr26(spark, sf_dir):
    quality = F.coalesce("frontality", F.lit(0.5)) * F.col("score") * F.least(F.lit(1.0), F.col("px") / 80)
    state = F.when(F.col("person_id").isNull(), "open").when(F.col("person_id") == "_ignored", "ignored").otherwise("named")
    return view(spark, sf_dir, "v_faces").select("face_id", F.round(quality, 4).alias("quality"), state.alias("state"))


@query("ex1_merge_tags", oracle("v_assets", "SELECT asset_id, list_distinct(list_filter([lower(lang), folder, CASE WHEN toxic = 1 THEN 'toxic' END, lower(lang)], lambda x: x IS NOT NULL)) AS tags FROM v_assets").replace("list_distinct(", "list_sort(list_distinct(").replace("IS NOT NULL))", "IS NOT NULL)))"))
def ex1(spark, sf_dir):
    tags = F.array_compact(F.array("lang", "folder", F.when(F.col("toxic") == 1, "toxic"), F.upper("lang")))
    return view(spark, sf_dir, "v_assets").select("asset_id", F.sort_array(T.ordered_distinct_by(tags, T.tag_folded)).alias("tags"))


@query("pr14_date_bounds", "SELECT o_orderkey, make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0) AS lower_bound, make_timestamp(year(o_orderdate), 12, 31, 23, 59, 59) AS upper_bound FROM orders")
def pr14(spark, sf_dir):
    year = F.year("o_orderdate").cast("string")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_timestamp(F.concat(year, F.lit("-01-01 00:00:00"))).alias("lower_bound"), F.to_timestamp(F.concat(year, F.lit("-12-31 23:59:59"))).alias("upper_bound"))


@query("pr12_stamp_parse", "SELECT event_id, CAST(ts AS TIMESTAMP) AS stamp, date_trunc('day', ts) = ts AS day_only FROM events")
def pr12(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    stamp = F.coalesce(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "T", " "), "Z$", "")), F.try_to_timestamp(F.substring(text, 1, 10)))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", stamp.alias("stamp")).withColumn("day_only", F.date_trunc("day", "stamp") == F.col("stamp"))


@query("pr29_frame_requests", oracle("v_paths", "SELECT asset_id, list_sort(list_distinct(CASE WHEN d < 3 THEN [round(d / 2, 3)] ELSE [round(d * 0.1, 3), round(d * 0.5, 3), round(d * 0.9, 3)] END)) AS offsets FROM (SELECT asset_id, size / 1000.0 AS d FROM v_paths WHERE path LIKE '%.mp4')"))
def pr29(spark, sf_dir):
    d = F.col("size") / 1000.0
    millis = lambda x: F.round(x * 1000) / 1000  # noqa: E731  # of the binary number, as SQL does; round(x, 3) goes by the decimals that are printed
    offsets = F.when(d < 3, F.array(millis(d / 2))).otherwise(F.transform(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), lambda x: millis(d * x)))
    return view(spark, sf_dir, "v_paths").where(P.kind(F.col("path")) == "video").select("asset_id", F.sort_array(F.array_distinct(offsets)).alias("offsets"))
