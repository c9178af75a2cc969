"""Registered queries over metadata notes, capture stamps, salvaged captions and clocks to repair."""

from pyspark.sql import functions as F

from medialake.functions import notes as N
from medialake.functions import paths as P
from medialake.functions import text as T
from medialake.plans.column_queries import ALBUM, NAME
from medialake.plans.date_queries import DECIDED, ZONE, _decided
from medialake.registry import query
from medialake.sources.views import SQL, oracle, view

c = F.col
MARK = "lake"
SQL["v_notes"] = f"""
        SELECT asset_id, path, told, CASE asset_id % 9 WHEN 0 THEN NULL WHEN 1 THEN concat('{MARK}:src=filename+mtime;mtime=', told) WHEN 2 THEN concat('x {MARK}:src=exif;mtime=', told) WHEN 3 THEN '{MARK}:src=folder;cap= two ;zoom=1'
            ELSE concat('{MARK}:mtime=', told, ';src=', CASE WHEN asset_id % 4 = 3 THEN 'file_time' ELSE 'filename' END, ';prev=') END AS note, CASE WHEN asset_id % 11 = 0 THEN '+01:00' END AS shift,
            CASE WHEN asset_id % 13 = 0 THEN NULL WHEN asset_id % 17 = 0 THEN '2021:01:01 00:00:00' ELSE replace(replace(replace(told, '-', ':'), 'T', ' '), 'Z', '') END AS original
        FROM (SELECT asset_id, path, concat(CASE WHEN asset_id % 8 = 6 THEN concat('2017-', lpad(CAST(1 + asset_id % 12 AS VARCHAR(9)), 2, '0'), '-21') ELSE concat('2021-0', CAST(1 + asset_id % 9 AS VARCHAR(9)), '-15') END, CASE WHEN asset_id % 3 = 0 THEN 'T23:1' ELSE 'T10:1' END, CAST(asset_id % 10 AS VARCHAR(9)), ':00Z') AS told FROM ({SQL["v_paths"]}) p) q"""
QUOTE = "chr(92), '\"'"  # both engines read chr(92) alike, but not a backslash in a literal
SQL["v_blobs"] = f"""
        SELECT doc_id AS asset_id, CASE doc_id % 6 WHEN 0 THEN concat('{{"caption": "', source, ' ', {QUOTE}, 'at', {QUOTE}, ' ', coalesce(lang, ''), '", "tags": []}}') WHEN 1 THEN concat('{{"caption": "', source, ' and ', coalesce(lang, ''))
            WHEN 2 THEN concat('{{"caption": "{{', {QUOTE}, 'caption', {QUOTE}, ': ', {QUOTE}, source, {QUOTE}, '}}"}}') WHEN 3 THEN concat(' ', source, ' ') WHEN 4 THEN '{{"other": 1}}' ELSE concat('{{"tags": ["a"], "caption" : "', source, ' ', {QUOTE}, 'x') END AS blob FROM documents"""
SUFFIX = "lower(regexp_extract(path, '[.]([^./]+)$', 1))"
BODY = f"CASE WHEN contains(note, '{MARK}:') THEN concat(';', string_split(note, '{MARK}:')[-1]) ELSE '' END"
FIELD = "trim(regexp_extract({body}, ';{key}=([^;]*)', 1))"


def field(key, body="body"):
    return FIELD.format(body=body, key=key)


@query("ex12_note_codec", oracle("v_notes", f"SELECT asset_id, {field('src')} AS src, {field('mtime')} AS mtime, CASE WHEN parts <> '' THEN concat('{MARK}:', parts) ELSE '' END AS written FROM (SELECT asset_id, body, concat_ws(';', CASE WHEN {field('src')} <> '' THEN 'src=' || {field('src')} END, CASE WHEN {field('prev')} <> '' THEN 'prev=' || {field('prev')} END, CASE WHEN {field('mtime')} <> '' THEN 'mtime=' || {field('mtime')} END, CASE WHEN {field('cap')} <> '' THEN 'cap=' || {field('cap')} END, CASE WHEN {field('zoom')} <> '' THEN 'zoom=' || {field('zoom')} END) AS parts FROM (SELECT asset_id, {BODY} AS body FROM v_notes) q) r"))
def ex12(spark, sf_dir):
    """A note's fields, and the note written anew from them."""
    rows = view(spark, sf_dir, "v_notes").withColumn("f", N.note_fields(F.coalesce("note", F.lit("")), MARK))
    told = lambda key: F.trim(F.coalesce(c("f")[key], F.lit(""))).alias(key)
    return rows.select("asset_id", told("src"), told("mtime"), N.note_text(c("f"), MARK).alias("written"))


READ = "try_strptime({0}, '%Y:%m:%d %H:%M:%S')"


@query("pr31_capture_stamp", oracle("v_notes", f"SELECT asset_id, coalesce(o, z, f) AS stamp, CASE WHEN o IS NOT NULL THEN 'original' WHEN z IS NOT NULL THEN 'digitized' WHEN f IS NOT NULL THEN 'file' END AS field, CASE WHEN coalesce(o, z, f) IS NULL THEN NULL WHEN body = '' THEN 1.0 ELSE CASE string_split({field('src')}, '+')[1] WHEN 'filename' THEN 0.7 WHEN 'folder' THEN 0.6 WHEN 'file_time' THEN 0.3 ELSE 0.5 END END AS confidence FROM (SELECT asset_id, coalesce({BODY}, '') AS body, {READ.format('original')} AS o, CASE WHEN asset_id % 2 = 0 THEN {READ.format(chr(39) + '2020:02:30 10:00:00' + chr(39))} ELSE {READ.format(chr(39) + '2020:02:03 10:00:00' + chr(39))} END AS z, CASE WHEN asset_id % 5 > 0 THEN CAST(replace(replace(told, 'T', ' '), 'Z', '') AS TIMESTAMP) END AS f FROM v_notes) q"))
def pr31(spark, sf_dir):
    digitized = F.when(c("asset_id") % 2 == 0, "2020:02:30 10:00:00").otherwise("2020:02:03 10:00:00")  # there is no 30th of February
    filed = F.when(c("asset_id") % 5 > 0, F.regexp_replace(F.translate("told", "-TZ", ": "), r"^(\d{4}):", "$1:"))
    stamp = N.capture_stamp([("original", c("original")), ("digitized", digitized), ("file", filed)], F.coalesce("note", F.lit("")), MARK, {"filename": 0.7, "folder": 0.6, "file_time": 0.3})
    return view(spark, sf_dir, "v_notes").withColumn("x", stamp).select("asset_id", "x.stamp", "x.field", "x.confidence")


def _opened(source: str) -> str:
    cut = r"""regexp_extract(t, '"caption"\s*:\s*"((?:[^"\\]|\\.)*)', 1, 's')"""
    plain = rf"""regexp_replace({cut}, '\\(["\\/])', '\1', 'g')"""
    return f"(SELECT asset_id, CASE WHEN NOT starts_with(t, '{{') THEN t WHEN json_valid(t) THEN trim(coalesce(json_extract_string(t, '$.caption'), '')) ELSE trim({plain}) END AS t FROM {source}) x"


@query("pr37_salvaged_caption", oracle("v_blobs", f"SELECT asset_id, t AS caption FROM {_opened(_opened(_opened(_opened('(SELECT asset_id, trim(blob) AS t FROM v_blobs) x'))))}"))
def pr37(spark, sf_dir):
    return view(spark, sf_dir, "v_blobs").select("asset_id", N.salvaged(c("blob"), "caption").alias("caption"))


CLOCK = r"(^|[^0-9])(19|20)[0-9][0-9][-_]?[0-9][0-9][-_]?[0-9][0-9][-_ T]?([01][0-9]|2[0-3])[-_.:]?[0-5][0-9][-_.:]?[0-5][0-9]([^0-9]|$)"
NOTED = "CASE WHEN {0} IN ('filename', 'folder', 'folder_name', 'folder_json', 'album') THEN concat({0}, '+mtime') ELSE {0} END"


@query("cu14_write_back_plan", oracle("v_dated", "").rstrip() + DECIDED + f", w AS (SELECT asset_id, path, album, name, x[1] AS day, x[2] AS source, mtime, mtime NOT LIKE '%Z' OR CAST(m_day AS VARCHAR) = x[1] AS fits FROM d), o AS (SELECT asset_id, album, CASE WHEN NOT {SUFFIX} IN ('jpg', 'jpeg', 'tif', 'tiff') OR source = 'exif' THEN NULL WHEN fits THEN CAST(replace(replace(mtime, 'T', ' '), 'Z', '') AS TIMESTAMP) WHEN source = 'filename' AND NOT regexp_matches(name, '{CLOCK}') THEN CAST(concat(day, ' 12:00:00') AS TIMESTAMP) END AS stamp, CASE WHEN fits THEN {NOTED.format('source')} ELSE 'filename+noon' END AS note_source FROM w) SELECT asset_id, stamp, note_source FROM o WHERE stamp IS NOT NULL")
def cu14(spark, sf_dir):
    """Which files without a capture time would get one, which, and how the note names its source."""
    plan = N.write_back(c("path"), P.file_name(c("path")), c("day"), c("source"), c("mtime"), ZONE)
    return _decided(spark, sf_dir).withColumn("w", plan).where("w is not null").select("asset_id", "w.stamp", c("w.source").alias("note_source"))


@query("cu15_clock_verdicts", oracle("v_notes", "").rstrip() + f""", n AS (SELECT asset_id, path, {NAME} AS name, coalesce({BODY}, '') AS body, shift, {READ.format('original')} AS written FROM v_notes), s AS (SELECT *, {field('src')} AS src, try_strptime(left(replace({field('mtime')}, 'Z', ''), 19), '%Y-%m-%dT%H:%M:%S') AS m, regexp_replace(regexp_extract(name, '((19|20)[0-9][0-9]-?[0-9][0-9]-?[0-9][0-9])', 1), '([0-9]{{4}})-?([0-9][0-9])-?([0-9][0-9])', '\\1-\\2-\\3') AS named FROM n)
    SELECT asset_id, CASE WHEN NOT {SUFFIX} IN ('jpg', 'jpeg', 'tif', 'tiff') THEN 'other format' WHEN src = '' THEN 'no note' WHEN contains(src, '+') THEN 'new form' WHEN src NOT IN ('filename', 'folder', 'folder_name', 'folder_json', 'album', 'file_time', 'derived') THEN concat('source ', src) WHEN shift IS NOT NULL THEN 'has an offset' WHEN written IS NULL THEN 'no stamp' WHEN m IS NULL THEN 'no file time' WHEN written <> m THEN 'another clock'
        WHEN src <> 'file_time' AND CAST(m + INTERVAL 1 HOUR AS DATE) <> CAST(written AS DATE) THEN CASE WHEN src = 'filename' AND named = strftime(written, '%Y-%m-%d') AND NOT regexp_matches(name, '{CLOCK}') THEN 'noon' ELSE 'day would change' END ELSE 'to correct' END AS verdict FROM s""")
def cu15(spark, sf_dir):
    verdict = N.clock_verdict(c("path"), P.file_name(c("path")), F.coalesce("note", F.lit("")), c("shift"), c("original"), MARK, ZONE)
    return view(spark, sf_dir, "v_notes").select("asset_id", verdict.alias("verdict"))


@query("pr20_header_line", oracle("v_assets", "SELECT asset_id, concat_ws(' · ', day, CASE WHEN day IS NOT NULL THEN CASE WHEN m IN (12, 1, 2) THEN 'winter' WHEN m < 6 THEN 'spring' WHEN m < 9 THEN 'summer' ELSE 'autumn' END END, event_name, CASE WHEN place IS NOT NULL AND lower(trim(place)) <> lower(coalesce(event_name, '')) THEN trim(place) END) AS head FROM (SELECT asset_id, event_name, 1 + asset_id % 12 AS m, CASE WHEN asset_id % 4 > 0 THEN concat('2019-', lpad(CAST(1 + asset_id % 12 AS VARCHAR), 2, '0')) END AS day, CASE WHEN asset_id % 3 = 0 THEN concat(' ', folder) WHEN asset_id % 10 = 0 THEN upper(event_name) END AS place FROM v_assets) q"))
def pr20(spark, sf_dir):
    """Date, season, occasion and place in one line; the place only where the occasion isn't named for it."""
    month = 1 + c("asset_id") % 12
    day = F.when(c("asset_id") % 4 > 0, F.concat(F.lit("2019-"), F.lpad(month.cast("string"), 2, "0")))
    place = F.when(c("asset_id") % 3 == 0, F.concat(F.lit(" "), "folder")).when(c("asset_id") % 10 == 0, F.upper("event_name"))
    own_place = F.when(F.lower(F.trim(place)) != F.lower(F.coalesce("event_name", F.lit(""))), F.trim(place))
    return view(spark, sf_dir, "v_assets").select("asset_id", T.header(day, F.when(day.isNotNull(), T.season(month)), c("event_name"), own_place).alias("head"))


@query("pr41_caption_context", oracle("v_assets", "SELECT asset_id, md5(concat_ws(chr(10), concat('album: ', folder), CASE WHEN event_name IS NOT NULL THEN concat('event: ', event_name) END, concat('kind: ', coalesce(kind, 'photo')), CASE WHEN person_id LIKE 'p%' THEN concat('confirmed: ', person_id) END, CASE WHEN persons <> '' THEN concat('in this album: ', persons) END, CASE WHEN lang IS NOT NULL THEN concat('tags: ', lang) END)) AS context FROM v_assets LEFT JOIN (SELECT folder AS f, string_agg(person_id, ', ' ORDER BY person_id) AS persons FROM (SELECT DISTINCT folder, person_id FROM v_assets WHERE person_id LIKE 'p%') q GROUP BY folder) a ON folder = a.f"))
def pr41(spark, sf_dir):
    """What a captioning model is told of each row: one line for each thing known, confirmed persons only."""
    rows = view(spark, sf_dir, "v_assets")
    named = rows.where("person_id like 'p%'").select("folder", "person_id").distinct()
    album = named.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("person_id")), ", ").alias("persons"))  # distinct persons of an album
    line = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))
    confirmed = F.when(c("person_id").startswith("p"), c("person_id"))
    text = F.concat_ws("\n", line("album", c("folder")), line("event", c("event_name")), line("kind", F.coalesce("kind", F.lit("photo"))), line("confirmed", confirmed), line("in this album", c("persons")), line("tags", c("lang")))
    return rows.join(album, "folder", "left").select("asset_id", F.md5(text).alias("context"))
