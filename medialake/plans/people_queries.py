"""Registered queries over the search form, the people that names mean, changes to who is on what, albums and the timeline."""

from pyspark.sql import functions as F

from medialake.functions import paths as PA
from medialake.operators import events as E
from medialake.operators import people as P
from medialake.operators import search_form as S
from medialake.registry import query, table
from medialake.sources.views import SQL, oracle, view

c = F.col
# People are customers: an id with parts, the given name, aliases that some lack.
SQL["v_people"] = """SELECT concat('c-', CAST(c_nationkey AS VARCHAR(9)), '-', CAST(c_custkey AS VARCHAR(9))) AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN concat('Nick ', CAST(c_nationkey AS VARCHAR(9)), ' ', CAST(c_custkey AS VARCHAR(9))) END AS alias, c_custkey FROM customer"""
TOKENS = """SELECT DISTINCT CASE c_custkey % 8 WHEN 0 THEN upper(alias) WHEN 1 THEN name WHEN 2 THEN id WHEN 3 THEN concat('c ', CAST(c_custkey % 25 AS VARCHAR(9)), ' ', CAST(c_custkey AS VARCHAR(9))) WHEN 4 THEN substr(alias, 1, 8) WHEN 5 THEN substr(name, 12) WHEN 6 THEN substr(name, 4) ELSE concat('zz', CAST(c_custkey AS VARCHAR(9))) END AS token FROM v_people"""


def _people(spark, sf_dir):
    people = view(spark, sf_dir, "v_people")
    people.createOrReplaceTempView("v_people")
    return people.select("id", "name", F.array("alias", F.lit("")).alias("aliases"))


@query(
    "fl6_people_with_aliases",
    oracle("v_people", f""", t AS ({TOKENS}), p AS (SELECT id, lower(name) AS n, lower(alias) AS a FROM v_people), k AS (SELECT token, lower(trim(token)) AS t, replace(lower(trim(token)), ' ', '-') AS s FROM t),
    m AS (SELECT token, id, CASE WHEN id = t OR n = t OR coalesce(a = t, false) THEN 1 WHEN len(list_filter(string_split(n, ' '), lambda x: starts_with(x, t))) > 0 OR coalesce(starts_with(a, t), false) OR starts_with(id, s) OR len(list_filter(string_split(id, '-'), lambda x: starts_with(x, s))) > 0 THEN 2
        WHEN contains(n, t) OR contains(id, s) OR coalesce(contains(a, t), false) THEN 3 END AS tier FROM k JOIN p ON contains(n, t) OR contains(id, s) OR contains(a, t)),
    b AS (SELECT token, min(tier) AS tier FROM m GROUP BY token)
    SELECT t.token, m.id, CAST(m.tier AS INT) AS tier FROM t LEFT JOIN b ON t.token = b.token LEFT JOIN m ON m.token = b.token AND m.tier = b.tier"""),
)
def fl6_aliases(spark, sf_dir):
    """Who each of many tokens means, by id, name or alias."""
    people = _people(spark, sf_dir)
    return S.resolve_people(spark.sql(TOKENS), people)


# Rows with all that the form asks for; persons are customers of the same number, if there is one.
SQL["v_rows"] = f"""SELECT asset_id, caption, folder, lang AS space, kind, trashed_at, event_name, TIMESTAMP '2015-01-01 00:00:00' + INTERVAL '1' DAY * CAST(asset_id % 1500 AS INT) AS taken_at, CASE WHEN asset_id % 6 = 0 THEN 'prag' WHEN asset_id % 6 = 1 THEN 'rom' END AS location_key,
        CASE WHEN asset_id % 6 = 0 THEN 'Prag' WHEN asset_id % 6 = 1 THEN 'Rom' END AS location, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'plain' END AS tag, CASE WHEN asset_id % 9 = 0 THEN 'Notiz über Prag' ELSE 'other' END AS note,
        CAST(asset_id % 40 + 1 AS BIGINT) AS p1, CAST(asset_id % 77 + 1 AS BIGINT) AS p2 FROM ({SQL["v_assets"]}) a"""
ON = "EXISTS (SELECT 1 FROM v_people p WHERE p.c_custkey IN (p1, p2) AND {0})"
FORMS = {
    # persons all, within dates, a space and kinds
    "all": (S.SearchForm(persons=("Customer#00000000", "NOBODY"), persons_match="any", date_from="2016", date_to="2018-03-31", kinds=("photo",), spaces=("en", "de")),
            f"({ON.format('starts_with(lower(p.name), $$customer#00000000$$)')} OR false) AND taken_at >= TIMESTAMP '2016-01-01 00:00:00' AND taken_at <= TIMESTAMP '2018-03-31 23:59:59' AND coalesce(kind, 'photo') = 'photo' AND space IN ('en', 'de')"),
    # any of: two persons together, a place, a tag, a note, a folder
    "any": (S.SearchForm(persons=("nick 4", "Customer#000000001"), match="any", location=" Prag ", tags=("TOXIC",), annotations=("Notiz über Prag ",), folder="src7"),
            f"({ON.format('starts_with(lower(coalesce(p.alias, $$$$)), $$nick 4$$)')} OR {ON.format('lower(p.name) = $$customer#000000001$$')} OR location_key = 'prag' OR tag = 'toxic' OR note = 'Notiz über Prag' OR folder = 'src7')"),
    "words": (S.SearchForm(words="der PRÄG und noti"), "regexp_matches(concat(' ', translate(replace(lower(concat_ws(' ', caption, folder, coalesce(location, ''), coalesce(event_name, ''), tag, note)), 'ß', 'ss'), 'äöü', 'aou')), '[^a-z0-9]prag') AND regexp_matches(concat(' ', translate(replace(lower(concat_ws(' ', caption, folder, coalesce(location, ''), coalesce(event_name, ''), tag, note)), 'ß', 'ss'), 'äöü', 'aou')), '[^a-z0-9]noti')"),
}


def _form_query(name: str) -> None:
    form, condition = FORMS[name]

    @query(f"fl3_search_form_{name}", oracle("v_people v_rows", f" SELECT asset_id FROM v_rows WHERE trashed_at IS NULL AND {condition}"))
    def run(spark, sf_dir):
        people = _people(spark, sf_dir)
        view(spark, sf_dir, "v_rows").createOrReplaceTempView("v_rows")
        numbers = spark.sql("SELECT asset_id, explode(array(p1, p2)) AS c_custkey FROM v_rows").join(spark.table("v_people").select("c_custkey", "id"), "c_custkey")
        held = numbers.groupBy("asset_id").agg(F.collect_set("id").alias("person_ids"))
        rows = spark.table("v_rows").join(held, "asset_id", "left").withColumn("tags", F.array("tag")).withColumn("annotations", F.array("note"))
        return S.search(rows, form, people).select("asset_id")


for _name in FORMS:
    _form_query(_name)


# Faces of persons; requests come from the faces themselves: some are assigned, moved, put aside, freed, and one person is dissolved.
SQL["v_named_faces"] = f"SELECT face_id, photo_id, person_id, CASE WHEN person_id IS NOT NULL THEN concat('Name ', person_id) END AS person_name, label FROM ({SQL['v_faces']}) f"
REQUESTS = """SELECT face_id AS seq, CASE face_id % 9 WHEN 0 THEN 'assign' WHEN 1 THEN 'move' WHEN 2 THEN 'skip' WHEN 3 THEN 'unassign' WHEN 4 THEN 'ignore' ELSE 'create' END AS action, face_id, CASE WHEN face_id % 9 = 0 THEN concat('p', CAST(label % 3 AS VARCHAR(9))) END AS person_id, CASE WHEN face_id % 9 = 1 THEN 'Änne Groß' WHEN face_id % 9 = 6 THEN ' New one ' WHEN face_id % 9 = 7 THEN ' ' END AS name
    FROM v_named_faces WHERE face_id % 2 = 0 UNION ALL SELECT 100, 'dissolve', NULL, 'p1', NULL UNION ALL SELECT 5000000000, 'unassign', face_id, NULL, NULL FROM v_named_faces WHERE face_id % 50 = 0 UNION ALL SELECT 7, 'assign', -5, 'p2', NULL"""
AFTER = f""", q AS ({REQUESTS}), n AS (SELECT person_id, arg_min(person_name, face_id) AS name FROM v_named_faces WHERE person_id IS NOT NULL GROUP BY 1),
    s AS (SELECT seq, face_id, CASE action WHEN 'assign' THEN q.person_id WHEN 'skip' THEN '_skipped' WHEN 'ignore' THEN '_ignored' WHEN 'unassign' THEN NULL ELSE CASE trim(q.name) WHEN 'Änne Groß' THEN 'aenne-gross' WHEN 'New one' THEN 'new-one' END END AS person, CASE action WHEN 'assign' THEN coalesce(n.name, q.person_id) WHEN 'skip' THEN 'skipped' WHEN 'ignore' THEN 'ignored' WHEN 'unassign' THEN NULL ELSE trim(q.name) END AS called
        FROM q LEFT JOIN n ON n.person_id = q.person_id WHERE action <> 'dissolve' AND (action NOT IN ('move', 'create') OR trim(coalesce(q.name, '')) <> '') UNION ALL SELECT q.seq, f.face_id, NULL, NULL FROM q JOIN v_named_faces f ON f.person_id = q.person_id WHERE action = 'dissolve'),
    l AS (SELECT face_id, arg_max({{'p': person, 'n': called}}, seq) AS x FROM s GROUP BY face_id),
    a AS (SELECT f.face_id, photo_id, CASE WHEN x IS NULL THEN person_id ELSE x.p END AS person_id, CASE WHEN x IS NULL THEN person_name ELSE x.n END AS person_name, x IS NOT NULL AND x.p IS DISTINCT FROM person_id AS changed FROM v_named_faces f LEFT JOIN l ON f.face_id = l.face_id)"""
TOLD = "SELECT photo_id, list(person_id ORDER BY person_id) AS person_ids, list(name ORDER BY person_id) AS person_names FROM (SELECT photo_id, person_id, arg_min(person_name, face_id) AS name FROM {0} WHERE person_id IS NOT NULL AND NOT starts_with(person_id, '_') GROUP BY 1, 2) t GROUP BY photo_id"


def _faces(spark, sf_dir):
    faces = view(spark, sf_dir, "v_named_faces")
    faces.createOrReplaceTempView("v_named_faces")
    return faces.select("face_id", "photo_id", "person_id", "person_name")


def _photos(faces):
    """Photos as they were: the persons of their faces."""
    pairs = faces.select("photo_id").distinct().withColumn("person_ids", F.array().cast("array<string>")).withColumn("person_names", F.array().cast("array<string>"))
    told = P.photo_persons(faces, pairs)
    return pairs.select("photo_id").join(told, "photo_id", "left")


@query("cu3_assigned_faces", oracle("v_named_faces", "").rstrip() + AFTER + " SELECT face_id, person_id, person_name, changed FROM a")
def cu3_faces(spark, sf_dir):
    """All faces after many requests at once."""
    faces = _faces(spark, sf_dir)
    return P.assigned(faces, spark.sql(REQUESTS)).select("face_id", "person_id", "person_name", "changed")


@query("ag16_changed_photos", oracle("v_named_faces", "").rstrip() + AFTER + f", was AS ({TOLD.format('v_named_faces')}), now AS ({TOLD.format('a')}), p AS (SELECT DISTINCT photo_id FROM v_named_faces) SELECT p.photo_id, coalesce(now.person_ids, []) AS person_ids, coalesce(now.person_names, []) AS person_names FROM p LEFT JOIN was ON was.photo_id = p.photo_id LEFT JOIN now ON now.photo_id = p.photo_id WHERE coalesce(was.person_ids, []) <> coalesce(now.person_ids, []) OR coalesce(was.person_names, []) <> coalesce(now.person_names, [])")
def ag16_changed(spark, sf_dir):
    """The photos whose persons these requests change."""
    faces = _faces(spark, sf_dir)
    return P.photo_persons(P.assigned(faces, spark.sql(REQUESTS)), _photos(faces))


RENAMES = [("p1", "Änne Groß"), ("p2", "Name p3"), ("p4", "  "), ("p9x", "Nobody"), ("p5", "P5")]
MAPPED = "m(old, name, id) AS (VALUES ('p1', 'Änne Groß', 'aenne-gross'), ('p2', 'Name p3', 'name-p3'), ('p5', 'P5', 'p5'))"


@query("cu4_renamed_photos", oracle("v_named_faces", "").rstrip() + f""", was AS ({TOLD.format('v_named_faces')}), {MAPPED},
    e AS (SELECT photo_id, list_transform(person_ids, lambda x: coalesce((SELECT id FROM m WHERE old = x), x)) AS ids, list_transform(person_names, lambda x: coalesce((SELECT name FROM m WHERE concat('Name ', old) = x), x)) AS names, list_transform(list_sort(list_filter(person_ids, lambda x: x IN ('p1', 'p2', 'p5'))), lambda x: (SELECT name FROM m WHERE old = x)) AS added FROM was WHERE list_has_any(person_ids, ['p1', 'p2', 'p5'])),
    o AS (SELECT photo_id, ids, list_concat(names, added) AS names FROM e)
    SELECT photo_id, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS person_ids, list_filter(names, lambda x, i: list_position(names, x) = i) AS person_names FROM o""".replace("(SELECT id FROM m WHERE old = x)", "CASE x WHEN 'p1' THEN 'aenne-gross' WHEN 'p2' THEN 'name-p3' WHEN 'p5' THEN 'p5' END").replace("(SELECT name FROM m WHERE concat('Name ', old) = x)", "CASE x WHEN 'Name p1' THEN 'Änne Groß' WHEN 'Name p2' THEN 'Name p3' WHEN 'Name p5' THEN 'P5' END").replace("(SELECT name FROM m WHERE old = x)", "CASE x WHEN 'p1' THEN 'Änne Groß' WHEN 'p2' THEN 'Name p3' WHEN 'p5' THEN 'P5' END"))
def cu4_photos(spark, sf_dir):
    """The photos that renamed persons are on, with both lists made distinct."""
    faces = _faces(spark, sf_dir)
    meta = spark.createDataFrame([], "person_id string, note string")
    return P.renamed(faces, _photos(faces), meta, spark.createDataFrame(RENAMES, "person_id string, name string"))[1]


@query("cu4_renamed_faces", oracle("v_named_faces", "").rstrip() + f", {MAPPED} SELECT face_id, m.id AS person_id, m.name AS person_name FROM v_named_faces JOIN m ON old = person_id")
def cu4_faces(spark, sf_dir):
    """The faces of renamed persons."""
    faces = _faces(spark, sf_dir)
    meta = spark.createDataFrame([], "person_id string, note string")
    return P.renamed(faces, _photos(faces), meta, spark.createDataFrame(RENAMES, "person_id string, name string"))[0].select("face_id", "person_id", "person_name")


# Spans by day: all are named, some again, some forgotten, some merged with the next day's, some rejected with it.
SPANS = """WITH d AS (SELECT channel, CAST(start_at AS TIMESTAMP) AS s, CAST(end_at AS TIMESTAMP) AS e, row_number() OVER (PARTITION BY channel ORDER BY start_at) AS n FROM v_spans), p AS (SELECT d.*, lead(s) OVER (PARTITION BY channel ORDER BY n) AS s2, lead(e) OVER (PARTITION BY channel ORDER BY n) AS e2 FROM d)"""
STEPS = """SELECT n AS seq, 'name' AS action, channel, s AS start_at, e AS end_at, concat(' ', channel, ' ') AS name, n AS photos, CAST(NULL AS VARCHAR(9)) AS other_channel, CAST(NULL AS TIMESTAMP) AS other_start, CAST(NULL AS TIMESTAMP) AS other_end FROM p
    UNION ALL SELECT 1000 + n, 'name', channel, s, e, CASE WHEN n % 6 = 0 THEN ' ' ELSE 'again' END, 9, NULL, NULL, NULL FROM p WHERE n % 3 = 0 UNION ALL SELECT 2000 + n, 'forget', channel, s, e, NULL, NULL, NULL, NULL, NULL FROM p WHERE n % 5 = 0
    UNION ALL SELECT 3000 + n, 'merge', channel, s, e, 'both', 7, channel, s2, e2 FROM p WHERE n % 4 = 1 AND s2 IS NOT NULL UNION ALL SELECT 4000 + n, 'reject', channel, s, e, NULL, NULL, channel, s2, e2 FROM p WHERE n % 4 = 2 AND s2 IS NOT NULL
    UNION ALL SELECT 5000 + n, 'reject', channel, s2, e2, NULL, NULL, channel, s, e FROM p WHERE n % 4 = 2 AND s2 IS NOT NULL"""


def _steps(spark, sf_dir):
    view(spark, sf_dir, "v_spans").createOrReplaceTempView("v_spans")
    return spark.sql(f"{SPANS} {STEPS}")


@query("cu7_registry_spans", SPANS.replace("WITH d", f"WITH v_spans AS ({SQL['v_spans']}), d") + f""", q AS ({STEPS}), x AS (SELECT channel, s, e, n, CASE WHEN n % 3 = 0 AND n % 6 <> 0 THEN 'again' ELSE channel END AS name, CASE WHEN n % 3 = 0 AND n % 6 <> 0 THEN 9 ELSE n END AS photos FROM p),
    g AS (SELECT channel, start_at, end_at FROM q WHERE action IN ('forget', 'merge') UNION SELECT other_channel, other_start, other_end FROM q WHERE action = 'merge')
    SELECT channel, s AS start_at, e AS end_at, name, photos FROM x WHERE (channel, s, e) NOT IN (SELECT channel, start_at, end_at FROM g) UNION ALL SELECT channel, least(start_at, other_start), greatest(end_at, other_end), name, photos FROM q WHERE action = 'merge'""")
def cu7_spans(spark, sf_dir):
    """Which spans bear which name in the end."""
    return P.registry(_steps(spark, sf_dir))[0].select("channel", c("start_at").cast("timestamp_ntz").alias("start_at"), c("end_at").cast("timestamp_ntz").alias("end_at"), "name", "photos")


@query("cu7_rejected_pairs", SPANS.replace("WITH d", f"WITH v_spans AS ({SQL['v_spans']}), d") + f", q AS ({STEPS}) SELECT channel, count(DISTINCT least(start_at, other_start)) AS pairs FROM q WHERE action = 'reject' GROUP BY channel")
def cu7_rejects(spark, sf_dir):
    """How many pairs of a channel were rejected, whichever came first."""
    return P.registry(_steps(spark, sf_dir))[1].groupBy(F.substring_index("a", "|", 1).alias("channel")).agg(F.count("*").alias("pairs"))


SQL["v_shelf"] = f"SELECT asset_id, path, CASE WHEN asset_id % 3 = 0 THEN concat('ev ', CAST(asset_id % 2 AS VARCHAR(9))) WHEN asset_id % 3 = 1 THEN ' ' END AS event FROM ({SQL['v_paths']}) p"
ALBUM = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


@query("ag7_album_list", oracle("v_shelf", f""", a AS (SELECT {ALBUM} AS path, asset_id, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS folder, nullif(trim(event), '') AS event FROM v_shelf), e AS (SELECT path, list(event ORDER BY at1) AS event_names FROM (SELECT path, event, min(asset_id) AS at1 FROM a WHERE event IS NOT NULL GROUP BY 1, 2) q GROUP BY 1),
    b AS (SELECT path, arg_min(folder, asset_id) AS folder_name, count(*) AS photos, count(event) AS named, min(asset_id) AS cover FROM a GROUP BY path), m AS (SELECT b.*, coalesce(event_names, []) AS event_names, regexp_matches(folder_name, '(?i)^(src[0-9]|camera|dcim|download|new folder|whatsapp images|sent|[0-9]{{3}}[A-Z_]+)$') AS generic FROM b LEFT JOIN e ON b.path = e.path)
    SELECT path, folder_name, photos, named, cover, event_names, generic, NOT generic OR (named >= 0.9 * photos AND len(event_names) = 1) AS rename_whole FROM m"""))
def ag7_list(spark, sf_dir):
    """Each album with its events, and whether it can be renamed as a whole."""
    rows = view(spark, sf_dir, "v_shelf").withColumn("album", PA.folder(c("path"))).withColumn("folder", F.element_at(F.split("album", "/"), -1))
    return P.album_list(rows, "album", "folder", "event", "asset_id", PA.generic(c("folder_name")))


SQL["v_times"] = f"SELECT asset_id, CASE WHEN asset_id % 97 <> 0 THEN taken_at + INTERVAL '1' MONTH * CAST(key % 30 AS INT) END AS taken_at, channel FROM ({SQL['v_stream']}) s WHERE key % 30 < 13 OR asset_id % 50 = 0"
YEARS = """, o AS (SELECT *, CASE WHEN lag(taken_at) OVER w IS NULL OR epoch_us(taken_at) - epoch_us(lag(taken_at) OVER w) > 10800000000 THEN 1 ELSE 0 END AS fresh FROM v_times WHERE taken_at IS NOT NULL WINDOW w AS (PARTITION BY channel ORDER BY taken_at, asset_id)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY channel ORDER BY taken_at, asset_id) AS sid FROM o), s AS (SELECT asset_id, channel, min(taken_at) OVER (PARTITION BY channel, sid) AS start_at FROM g),
    r AS (SELECT v.asset_id, v.channel, start_at, coalesce(strftime(start_at, '%Y'), 'undated') AS year, coalesce(strftime(start_at, '%Y-%m'), '') AS month FROM v_times v LEFT JOIN s ON v.asset_id = s.asset_id)"""


def _timeline(spark, sf_dir):
    rows = view(spark, sf_dir, "v_times")
    at = E.gap_session_starts(rows, "channel", "taken_at", "asset_id").select("asset_id", c("session_start").alias("start_at"))
    rows = rows.select("asset_id", "channel").join(at, "asset_id", "left").withColumn("session", F.when(c("start_at").isNotNull(), F.concat_ws("|", "channel", "start_at")))
    return P.timeline(rows, "session", "start_at", "channel")


@query("ag6_timeline_years", oracle("v_times", "").rstrip() + YEARS + ", n AS (SELECT year, channel, count(*) AS n FROM r GROUP BY 1, 2) SELECT year, CAST(sum(n) AS BIGINT) AS photos, list(concat(channel, '=', n) ORDER BY channel) AS channels FROM n GROUP BY year")
def ag6_years(spark, sf_dir):
    """Rows of each year by channel; those without a time are undated."""
    years, _ = _timeline(spark, sf_dir)
    return years.select("year", "photos", F.transform(F.map_entries("channels"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))).alias("channels"))


@query("ag6_timeline_months", oracle("v_times", "").rstrip() + YEARS + ", m AS (SELECT year, month, count(*) AS photos, count(DISTINCT CASE WHEN start_at IS NOT NULL THEN concat(channel, start_at) END) AS events FROM r GROUP BY 1, 2) SELECT year, month, photos, events FROM m WHERE year IN (SELECT year FROM m GROUP BY year HAVING sum(photos) >= 60 AND count(*) >= 2)")
def ag6_months(spark, sf_dir):
    """The months of years that have enough rows to be told by months."""
    return _timeline(spark, sf_dir)[1]
