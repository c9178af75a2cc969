"""Registered queries over folds: event cards that become one series, what a series holds and where it comes from."""

from pyspark.sql import functions as F

from medialake.operators import cards as C
from medialake.operators import events as E
from medialake.operators import folds as D
from medialake.registry import query
from medialake.sources.views import SQL, oracle, view

SQL["v_albums"] = f"""
        SELECT asset_id, taken_at, key, CASE WHEN extract(day FROM taken_at) % 4 = 0 THEN 'camera' ELSE concat('album ', CAST(key % 5 AS VARCHAR(9))) END AS folder,
            CASE WHEN extract(day FROM taken_at) % 9 = 0 THEN '/mnt/photo/other' WHEN key % 3 <> 0 THEN concat('/mnt/photo/album ', CAST(key % 5 AS VARCHAR(9))) END AS path,
            CASE WHEN asset_id % 2 = 0 THEN concat('p', CAST(asset_id % 6 AS VARCHAR(9))) END AS person
        FROM ({SQL["v_stream"]}) s"""
NAMED = "CASE WHEN extract(day FROM start_at) % 5 = 1 THEN 'A' WHEN extract(day FROM start_at) % 5 = 2 THEN 'B' END"
LISTED = "{n} AS (SELECT key, sid, list({n} ORDER BY t, i) AS {n} FROM (SELECT key, sid, {n}, min(taken_at) AS t, arg_min(asset_id, (taken_at, asset_id)) AS i FROM g WHERE {n} IS NOT NULL GROUP BY 1, 2, 3) q GROUP BY 1, 2)"
SERIES = f"""
    WITH RECURSIVE v_albums AS ({SQL["v_albums"]}),
    o AS (SELECT *, CASE WHEN lag(taken_at) OVER w IS NULL OR epoch_us(taken_at) - epoch_us(lag(taken_at) OVER w) > 10800000000 THEN 1 ELSE 0 END AS fresh FROM v_albums WHERE taken_at IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY taken_at, asset_id)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY taken_at, asset_id) AS sid FROM o),
    {", ".join(LISTED.format(n=n) for n in ("folder", "path", "person"))},
    s AS (SELECT key, sid, min(taken_at) AS start_at, max(taken_at) AS end_at, count(*) AS size, list(asset_id ORDER BY taken_at, asset_id)[1:8] AS cover FROM g GROUP BY 1, 2),
    k AS (SELECT s.*, coalesce(folder, []) AS folder, coalesce(path, []) AS path, coalesce(person, []) AS person, concat('ev-', s.key, '-', strftime(start_at, '%Y%m%dT%H%M%S'), '-', lpad(CAST(size AS VARCHAR), 4, '0')) AS event_key,
            {NAMED} AS name, s.key % 11 = 0 AS day_level FROM s LEFT JOIN folder USING (key, sid) LEFT JOIN path USING (key, sid) LEFT JOIN person USING (key, sid)),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start_at, event_key) AS rn FROM k),
    r AS (SELECT key, rn, event_key, event_key AS series, folder AS fs, path AS ps, name AS nm, day_level AS dl, end_at AS en FROM n WHERE rn = 1
        UNION ALL SELECT key, rn, event_key, CASE WHEN j THEN series ELSE event_key END, CASE WHEN j THEN fs ELSE folder END, CASE WHEN j THEN list_distinct(list_concat(ps, path)) ELSE path END, CASE WHEN j THEN nm ELSE name END, CASE WHEN j THEN dl ELSE day_level END, CASE WHEN j THEN greatest(en, end_at) ELSE end_at END
        FROM (SELECT n.*, r.series, fs, ps, nm, dl, en, NOT n.day_level AND NOT dl AND NOT coalesce(n.name <> nm, false) AND len(list_distinct(list_concat(fs, n.folder))) = 1 AND NOT regexp_matches(list_concat(fs, n.folder)[1], '(?i)^(camera|dcim|download)$')
            AND len(list_distinct(list_concat(ps, n.path))) <= 1 AND epoch_us(n.start_at) - epoch_us(en) <= 43200000000 AS j FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1) q),
    m AS (SELECT k.*, series FROM k JOIN r USING (key, event_key))"""
ORDERED = "(SELECT series, list(x ORDER BY start_at, event_key, i) AS {n} FROM (SELECT *, row_number() OVER (PARTITION BY series, x ORDER BY start_at, event_key, i) AS first FROM (SELECT series, start_at, event_key, unnest({n}) AS x, generate_subscripts({n}, 1) AS i FROM m) u) q WHERE first = 1 GROUP BY series) {n}"


def _series(spark, sf_dir):
    made = C.cards(view(spark, sf_dir, "v_albums"), "key", "taken_at", "asset_id", ["folder", "path", "person"])
    made = made.withColumn("name", F.expr(NAMED)).withColumn("day_level", F.col("key") % 11 == 0)
    return D.coalesce(made, "key", lambda folder: folder.lower() in ("camera", "dcim", "download"))


@query("wn4_coalesced_albums", SERIES + " SELECT event_key, series FROM m")
def wn4_albums(spark, sf_dir):
    """Each event card with the series that it becomes part of."""
    return _series(spark, sf_dir).select("event_key", "series")


@query(
    "ag4_series_cards",
    SERIES + f""" SELECT m.series, max(CASE WHEN event_key = m.series THEN name END) AS name, count(*) AS parts, CAST(sum(size) AS BIGINT) AS size, round((epoch_us(max(end_at)) - epoch_us(min(start_at))) / 6e7, 4) AS span_minutes, any_value(coalesce(folder.folder, [])) AS folder,
    any_value(coalesce(path.path, [])) AS path, any_value(coalesce(person.person, [])) AS person, any_value(cover.cover)[1:8] AS cover FROM m LEFT JOIN {ORDERED.format(n="folder")} USING (series) LEFT JOIN {ORDERED.format(n="path")} USING (series) LEFT JOIN {ORDERED.format(n="person")} USING (series) LEFT JOIN {ORDERED.format(n="cover")} USING (series) GROUP BY m.series""",
)
def ag4_series(spark, sf_dir):
    """The card of each series: what its parts hold, ordered and distinct."""
    cards = D.merged(_series(spark, sf_dir), "key", ["folder", "path", "person"])
    span = (E.seconds(F.col("end_at")) - E.seconds(F.col("start_at"))) / 60
    return cards.select("series", "name", "parts", "size", F.round(span, 4).alias("span_minutes"), "folder", "path", "person", "cover")


@query(
    "wn5_series_sources",
    SERIES + """, a AS (SELECT series, g.path, g.folder, coalesce(g.path, concat('folder ', g.folder)) AS place, taken_at, asset_id FROM g JOIN m ON g.key = m.key AND g.sid = m.sid)
    SELECT series, coalesce(max(path), '') AS path, min(folder) AS folder, count(*) AS size, arg_min(asset_id, (taken_at, asset_id)) AS first_id FROM a GROUP BY series, place""",
)
def wn5_sources(spark, sf_dir):
    """The paths, or folders, that the rows of each series come from."""
    rows = E.gap_session_starts(view(spark, sf_dir, "v_albums"), "key", "taken_at", "asset_id")
    series = _series(spark, sf_dir).select(F.col("key").alias("_key"), F.col("start_at").alias("_start"), F.col("series").alias("_series"))
    rows = rows.join(series, (F.col("key") == F.col("_key")) & (F.col("session_start") == F.col("_start")))
    return D.sources(rows, F.col("_series"), "path", "folder", "asset_id", "taken_at")
