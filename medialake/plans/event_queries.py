"""Registered queries over time-ordered rows."""

from pyspark.sql import functions as F

from medialake.operators import events as E
from medialake.registry import query
from medialake.sources.views import oracle, view

SESSIONS = """, o AS (SELECT *, CASE WHEN lag(taken_at) OVER w IS NULL OR epoch_us(taken_at) - epoch_us(lag(taken_at) OVER w) > 10800000000 THEN 1 ELSE 0 END AS fresh FROM v_stream WHERE taken_at IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY taken_at, asset_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY taken_at, asset_id) AS sid FROM o),
s AS (SELECT key, min(taken_at) AS start_at, max(taken_at) AS end_at, count(*) AS size, (epoch_us(max(taken_at)) - epoch_us(min(taken_at))) / 6e7 AS span_minutes FROM g GROUP BY key, sid),
k AS (SELECT *, concat('ev-', key, '-', strftime(start_at, '%Y%m%dT%H%M%S'), '-', lpad(CAST(size AS VARCHAR), 4, '0')) AS event_key FROM s)"""


def sessions_sql(body: str, more: str = "") -> str:
    return oracle("v_stream" + more, "").rstrip() + SESSIONS + " " + body


def _sessions(spark, sf_dir):
    return E.gap_sessions(view(spark, sf_dir, "v_stream"), "key", "taken_at", "asset_id")


@query("wn1_gap_sessions", sessions_sql("SELECT key, start_at, end_at, size, round(span_minutes, 6) AS span_minutes FROM k"))
def wn1(spark, sf_dir):
    return _sessions(spark, sf_dir).select("key", "start_at", "end_at", "size", F.round("span_minutes", 6).alias("span_minutes"))


@query("wn3_event_keys", sessions_sql("SELECT event_key FROM k"))
def wn3(spark, sf_dir):
    return _sessions(spark, sf_dir).select("event_key")


@query("wn2_day_events", oracle("v_daily", "SELECT channel, CAST(taken_at AS DATE) AS day, count(*) AS size FROM v_daily GROUP BY 1, 2"))
def wn2(spark, sf_dir):
    return E.day_events(view(spark, sf_dir, "v_daily"), "channel", "taken_at")


@query("ag5_session_metrics", sessions_sql("SELECT count(*) AS events, CAST(sum(size) AS BIGINT) AS assets, count(*) FILTER (size = 1) AS singles, list_sort(list(size))[CAST(floor(count(*) / 2) AS INT) + 1] AS median_size, max(size) AS largest FROM k"))
def ag5(spark, sf_dir):
    return E.session_metrics(_sessions(spark, sf_dir))


@query("tk3_largest_sessions", sessions_sql("SELECT event_key, size FROM k WHERE size >= 2 ORDER BY size DESC, event_key LIMIT 50"))
def tk3(spark, sf_dir):
    return _sessions(spark, sf_dir).where("size >= 2").orderBy(F.desc("size"), "event_key").limit(50).select("event_key", "size")


@query("tk1_session_page", sessions_sql("SELECT event_key, size, (SELECT count(*) FROM k) AS total FROM k ORDER BY event_key LIMIT 20 OFFSET 40"))
def tk1(spark, sf_dir):
    from medialake.operators.paging import page

    return page(_sessions(spark, sf_dir).select("event_key", "size"), ["event_key"], 40, 20)


@query("wn6_neighbour_sessions", sessions_sql(", p AS (SELECT event_key, lead(event_key) OVER w AS next_key, (epoch_us(lead(start_at) OVER w) - epoch_us(end_at)) / 3.6e9 AS gap_h FROM k WINDOW w AS (PARTITION BY key ORDER BY start_at)) SELECT event_key, next_key, round(gap_h, 4) AS gap_h, round(1 + (12.0 - gap_h) / 12.0, 4) AS score FROM p WHERE gap_h > 3 AND gap_h <= 12"))
def wn6(spark, sf_dir):
    return E.neighbours(_sessions(spark, sf_dir), "key")


CHANNEL_SESSIONS = SESSIONS.replace("PARTITION BY key", "PARTITION BY channel").replace("SELECT key,", "SELECT channel,").replace("GROUP BY key", "GROUP BY channel").replace("'ev-', key", "'ev-', channel")


@query(
    "jn5_overlap_names",
    oracle("v_stream v_spans", "").rstrip() + CHANNEL_SESSIONS.replace("10800000000", "600000000") + """,
    m AS (SELECT event_key, name, v.start_at AS s0, CASE WHEN k.start_at = k.end_at THEN CASE WHEN v.start_at <= k.start_at AND k.start_at <= v.end_at THEN 1.0 ELSE 0.0 END
        ELSE (least(epoch_us(k.end_at), epoch_us(v.end_at)) - greatest(epoch_us(k.start_at), epoch_us(v.start_at))) / (epoch_us(k.end_at) - epoch_us(k.start_at)) END AS share FROM k JOIN v_spans v USING (channel)),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY share DESC, s0, name) AS n FROM m WHERE share >= 0.5)
    SELECT event_key, name, CAST(round(share, 6) AS DOUBLE) AS share FROM r WHERE n = 1""",
)
def jn5(spark, sf_dir):
    sessions = E.gap_sessions(view(spark, sf_dir, "v_stream"), "channel", "taken_at", "asset_id", 600)
    return E.overlapping(sessions, view(spark, sf_dir, "v_spans"))


@query("jn7_rows_in_spans", oracle("v_stream v_spans", "SELECT s.asset_id, n.name FROM v_stream s JOIN v_spans n ON s.channel = n.channel AND taken_at BETWEEN start_at AND end_at"))
def jn7(spark, sf_dir):
    return E.within(view(spark, sf_dir, "v_stream"), view(spark, sf_dir, "v_spans")).select("asset_id", "name")


@query(
    "jn6_near_time_pairs",
    oracle("v_stream", "SELECT a.asset_id AS left_id, b.asset_id AS right_id, round(abs(epoch_us(a.taken_at) - epoch_us(b.taken_at)) / 1e6, 3) AS apart_s FROM v_stream a JOIN v_stream b ON abs(epoch_us(a.taken_at) - epoch_us(b.taken_at)) <= 2000000 AND a.asset_id <> b.asset_id WHERE a.channel = 'click' AND b.channel <> 'click'"),
)
def jn6(spark, sf_dir):
    s = view(spark, sf_dir, "v_stream")
    return E.near_pairs(s.where("channel = 'click'"), s.where("channel <> 'click'"), "asset_id", "taken_at", 2)


CLOCK = """, y AS (SELECT album, extract(year FROM taken_at) AS year, count(*) AS n FROM v_clock GROUP BY 1, 2),
    a AS (SELECT album, sum(n) AS total, max(n) AS most, arg_max(year, n * 10000 + year) AS year FROM y GROUP BY album HAVING sum(n) >= 8 AND max(n) * 2 >= sum(n)),
    r AS (SELECT v.album, taken_at, most, row_number() OVER (PARTITION BY v.album ORDER BY taken_at) AS k FROM v_clock v JOIN a ON v.album = a.album AND extract(year FROM taken_at) = a.year),
    c AS (SELECT album, taken_at AS centre FROM r WHERE k = CAST(floor(most / 2) AS BIGINT) + 1),
    o AS (SELECT v.album, model, (epoch_us(taken_at) - epoch_us(centre)) / 8.64e10 AS off FROM v_clock v JOIN c ON v.album = c.album),
    f AS (SELECT album, model, count(*) AS n, max(off) - min(off) <= 2 AS same, median(off) AS middle FROM o WHERE abs(off) > 365 GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("wn11_wrong_clocks", oracle("v_clock", "").rstrip() + CLOCK + " SELECT album, model, n, CASE WHEN same THEN 'constant' ELSE 'fallen back' END AS verdict, CASE WHEN same THEN round(middle, 4) END AS offset_days FROM f")
def wn11(spark, sf_dir):
    return E.wrong_clocks(view(spark, sf_dir, "v_clock"), "album", "model", "taken_at")


@query("wn12_clock_evidence", oracle("v_clock", "").rstrip() + CLOCK + " SELECT model, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT album) AS albums FROM f GROUP BY model")
def wn12(spark, sf_dir):
    return wn11(spark, sf_dir).groupBy("model").agg(F.sum("n").alias("n"), F.countDistinct("album").alias("albums"))
