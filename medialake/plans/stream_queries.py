"""Registered queries over streams of the given tables' files, each run until its input is used up; and the user's own row functions."""

import uuid

from pyspark.sql import functions as F

from medialake.operators.rowwise import map_rows
from medialake.registry import query, table
from medialake.sources.rules import path_rules
from medialake.storage import shared_dir
from medialake.streaming import jobs as J
from medialake.streaming.changes import ChangeLog

c = F.col
RUNS = "WITH o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 10800000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS sid FROM o), s AS (SELECT event_type, sid, min(ts) AS start_at, max(ts) AS end_at, count(*) AS size FROM g GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)"
BY_USER = RUNS.replace("event_type", "user_id")


def _events(spark, sf_dir, name):
    """The event stream with instants, which watermarks need, in place of clock times."""
    return J.files(spark, sf_dir, "events").select(name, c("ts").cast("timestamp").alias("ts"))


@query("st1_incremental_ingest", "SELECT doc_id, md5(text) AS content, source FROM documents")
def st1(spark, sf_dir):
    """Documents merged batch by batch into versions of a table; the last version."""
    base = f"{shared_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    rows = J.files(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content"), "source")
    started = J.incremental_ingest(rows, f"{base}/rows", "doc_id", ["source"], f"{base}/state")
    started.awaitTermination()
    return spark.read.parquet(f"{base}/rows/v={started.lastProgress['batchId']}").select("doc_id", "content", "source")


CHANGED = """WITH s AS (SELECT doc_id, 1 AS stage, md5(text) AS content, CASE WHEN doc_id % 4 <> 0 THEN source END AS note FROM documents UNION ALL SELECT doc_id, 2, md5(concat(text, ' again')), concat('new ', source) FROM documents WHERE doc_id % 33 = 0 OR doc_id % 8 = 0
    UNION ALL SELECT doc_id, 3, md5(text), '' FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 4, md5(concat(text, ' later')), 'late' FROM documents WHERE doc_id % 50 = 3 UNION ALL SELECT doc_id + 10000000, 4, md5(text), source FROM documents WHERE doc_id % 20 = 0)"""


@query("st1_change_log", CHANGED + " SELECT doc_id, max(stage) AS stage, arg_max(content, stage) AS content, coalesce(arg_min(note, stage) FILTER (note IS NOT NULL AND note <> ''), arg_max(note, stage)) AS note FROM s GROUP BY doc_id")
def st1_log(spark, sf_dir):
    """Documents that arrive in four stages, some changed, some again as they were, some new: several batches, a compaction between them, and the table after all."""
    base = f"{shared_dir(spark).rstrip('/')}/changes-{uuid.uuid4().hex}"
    docs, content = table(spark, sf_dir, "documents"), lambda more="": F.md5(F.concat("text", F.lit(more)))
    stages = [
        docs.select("doc_id", F.lit(1).alias("stage"), content().alias("content"), F.when(c("doc_id") % 4 != 0, c("source")).alias("note")),
        docs.where("doc_id % 33 = 0 or doc_id % 8 = 0").select("doc_id", F.lit(2), content(" again"), F.concat(F.lit("new "), "source")),
        docs.where("doc_id % 7 = 0").select("doc_id", F.lit(3), content(), F.lit("")),
        docs.where("doc_id % 50 = 3").select("doc_id", F.lit(4), content(" later"), F.lit("late")).union(docs.where("doc_id % 20 = 0").select(c("doc_id") + 10_000_000, F.lit(4), content(), "source")),
    ]
    schema = stages[0].schema
    log = ChangeLog(f"{base}/table", schema, "doc_id", "stage", ("note",), buckets=8)
    for number, rows in enumerate(stages):
        rows.toDF(*schema.names).write.mode("append").parquet(f"{base}/inbox")
        if number in (1, 3):
            inbox = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/inbox")
            log.ingest(inbox, f"{base}/state").awaitTermination()
        if number == 1:
            log.compact(spark)
    return log.current(spark)


@query("st2_stream_sessions", BY_USER + " SELECT user_id, start_at, end_at + INTERVAL 3 HOUR AS closes_at, size FROM s, m WHERE end_at + INTERVAL 3 HOUR <= mark")
def st2(spark, sf_dir):
    """The sessions of each user that the watermark, a day behind the newest row, has closed."""
    done = J.drained(J.sessions(_events(spark, sf_dir, "user_id"), "user_id", "ts"))
    return done.select("user_id", c("start_at").cast("timestamp_ntz").alias("start_at"), c("closes_at").cast("timestamp_ntz").alias("closes_at"), "size")


@query("st3_heartbeats", "SELECT conv_id, max(turn) AS latest, count(*) AS beats, (SELECT max(turn) FROM conversations) - max(turn) > 2 AS stale FROM conversations GROUP BY conv_id")
def st3(spark, sf_dir):
    """Each job's latest heartbeat, and whether it is more than two behind the newest of all."""
    beats = J.drained(J.heartbeats(J.files(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id"), "update")
    newest = beats.agg(F.max("latest").alias("newest"))
    return J.stale(beats, newest, 2, "conv_id")


@query("st4_unseen_content", "SELECT DISTINCT sha256(props) AS content_sha256 FROM events")
def st4(spark, sf_dir):
    """Contents that come for the first time within the watermark (a year, which all rows lie in)."""
    return J.drained(J.unseen_content(_events(spark, sf_dir, "props"), "ts", "props", "365 days")).select("content_sha256")


@query("st5_open_events", BY_USER + " SELECT user_id, start_at, end_at, size FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_at DESC) AS n FROM s) q, m WHERE n > 1 OR end_at + INTERVAL 3 HOUR < mark")
def st5(spark, sf_dir):
    """Each user's events that a later row or the watermark has closed."""
    done = J.drained(J.open_events(_events(spark, sf_dir, "user_id"), "user_id", "ts"))
    return done.select("user_id", c("start_at").cast("timestamp_ntz").alias("start_at"), c("end_at").cast("timestamp_ntz").alias("end_at"), "size")


@query("ud1_row_function", "SELECT doc_id, len(string_split(trim(text), ' ')) > 0 AS ok, CAST(length(text) AS VARCHAR) AS result FROM documents")
def ud1(spark, sf_dir):
    """The user's function over every row, in bounded batches."""
    return map_rows(table(spark, sf_dir, "documents"), "doc_id", "text", lambda text: str(len(text))).select("doc_id", "ok", "result")


@query("ud2_poison_rows", "SELECT kind, n, ids FROM (SELECT 'bad' AS kind, count(*) AS n, list(conv_id ORDER BY conv_id, turn)[1:20] AS ids FROM conversations WHERE length(text) % 2 = 1 UNION ALL SELECT 'good', count(*), NULL FROM conversations WHERE length(text) % 2 = 0) q WHERE n > 0")
def ud2(spark, sf_dir):
    """Rows that the user's function fails on are counted and twenty of them told; no other row is lost."""

    def even(text):
        if len(text) % 2:
            raise ValueError("an odd length")
        return "even"

    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    done = map_rows(rows.select(F.to_json("id").alias("id"), "text"), "id", "text", even)
    counts = done.groupBy(F.when(c("ok"), "good").otherwise("bad").alias("kind")).agg(F.count("*").alias("n"))
    at = F.from_json("id", "conv_id long, turn long")
    told = done.where("not ok").select(at.alias("at")).orderBy("at.conv_id", "at.turn").limit(20).agg(F.sort_array(F.collect_list("at")).alias("s")).select(F.lit("bad").alias("kind"), c("s.conv_id").alias("ids"))
    return counts.join(F.broadcast(told), "kind", "left").select("kind", "n", "ids")  # one row of twenty ids


@query("sc2_rule_file", "SELECT concat('/mnt/photo/', source) AS path, source <> 'src3' AS include FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) q")
def sc2(spark, sf_dir):
    """Rules written as lines of text, with a comment, a blank line and one exclusion, read back as a table."""
    path = f"{shared_dir(spark).rstrip('/')}/rules-{uuid.uuid4().hex}"
    sources = table(spark, sf_dir, "documents").where("source is not null").select("source").distinct()
    lines = sources.select(F.explode(F.array(F.lit("# a comment"), F.lit(""), F.concat(F.when(c("source") == "src3", "- ").otherwise(" "), F.lit("/mnt/photo/"), "source"))).alias("value"))
    lines.write.text(path)
    return path_rules(spark, path)
