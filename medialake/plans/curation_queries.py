"""Registered queries over change sets."""

from pyspark.sql import functions as F

from medialake.operators import curation as C
from medialake.registry import query, table
from medialake.sources.views import oracle, view


@query("cu1_soft_delete", oracle("v_assets", "SELECT asset_id, trashed_at IS NOT NULL OR asset_id IN (SELECT item_id FROM benchmark) AS trashed FROM v_assets"))
def cu1(spark, sf_dir):
    marked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("asset_id"), F.lit(True).alias("mark"))
    return view(spark, sf_dir, "v_assets").join(marked, "asset_id", "left").select("asset_id", (F.col("trashed_at").isNotNull() | F.coalesce("mark", F.lit(False))).alias("trashed"))


@query("cu2_purge_plan", oracle("v_assets v_faces", "SELECT v, count(*) AS n, CAST(sum(faces) AS BIGINT) AS faces FROM (SELECT asset_id, CASE WHEN trashed_at IS NULL THEN 'skipped' WHEN folder = 'src3' THEN 'outside' ELSE 'delete' END AS v, coalesce(faces, 0) AS faces FROM v_assets LEFT JOIN (SELECT photo_id, count(*) AS faces FROM v_faces GROUP BY 1) ON photo_id = asset_id) GROUP BY v").replace("SELECT v,", "SELECT v AS verdict,"))
def cu2(spark, sf_dir):
    faces = view(spark, sf_dir, "v_faces").groupBy(F.col("photo_id").alias("asset_id")).agg(F.count("*").alias("faces"))
    verdict = F.when(F.col("trashed_at").isNull(), "skipped").when(F.col("folder") == "src3", "outside").otherwise("delete")
    return view(spark, sf_dir, "v_assets").join(faces, "asset_id", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.coalesce(F.sum("faces"), F.lit(0)).alias("faces"))


@query("cu3_assignments", oracle("v_faces", "SELECT face_id, CASE WHEN face_id % 6 = 0 THEN 'p99' WHEN face_id % 10 = 0 THEN NULL ELSE person_id END AS person_id FROM v_faces"))
def cu3(spark, sf_dir):
    faces = view(spark, sf_dir, "v_faces")
    first = faces.where("face_id % 10 = 0").select("face_id", F.lit(None).cast("string").alias("assigned"), F.lit(1).alias("at"))
    second = faces.where("face_id % 6 = 0").select("face_id", F.lit("p99").alias("assigned"), F.lit(2).alias("at"))
    changes = C.latest(first.union(second), ["face_id"], ["at"])
    return faces.join(changes, "face_id", "left").select("face_id", F.when(F.col("at").isNotNull(), F.col("assigned")).otherwise(F.col("person_id")).alias("person_id"))


@query("cu4_rename_person", oracle("v_faces", "SELECT person_id, count(*) AS n FROM (SELECT CASE WHEN person_id = 'p3' THEN 'p4' ELSE person_id END AS person_id FROM v_faces) GROUP BY 1"))
def cu4(spark, sf_dir):
    return view(spark, sf_dir, "v_faces").groupBy(F.when(F.col("person_id") == "p3", "p4").otherwise(F.col("person_id")).alias("person_id")).agg(F.count("*").alias("n"))


@query("cu7_registry_upsert", oracle("v_spans", "SELECT channel, name, min(start_at) AS start_at, max(end_at) AS end_at FROM (SELECT * FROM v_spans UNION ALL SELECT name, channel, start_at - INTERVAL '1' HOUR, end_at FROM v_spans WHERE channel = 'click') GROUP BY 1, 2"))
def cu7(spark, sf_dir):
    spans = view(spark, sf_dir, "v_spans")
    more = spans.where("channel = 'click'").withColumn("start_at", F.expr("start_at - INTERVAL '1' HOUR"))
    return spans.unionByName(more).groupBy("channel", "name").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"))


@query("cu8_move_plan", "SELECT doc_id, CASE WHEN n = 0 THEN name ELSE concat(regexp_extract(name, '^(.*)\\.', 1), '-', CAST(n AS VARCHAR), '.txt') END AS target FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY source, name ORDER BY doc_id) - 1 AS n FROM (SELECT doc_id, source, concat(lang, '_', CAST(doc_id % 10 AS VARCHAR), '.txt') AS name FROM documents))")
def cu8(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("lang", F.lit("_"), (F.col("doc_id") % 10).cast("string"), F.lit(".txt")).alias("name"))
    return C.collision_free(rows, "source", "name", "doc_id").select("doc_id", "target")


@query("cu10_overrides", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, CASE WHEN l.toxic = 1 THEN 'toxic' END, d.lang) AS tag FROM documents d LEFT JOIN labels l USING (doc_id)")
def cu10(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.col("lang")).alias("tag"))


@query("cu12_backfill_verdicts", "SELECT v AS verdict, count(*) AS n FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 4 = 0 THEN 'todo' WHEN doc_id % 33 = 0 THEN 'diverging' ELSE 'ok' END AS v FROM documents) GROUP BY 1")
def cu12(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    now = F.when(F.col("doc_id") % 9 != 0, F.sha2("text", 256))
    was = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 33 == 0, F.lit("other")).otherwise(F.sha2("text", 256))
    return C.verdicts(d, was, now)


@query("cu13_day_shifts", "SELECT CASE WHEN d = 0 THEN 'unchanged' WHEN CAST(ts AS DATE) = CAST(ts + to_seconds(d) AS DATE) THEN 'time' ELSE 'day' END AS verdict, count(*) AS n FROM (SELECT ts, (event_id % 4) * 7200 AS d FROM events) GROUP BY 1")
def cu13(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("new", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((F.col("event_id") % 4) * 7200).cast("decimal(18,6)")))
    verdict = F.when(F.col("new") == F.col("ts"), "unchanged").when(F.to_date("new") == F.to_date("ts"), "time").otherwise("day")
    return e.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("cu16_night", "SELECT event_type, count(*) AS n, min(event_id) AS sample FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1")
def cu16(spark, sf_dir):
    return table(spark, sf_dir, "events").where((F.col("ts") >= F.lit("2024-01-15").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-16").cast("timestamp"))).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("sample"))


@query("cu17_changed_documents", "SELECT doc_id FROM documents WHERE length(trim(text)) > 0 AND sha256(concat(text, source)) <> sha256(concat(text, CASE WHEN doc_id % 6 = 0 THEN 'moved' ELSE source END))")
def cu17(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0)
    return d.where(F.sha2(F.concat("text", "source"), 256) != F.sha2(F.concat("text", F.when(F.col("doc_id") % 6 == 0, "moved").otherwise(F.col("source"))), 256)).select("doc_id")
