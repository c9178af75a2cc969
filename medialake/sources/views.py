"""Media-shaped views of the given tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.registry import table

# Each view once, in SQL that both engines read the same way. Path templates by doc_id % 8.
SQL = {
    "v_stream": "SELECT event_id AS asset_id, ts AS taken_at, user_id AS key, event_type AS channel FROM events",
    "v_daily": "SELECT o_orderkey AS asset_id, date_trunc('day', o_orderdate) AS taken_at, o_orderpriority AS channel FROM orders",
    "v_paths": """
        SELECT doc_id AS asset_id, n_chars AS size, CASE doc_id % 8
            WHEN 0 THEN concat('/mnt/photo/Handys/', source, '/WhatsApp Images/IMG-2019', lpad(CAST(1 + doc_id % 12 AS VARCHAR(9)), 2, '0'), lpad(CAST(1 + doc_id % 28 AS VARCHAR(9)), 2, '0'), '-WA', lpad(CAST(doc_id % 10000 AS VARCHAR(9)), 4, '0'), '.jpg')
            WHEN 1 THEN concat('/mnt/photo/Handys/', source, '/WhatsApp Images/Sent/IMG-2020', lpad(CAST(1 + doc_id % 12 AS VARCHAR(9)), 2, '0'), '15-WA', lpad(CAST(doc_id % 10000 AS VARCHAR(9)), 4, '0'), '.jpg')
            WHEN 2 THEN concat('/mnt/photo/Handys/', source, '/Screenshot_2021', lpad(CAST(1 + doc_id % 12 AS VARCHAR(9)), 2, '0'), '03.png')
            WHEN 3 THEN concat('/mnt/photo/Handys/', source, '/Download/file', CAST(doc_id AS VARCHAR(9)), '.JPG')
            WHEN 4 THEN concat('/mnt/photo/Fotos/', source, ' 2018/100CANON/IMG_', lpad(CAST(doc_id % 10000 AS VARCHAR(9)), 4, '0'), '.CR2')
            WHEN 5 THEN concat('/mnt/photo/Fotos/', source, '/VID_2025', lpad(CAST(1 + doc_id % 12 AS VARCHAR(9)), 2, '0'), '09_173920_00_031.mp4')
            WHEN 6 THEN concat('/mnt/photo/Fotos/', source, '/2017-', lpad(CAST(1 + doc_id % 12 AS VARCHAR(9)), 2, '0'), '-21 walk ', CAST(doc_id AS VARCHAR(9)), '.jpeg')
            ELSE concat('/mnt/photo/Fotos/', source, '/plain', CAST(doc_id AS VARCHAR(9)), '.heic') END AS path
        FROM documents""",
    "v_assets": """
        SELECT d.doc_id AS asset_id, d.source AS folder, d.text AS caption, d.lang, l.quality, l.toxic, d.n_chars,
            CASE WHEN d.doc_id % 17 = 0 THEN TIMESTAMP '2025-01-01 00:00:00' END AS trashed_at,
            CASE WHEN d.doc_id % 5 = 0 THEN concat('event ', CAST(d.doc_id % 40 AS VARCHAR(9))) END AS event_name,
            CASE WHEN d.doc_id % 11 = 0 THEN 'video' WHEN d.doc_id % 2 = 0 THEN 'photo' END AS kind,
            CASE WHEN d.doc_id % 7 = 0 THEN concat('p', CAST(d.doc_id % 9 AS VARCHAR(9))) WHEN d.doc_id % 13 = 0 THEN '_ignored' END AS person_id
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_faces": """
        SELECT vec_id AS face_id, CAST(floor(vec_id / 3) AS BIGINT) AS photo_id, label,
            CASE WHEN vec_id % 31 = 0 THEN '_ignored' WHEN vec_id % 3 = 0 THEN concat('p', CAST(label AS VARCHAR(9))) END AS person_id,
            0.5 + CAST(vec_id % 50 AS DOUBLE) / 100 AS score, 20 + vec_id % 200 AS px,
            CASE WHEN vec_id % 4 <> 0 THEN CAST(vec_id % 10 AS DOUBLE) / 10 END AS frontality
        FROM embeddings""",
    "v_spans": """
        SELECT concat(event_type, ' ', CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR(10))) AS name, event_type AS channel, min(ts) AS start_at, max(ts) AS end_at
        FROM events WHERE extract(day FROM ts) % 2 = 0 GROUP BY event_type, date_trunc('day', ts)""",
    "v_clock": """
        SELECT o_orderkey AS asset_id, concat(CAST(c_nationkey AS VARCHAR(9)), ' ', CAST(extract(year FROM o_orderdate) AS VARCHAR(9))) AS album, o_orderpriority AS model,
            CASE WHEN o_orderkey % 4 = 0 AND o_orderpriority LIKE '1-%' THEN o_orderdate - INTERVAL '1400' DAY
                 WHEN o_orderpriority LIKE '2-%' AND o_orderkey % 4 = 0 THEN TIMESTAMP '1985-01-01 00:00:00' ELSE o_orderdate END AS taken_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_jobs": """
        SELECT conv_id AS job_id, concat('kind', CAST(conv_id % 4 AS VARCHAR(9))) AS kind, CASE WHEN conv_id % 10 = 0 THEN 'running' WHEN conv_id % 7 = 0 THEN 'aborted' ELSE 'done' END AS status,
            count(*) AS processed, max(turn) + 2 AS total, conv_id * 60 AS started_at, conv_id * 60 + 10 * count(*) AS updated_at
        FROM conversations GROUP BY conv_id""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, over the tables in ``sf_dir``."""
    text = SQL[name]
    for source in ("events", "orders", "documents", "labels", "embeddings", "customer", "conversations"):
        if source in text:
            table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(text)


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_faces`` with the vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("face_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return view(spark, sf_dir, "v_faces").join(vectors, "face_id")


def oracle(names: str, body: str) -> str:
    """A DuckDB query over the named views."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + " " + body
