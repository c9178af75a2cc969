"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from medialake.llm import hamming_search, oracles, secrets, sharding, turns, url_filter
from medialake.llm.decontaminate import contaminated
from medialake.llm.html_extract import extract
from medialake.llm.language_id import identify
from medialake.llm.mixing import mix
from medialake.llm.near_dedup import near_duplicates
from medialake.llm.packing import pack
from medialake.llm.substring_dedup import remove_repeats
from medialake.llm.variants import variants

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out():
    """Whether crc32 of the id, as text, modulo 4 is 2."""
    return F.expr("coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, false)")


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    found = identify(_documents(spark, sf_dir), training=~held_out() & F.col("doc_id").isNotNull())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs", "proportions")


@query(
    "op6_substring_dedup",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    p AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 12, 0) + 1)) AS i, ws FROM w),
    g AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS h FROM p),
    f AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (h) WHERE doc_id > least),
    lists AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
    n AS (SELECT doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN lists USING (doc_id))
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
           sha256(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]), ' ')) AS kept_sha256
    FROM n
    """,
)
def op6_substring_dedup(spark, sf_dir):
    return remove_repeats(_documents(spark, sf_dir), window=13, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(
    "op4_near_dedup",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 3], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * same >= 80 * (x.n + y.n - same)),
    ab AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, ab.b FROM r JOIN ab ON r.b = ab.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
    """,
)
def op4_near_dedup(spark, sf_dir):
    return near_duplicates(_documents(spark, sf_dir), shingle=4, percent=80)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, sf_dir):
    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


@query("op3_secret_scan")
def op3_secret_scan(spark, sf_dir):
    findings, _ = secrets.scan(_documents(spark, sf_dir))
    return secrets.digest(findings)


@query("op5_sharding")
def op5_sharding(spark, sf_dir):
    placed = sharding.shard(_documents(spark, sf_dir), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# The rules of the contract.
URL_RULES = [
    url_filter.UrlRule("com", "/en/", "block"),
    url_filter.UrlRule("example.com", "/en/7", "allow"),
    url_filter.UrlRule("net", "/de/", "allow"),
    url_filter.UrlRule("example.net", "/de/8", "block"),
    url_filter.UrlRule("org", "/es/", "block"),
]


@query("op7_url_filter", oracles.OP7)
def op7_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op10_hamming_top_k",
    r"""
    WITH c AS (SELECT vec_id AS id, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    q AS (SELECT id AS query_id, b AS w FROM c WHERE id % 100 = 0),
    d AS (SELECT query_id, id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN b[i] <> w[i] THEN 1 ELSE 0 END)) AS INT) AS distance FROM q, c),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank FROM d)
    SELECT query_id, rank, id AS vec_id, distance FROM r WHERE rank <= 10
    """,
)
def op10_hamming_top_k(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes = vectors.where("embedding is not null").select(F.col("vec_id").alias("id"), hamming_search.sign_code(F.col("embedding"), 64).alias("code"))
    return hamming_search.top_k(codes, codes.where("id % 100 = 0"), k=10, bits=64).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op9_html_extraction")
def op9_html_extraction(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


@query(
    "op11_source_mixing",
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS k FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST)) % 3 WHEN 1 THEN 5.0 WHEN 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM d GROUP BY source),
    level AS (
        SELECT 0 AS i, sum(source_size)::DOUBLE / sum(w) AS l, list({'n': source_size, 'w': w}) AS s, sum(source_size)::DOUBLE AS total FROM s
        UNION ALL
        SELECT i + 1, (total - list_sum(list_transform(s, lambda x: CASE WHEN 3.0 * x.n < l * x.w THEN 3.0 * x.n ELSE 0 END))::DOUBLE) / list_sum(list_transform(s, lambda x: CASE WHEN 3.0 * x.n < l * x.w THEN 0 ELSE x.w END))::DOUBLE, s, total FROM level WHERE i < 40),
    t AS (SELECT source, source_size, least(3.0 * source_size::DOUBLE, w * (SELECT max_by(l, i) FROM level)) AS target FROM s),
    b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS times FROM t),
    c AS (SELECT d.doc_id, size, source_size, target, times, target - times * source_size AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN before + size <= rest OR (before <= rest AND 2 * (rest - before) > size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
    """,
)
def op11_source_mixing(spark, sf_dir):
    return mix(_documents(spark, sf_dir), weights=(5, 2, 1), most=3).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_spelling_variants", oracles.OP13)
def op13_spelling_variants(spark, sf_dir):
    return variants(_documents(spark, sf_dir), least=6, often=5, every=199, share=5)


@query("op12_conversation_repair", oracles.OP12)
def op12_conversation_repair(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.report(conversations, turns.damaged(conversations))
