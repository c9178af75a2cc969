"""Registered queries over the words of clusters."""

from pyspark.sql import functions as F

from medialake.operators import keywords as K
from medialake.registry import query, table
from medialake.sources.views import oracle, view

# Words that every caption may hold, and names, from the texts of the benchmark.
STOP = ("that", "with", "nicht", "eine", "dans", "para", "una", "the", "und")
RANKED = r""", w AS (SELECT folder AS cluster, asset_id, unnest(list_distinct(regexp_extract_all(lower(caption), '[a-zA-ZÄÖÜäöüß]{4,}'))) AS term FROM v_assets WHERE caption IS NOT NULL AND folder IS NOT NULL),
    k AS (SELECT * FROM w WHERE term NOT IN ('that', 'with', 'nicht', 'eine', 'dans', 'para', 'una', 'the', 'und')),
    n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(left(text, 60)), '[a-zA-ZÄÖÜäöüß]{4,}')) AS word FROM benchmark),
    h AS (SELECT cluster, term, count(*) AS seen FROM k GROUP BY 1, 2), l AS (SELECT cluster, count(DISTINCT asset_id) AS local FROM k GROUP BY 1), t AS (SELECT sum(local) AS total FROM l), d AS (SELECT term, count(*) AS everywhere FROM k GROUP BY 1),
    s AS (SELECT h.cluster, h.term, round(seen / local * ln((seen / local) / (everywhere / total)), 9) AS score FROM h JOIN l ON h.cluster = l.cluster JOIN d ON h.term = d.term, t WHERE seen >= 3 AND seen / local >= 0.05 AND everywhere / total <= 0.2 AND h.term NOT IN (FROM n) AND regexp_replace(h.term, 's$', '') NOT IN (FROM n)),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term DESC) AS rank FROM s)"""
FORM = """(r.term = x OR (least(length(r.term), length(x)) >= 4 AND (CASE WHEN length(r.term) <= length(x) THEN starts_with(x, r.term) OR ends_with(x, r.term) ELSE starts_with(r.term, x) OR ends_with(r.term, x) END))
    OR (least(length(r.term), length(x)) >= greatest(5, greatest(length(r.term), length(x)) - 3) AND left(r.term, greatest(5, greatest(length(r.term), length(x)) - 3)) = left(x, greatest(5, greatest(length(r.term), length(x)) - 3))))"""


def _ranked(spark, sf_dir):
    names = K.name_tokens(table(spark, sf_dir, "benchmark").select(F.substring("text", 1, 60).alias("name")))
    return K.ranked_terms(view(spark, sf_dir, "v_assets"), "folder", "caption", names, spark.createDataFrame([(w,) for w in STOP], "word string"))


@query("tx1_ranked_terms", oracle("v_assets", RANKED + " SELECT cluster, term, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM r"))
def tx1_ranked(spark, sf_dir):
    """All words that tell a folder from the others, best first."""
    return _ranked(spark, sf_dir).select("cluster", "term", "rank", F.round("score", 6).alias("score"))


@query("tx2_distinct_terms", oracle("v_assets", RANKED + f""", g AS (SELECT cluster, 0::BIGINT AS rank, []::VARCHAR[] AS terms FROM (SELECT DISTINCT cluster FROM r) c
    UNION ALL SELECT g.cluster, r.rank, CASE WHEN len(terms) >= 4 OR len(list_filter(terms, lambda x: {FORM})) > 0 THEN terms ELSE list_append(terms, r.term) END FROM g JOIN r ON r.cluster = g.cluster AND r.rank = g.rank + 1)
    SELECT cluster, arg_max(terms, rank) AS terms FROM g GROUP BY cluster""").replace("WITH v_assets", "WITH RECURSIVE v_assets"))
def tx2_terms(spark, sf_dir):
    """Four words for each folder, no two of them forms of one."""
    return K.cluster_terms(_ranked(spark, sf_dir))
