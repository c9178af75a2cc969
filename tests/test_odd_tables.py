"""Queries against their SQL on small tables that hold rows which the given ones lack."""

import duckdb
import pytest
from test_queries import plain

from medialake import registry

registry.load()
VECTORS = "SELECT i AS vec_id, [cos(i), sin(i), 0.1]::FLOAT[] AS embedding, 1::INTEGER AS label FROM (SELECT unnest([0, 1, 2, 3, 48, 100, 1449]) AS i)"


def against(spark, folder, name, tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = con.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in registry.QUERIES[name](spark, str(folder)).collect()), key=str)
    assert got == want and want
    return got


def test_cover_of_a_person_weighs_score_against_id(spark, tmp_path):
    assert against(spark, tmp_path, "ag2_people", {"embeddings": VECTORS})[0][0] == 48


def test_offsets_are_rounded_as_binary_numbers(spark, tmp_path):
    sizes = {"documents": "SELECT 5 + 8 * n AS doc_id, 's' AS source, '' AS text, n_chars FROM (VALUES (0, 8149), (1, 1013), (2, 1015), (3, 3005), (4, 0), (5, 2999)) v(n, n_chars)"}
    assert (8149 / 1000 * 0.5 > 4.0745) is False and len(against(spark, tmp_path, "pr29_frame_requests", sizes)) == 6


@pytest.mark.parametrize("text", ["étéen", "en", "a en", "aen", "_en", "9en", "ßEnde", "-en"])
def test_words_start_after_anything_but_ascii_word_letters(spark, tmp_path, text):
    rest = "SELECT i AS doc_id, concat('en ', i) AS text FROM (SELECT unnest([1, 2, 48]) AS i)"
    against(spark, tmp_path, "vc2_hybrid_search", {"embeddings": VECTORS, "documents": f"{rest} UNION ALL SELECT 3, '{text}'"})
