"""The operators' queries against their SQL, on the smallest tables."""

import zlib
from collections import Counter

import duckdb
import pytest

from medialake.llm import oracles, queries
from tests.test_queries import SF, TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_checksums_in_sql():
    for text in ("1", "12:größe", "7:ÿÀ", "9" * 40):
        assert duckdb.connect().execute(f"SELECT {oracles.crc32_sql(chr(39) + text + chr(39))}").fetchone()[0] == zlib.crc32(text.encode())
