"""Secret scans, sharding, URL filters and Hamming search against plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from medialake.llm import hamming_search, queries, secrets, sharding, url_filter

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


def plain_spans(text):
    out = []
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def spell(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def agree(rows, texts):
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for doc_id, text in texts.items():
        want = plain_spans(text or "")
        r = got[doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in want) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(spell(want).encode()).hexdigest()
        assert set(filter(None, spell(want).split(","))) <= set(r.spans.split(","))


def test_secrets_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    agree(queries.QUERIES["op3_secret_scan"](spark, SF).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_secrets_edges(spark):
    texts = {
        1: None, 2: "", 3: "secret: token: abcdef12", 4: "token=token=abcdef", 5: "😀 API_KEY = 'abc.def-1' x", 6: "AKIA" + "Z" * 15, 7: "AKIA" + "Z" * 16 + "AKIA",
        8: "x" + "0123456789abcdef" * 2, 9: "Password\n: abcdefgh", 10: "passwd:abc;password=\"\"abcdefgh", 11: "token: " + "é" * 9 + " secret=abcdef é 0123456789abcdef01234567", 12: "secret=ſecret token=abcdefK",
        13: "-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----",
    }
    rows = spark.createDataFrame(list(texts.items()), DOCS).selectExpr("*", "'x' as blob", "1 as found", "2 as body")
    out = secrets.digest(secrets.scan(rows)[0]).collect()
    agree(out, texts)
    assert any("pem" in r.spans for r in out)


def test_ledger_scans_only_what_is_new(spark):
    old = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "plain")], DOCS)
    first, ledger = secrets.scan(old)
    assert ledger.count() == 2 * len(secrets.RULES)
    new = spark.createDataFrame([(4, "token=abcdefgh"), (5, "secret=12345678"), (5, "secret=12345678"), (None, None)], DOCS)
    found, grown = secrets.scan(new, ledger)
    assert grown.count() == 4 * len(secrets.RULES)
    assert sorted((r.path is None, r.path or 0, len(r.found)) for r in found.collect()) == [(False, 4, 1), (False, 5, 1), (False, 5, 1), (True, 0, 0)]
    again, same = secrets.scan(new, grown)
    assert same.count() == grown.count() and again.count() == 4
    changed = [r._replace(version=2) if r.kind == "assign" else r for r in secrets.RULES]
    _, more = secrets.scan(new, grown, changed)
    assert more.count() == grown.count() + 3
    assert secrets.scan(new.limit(0), ledger)[0].count() == 0


def test_ledger_keeps_versions_of_paths(spark):
    rows = [("a", 1, "token=abcdefgh"), ("a", 2, "plain"), ("a", 3, "token=abcdefgh"), ("b", 1, "token=abcdefgh"), (None, None, "plain"), ("b", 2, None)]
    found, ledger = secrets.scan(spark.createDataFrame(rows, "doc_id string, v int, text string"), version="v")
    assert ledger.count() == 3 * len(secrets.RULES) and ledger.where("size(found) > 0").count() == 1
    got = sorted((r.path or "", r.version or 0, [(x.kind, x.begin, x.finish) for x in r.found]) for r in found.collect())
    hit = [("assign", 0, 14)]
    assert got == [("", 0, []), ("a", 1, hit), ("a", 2, []), ("a", 3, hit), ("b", 1, hit), ("b", 2, [])]
    again, same = secrets.scan(spark.createDataFrame([("c", 1, "plain"), ("c", 2, "secret=zzzzzz")], "doc_id string, v int, text string"), ledger, version="v")
    assert same.count() == 4 * len(secrets.RULES) and sorted(len(r.found) for r in again.collect()) == [0, 1]


def shards_hold(rows, texts, shards=8):
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
    assert all(0 <= s < shards for s in by)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    return [sum(r.size for r in by.get(s, [])) for s in range(shards)]


def test_shards_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_sharding"](spark, SF).collect()
    sums = shards_hold(rows, docs)
    assert max(sums) - min(sums) <= 2 * max(r.size for r in rows)


def test_shards_with_one_hot_text(spark):
    texts = {i: ("copy " * 40 if i % 3 == 0 else "t" * (i % 50)) for i in range(3000)} | {5: None, 7: "", 9: "long " * 500}
    sums = shards_hold(sharding.shard(spark.createDataFrame(list(texts.items()), DOCS).selectExpr("*", "1 as size", "2 as shard", "3 as key"), 8, ranges=16).collect(), texts)
    assert max(sums) - min(sums) <= 2 * 2501


def test_shards_of_one_text_without_ids(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "'same text' as text").repartition(3)
    rows = sharding.shard(docs, 8, ranges=16).collect()
    sums = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert len(rows) == 4000 and max(sums) - min(sums) <= 20
    few = sharding.shard(docs, 8, rows_each=3).collect()  # over a thousand ranges
    assert len(few) == 4000 and all(sorted(r.slot for r in few if r.shard == s) == list(range(500)) for s in range(8))


def test_shards_of_nothing_and_nulls(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
    rows = sharding.shard(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], DOCS)).collect()
    assert len(rows) == 3


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_url_rules_on_the_table(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["op7_url_filter"](spark, SF).collect():
        host, path, rule, verdict = plain_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_url_aliases(spark):
    link = '<link href="{}" rel=canonical>'
    pages = [
        (1, "http://a.example.org/es/1", ""), (2, "https://b.test/x", link.format("https://a.example.org/es/1")), (3, "https://c.test/y", '<meta http-equiv="refresh" content="0; url=https://b.test/x#top">'),
        (4, "https://d.test/z", link.format("/z2")), (5, "https://d.test/z2?q", ""), (6, None, link.format("https://b.test/x")), (7, "no scheme", None), (8, "HTTP://A.Example.COM/en/712?a#b", ""),
        (9, "https://e.test/q", link.format("https://www.example.com/en/7")), (10, "https://e.test/q2", link.format("https://e.test/q")), (11, "https://f.test/r", link.format("https://x.com/en/1")), (11, "https://f.test/r", None),
        (12, "https://e.test/q2", link.format("https://n.test.com/en/")), (13, "xÉ://É.Example.ORG", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'h' as host", "1 as own", "2 as src")
    got = url_filter.judge(df, queries.URL_RULES).collect()
    verdicts = sorted((r.page_id, r.verdict) for r in got)
    assert verdicts == [(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "allow"), (9, "allow"), (10, "allow"), (11, "block"), (11, "block"), (12, "allow"), (13, "allow")]
    for r in got:
        url = next(p[1] for p in pages if p[0] == r.page_id)
        assert (r.host, r.path, r.rule) == plain_rule(url)[:3]
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0
    more = spark.createDataFrame([("https://d.test/z", "https://q.org/es/"), (None, "x")], "src string, dst string")
    assert {r.page_id for r in url_filter.judge(df, queries.URL_RULES, more).where("verdict = 'block'").collect()} >= {4}


@pytest.mark.parametrize("k", [1, 5])
def test_hamming_with_ties_and_a_hot_code(spark, k):
    r = random.Random(k)
    codes = [(i, [r.choice([0, 1, 3, 7, 65535]) for _ in range(2)] if i % 3 else [5, 5]) for i in range(300)] + [(None, [1, 1]), (400, None), (3, [5, 5])]
    df = spark.createDataFrame(codes, "id long, code array<int>").selectExpr("*", "1 as value", "2 as wanted")
    asked = df.where("id % 100 = 0 or id = 7")
    got = sorted(tuple(x) for x in hamming_search.top_k(df, asked, k, 32).collect())
    good = [(i, c) for i, c in codes if i is not None and c is not None]
    want = []
    for q, c in [(i, c) for i, c in good if i % 100 == 0 or i == 7]:
        near = sorted((sum((a ^ b).bit_count() for a, b in zip(c, d)), i) for i, d in good)[:k]
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert got == sorted(want)
    assert hamming_search.top_k(df.limit(0), asked, k, 32).count() == 0
    assert hamming_search.top_k(df, asked.limit(0), k, 32).count() == 0
