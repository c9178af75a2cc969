"""Very long and hostile texts: each in seconds."""

import time

import numpy as np
import pytest

from medialake.llm import html_extract, language_id, queries, secrets, url_filter
from medialake.llm.decontaminate import contaminated

DOCS = "doc_id long, text string"


@pytest.fixture
def quick():
    began = time.time()
    yield
    assert time.time() - began < 60


def test_tokens_that_never_end(spark, quick):
    good = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    docs = spark.createDataFrame([(1, "eyJ" * 350_000), (2, "eyJa." * 200_000), (3, f"x {good} y")], DOCS)
    rows = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(docs)[0]).collect()}
    assert "jwt" not in rows[1] and "jwt:2:" in rows[3]


def test_links_that_never_end(spark, quick):
    pages = [(1, "http://a.com/x", "canonical " + "<link " * 180_000), (2, "http://b.com/y", "http-equiv " + "<meta " * 180_000), (3, "http://c.com/z", "<link href='/other' rel=canonical>")]
    edges = url_filter.aliases(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert [tuple(e) for e in edges] == [("c.com/z", "c.com/other")]


def test_end_tags_without_elements(quick):
    assert [n.text for n in html_extract.parse("<div>a" + "</section>" * 100_000 + "b</div>") if n.text] == ["ab"]
    deep = html_extract.parse("<div>" * 3000 + "a" + "</p></x></li>" * 3000)
    assert [n.text for n in deep if n.text] == ["a"]
    assert not [n.text for n in html_extract.parse("<noscript>" + "<div>" * 3000 + "a" + "</i></x></li>" * 3000) if n.text]
    assert not [n.text for n in html_extract.parse("<script>" + "</script " * 100_000) if n.text]


def test_item_behind_a_million_words(spark, quick):
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c " * 1000 + "d e"), (2, "a b c " * 400_000 + "d e"), (3, "a b c " * 10)], DOCS)
    found = {r.doc_id: r for r in contaminated(docs, items).collect()}
    assert set(found) == {1, 2} and all(r.score == 1 for r in found.values())
    assert (found[2].start_word, found[2].end_word) == (1_199_997, 1_200_002)


def test_likelihoods_in_slices():
    texts = "Die Häuser von Köln  sind alt, the houses are old. 1 x  é".encode()
    data, offsets = np.frombuffer(texts, np.uint8), np.array([0, 20, len(texts)])
    starts, ends, _, code = language_id.trigrams(data, offsets)
    table = np.random.default_rng(1).normal(size=(3, language_id.CODES)).astype(np.float32)
    whole = language_id.word_likelihoods(table, code, starts, ends)
    for step in (1, 2, 5):
        assert np.allclose(whole, language_id.word_likelihoods(table, code, starts, ends, step), atol=1e-4)
    assert language_id.word_likelihoods(table, code[:0], starts[:0], ends[:0]).shape == (3, 0)


def test_a_long_text_has_its_language(spark, quick):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    long = " ".join(r.text for r in docs.where("lang = 'de' and text is not null").limit(40).collect())
    long *= 8_000_000 // len(long) + 1
    row = language_id.identify(docs.union(spark.createDataFrame([(999_999, long, None)], "doc_id long, text string, lang string"))).where("doc_id = 999999").first()
    assert row.lang_pred == "de"


def test_queries_are_named():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
