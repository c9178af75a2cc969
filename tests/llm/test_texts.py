"""Text operators against plain Python, on small fixtures with nulls, ties, copies and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from medialake.llm import html_extract
from medialake.llm.decontaminate import _slices, align, contaminated
from medialake.llm.language_id import identify
from medialake.llm.near_dedup import _grid, near_duplicates, sure
from medialake.llm.packing import pack, plan_patterns
from medialake.llm.substring_dedup import remove_repeats

FILE = public_tokenizers.path("word_bpe_49k.json")
WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st", "lm", "")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, rows, extra="'x' as lang, 1 as home, 2 as value, 3 as id, 4 as n, 'y' as set_id, 5 as length, 6 as rank"):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *extra.split(", "))


@pytest.fixture(scope="module")
def docs():
    r = random.Random(5)
    base = [prose(r, n) for n in (3, 5, 20, 60, 60, 200, 400)]
    texts = base + [base[3], base[4].upper(), base[5] + " tail", base[6][:1200], prose(r, 10) + " " + base[3] + " " + prose(r, 9), "", None, " \t\n", "one", "One", "a b c", "é è ü x", "w " * 300]
    hot = prose(r, 120).split()
    for _ in range(60):  # near copies, some of them too far apart
        edited = list(hot)
        for k in r.sample(range(120), r.choice([0, 1, 1, 2, 5, 12])):
            edited[k] = r.choice(WORDS)
        texts.append(" ".join(edited))
    return list(enumerate(texts))


def plain_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, min(len(w), 1)))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("short", "pivots", "rounds", "exact"), [(16, 8, 2, False), (2, 1, 1, False), (2, 1, 0, True)])
def test_near_duplicates(spark, docs, short, pivots, rounds, exact):
    got = near_duplicates(frame(spark, docs), shingle=4, short=short, pivots=pivots, rounds=rounds, exact=exact).collect()
    want = plain_components(docs, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("columns", [3, 8192])
def test_blocks_of_sets_against_plain_sets(columns):
    r = random.Random(columns)
    sets = [sorted(r.sample(range(30), r.randint(1, 12))) for _ in range(60)]
    rows = [(k, k % 7, k % 2 == 0, x) for k, x in enumerate(sets)]
    table = pa.table({"id": [x[0] for x in rows], "component": [x[1] for x in rows], "asks": [x[2] for x in rows], "shingles": pa.array([x[3] for x in rows], pa.list_(pa.int64()))})
    found = _grid(50, columns)(table)
    want = {(min(i, j), max(i, j)) for i, c, asks, x in rows for j, d, other, y in rows if asks and not other and c != d and 100 * len({*x} & {*y}) >= 50 * len({*x} | {*y})}
    assert set(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)) == want


def test_near_duplicates_edges(spark):
    assert near_duplicates(frame(spark, []).limit(0)).count() == 0
    rows = near_duplicates(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]), shingle=4).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sure(40, 0.8) == 15


def test_repeats(spark, docs):
    rows = docs + [(3, docs[3][1]), (None, docs[5][1])]
    got = remove_repeats(frame(spark, rows), window=13, chunk_bytes=3000, bucket_chars=4000).collect()
    key = lambda i: float("inf") if i is None else i
    seen = {}
    for i, t in sorted(rows, key=lambda x: key(x[0])):
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            seen.setdefault(tuple(w[k : k + 13]), key(i))
    want = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if seen[tuple(w[k : k + 13])] < key(i):
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == want
    assert all(sum(b - a for a, b in r.intervals) == r.n_removed for r in got)
    assert remove_repeats(frame(spark, []).limit(0)).count() == 0


def test_packing(spark, docs):
    odd = ["it's A-b,c! 12ab <|endoftext|> X<|ENDOFTEXT|>", "é ,̸= Å İ", "Ünï—,x 'S don'T,", "x" * 9000, prose(random.Random(1), 9000)]
    rows = docs + [(1000 + k, t) for k, t in enumerate(odd)] + [(None, "x")]
    got = pack(frame(spark, rows), FILE, keep_ids=True, chunk_bytes=5000).collect()
    tokenizer = Tokenizer.from_file(FILE)
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r.length for r in got) // 4096) + 1
    assert pack(frame(spark, []).limit(0), FILE).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_every_piece(seed):
    r = random.Random(seed)
    counts = Counter(min(300, int(r.lognormvariate(3.5, 1.2)) + 1) for _ in range(10 ** (seed + 1)))
    used = Counter()
    for n, lengths in plan_patterns(dict(counts), 300):
        assert n > 0 and sum(lengths) <= 300
        for x in lengths:
            used[x] += n
    assert used == counts


def plain_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_scores():
    r = np.random.default_rng(3)
    items = [r.integers(0, 6, n).astype(np.uint64) for n in r.integers(1, 20, 40)]
    passages = [r.integers(0, 6, n).astype(np.uint64) for n in r.integers(1, 40, 40)]
    assert align(items, passages)[0].tolist() == [plain_align(a.tolist(), b.tolist()) for a, b in zip(items, passages)]


def test_contamination(spark):
    r = random.Random(9)
    items = [(k, prose(r, 40)) for k in range(6)] + [(6, None), (7, ""), (8, prose(r, 700)), (9, "ban ber")]
    edited = items[2][1].split()
    for k in range(0, 40, 7):
        edited[k] = "other"
    del edited[10:12]
    docs = [(k, prose(r, 300)) for k in range(30)]
    docs += [(100, prose(r, 50) + " " + items[1][1].upper() + ". " + prose(r, 50)), (101, prose(r, 20) + " " + ", ".join(edited) + " " + prose(r, 9)), (102, items[0][1]), (103, None), (104, ""), (105, items[8][1]), (None, items[3][1]), (106, items[4][1]), (106, items[4][1])]
    got = {(x.doc_id, x.item_id) for x in contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words", "2 as part"), block_words=500).collect()}
    assert got - {(d, 9) for d in range(30)} == {(100, 1), (101, 2), (102, 0), (105, 8), (None, 3), (106, 4)}
    assert contaminated(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0
    twins = [(None, items[1][1]), (-1, items[1][1]), (1, items[1][1])]
    assert {x.item_id for x in contaminated(frame(spark, docs), spark.createDataFrame(twins, "item_id long, text string")).collect() if x.doc_id == 100} == {None, -1, 1}
    assert contaminated(frame(spark, []).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize(("n", "every"), [(40, 5), (40, 4), (12, 4), (300, 5)])
def test_contamination_by_an_edited_copy_beside_exact_ones(spark, n, every):
    r = random.Random(n)
    item = " ".join(f"{r.choice(WORDS)}{k}" for k in range(n))  # its trigrams occur nowhere else
    edited = " ".join(f"other{k}" if k % every == every - 1 else w for k, w in enumerate(item.split()))
    docs = [(1, item), (2, prose(r, 30) + " " + edited + " " + prose(r, 30)), (3, prose(r, 60)), (4, "x " + item + " y")]
    got = {(x.doc_id, x.item_id): x.score for x in contaminated(frame(spark, docs), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got.keys() == {(1, 7), (2, 7), (4, 7)} and got[1, 7] == got[4, 7] == 1 and 0.4 <= got[2, 7] < 1


def test_postings_are_cut_between_texts():
    row, times = np.array([0, 0, 1, 4, 4, 4, 5]), np.array([3, 3, 1, 9, 9, 9, 1])
    assert [(x.start, x.stop) for x in _slices(row, times, 7)] == [(0, 3), (3, 6), (6, 7)]
    assert list(_slices(row[:0], times[:0])) == []


def test_languages(spark):
    r = random.Random(2)
    made = {"aa": ["thon", "ere", "wha", "ing"], "bb": ["eau", "oui", "que", "ç"], "cc": ["ung", "sch", "ö", "keit"]}
    text = lambda lang, n: " ".join("".join(r.choice(made[lang]) for _ in range(3)) for _ in range(n))
    rows = [(k, text(lang, 30), lang) for k, lang in enumerate("aa bb cc".split() * 40)]
    rows += [(900, text("aa", 60) + " " + text("bb", 30), None), (901, "12 !?", None), (902, None, "aa"), (903, "", None), (904, "—", None), (None, text("cc", 9), None), (905, "中文字", None)]
    got = {x.doc_id: x for x in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as n")).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:120])
    assert got[900].langs == ["aa", "bb"] and abs(got[900].score - 2 / 3) < 0.15
    assert [got[k].lang_pred for k in (901, 902, 903, 904)] == ["und"] * 4 and got[None].lang_pred == "cc" and got[905].lang_pred != "und"
    none = identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert none[0].lang_pred == "und" and identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_extraction_on_held_out_pages(spark):
    counts = Counter()
    for html in html_extract.labelled_pages(300):
        nodes = html_extract.parse(html)
        counts.update(html_extract.counted(nodes, html_extract.labels(nodes)))
    model, wrong, total = html_extract.Model(counts), 0, 0
    for html in html_extract.labelled_pages(400)[300:]:
        nodes = html_extract.parse(html)
        for n, s, p in zip(nodes, html_extract.labels(nodes), model.marginals(nodes)):
            if n.text is not None:
                total, wrong = total + 1, wrong + ((s == html_extract.INSIDE) != (p > 0.5))
    assert wrong < 0.06 * total
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a href=1>x</a></nav><article><h1>T &amp; t</h1><p>One\n two.<p>Three&nbsp;four<script>var a='<p>no</p>'</script></article><footer>f</footer>"), (3, "u", "<p"), (None, "u", "plain &lt;text")]
    got = [(x.page_id, x.text, x.n_chars) for x in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as key")).collect()]
    assert sorted(got, key=str) == sorted([(1, "", 0), (2, "", 0), (3, "T & t\nOne two.\nThree four", 25), (3, "", 0), (None, "plain <text", 11)], key=str)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<form><select><option>A<option>B</select>more</form><article><p>One.</article>", ["more", "One."]),
        ("<form><select><optgroup label=x><option>A<optgroup><option>B</select></form><p>One.", ["One."]),
        ("<select><option>A</option><option selected>B</select><p>One.", ["One."]),
        ("<form><select><option>A</form><p>One.", ["One."]),
        ("<form><select><option>A<input name=q></form><p>One.", ["One."]),
        ("<ul><li><select><option>A<li>Two</ul><p>One.", ["Two", "One."]),
        ("<table><tr><td><select><option>A<td>Two</table>One.", ["Two", "One."]),
        ("<select><option>A<select><option>B</select><p>One.", ["One."]),
        ("<datalist id=x><option>A<option>B</datalist><p>One.", ["One."]),
        ("<html><head><title>T</title><meta name=x><link rel=y><article><p>One.</p></article>", ["One."]),
        ("<html><head><title>T</title><style>p{}</style><script>'<p>'</script>One. <b>Two.</b><p>Three.", ["One. Two.", "Three."]),
        ("<head><noscript><img src=x></noscript><title>T</title><a href=1>One.</a>", ["One."]),
        ("<head><title>T</title></head><body><p>One.", ["One."]),
        ("<head><title>T</title><noscript><p>No</p></noscript><body><p>One.</body>", ["One."]),
        ("<div><button>Go</div><p>One.", ["One."]),
        ("<div><button>Go<button>Stop</button> x</div><p>One.", ["x", "One."]),
        ("<div><svg viewBox='0 0 1 1'><g><path d='M0 0'/><title/></div><p>One.", ["One."]),
        ("<svg><g><path d=x></path><text>a</text><p>One.<p>Two.", ["One.", "Two."]),
        ("<svg><foreignObject><p>a</p></foreignObject><text>b</text></svg><p>One.", ["One."]),
        ("<svg/><p>One.", ["One."]),
        ("<div><noscript><img src=1></div><p>One.", ["One."]),
        ("<div><noscript><div>No</noscript>Two</div><p>One.", ["Two", "One."]),
        ("<div><template><div>No</div>no</template>Two</div><p>One.", ["Two", "One."]),
        ("<table><tr><td>Two<template><tr><td>No</template></table><p>One.", ["Two", "One."]),
        ("<p>a<canvas><p>No</p>no</canvas>b</p></select></option>c", ["a", "b", "c"]),
    ],
)
def test_unseen_elements_end(html, want):
    assert [n.text for n in html_extract.parse(html) if n.text is not None] == want


def test_article_after_a_form_without_end_tags(spark):
    pages = [(1, "u", "<body><nav><form><select><option>English<option>Deutsch</select></form></nav><article><h1>T</h1><p>One two three.</article></body>"), (2, "u", "<html><head><title>t</title><meta charset=utf-8><article><h1>T</h1><p>One two three.</p></article>")]
    got = {x.page_id: x.text for x in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "T\nOne two three.", 2: "T\nOne two three."}


def test_marginals_are_exact():
    nodes = html_extract.parse("<div class=nav><a href=1>x</a></div><main><p>Some words are here.</p><div class=comment>No.</div></main>")
    counts = Counter()
    for html in html_extract.labelled_pages(20):
        n = html_extract.parse(html)
        counts.update(html_extract.counted(n, html_extract.labels(n)))
    model = html_extract.Model(counts)
    weights = np.zeros((len(nodes), 3))
    for states in np.ndindex(*[3] * len(nodes)):
        w = 1.0
        for k, (n, s) in enumerate(zip(nodes, states)):
            own = np.sum([model.features.get(f, (0, 0, 0)) for f in n.features], axis=0) + ([0, 0, -50.0] if n.text is not None else 0)
            w *= np.exp(own[s]) * (model.edges[n.text is not None, states[n.parent]][s] if n.parent >= 0 else (1e-3, 1e-3, 1)[s])
        weights[np.arange(len(nodes)), states] += w
    assert np.allclose((weights / weights.sum(1, keepdims=True))[:, 1], model.marginals(nodes), atol=1e-6)
