"""Mixing of sources and spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from medialake.llm import mixing, variants

DOCS = "doc_id long, text string, source string, size string, target int"


def levels(sizes, weights, most):
    """The contract's resharing, round by round: {source: target}."""
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    weight = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = sum(weight[x] for x in names if x not in capped)
        left = total - sum(most * sizes[x] for x in capped)
        target = {x: most * sizes[x] if x in capped else left * weight[x] / free for x in names}
        above = {x for x in names if target[x] > most * sizes[x] + 1e-9}
        if not above:
            return target
        capped |= above


def check(rows, docs):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs]
    sizes = defaultdict(int)
    for d, n in zip(docs, words, strict=True):
        sizes[d[2]] += n
    want = levels(sizes, (5, 2, 1), 3)
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((d[0], n) for d, n in zip(docs, words, strict=True))
    taken, largest = defaultdict(int), defaultdict(int)
    by_row = defaultdict(list)
    for d, n in zip(docs, words, strict=True):
        by_row[d[0], n].append(d[2])
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.times * r["size"]
        of = [s for s in by_row[r.doc_id, r["size"]] if abs(want[s] - r.target) < 1e-6 and sizes[s] == r.source_size]
        assert of
        taken[of[0]] += r.taken
        largest[of[0]] = max(largest[of[0]], r["size"])
    for s, n in taken.items():
        assert abs(n - want[s]) <= largest[s] / 2 + 1e-6, (s, n, want[s])


def test_mix_small(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.choice([0, 1, 3, 30, 400]))), rnd.choice(["a", "b", "ä", "é", "", None, "zz", "Z"]), "x", 1) for i in range(300)]
    docs += [(300, None, "a", None, 1), (None, "one two", "null text", None, 1), (301, " \n\t ", "blank", None, 1), (302, None, "none", None, 1), (303, "a " * 200_000, "long", None, None)]
    docs += [(7, "again and again", "copies", None, 1)] * 40 + [(8, "x", None, None, None)] * 3
    rows = mixing.mix(spark.createDataFrame(docs, DOCS)).collect()
    check(rows, docs)
    copies = [r.taken for r in rows if r.doc_id == 7 and r.source_size == 120]
    assert len(copies) == 40 and len(set(copies)) <= 2
    again = mixing.mix(spark.createDataFrame(docs[::-1], DOCS).repartition(3)).collect()
    plain = lambda rs: Counter(map(tuple, rs))
    assert plain(rows) == plain(again)


def test_mix_empty_and_drawn(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b", "s", None, 1), (2, "c", "t", None, 1)], DOCS)
    mixed = mixing.mix(docs, keep=("text",))
    assert sum(len(r.text.split()) for r in mixing.drawn(mixed).collect()) == sum(r.taken for r in mixed.collect())


def test_mix_nested(spark):
    docs = [(i, "w " * (i % 17 + 1), "ab"[i % 2], None, None) for i in range(400)]
    low, high = ({r.doc_id: r.times for r in mixing.mix(spark.createDataFrame(docs, DOCS), weights=w).collect()} for w in ((2, 3), (1, 3)))
    assert all(low[i] >= high[i] for i in low if i % 2 == 0)


def test_running_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 50)
    rows = spark.createDataFrame([(i * 37 % 501, i) for i in range(501)], "k int, v int")
    seen = 0
    for place, r in enumerate(sorted(mixing.running(rows, [F.col("k")], ["v"]).collect(), key=lambda r: r.k)):
        assert (r["rank"], r.before_v) == (place, seen)
        seen += r.v


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(docs, least=6, often=5, every=199, share=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= often}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= share * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def texts(seed, n):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcÀé") for _ in range(rnd.randint(6, 9))) for _ in range(12)]

    def edited(w):
        for _ in range(rnd.choice([0, 0, 0, 0, 0, 0, 1, 1, 2, 3])):
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("abcÀé") + w[i:], w[:i] + rnd.choice("abcÀé") + w[i + 1 :]])
        return w

    return [(i, rnd.choice([" ", ", ", "1", "’", "Ā"]).join(rnd.choice([str.upper, str])(edited(rnd.choice(base))) if rnd.random() < 0.3 else edited(rnd.choice(base)) for _ in range(200))) for i in range(n)]


def test_variants_equal_plain(spark):
    docs = texts(1, 40) + [(None, None), (None, "Strasse strasse " * 9), (90, ""), (91, "a" * 300 + " " + "b" * 299), (91, "×÷" * 4)] + [(92, "a" * 300)] * 5
    docs += [(93, "kettenwort " * 200 + "kettenwirt " * 30 + "Kettenwird " * 5)]
    rows = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string")
    want = grouped(docs)
    for part in (variants.PART, 3):  # tiles in parts as well
        got = [tuple(r) for r in variants.variants(rows, part=part).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert any(form for _, form, *_ in want) and any(root != (form or w) for w, form, root, *_ in want)
    assert variants.variants(rows.limit(0)).collect() == []


def test_variants_slices(spark, monkeypatch):
    docs = [(3, " ".join(t for _, t in texts(2, 30)))]
    monkeypatch.setattr(variants, "SLICE", 5000)
    total = Counter()
    for b in variants._counted(6, 199)(iter(spark.createDataFrame(docs, "id string, text string").toArrow().to_batches())):
        for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[w] += c
    assert {(w, c) for w, c in total.items() if c >= 5} == {(w, c) for w, _, _, c, _, _ in grouped(docs)}


def test_crc(spark):
    rnd = np.random.default_rng(3)
    data = rnd.integers(0, 256, 4000).astype(np.uint8)
    starts, sizes = rnd.integers(0, 3500, 300), rnd.integers(0, 130, 300)
    states = np.array([zlib.crc32(f"{i}:".encode()) for i in range(300)], np.uint32)
    want = [zlib.crc32(f"{i}:".encode() + data[a : a + n].tobytes()) for i, (a, n) in enumerate(zip(starts, sizes, strict=True))]
    assert variants.crc32_after(states, data, starts, sizes).tolist() == want
