"""Benchmark decontamination: word trigrams seed passages, Smith-Waterman alignment scores them.

The benchmark is taken in blocks of bounded size. For each block one pass over the corpus finds which of its
trigrams occur; each of those is a seed, so that no copy hides the trigrams of another. A second pass finds
the seeds in every whole document, joins them to their items, and aligns the passage around hits on
neighbouring diagonals with the item, so that edited and paraphrased copies score as well. No text is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.llm.batches import chunks, folded, small_batches, spans, utf8, window_hashes, window_starts, word_hashes
from medialake.storage import stored

GRAM = 3
PART, STRIDE = 256, 128  # a longer item is aligned in overlapping parts
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
MATCH, MISS, GAP = 2, -1, -1


def hashed(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (letters, digits and bytes outside ASCII; case folded) and each text's first word."""
    data, offsets = utf8(text)
    data = folded(data)
    starts, ends, first = spans(_WORD[data], offsets)
    return word_hashes(data, starts, ends), first


class Parts(NamedTuple):
    """Items of a block, cut into parts: the item of each, its words, and its trigrams' postings sorted by hash."""

    item: np.ndarray
    words: list[np.ndarray]
    grams: np.ndarray
    part: np.ndarray
    place: np.ndarray


def _parts(items: list[tuple[int, np.ndarray]]) -> Parts:
    owner, words, grams, part, place = [], [], [], [], []
    for item, all_words in items:
        for at in range(0, max(1, len(all_words) - STRIDE), STRIDE) if len(all_words) > PART else [0]:
            w = all_words[at : at + PART]
            if not len(w):
                continue
            n = min(GRAM, len(w))
            g = window_hashes(w, np.arange(len(w) - n + 1), n)
            owner.append(item)
            grams.append(g)
            part.append(np.full(len(g), len(words)))
            place.append(np.arange(len(g)))
            words.append(w)
    g, p, q = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((grams, np.uint64), (part, np.int64), (place, np.int64)))
    o = np.lexsort((q, p, g))
    return Parts(np.array(owner, np.int64), words, g[o], p[o], q[o])


def _lookup(keys: np.ndarray):
    """A function that gives, for hashes, the indices of those among the sorted distinct keys, and which keys they are."""
    mask = np.uint64((1 << 22) - 1)
    seen = np.zeros(1 << 22, bool)
    seen[keys & mask] = True

    def find(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(seen[hashes & mask])
        k = np.minimum(np.searchsorted(keys, hashes[at]), max(0, len(keys) - 1))
        hit = keys[k] == hashes[at] if len(keys) else np.zeros(len(at), bool)
        return at[hit], k[hit]

    return find


def _hits(words: np.ndarray, first: np.ndarray, find, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word of the text, key) of every gram that is looked for."""
    out = [[], [], []]
    for n in sizes:
        at, row = window_starts(first, n)
        i, k = find(window_hashes(words, at, n))
        for part, x in zip(out, (row[i], at[i] - first[row[i]], k), strict=True):
            part.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _occurring(keys: np.ndarray, sizes: list[int], size: int):
    def run(batches):
        find, there = _lookup(keys), np.zeros(len(keys), bool)
        for table in chunks(batches, "text", size):
            there[_hits(*hashed(table.column("text")), find, sizes)[2]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(there))], names=["key"])

    return run


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman scores of each item with its passage, and where in the passage the best alignment starts and ends.

    All pairs are computed together, a row of all matrices at a time. A cell carries its score and, below it, the
    complement of its start, so that one maximum decides both; gaps along a row are a running maximum.
    """
    m, w = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((len(items), m), np.uint64), np.zeros((len(items), w), np.uint64)
    inside_a, inside_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for k, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[k, : len(x)], inside_a[k, : len(x)] = x, True
        b[k, : len(y)], inside_b[k, : len(y)] = y, True
    unit = 1 << 32  # starts fit below it, and scores times it in 63 bits
    zero = unit - 1 - np.arange(w + 1)
    slope = -GAP * unit * np.arange(w + 1)
    cell = np.tile(zero, (len(items), 1))
    best, end = np.full(len(items), unit - 1), np.zeros(len(items), np.int64)
    for i in range(m):
        same = (a[:, i : i + 1] == b) & inside_b & inside_a[:, i : i + 1]
        new = np.maximum(cell + GAP * unit, zero)
        new[:, 1:] = np.maximum(new[:, 1:], cell[:, :-1] + np.where(same, MATCH * unit, MISS * unit))
        cell = np.maximum.accumulate(new + slope, axis=1) - slope
        top = cell.argmax(1)
        value = cell[np.arange(len(items)), top]
        more = value // unit > best // unit
        best, end = np.where(more, value, best), np.where(more, top, end)
    return best // unit, unit - 1 - best % unit, end


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("n_seeds", pa.int64())])


def _slices(row: np.ndarray, times: np.ndarray, most: int = 1_000_000):
    """Cuts hits, sorted by text, into runs of whole texts of about ``most`` postings."""
    ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1 if len(row) else []
    at, total = 0, np.append(0, times.cumsum())
    for k, end in enumerate(ends):
        if k == len(ends) - 1 or total[ends[k + 1]] - total[at] > most:
            yield slice(at, end)
            at = end


def _aligner(shared, sizes: list[int], min_score: float, min_words: int, size: int):
    def run(batches):
        parts, names, keys, from_, to = shared.value
        find = _lookup(keys)
        lengths = np.array([len(x) for x in parts.words])
        seeds_of = np.bincount(parts.part, minlength=len(lengths))

        def aligned(table, words, first, row, at, k):
            times = to[k] - from_[k]
            post = np.arange(times.sum()) + np.repeat(from_[k] - (times.cumsum() - times), times)
            row, at, part, place = np.repeat(row, times), np.repeat(at, times), parts.part[post], parts.place[post]
            diagonal = at - place
            o = np.lexsort((place, diagonal, part, row))
            row, at, part, place, diagonal = (x[o] for x in (row, at, part, place, diagonal))
            cuts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1]) | (diagonal[1:] - diagonal[:-1] > 8)))
            ends = np.append(cuts[1:], len(row))
            n = np.array([len(np.unique(place[x:y])) for x, y in zip(cuts, ends, strict=True)])
            good = n >= np.minimum(2, seeds_of[part[cuts]])
            cuts, ends, n = cuts[good], ends[good], n[good]
            if not len(cuts):
                return None
            r, p = row[cuts], part[cuts]
            slack = lengths[p] // 4 + 4
            lo = np.maximum(0, diagonal[cuts] - slack)
            hi = np.minimum(np.diff(first)[r], diagonal[ends - 1] + lengths[p] + slack)
            lo, hi = lo + first[r], hi + first[r]
            order = np.lexsort((hi - lo, lengths[p]))
            score, start, end = (np.zeros(len(order), np.int64) for _ in range(3))
            x = 0
            while x < len(order):
                g = order[x : x + 128]
                g = g[: max(1, 500_000 // int((hi - lo)[g].max()))]  # wide passages in smaller groups
                x += len(g)
                score[g], start[g], end[g] = align([parts.words[y] for y in p[g]], [words[a:b] for a, b in zip(lo[g], hi[g], strict=True)])
            share = score / (MATCH * lengths[p])
            ok = np.flatnonzero((share >= min_score) & ((lengths[p] >= min_words) | (share >= 1)))
            if not len(ok):
                return None
            ids = table.column("doc_id").to_pylist()
            base = lo - first[r]
            cols = [[ids[x] for x in r[ok]], [names[x] for x in parts.item[p[ok]]], share[ok], (base + start)[ok], (base + end)[ok], n[ok]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)

        for table in chunks(batches, "text", size):
            words, first = hashed(table.column("text"))
            row, at, k = _hits(words, first, find, sizes)
            o = np.argsort(row, kind="stable")
            row, at, k = row[o], at[o], k[o]
            for x in _slices(row, to[k] - from_[k]):
                if (found := aligned(table, words, first, row[x], at[x], k[x])) is not None:
                    yield found

    return run


def _worder(size: int):
    def run(batches):
        for table in chunks(batches, "text", size):
            words, first = hashed(table.column("text"))
            ids = table.column("item_id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([words[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array(np.diff(first))], names=["item_id", "words", "n"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, min_score: float = 0.4, min_words: int = 8, block_words: int = 1_000_000, chunk_bytes: int = 1_000_000) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, exactly or edited.

    Returns ``doc_id, item_id, score, start_word, end_word, n_seeds``, the best alignment of each pair. ``score`` is
    the alignment's score over that of the whole item (or of its best part of 256 words); at least ``min_score`` is
    reported. Items of fewer than ``min_words`` words must occur word for word. Words are letters and digits, case
    folded. An item's seeds are all its trigrams that occur in any document; two of them on neighbouring diagonals (or
    its only one) lead to an alignment.

    The benchmark may have any size: it is taken in blocks of about ``block_words`` words, and only a block is
    collected and broadcast. Null or empty texts, on either side, match nothing; null ids come back as null;
    repeated documents give repeated ids once for each item. Empty tables: empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select("doc_id", "text")
    worded = stored(items.select("item_id", "text").mapInArrow(_worder(chunk_bytes), "item_id long, words binary, n long").where("n > 0"), "items")
    block = F.floor(F.sum("n").over(Window.partitionBy("part").orderBy("item_id", "words")) / block_words)
    parts_n = int((worded.agg(F.sum("n")).first()[0] or 0) // (8 * block_words) + 1)
    worded = stored(worded.withColumn("part", F.expr(f"pmod(xxhash64(item_id), {parts_n})")).withColumn("block", block), "blocks")
    found = None
    for b in worded.select("part", "block").distinct().orderBy("part", "block").toLocalIterator():
        rows = worded.where((F.col("part") == b["part"]) & (F.col("block") == b["block"])).select("item_id", "words").orderBy("item_id", "words").collect()
        parts = _parts([(k, np.frombuffer(r["words"], np.uint64)) for k, r in enumerate(rows)])
        names = [r["item_id"] for r in rows]
        sizes = sorted({min(GRAM, len(w)) for w in parts.words})
        keys, spot = np.unique(parts.grams, return_inverse=True)
        there = np.zeros(len(keys), bool)
        there[source.mapInArrow(_occurring(keys, sizes, chunk_bytes), "key long").distinct().toPandas()["key"].to_numpy(int)] = True  # at most the block's trigrams
        keep = there[spot]  # what occurs nowhere leads nowhere
        seeds = parts._replace(grams=parts.grams[keep], part=parts.part[keep], place=parts.place[keep])
        keys, from_ = np.unique(seeds.grams, return_index=True)
        shared = spark.sparkContext.broadcast((seeds, names, keys, from_, np.append(from_[1:], len(seeds.grams))))
        new = source.mapInArrow(_aligner(shared, sizes, min_score, min_words, chunk_bytes), "doc_id long, item_id long, score double, start_word long, end_word long, n_seeds long")
        found = new if found is None else found.union(new)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long, n_seeds long")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start_word")).alias("at"), "end_word", "n_seeds")).alias("x"))
    return best.select("doc_id", "item_id", "x.score", (-F.col("x.at")).alias("start_word"), "x.end_word", "x.n_seeds")
