"""Substring de-duplication: repeated fixed-length word windows are removed outside the first document that has them.

Windows are found by Rabin-Karp hashes. A task looks at a few MB of text at once, settles what repeats inside
them, and ships one entry for each remaining window: 64 hash bits and the place, packed by bucket; the bucket
is taken from a second hash, so that a window is told apart by 64 bits and the bucket's. A window that a third
of all documents share thus costs one entry per few MB of text. Buckets find windows of other tasks with a
smaller document; the places to remove go back to their documents, where windows merge into maximal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.batches import chunks, small_batches, spans, utf8, window_hashes, window_starts, word_hashes, SPACES

LAST = np.iinfo(np.int64).max


def _pack(docs: np.ndarray, places: np.ndarray) -> bytes:
    """Document ids, ascending, and word places, ascending in each document, as compressed differences."""
    fresh = np.ones(len(docs), bool)
    fresh[1:] = docs[1:] != docs[:-1]
    at = np.flatnonzero(fresh)
    steps = places.astype(np.int64)
    steps[1:] -= np.where(fresh[1:], 0, places[:-1])
    ids = docs[at]
    ids = np.concatenate([ids[:1], ids[1:] - ids[:-1]])
    body = b"".join([
        np.array([len(at), len(docs)], np.int64).tobytes(),
        ids.view(np.uint8).reshape(-1, 8).T.tobytes(),
        np.diff(np.append(at, len(docs))).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(),
        steps.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(),
    ])
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, m = body[:16].view(np.int64)
    planes = lambda part, width, kind: np.ascontiguousarray(part.reshape(width, -1).T).view(kind).ravel()
    ids = planes(body[16 : 16 + 8 * n], 8, np.int64).cumsum()
    counts = planes(body[16 + 8 * n : 16 + 12 * n], 4, np.uint32).astype(np.int64)
    steps = planes(body[16 + 12 * n :], 4, np.uint32).astype(np.int64)
    run = steps.cumsum()
    first = counts.cumsum() - counts
    return np.repeat(ids, counts), run - np.repeat(run[first] - steps[first], counts)


def _home(docs: np.ndarray, homes: int) -> np.ndarray:
    """The bucket in which a document's text meets its removals; as in SQL below."""
    return (docs ^ (docs >> np.int64(15))) % homes


def _split(values: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket the indices that are in it, in order."""
    if not len(values):
        return
    order = np.argsort(values.astype(np.uint16) if n <= 1 << 16 else values, kind="stable")
    kept = values[order]
    cuts = np.flatnonzero(np.append(True, kept[1:] != kept[:-1]))
    for at, to in zip(cuts, np.append(cuts[1:], len(kept)), strict=True):
        yield int(kept[at]), order[at:to]


_SHIPPED = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary())])
_GONE = pa.schema([("home", pa.int64()), ("places", pa.binary())])


def _shipper(window: int, buckets: int, homes: int, size: int):
    def run(batches):
        for table in chunks(batches, "text", size):
            ids = table.column("doc_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            table, ids = table.take(pa.array(order)), ids[order]
            data, offsets = utf8(table.column("text"))
            starts, ends, first = spans(~SPACES[data], offsets)
            at, row = window_starts(first, window)
            if not len(at):
                continue
            words = word_hashes(data, starts, ends)
            h, g = window_hashes(words, at, window), window_hashes(words, at, window, 1)
            docs, places = ids[row], at - first[row]
            o = np.argsort(h, kind="stable")
            ho, go = h[o], g[o]
            cuts = np.flatnonzero(np.append(True, (ho[1:] != ho[:-1]) | (go[1:] != go[:-1])))
            least = docs[o[cuts]]
            later = np.zeros(len(o), bool)
            later[o] = docs[o] > np.repeat(least, np.diff(np.append(cuts, len(o))))
            out = [[], [], []]
            keep = np.flatnonzero(~later)
            for bucket, i in _split((g[keep] % np.uint64(buckets)).astype(np.int64), buckets):
                i = keep[i]
                for part, x in zip(out, (bucket, h[i].tobytes(), _pack(docs[i], places[i])), strict=True):
                    part.append(x)
            gone = np.flatnonzero(later)
            for home, i in _split(_home(docs[gone], homes), homes):
                i = gone[i]
                for part, x in zip(out, (home % buckets, None, home.to_bytes(8, "little") + _pack(docs[i], places[i])), strict=True):
                    part.append(x)
            for k in range(0, len(out[0]), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 4096], f.type) for x, f in zip(out, _SHIPPED, strict=True)], schema=_SHIPPED)

    return run


def _judge(homes: int):
    def run(table: pa.Table) -> pa.Table:
        hashes, docs, places, out = [], [], [], [[], []]
        for h, p in zip(table.column("hashes").to_pylist(), table.column("places").to_pylist(), strict=True):
            if h is None:
                out[0].append(int.from_bytes(p[:8], "little"))
                out[1].append(p[8:])
                continue
            hashes.append(np.frombuffer(h, np.uint64))
            d, w = _unpack(p)
            docs.append(d)
            places.append(w)
        if hashes:
            h, d, w = map(np.concatenate, (hashes, docs, places))
            o = np.argsort(h, kind="stable")
            ho = h[o]
            cuts = np.flatnonzero(np.append(True, ho[1:] != ho[:-1]))
            many = np.diff(np.append(cuts, len(o)))
            gone = o[d[o] > np.repeat(np.minimum.reduceat(d[o], cuts), many)]
            d, w = d[gone], w[gone]
            o = np.lexsort((w, d))
            d, w = d[o], w[o]
            for home, i in _split(_home(d, homes), homes):
                out[0].append(home)
                out[1].append(_pack(d[i], w[i]))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, _GONE, strict=True)], schema=_GONE)

    return run


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()), ("intervals", pa.list_(pa.list_(pa.int64())))])


def _cutter(window: int, texts: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p in right.column("places").to_pylist():
            d, w = _unpack(p)
            docs.append(d)
            places.append(w)
        d, w = np.concatenate(docs), np.concatenate(places)
        o = np.lexsort((w, d))
        d, w = d[o], w[o]
        cols = [[] for _ in _KEPT]
        ids, null = left.column("doc_id"), left.column("no_id").to_pylist()
        lo, hi = np.searchsorted(d, ids.to_numpy(), "left"), np.searchsorted(d, ids.to_numpy(), "right")
        for k, (doc, text) in enumerate(zip(ids.to_pylist(), left.column("text"), strict=True)):
            words = (text.as_py() or "").encode().split()
            spans_, gone = [], 0
            if hi[k] > lo[k]:
                mine = w[lo[k] : hi[k]]
                cuts = np.flatnonzero(np.append(True, mine[1:] > mine[:-1] + window))
                spans_ = [[int(a), int(b) + window] for a, b in zip(mine[cuts], mine[np.append(cuts[1:], len(mine)) - 1], strict=True)]
                left_over, at = [], 0
                for a, b in spans_:
                    left_over += words[at:a]
                    gone += b - a
                    at = b
                kept = b" ".join(left_over + words[at:])
            else:
                kept = b" ".join(words)
            for col, x in zip(cols, (None if null[k] else doc, len(words), gone, kept.decode() if texts else None, hashlib.sha256(kept).hexdigest(), spans_), strict=True):
                col.append(x)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _KEPT, strict=True)], schema=_KEPT)

    return run


def remove_repeats(docs: DataFrame, window: int = 13, texts: bool = True, bucket_chars: int = 16_000_000, chunk_bytes: int = 4_000_000) -> DataFrame:
    """Removes each word that a window covers whose words also start in a document with a smaller ``doc_id``.

    Words are runs of bytes other than ASCII white space, unchanged. Returns for each row of ``docs`` its
    ``doc_id, n_words, n_removed, kept_text`` (null unless ``texts``), ``kept_sha256`` and the maximal removed
    ``intervals`` of word places, end exclusive. The number of buckets follows the size of the text, so that
    each fits a worker. Windows are told apart by 64 bits plus the bucket's bits of independent hashes.

    Null text: no words. Null ``doc_id``: after all others; such rows don't judge each other. A row that is
    repeated as it is (same id, same text) is never judged against itself; ids that name several texts get the
    union of their removals. Empty table: empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("doc_id", F.lit(int(LAST))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(max(8, total // bucket_chars + 1), 1 << 22))
    homes = buckets | 1
    shipped = rows.select("doc_id", "text").mapInArrow(_shipper(window, buckets, homes, chunk_bytes), "bucket int, hashes binary, places binary")
    gone = shipped.groupBy("bucket").applyInArrow(_judge(homes), "home long, places binary")
    home = F.expr(f"pmod(doc_id ^ shiftright(doc_id, 15), {homes})")
    met = rows.withColumn("home", home).groupBy("home").cogroup(gone.groupBy("home"))
    return met.applyInArrow(_cutter(window, texts), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, intervals array<array<long>>")
