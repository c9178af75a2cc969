"""Spelling variants: words one edit apart, found by dense tiling, grouped under their most frequent form.

Words are counted over all texts. Two words are one edit apart exactly if their common prefix and common suffix together
reach the longer length minus one. Such words share the first half of the longer one's length, or what is left of it at
their end; so words meet in tiles of one length and half. A tile's words are rows of padded code-point matrices, compared
block by block, all pairs of two blocks at once. Tiles above a bound are divided, and pairs of their parts are tiles of their own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.batches import chunks, lowered, utf8
from medialake.storage import stored

SLICE = 1 << 21  # bytes of text that are worked on at once
PART = 2048  # words of a tile's part
CELLS = 1 << 21  # of the comparison of two blocks
KEY = ("longer", "tail", "piece", "i", "j")  # of a tile
LONG = 64  # bytes from which on a word is hashed on its own


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = _crc_table()


def crc32_after(states: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """zlib's crc32 of each prefix, of which ``states`` are the values, and the bytes data[start:start + size] behind it."""
    order = np.argsort(-sizes, kind="stable")
    begin, size = starts[order], sizes[order]
    crc = states[order] ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-size, -LONG, "left"))
    for i in range(long):
        crc[i] = zlib.crc32(data[begin[i] : begin[i] + size[i]].tobytes(), int(crc[i] ^ np.uint32(0xFFFFFFFF))) ^ 0xFFFFFFFF
    for p in range(int(size[long]) if long < len(size) else 0):
        end = int(np.searchsorted(-size, -p, "left"))  # words longer than p
        part = crc[long:end]
        crc[long:end] = CRC[(part ^ data[begin[long:end] + p]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF (0xC3 and the byte behind it)."""
    low = data | np.uint8(32)
    inside = ((low >= 97) & (low <= 122)) | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    return inside


def _counted(least: int, every: int):
    """For Arrow batches (id string, text): distinct words of a slice of text and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", SLICE):
            data, offsets = utf8(table.column("text"))
            prefixes = np.array([zlib.crc32(f"{x or ''}:".encode()) for x in table.column("id").to_pylist()], np.uint32)
            at = 0
            while at < len(data):
                to = min(at + SLICE, len(data))
                while to < len(data):  # a slice ends between words
                    rest = _letters(data[to - 1 : to + 4096])[1:]
                    run = len(rest) if rest.all() else int(np.argmin(rest))
                    to += run
                    if run < 4096:
                        break
                words, n = _slice(data[at:to], offsets, at, prefixes, least, every)
                if len(words):
                    yield pa.RecordBatch.from_arrays([words, n], names=["word", "n"])
                at = to

    return run


def _slice(data: np.ndarray, offsets: np.ndarray, at: int, prefixes: np.ndarray, least: int, every: int) -> tuple[pa.Array, pa.Array]:
    inside = _letters(data)
    cut = np.zeros(len(data) + 1, bool)  # a text begins
    mine = offsets[(offsets >= at) & (offsets <= at + len(data))] - at
    cut[mine] = True
    begins = inside & np.concatenate([[True], ~inside[:-1]]) | inside & cut[:-1]
    ends = inside & (np.concatenate([~inside[1:], [True]]) | cut[1:])
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0xC3, out=leads[1:])
    points = stops - starts - (leads[stops] - leads[starts])
    kept = points >= least
    starts, stops, points = starts[kept], stops[kept], points[kept]
    if not len(starts):
        return pa.array([], pa.string()), pa.array([], pa.int64())
    flat = lowered(data)
    rows = np.searchsorted(offsets, starts + at, "right") - 1
    crc = crc32_after(prefixes[rows], flat, starts, stops - starts)
    hit = crc % np.uint32(every) == 0
    found: Counter = Counter()
    for a, b, size, h in zip(starts[hit], stops[hit], points[hit], crc[hit], strict=True):
        word, gone = flat[a:b].tobytes().decode(), int(h) % int(size)
        if size > least:
            found[word[:gone] + word[gone + 1 :]] += 1
    starts, stops = starts[~hit], stops[~hit]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[stops] -= 1
    body = flat[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=ends[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body)))
    counts = pc.value_counts(words)
    values, n = counts.field("values"), counts.field("counts").cast(pa.int64())
    if found:
        values, n = pa.concat_arrays([values, pa.array(list(found), pa.string())]), pa.concat_arrays([n, pa.array(list(found.values()), pa.int64())])
    return values, n


def word_counts(docs: DataFrame, row_id: str = "doc_id", text: str = "text", least: int = 6, often: int = 5, every: int = 199) -> DataFrame:
    """(word, n): words of at least ``least`` code points that occur at least ``often`` times in all texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. Where crc32 of ``id:word`` is divisible by ``every``, the
    word loses the code point crc32 modulo its length. Null texts have no words, null ids are written as nothing. Long texts
    are worked on in slices that end between words.
    """
    asked = docs.select(F.col(row_id).cast("string").alias("id"), F.col(text).alias("text"))
    counted = asked.mapInArrow(_counted(least, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def tiles(words: DataFrame) -> DataFrame:
    """``words`` (word, ...) once for each tile it stands in: longer (the longer length of the tile's pairs), tail, piece.

    For a longer length K an edit behind the first half leaves K // 2 code points at the front as they are, any other one leaves K - K // 2
    at the end.
    """
    size = F.length("word")
    longer = F.explode(F.array(size, size + 1)).alias("longer")
    dealt = words.select("*", longer).withColumn("tail", F.explode(F.array(F.lit(False), F.lit(True))))
    half = F.floor(F.col("longer") / 2).cast("int")
    piece = F.when(F.col("tail"), F.substring(F.col("word"), half - F.col("longer"), F.col("longer") - half)).otherwise(F.substring(F.col("word"), F.lit(1), half))
    return dealt.withColumn("piece", piece)


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words at the left, at the right, each padded with zeros, and their lengths."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    flat = flat.astype(np.uint8 if flat.max() < 256 else np.uint32)
    size = np.array([len(w) for w in words])
    rows = np.repeat(np.arange(len(words)), size)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    left = np.zeros((len(words), int(size.max()) + 1), flat.dtype)
    right = left.copy()
    left[rows, column] = flat
    right[rows, np.repeat(size, size) - 1 - column] = flat
    return left, right, size


def compared(group: np.ndarray, longer: np.ndarray, tail: np.ndarray, own: np.ndarray, apart: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of words one edit apart within a group; rows are sorted by group.

    Blocks of rows are compared as a whole, also across small groups, of which pairs count only within one. Words of
    ``longer`` meet one another and those one shorter. Where ``apart``, only words of different parts (``own``) meet. In tiles of ends a common
    prefix of half the length is left to the tile of that prefix, so a pair is found once.
    """
    found = [(np.zeros(0, int), np.zeros(0, int))]
    left, right, size = matrices(words)
    rows = max(2, min(128, int((CELLS / left.shape[1]) ** 0.5)))
    starts = range(0, len(words), rows)
    for i in starts:
        a = slice(i, i + rows)
        for j in range(i, len(words), rows):
            b = slice(j, j + rows)
            if group[j] > group[a][-1]:
                break
            wide = int(max(size[a].max(), size[b].max())) + 1
            heads = (left[a, None, :wide] != left[None, b, :wide]).argmax(2)  # equal words have 0, and the same place or none
            ends = (right[a, None, :wide] != right[None, b, :wide]).argmax(2)
            k, m, n = longer[a][:, None], size[a][:, None], size[b][None, :]
            near = (group[a][:, None] == group[None, b]) & (np.maximum(m, n) == k) & (heads + ends >= k - 1)
            near &= (~tail[a][:, None]) | (heads < k // 2)
            near &= (~apart[a][:, None]) | (own[a][:, None] != own[None, b])
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            one = x < y
            found.append((x[one], y[one]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For sorted rows of tiles: each word's number of near words in a tile and the most frequent of them, ties by code points."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None

    def done(table: pa.Table) -> pa.RecordBatch | None:
        rows = table.num_rows
        keys = [table.column(c).to_numpy() for c in KEY]
        new = np.ones(rows, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        group = np.cumsum(new)
        several = np.bincount(group)[group] > 1
        if not several.any():
            return None
        table, group = table.filter(pa.array(several)), group[several]
        words = table.column("word").to_pylist()
        longer, tail, own, i, j, often = (table.column(c).to_numpy() for c in ("longer", "tail", "own", "i", "j", "n"))
        x, y = compared(group, longer, tail, own, i != j, words)
        if not len(x):
            return None
        one, other = np.concatenate([x, y]), np.concatenate([y, x])
        rank = np.empty(len(words), np.int64)  # frequent first, then by code points
        rank[sorted(range(len(words)), key=lambda r: (-often[r], words[r]))] = np.arange(len(words))
        best = np.full(len(words), len(words))
        np.minimum.at(best, one, rank[other])
        count = np.bincount(one, minlength=len(words))
        at = np.flatnonzero(count)
        of = np.argsort(rank)[best[at]]
        return pa.RecordBatch.from_arrays([pa.array([words[r] for r in at]), pa.array(count[at]), pa.array([words[r] for r in of]), pa.array(often[of])], names=["word", "n_near", "near", "near_n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = lambda r: tuple(batch.column(c)[r].as_py() for c in KEY)
        if n >= 4 * PART and held:
            first = 0
            while first < batch.num_rows and key(first) == last:
                first += 1
            if first < batch.num_rows:
                held.append(batch.slice(0, first))
                out = done(pa.Table.from_batches(held))
                if out is not None:
                    yield out
                held, n, batch = [], 0, batch.slice(first)
        held.append(batch)
        n += batch.num_rows
        last = key(batch.num_rows - 1)
    if held:
        out = done(pa.Table.from_batches(held))
        if out is not None:
            yield out


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n_near, near, near_n) of ``words`` (word, n; distinct, not null): how many are one edit apart, and the most frequent of them.

    A tile of more than ``part`` words is dealt in parts by a hash, and each two parts meet in a tile of their own, so no task
    compares a tile that grows with the data.
    """
    tile, dealt = ["longer", "tail", "piece"], tiles(words)
    large = stored(dealt.groupBy(*tile).count().where(F.col("count") > part).select(*tile, F.ceil(F.col("count") / part).cast("int").alias("parts")), "large")
    met = dealt.join(large, tile, "left").withColumn("own", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    met = met.withColumn("_other", other).withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other"))
    met = met.select(*KEY, "own", "word", "n").repartition(*KEY).sortWithinPartitions(*KEY)
    found = met.mapInArrow(_neighbours, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.near", (-F.col("b.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form) without cycles: the last form, by doubling the way in each round."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ways = stored(ways.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "ways")
        if not ways.where("_moved").limit(1).count():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def variants(docs: DataFrame, row_id: str = "doc_id", text: str = "text", least: int = 6, often: int = 5, every: int = 199, share: int = 5, part: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word that ``word_counts`` gives.

    The form is the word one edit away that occurs most (ties: the first by code points), if it occurs at least ``share`` times as often; the root is the last
    form of the forms, or the word itself. Null and empty texts have no words; no words give an empty result; repeated rows
    count again. Extra columns are not read.
    """
    words = stored(word_counts(docs, row_id, text, least, often, every), "words")
    near = words.join(near_words(words, part), "word", "left")
    has = F.col("near_n") >= share * F.col("n")
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "near")
    named = near.join(roots(near.where("form is not null")), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

