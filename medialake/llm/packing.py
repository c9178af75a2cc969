"""Best-fit packing of token pieces into sequences, by exact complements over the histogram of piece lengths.

Tasks tokenise whole texts and cut them into pieces; the histogram of piece lengths, which has at most
``capacity`` entries at any scale, is all that reaches the driver. There the plan is made as patterns (how many
sequences hold which lengths); every piece then finds its sequence from its length and its rank among the
pieces of that length.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.llm.batches import SPACES, chunks, lowered, small_batches, spans, utf8, whole, word_hashes
from medialake.storage import stored


# ASCII letters, digits and signs; the tokenizer parts one from another wherever they meet. Apostrophes start endings such as
# 's, and <, | and > may spell special tokens, so nothing is parted beside these.
_KINDS = np.zeros(256, np.uint8)
_KINDS[65:91] = _KINDS[97:123] = 1
_KINDS[48:58] = 2
_KINDS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = 3


def atoms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of all words that are tokenised each for itself, on a copy with A-Z lower-cased unless special tokens may occur."""
    if b"<|" not in data.tobytes():
        data = lowered(data)
    starts, ends, _ = spans(~SPACES[data], offsets)
    kinds = _KINDS[data]
    parted = np.flatnonzero((kinds[1:] > 0) & (kinds[:-1] > 0) & (kinds[1:] != kinds[:-1])) + 1
    parted = parted[~np.isin(parted, offsets)]
    starts, ends = np.sort(np.concatenate([starts, parted])), np.sort(np.concatenate([ends, parted]))
    return data, starts, ends, np.searchsorted(starts, offsets)


class Encoder:
    """A tokenizer's ids of many words at once; words that keep their length when normalised are encoded as running text."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token.removesuffix(suffix))  # byte-level tokens have a letter for each byte

    def _plain(self, words: list[bytes]) -> np.ndarray:
        """Words of ASCII and Latin-1 letters only, without what may spell a special token."""
        data, offsets = np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum([len(w) for w in words]))
        odd = (data >= 0xC0) & (data != 0xC3) | np.isin(data, [0, ord("<"), ord("|"), ord(">")])
        sums = np.append(0, odd.cumsum())
        return sums[offsets[1:]] == sums[offsets[:-1]]

    def __call__(self, words: list[bytes], each: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and each word's number of ids."""
        plain = self._plain(words)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, rest = np.flatnonzero(plain), [np.flatnonzero(~plain)]
        for k in range(0, len(at), each):
            part = at[k : k + each]
            text = b" ".join([words[x] for x in part.tolist()]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum([len(words[x]) for x in part.tolist()])
            sums = self.bytes_of[ids].cumsum()
            to = np.searchsorted(sums, ends)
            if len(ids) and to[-1] == len(ids) - 1 and (sums[to] == ends).all():
                out.append((part, np.diff(to, prepend=-1), ids))
            else:
                rest.append(part)
        rest = np.concatenate(rest)
        if len(rest):
            lists = [x.ids for x in self.tokenizer.encode_batch_fast([words[x].decode() for x in rest], add_special_tokens=False)]
            out.append((rest, np.fromiter(map(len, lists), np.int64, len(lists)), np.fromiter(chain.from_iterable(lists), np.int32)))
        order, long, ids = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        counts = np.zeros(len(words), np.int64)
        counts[order] = long
        from_ = long.cumsum() - long
        place = np.zeros(len(words), np.int64)
        place[order] = from_
        return ids[np.arange(len(ids)) + np.repeat(place - (counts.cumsum() - counts), counts)], counts


class WordIds:
    """Token ids of words, remembered in a hash table of bounded size that whole arrays of words are looked up in.

    Words are told apart by 64 bits of a hash.
    """

    def __init__(self, encode: Encoder, slots: int = 1 << 21):
        self.encode, self.slots = encode, slots
        self.clear()

    def clear(self, words: int = 0) -> None:
        slots = max(self.slots, 1 << (2 * words).bit_length())
        self.mask, self.limit = np.uint64(slots - 1), slots // 2
        self.keys, self.where = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.at, self.long, self.ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self.n = self.used = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, or -1; linear probing."""
        out = np.full(len(hashes), -1, np.int32)
        left, slot = np.arange(len(hashes)), hashes & self.mask
        while len(left):
            found = self.where[slot]
            hit = (found >= 0) & (self.keys[slot] == hashes[left])
            out[left[hit]] = found[hit]
            go = (found >= 0) & ~hit
            left, slot = left[go], (slot[go] + np.uint64(1)) & self.mask
        return out

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        flat, long = self.encode(words)
        n, used = self.n + len(words), self.used + len(flat)
        grown = lambda a, m: a if m <= len(a) else np.concatenate([a, np.zeros(max(m, 2 * len(a)) - len(a), a.dtype)])
        self.at, self.long, self.ids = grown(self.at, n), grown(self.long, n), grown(self.ids, used)
        self.at[self.n : n] = self.used + np.append(0, long.cumsum()[:-1])
        self.long[self.n : n], self.ids[self.used : used] = long, flat
        names, slot = np.arange(self.n, n, dtype=np.int32), hashes & self.mask
        while len(names):
            free = self.where[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.where[slot[put]], self.keys[slot[put]] = names[put], hashes[names[put] - self.n]
            rest = np.ones(len(names), bool)
            rest[put] = False
            names, slot = names[rest], slot[rest]
            slot = np.where(self.where[slot] >= 0, (slot + np.uint64(1)) & self.mask, slot)
        self.n, self.used = n, used

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in a row, and each word's number of ids."""
        hashes = word_hashes(data, starts, ends)
        known = self.find(hashes)
        if (known < 0).any():
            new, first = np.unique(hashes[known < 0], return_index=True)
            first = np.flatnonzero(known < 0)[first]
            if self.n + len(new) > self.limit:  # start anew, with room for all words of this chunk
                new, first = np.unique(hashes, return_index=True)
                self.clear(len(new))
            raw = data.tobytes()
            for k in range(0, len(new), 1 << 15):
                part = slice(k, k + (1 << 15))
                self.learn(new[part], [raw[a:b] for a, b in zip(starts[first[part]].tolist(), ends[first[part]].tolist(), strict=True)])
            known = self.find(hashes)
        long = self.long[known].astype(np.int64)
        cuts = long.cumsum()
        return self.ids[np.arange(cuts[-1] if len(cuts) else 0) + np.repeat(self.at[known] - (cuts - long), long)], long


_learned: dict[str, WordIds] = {}  # one table in a worker process, kept from task to task


def _piecer(tokenizer_file: str, capacity: int, end_id: int, keep_ids: bool, size: int):
    def run(batches):
        if tokenizer_file not in _learned:
            _learned[tokenizer_file] = WordIds(Encoder(tokenizer_file))
        table_of = _learned[tokenizer_file]
        for table in chunks(batches, "text", size):
            data, offsets = utf8(table.column("text"))
            data, starts, ends, first = atoms(data, offsets)
            ids, long = table_of.of(data, starts, ends)
            sums = np.append(0, long.cumsum())
            cuts = sums[first]
            ids = np.insert(ids, cuts[1:], end_id).astype("<u4")
            cuts = cuts + np.arange(len(cuts))
            sizes = np.diff(cuts)
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(pieces.cumsum() - pieces, pieces)
            begin = piece * capacity
            length = np.minimum(sizes[row] - begin, capacity)
            at = cuts[row] + begin
            view = memoryview(ids).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(at))
            cols = [whole(table.column("doc_id")).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(begin), pa.array(length), pa.array(crc)]
            if keep_ids:
                ends_ = np.append(0, length.cumsum()).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends_), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return run


class Sums:
    """Available lengths, and an index of their sums: how many pairs of available lengths add up to each sum.

    A triple for a gap is an available length whose remainder is an indexed pair sum.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        have = (self.left > 0).astype(np.float64)
        ordered = np.rint(np.fft.irfft(np.fft.rfft(have, 4 * capacity) ** 2, 4 * capacity)[: capacity + 1]).astype(np.int64)
        lengths = np.arange(capacity // 2 + 1)
        ordered[2 * lengths] -= have[lengths].astype(np.int64)  # a length with itself counts only if it is there twice
        self.pairs = ordered // 2
        self.pairs[2 * lengths] += self.left[lengths] > 1

    def put(self, length: int, n: int) -> None:
        """Sets how many are left of a length."""
        was, self.left[length] = int(self.left[length]), n
        if (was > 0) != (n > 0):
            others = np.flatnonzero(self.left[: max(0, len(self.left) - length)])
            self.pairs[others[others != length] + length] += 1 if n else -1
        if (was > 1) != (n > 1) and 2 * length < len(self.pairs):
            self.pairs[2 * length] += 1 if n > 1 else -1

    def pair(self, gap: int) -> tuple[int, int]:
        """The pair of an indexed sum with the longest piece."""
        have = self.left[1:gap] > 0
        both = have & have[::-1]
        if gap % 2 == 0 and self.left[gap // 2] < 2:
            both[gap // 2 - 1] = False
        a = int(np.flatnonzero(both)[-1]) + 1
        return a, gap - a

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap exactly."""
        if self.left[gap]:
            return (gap,)
        if self.pairs[gap]:
            return self.pair(gap)
        longest = np.flatnonzero((self.left[:gap] > 0) & (self.pairs[gap:0:-1] > 0))[::-1]
        for a in longest.tolist():
            if 3 * a < gap:
                break
            n = int(self.left[a])
            self.put(a, n - 1)
            found = self.pair(gap - a) if self.pairs[gap - a] else None
            self.put(a, n)
            if found:
                return (a, *found)
        return None


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths descending) that use up all pieces of ``counts`` (length -> number).

    Longest first: a gap left by the longest piece is filled exactly by one length, by a pair, or by a triple of
    lengths still available, found in an index of their sums; a combination is used as often as its counts allow.
    What has no exact complement is set aside, and packed by best fit decreasing into the open sequences.
    """
    sums = Sums(counts, capacity)
    left, put = sums.left, sums.put
    patterns: list[tuple[int, tuple[int, ...]]] = []

    aside = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        while left[length]:
            n = int(left[length])
            if length == capacity:
                patterns.append((n, (length,)))
                put(length, 0)
                break
            put(length, n - 1)
            fill = sums.complement(capacity - length)
            put(length, n)
            if fill is None:
                aside[length] = n
                put(length, 0)
                break
            uses: dict[int, int] = {}
            for x in (length, *fill):
                uses[x] = uses.get(x, 0) + 1
            times = min(int(left[x]) // k for x, k in uses.items())
            for x, k in uses.items():
                put(x, int(left[x]) - k * times)
            patterns.append((times, tuple(sorted((length, *fill), reverse=True))))

    open_: dict[int, list[list]] = {}  # gap -> [[number, lengths], ...]
    gaps = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        n = int(aside[length])
        while n:
            fits = np.flatnonzero(gaps[length:])
            if fits.size:
                gap = length + int(fits[0])
                group = open_[gap][-1]
                each = max(1, min(gap // length, n // group[0])) if group[0] <= n else 1
                used = min(group[0], n)
                new = (group[1] + (length,) * each, used)
                group[0] -= used
                if not group[0]:
                    open_[gap].pop()
            else:
                each = min(capacity // length, n)
                used = n // each
                gap, new = capacity, ((length,) * each, used)
            gaps[gap] -= used if gap < capacity else 0
            n -= each * used
            rest = gap - each * length
            if rest:
                open_.setdefault(rest, []).append([used, new[0]])
                gaps[rest] += used
            else:
                patterns.append((used, new[0]))
    patterns += [(n, lengths) for groups in open_.values() for n, lengths in groups if n]
    return patterns


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, pieces of that length in a sequence, offset), by length and rank."""
    rows, ranks, base = [], {}, 0
    for n, lengths in patterns:
        at = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            r = ranks.get(length, 0)
            ranks[length] = r + n * each
            rows.append((length, r, r + n * each, base, each, at))
            at += each * length
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _placer(slots: np.ndarray):
    def run(batches):
        keys = slots[:, 0].astype(np.uint64) << np.uint64(48) | slots[:, 1].astype(np.uint64)
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            s = slots[np.searchsorted(keys, length.astype(np.uint64) << np.uint64(48) | rank.astype(np.uint64), "right") - 1]
            k = rank - s[:, 1]
            sequence, offset = s[:, 3] + k // np.maximum(s[:, 4], 1), s[:, 5] + k % np.maximum(s[:, 4], 1) * length
            names = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False, split: int = 64, chunk_bytes: int = 1_000_000) -> DataFrame:
    """Places every piece of every document in a sequence of at most ``capacity`` tokens.

    A document is its token ids and ``end_id``; longer ones are cut into pieces of ``capacity``, the last may be
    shorter. Returns ``doc_id, piece, start, length, ids_crc32`` (and ``ids`` if ``keep_ids``), ``sequence_id`` and
    ``offset``; offsets in a sequence are gapless from 0. The tokenizer file must part ASCII
    letters, digits and signs and fold case, as public word-level BPE files do; tests hold it against whole texts.

    Null or empty text: one piece that is ``end_id`` alone. Null or repeated ``doc_id``: each row is a document of
    its own. Empty table: empty result. ``split`` is the least number of parts a length's pieces are ranked in, so that
    a length that a third of all pieces share is no single task; a part has about 100,000 pieces at most. Words are told
    apart by 64 bits of a hash.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_piecer(tokenizer_file, capacity, end_id, keep_ids, chunk_bytes), schema), "pieces")
    split = max(split, pieces.count() // 100_000 + 1)
    pieces = pieces.withColumn("part", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32), {split})").cast("int"))
    counts = stored(pieces.groupBy("length", "part").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("in_part", rank).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("in_part")).drop("part", "in_part", "before")
    names = [x.split()[0] for x in schema.split(", ")]
    return ranked.select(*names, "rank").mapInArrow(_placer(_slots(plan_patterns(histogram, capacity))), schema + ", sequence_id long, offset long")
