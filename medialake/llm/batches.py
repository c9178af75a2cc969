"""Arrow and numpy helpers that work on the UTF-8 bytes of many texts at once, inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Odd multipliers of the rolling hashes, with their inverses modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def small_batches(spark, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch, so that a batch of long texts stays small in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.Table]:
    """Groups or slices record batches into tables with about ``size`` bytes of text; a longer text is a table of its own."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size - n, "right")))
            held.append(batch.slice(at, to - at))
            n += int(ends[to - 1] - base)
            at = to
            if n >= size or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def whole(column: pa.ChunkedArray) -> pa.Array:
    """A table's column as one array."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def utf8(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offset of each text, plus the end."""
    arr = pc.fill_null(whole(column), "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    offsets = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes that don't cross texts: starts, ends, and each text's first run (plus the number of runs)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[full] = inside[full]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z lower-cased."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def folded(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z and the capital letters of Latin-1 lower-cased."""
    high = (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    high[1:] &= data[:-1] == 0xC3
    high[:1] = False
    return lowered(data) + high.astype(np.uint8) * np.uint8(32)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for each pair, independent of where it stands."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(pow(base, -1, 2**64), len(values) + 1)[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return mixed(rolled(data.astype(np.uint64) + np.uint64(1), starts, ends, BYTE_BASE) + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, starts: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``n`` words from each start on."""
    return mixed(rolled(mixed(words, seed) if seed else words, starts, starts + n, WORD_BASES[seed % 2]), 7 * seed + n)


def window_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose words start at ``first``: the word at which each whole window of ``n`` words starts, and its text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(rows)) + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts), rows
