"""Languages of documents as mixtures.

A word's likelihood under each language is a product of conditional letter trigrams, learned from labelled
documents. Expectation-maximisation estimates each document's proportions from its words; a language stays in
the document's set only if leaving it out costs more likelihood than its penalty. All documents of an Arrow
batch are computed together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm.batches import chunks, folded, small_batches, spans, utf8

SYMBOLS = 64
CODES = SYMBOLS**3

# Letters are a-z (1 to 26) and the bytes of letters outside ASCII, folded into the other symbols; 0 is what stands between words.
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % 37


def trigrams(data: np.ndarray, offsets: np.ndarray):
    """Words' letters with a blank after each text: each word's first and last place, each text's first word, and the code of each place's trigram."""
    data = folded(data)
    symbols = np.insert(_SYMBOL[data], offsets[1:], 0)
    offsets = offsets + np.arange(len(offsets))
    starts, ends, first = spans(symbols > 0, offsets)
    code = symbols.copy()
    code[1:] += symbols[:-1] * SYMBOLS
    before = np.zeros_like(symbols)
    before[2:] = symbols[:-2]
    before[1:][symbols[:-1] == 0] = 0  # what stands before a blank doesn't count
    return starts, ends, first, code + before * SYMBOLS * SYMBOLS


def _counter(size: int):
    def run(batches):
        found: dict[str, np.ndarray] = {}
        for table in chunks(batches, "text", size):
            langs = table.column("lang").to_pylist()
            starts, ends, first, code = trigrams(*utf8(table.column("text")))
            cuts = np.append(0, (ends - starts + 1).cumsum())
            inside = np.arange(cuts[-1]) + np.repeat(starts - cuts[:-1], ends - starts + 1)  # a word's letters and the blank behind it
            values, cuts = code[inside], cuts[first]
            for lang in set(langs):
                mine = np.concatenate([values[cuts[k] : cuts[k + 1]] for k, x in enumerate(langs) if x == lang])
                found[lang] = found.get(lang, 0) + np.bincount(mine, minlength=CODES)
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "code", "n"])

    return run


def learn(docs: DataFrame, training: Column, per_language: int = 4000) -> tuple[list[str], np.ndarray]:
    """The languages, in order, and the log likelihood of each trigram code under each: an array (languages, codes).

    ``per_language`` bounds the sample: a language with more training rows gives about as many, chosen by a hash of
    the id. What reaches the driver is a table of at most languages times ``CODES`` counts.
    """
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return [], np.zeros((0, CODES), np.float32)
    rate = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))))[F.col("lang")]
    drawn = rows.where(F.expr("pmod(xxhash64(doc_id, 'train'), 1000000) / 1000000.0") < rate).select("lang", "text")
    counts = drawn.mapInArrow(_counter(2_000_000), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    n = np.zeros((len(langs), CODES))
    n[[langs.index(x) for x in counts["lang"]], counts["code"].to_numpy(int)] = counts["n"].to_numpy(float)
    n = n.reshape(len(langs), SYMBOLS * SYMBOLS, SYMBOLS)
    plain = n.sum(1) + 0.5
    plain /= plain.sum(1, keepdims=True)
    likely = (n + 2 * plain[:, None, :]) / (n.sum(2, keepdims=True) + 2)  # shrunk towards single letters
    return langs, np.log(likely).reshape(len(langs), CODES).astype(np.float32)


def mixtures(likely: np.ndarray, weight: np.ndarray, first: np.ndarray, penalty: float, rounds: int = 6) -> np.ndarray:
    """Proportions (texts, languages) from the words' log likelihoods (languages, words); zero for texts without words."""
    langs, words = likely.shape
    docs = len(first) - 1
    out = np.zeros((langs, docs), np.float32)
    full = np.flatnonzero(first[1:] > first[:-1])
    if not len(full) or not langs:
        return out.T
    cuts, row = first[:-1][full], np.repeat(np.arange(len(full)), np.diff(first)[full])
    peak = likely.max(0)
    share = np.exp(likely - peak)
    total = np.add.reduceat(weight, cuts)

    def fitted(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            part = pi[:, row] * share
            below = np.maximum(part.sum(0), np.float32(1e-30))
            pi = np.stack([np.add.reduceat(p / below * weight, cuts) / total for p in part])
        below = np.maximum((pi[:, row] * share).sum(0), np.float32(1e-30))
        return pi, np.add.reduceat(np.log(below) + peak, cuts, dtype=np.float64)

    pi, gain = fitted(np.full((langs, len(full)), 1 / langs, np.float32), rounds)
    cost = penalty * np.log(np.diff(first)[full] + 1.0)
    tiny = (pi < 1e-4) & (pi < pi.max(0))
    if tiny.any():  # all that hardly count leave at once
        pi = np.where(tiny, 0, pi)
        pi, gain = fitted(pi / pi.sum(0), 1)
    held = np.zeros(pi.shape, bool)  # tried and needed
    for _ in range(langs):
        candidates = np.where((pi > 0) & ~held, pi, np.inf)
        least = candidates.argmin(0)
        may = np.isfinite(candidates.min(0)) & ((pi > 0).sum(0) > 1)
        if not may.any():
            break
        # Only texts that may still lose a language are computed again.
        some = np.flatnonzero(may)
        keep = np.flatnonzero(may[row])
        mine, sub_first = row[keep], np.append(0, np.cumsum(np.diff(first)[full][some]))
        tried = pi[:, some].copy()
        tried[least[some], np.arange(len(some))] = 0
        tried /= tried.sum(0)
        place = np.cumsum(may)[mine] - 1
        s, w, p = share[:, keep], weight[keep], peak[keep]
        sub = sub_first[:-1]
        for _ in range(3):
            part = tried[:, place] * s
            below = np.maximum(part.sum(0), np.float32(1e-30))
            tried = np.stack([np.add.reduceat(x / below * w, sub) / total[some] for x in part])
        now = np.add.reduceat(np.log(np.maximum((tried[:, place] * s).sum(0), np.float32(1e-30))) + p, sub, dtype=np.float64)
        drop = now + cost[some] >= gain[some]
        pi[:, some[drop]], gain[some[drop]] = tried[:, drop], now[drop]
        held[least[some[~drop]], some[~drop]] = True
    out[:, full] = pi
    return out.T


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64()))])


def word_likelihoods(table_of: np.ndarray, code: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 50_000) -> np.ndarray:
    """Log likelihoods (languages, words), so many words at a time that a long text needs no array of all its letters.

    A word's sum goes from its first letter to the blank behind it, where only words' places count.
    """
    out = np.empty((len(table_of), len(starts)), np.float32)
    for at in range(0, len(starts), step):
        a, b = starts[at : at + step], ends[at : at + step] + 1
        part = code[a[0] : b[-1]]
        sums = np.zeros((len(table_of), len(part) + 1))
        np.cumsum(np.where(part % SYMBOLS + part // SYMBOLS % SYMBOLS > 0, table_of[:, part], 0), axis=1, out=sums[:, 1:])
        out[:, at : at + step] = sums[:, b - a[0]] - sums[:, a - a[0]]
    return out


def _predictor(langs: list[str], broadcast, penalty: float, size: int):
    def run(batches):
        table_of = broadcast.value
        for table in chunks(batches, "text", size):
            data, offsets = utf8(table.column("text"))
            starts, ends, first, code = trigrams(data, offsets)
            likely = word_likelihoods(table_of, code, starts, ends)
            pi = mixtures(likely, (ends - starts + 1).astype(np.float32), first, penalty)
            cols = [table.column("doc_id").to_pylist(), [], [], [], []]
            texts = table.column("text")
            for k, p in enumerate(pi):
                if first[k] == first[k + 1] or not langs or not any(map(str.isalpha, texts[k].as_py() or "")):
                    row = ("und", 0.0, [], [])
                else:
                    order = [int(x) for x in np.argsort(-p, kind="stable") if p[x] > 0]
                    row = (langs[order[0]], min(1.0, float(p[order[0]])), [langs[x] for x in order], [float(p[x]) for x in order])
                for col, x in zip(cols[1:], row, strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _OUT, strict=True)], schema=_OUT)

    return run


def identify(docs: DataFrame, training: Column | None = None, penalty: float = 2.0, per_language: int = 4000, chunk_bytes: int = 300_000) -> DataFrame:
    """For each row: ``doc_id, lang_pred, score, langs, proportions``, the languages by falling proportion.

    ``training`` says which rows may be learned from (default: all with a language). ``lang_pred`` is the language
    of the largest proportion, ``score`` that proportion; ``und`` and 0 if the text is null, has no letter, or
    nothing could be learned. ``penalty`` times the log of the number of words is what a further language must gain.

    Predictions see the text only. Null ids and repeated rows come back as they are. Empty table: empty result.
    """
    small_batches(docs.sparkSession)
    langs, likely = learn(docs, F.lit(True) if training is None else training, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(likely)  # languages times 2**18 numbers
    return docs.select("doc_id", "text").mapInArrow(_predictor(langs, shared, penalty, chunk_bytes), "doc_id long, lang_pred string, score double, langs array<string>, proportions array<double>")
