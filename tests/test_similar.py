"""All pairs of similar vectors against plain products."""

import math

import numpy as np
import pandas as pd

from medialake.operators import cells as K
from medialake.operators import vectors as V


def test_similar_pairs_hold_copies_with_all_their_links(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(8, 6))
    x = np.concatenate([x, x[:5], x[:2], np.tile(x[:1], (4, 1))])
    ids = r.permutation(len(x) * 3)[: len(x)]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + [(int(ids[0]), x[1].tolist()), (None, x[0].tolist()), (900, None), (901, [])]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    every = [(int(i), v) for i, v in zip(ids, u)] + [(int(ids[0]), u[1])]
    want = sorted((a, b, round(float(p @ q), 5)) for a, p in every for b, q in every if a < b and p @ q >= 0.3)  # an id that two rows have meets no row of its own
    got = V.similar_pairs(spark.createDataFrame(rows, "id long, v array<double>"), "v", "id", 0.3, block=7).collect()
    assert sorted((t.a, t.b, round(t.score, 5)) for t in got) == want and len(want) > 60


def test_vectors_without_direction_meet_all(spark):
    """As the SQL has it: their cosine is NaN, which is greater than any number."""
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [float("nan"), 1.0]), (0, [1.0, 1.0]), (5, [0.0, 0.0])]
    got = V.similar_pairs(spark.createDataFrame(rows, "id long, v array<double>"), "v", "id", 0.9).collect()
    assert all(math.isnan(t.score) for t in got) and sorted((t.a, t.b) for t in got) == sorted((a, b) for a in range(6) for b in range(a + 1, 6) if {a, b} & {1, 4, 5})


def test_products_are_sent_on_strip_by_strip():
    """A block of copies has a square of pairs; none of it is gathered."""
    x = {"id": np.arange(3 * K.STRIP), "v": np.ones((3 * K.STRIP, 1))}
    sizes = [len(df) for df in K.product(x, x, 0.5, lambda p, q, a, b, s: pd.DataFrame({"a": a[p[:1]]}), True)]
    assert len(sizes) == 6
