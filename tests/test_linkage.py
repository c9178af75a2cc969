"""Average linkage: what it stores, and its searches against plain products."""

import numpy as np
import pandas as pd
import pytest

from medialake.operators import linkage as L
from medialake.operators import vectors as V
from medialake.storage import stored


def test_no_table_has_a_row_a_link(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = np.abs(r.normal(size=(700, 12)))  # nearly all of 244,650 pairs are links
    sizes = []

    def kept(df, name="t"):
        out = stored(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(V, "stored", kept)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {t.id: t.cluster for t in V.average_linkage(df, "v", "id", 0.5, 200).collect()}
    assert max(sizes) < 5 * len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    alone = L.linked(0.5)(pd.DataFrame({"c": np.arange(len(x)), "n": 1, "v": list(u)}))
    assert got == dict(zip(alone["c"].tolist(), alone["cluster"].tolist()))


@pytest.mark.parametrize(("most_sent", "most_rows"), [(10_000, 100), (0, 100), (0, 40)])
def test_searches_sent_and_in_blocks(spark, most_sent, most_rows):
    r = np.random.default_rng(9)
    v = r.normal(size=(300, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True) * r.uniform(1, 1.2, size=(300, 1))
    seek = r.random(300) < 0.2
    s = np.round(v @ v.T, 12)
    np.fill_diagonal(s, -1)
    rows = [(i, 1, v[i].tolist(), i if seek[i] else 1_000, L.SEEKS if seek[i] else 0.8) for i in range(300)]  # the others have one at 0.8
    table = stored(spark.createDataFrame(rows, "c long, n long, v array<double>, o long, s double"))
    found = {}
    for t in L.sought(table, int(seek.sum()), 300, 0.4, most_sent, most_rows, 20).collect():
        found[t.c] = max(found.get(t.c, (-1, 0)), (t.s, -t.o))
    want = {i: (s[i].max(), -int(s[i].argmax())) for i in range(300) if seek[i] and s[i].max() >= 0.4}
    want |= {i: (s[i][seek].max(), -int(np.flatnonzero(seek)[s[i][seek].argmax()])) for i in range(300) if not seek[i] and s[i][seek].max() > 0.8}
    assert {c: o for c, (_, o) in found.items()} == {c: o for c, (_, o) in want.items()}
    assert all(abs(found[c][0] - want[c][0]) < 2e-12 for c in want) and len(want) > seek.sum()


def test_pairs_as_good_as_equal_are_told_apart():
    """Copies but for less than short floats hold, ties among them, and more pairs than are summed again at once."""
    v = np.concatenate([np.tile([[0.6, 0.8]], (600, 1)), [[0.6 + 1e-9, 0.8 - 7.5e-10]], [[0.8, 0.6]]])
    rows = {"id": np.arange(len(v)) * 3, "v": v}
    near = L.Nearest(rows, rows, True, 0.5).x
    s = np.round((v[:, None] * v[None]).sum(2), 12)
    np.fill_diagonal(s, -1)
    assert (near[0] == s.max(1)).all() and (near[1] == s.argmax(1) * 3).all()


def test_rows_with_nan_and_without_links_stay_alone(spark):
    rows = [(1, [float("nan"), 1.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [0.1, 1.0])]
    got = {t.id: t.cluster for t in V.average_linkage(spark.createDataFrame(rows, "id long, v array<double>"), "v", "id", 0.9, 1).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    assert V.average_linkage(spark.createDataFrame([], "id long, v array<double>"), "v", "id", 0.9).collect() == []
