"""Similarity joins in cells against all products."""

import numpy as np
import pytest

from medialake.operators import cells as K


def blobs(seed, groups, each, d, noise):
    rnd = np.random.default_rng(seed)
    v = (rnd.normal(size=(groups, d))[:, None] + noise * rnd.normal(size=(groups, each, d))).reshape(-1, d)
    return v / np.sqrt((v * v).sum(1))[:, None]


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, v array<double>, cell int")


@pytest.mark.parametrize(("least", "per_cell", "noise"), [(0.95, 40, 0.1), (0.95, 7, 0.3), (0.5, 60, 0.5), (0.2, 30, 1.0), (0.999, 1, 0.05)])
def test_pairs_equal_all_products(spark, least, per_cell, noise):
    v = blobs(int(per_cell), 9, 25, 8, noise)
    v[5] = v[200]
    s = v @ v.T
    want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if s[a, b] >= least - 1e-12 and 200 not in (a, b)}
    got = K.pairs(frame(spark, v), "v", "vec_id", least, per_cell).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b) for r in got} == want
    assert all(abs(r.score - s[r.a, r.b]) < 1e-9 for r in got)


def test_stacks_and_few_rows(spark):
    v = blobs(3, 12, 20, 6, 0.15)
    v = np.concatenate([v, np.tile(v[:1], (300, 1))])  # a vector that more than half of all rows have
    df = frame(spark, v)
    s = v @ v.T >= 0.95
    label = np.arange(len(v))
    while True:
        new = np.array([label[row].min() for row in s])
        if (new == label).all():
            break
        label = new
    sizes = np.bincount(label, minlength=len(v))
    got = {r.vec_id: r.head for r in K.stack_members(df, "v", "vec_id", 0.95, 30).collect()}
    assert got == {i: int(x) for i, x in enumerate(label) if sizes[x] > 1}
    heads = K._heads(df, "v", "vec_id", lambda x: x)[1]
    edges = K.met(heads, 0.95, K._forest, 30).count()
    assert edges < K.met(heads, 0.95, K._pairs, 30).count() / 3


def test_bounds_leave_cells_out(spark):
    """Among clusters, a vector visits few of the cells, so products grow with the cells' own sizes."""
    centre = blobs(1, 40, 1, 16, 0)
    v = blobs(1, 40, 30, 16, 0.05)
    homes = list(K._homes(type("B", (), {"value": centre})())(iter([frame(spark, v).drop("cell").toPandas().rename(columns={"vec_id": "id"})])))[0]
    radius = np.array([np.arccos(np.clip(homes[homes["cell"] == c]["own"].min(), -1, 1)) for c in range(40)])
    visits = sum(len(x) for x in K._visits(type("B", (), {"value": (centre, radius)})(), 0.95)(iter([homes])))
    assert visits < len(v) / 10


def test_nothing_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "vec_id long, v array<double>")
    assert K.stack_members(df, "v", "vec_id", 0.9).collect() == [] and K.pairs(df.limit(0), "v", "vec_id", 0.9).collect() == []
