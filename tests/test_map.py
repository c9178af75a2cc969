"""Islands, example sets and running bests against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from medialake.operators import islands as I
from medialake.operators import search as S


def plain_islands(points, radius, least, smallest):
    d = {(a, b): (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 for a, p in points.items() for b, q in points.items()}
    near = {a: [b for b in points if d[a, b] <= radius * radius] for a in points}
    core = {a for a in points if len(near[a]) >= least}
    label = {}
    for a in sorted(core):
        if a not in label:
            todo, label[a] = [a], a
            while todo:
                for b in near[todo.pop()]:
                    if b in core and b not in label:
                        label[b] = a
                        todo.append(b)
    for a in set(points) - core:
        close = [(d[a, b], b) for b in near[a] if b in core]
        if close:
            label[a] = label[min(close)[1]]
    sizes = pd.Series(label).value_counts()
    return {(a, a in core, int(label[a]) if a in label and sizes[label[a]] >= smallest else None) for a in points}


@pytest.mark.parametrize("seed", [1, 2])
def test_islands_equal_plain(spark, seed):
    rnd = np.random.default_rng(seed)
    xy = np.concatenate([rnd.normal(0, 0.5, (150, 2)), rnd.normal(3, 0.05, (120, 2)), rnd.uniform(-4, 4, (120, 2)), np.tile([[-3.0, -3.0]], (40, 1)), np.round(rnd.uniform(-1, 1, (60, 2)), 1) + 5, [[0.3 * i - 3, 6.0] for i in range(20)]])
    points = {i: (float(x), float(y)) for i, (x, y) in enumerate(xy)}
    df = spark.createDataFrame([(i, *p, "other") for i, p in points.items()] + [(900, None, 1.0, "x"), (901, float("nan"), 1.0, "x")], "id long, x double, y double, cx string")
    got = I.islands(df, "id", "x", "y", 0.3, 5, 25).collect()
    assert len(got) == len(points) + 2
    assert {tuple(r) for r in got} == plain_islands(points, 0.3, 5, 25) | {(900, False, None), (901, False, None)}
    assert I.islands(df.limit(0), "id", "x", "y", 0.3).collect() == []


def unit(n, d, seed):
    v = np.random.default_rng(seed).normal(size=(n, d))
    return v / np.sqrt((v * v).sum(1))[:, None]


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")


@pytest.mark.parametrize("block", [2000, 7])
def test_nearest_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BATCH", 50)
    v = unit(400, 6, 3)
    rows = frame(spark, np.concatenate([v, v[:5]]))  # five ties
    got = S.nearest(rows.where("id % 20 = 0"), rows, 9, block=block).collect()
    s = v[::20] @ np.concatenate([v, v[:5]]).T
    for q in range(0, 400, 20):
        order = sorted((i for i in range(405) if i != q), key=lambda i: (-round(s[q // 20, i], 9), i))[:9]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == order
    assert S.nearest(rows.limit(0), rows, 3).collect() == []


@pytest.mark.parametrize("strategy", ["average", "best"])
def test_examples_equal_plain(spark, strategy):
    rnd, v = random.Random(4), unit(300, 5, 8)
    given = {q: ([rnd.randrange(300) for _ in range(n)], [rnd.randrange(300) for _ in range(m)]) for q, (n, m) in enumerate([(1, 0), (3, 2), (150, 0), (20, 90), (0, 4), (2, 1)])}
    given[5][0].append(7777)  # no such row
    rows = [(q, i, side == 0, place) for q, sides in given.items() for side in (0, 1) for place, i in enumerate(sides[side])]
    df = spark.createDataFrame([*rows, (None, 1, True, 0), (9, None, True, 0)], "request long, id long, positive boolean, place int")
    got = S.like_examples(df, frame(spark, v), 12, strategy, most=16, block=2).collect()
    thin = lambda ids: ids if len(ids) <= 16 else [ids[int(i * (len(ids) / 16))] for i in range(16)]
    for q, (plus, minus) in given.items():
        p, m = ([i for i in thin(side) if i < 300] for side in (plus, minus))
        answers = [(r.id, round(r.score, 6)) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        if not p:
            assert not answers
            continue
        if strategy == "average":
            want = v[p].mean(0) - (v[m].mean(0) if m else 0)
            score = v @ want / np.sqrt(want @ want)
        else:
            score = (v[p] @ v.T).max(0) - ((v[m] @ v.T).max(0) if m else 0)
        order = sorted((i for i in range(300) if i not in plus + minus), key=lambda i: (-round(score[i], 9), i))[:12]
        assert answers == [(i, round(score[i], 6)) for i in order]


def test_thinned_is_even(spark):
    for n in (5, 64, 65, 127, 128, 1000):
        rows = spark.range(n).select(F.lit(1).alias("g"), "id")
        assert sorted(r.id for r in S.thinned(rows, ["g"], "id", 64).collect()) == [int(i * (n / 64)) for i in range(64)] if n > 64 else list(range(n))
