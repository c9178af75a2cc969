"""Blocks of similarity joins: strips give what one product gives, and a vector is sent to a bounded number of tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialake.operators import cells as K


@pytest.mark.parametrize("same", [True, False])
def test_strips_give_the_whole_product(same):
    rnd = np.random.default_rng(4)
    n, m = K.STRIP * 2 + 300, K.STRIP + 100
    block = lambda k, first: {"id": rnd.permutation(k) + first, "v": (lambda v: v / np.sqrt((v * v).sum(1))[:, None])(rnd.normal(size=(k, 16)))}
    x = block(n, 0)
    y = x if same else block(m, n)
    got = K.product(x, y, 0.8, K._pairs, same)
    p, q = np.nonzero(x["v"] @ y["v"].T >= 0.8)
    want = {(min(a, b), max(a, b)) for a, b in zip(x["id"][p], y["id"][q], strict=True) if a != b}
    assert len(got) == len(want) > 50 and set(zip(got["a"], got["b"], strict=True)) == want
    tree = K.product(x, y, 0.8, K._forest, same)
    assert len(tree) < len({i for pair in want for i in pair})
    label = lambda links: dict(zip(*(lambda t: (t["b"], t["a"]))(K._tree(*np.array(sorted(links)).T)), strict=True))
    assert label(want) == label(set(zip(tree["a"], tree["b"], strict=True)))


def test_blocks_grow_rather_than_their_number():
    for n in (10, 2000, 64_000, 100_000, 600_000, 1_600_000):
        assert -(-n // K.block_rows(n, 2000)) <= K.BLOCKS and K.block_rows(n, 2000) <= K.MOST_ROWS
    assert K.block_rows(10_000_000, 2000) == K.MOST_ROWS and K.block_rows(50, 2000) == 2000


def test_a_vector_is_sent_to_as_many_tasks_whatever_the_rows():
    """From 16,000 to 400,000 rows what is shuffled grows in proportion."""
    assert {-(-n // K.block_rows(n, 2000)) for n in (16_000, 20_000, 51_282, 102_564, 400_000)} == {8}


@pytest.mark.parametrize("cells", [True, False])
def test_a_block_that_meets_itself_is_sent_once(spark, monkeypatch, cells):
    """With two blocks three products need each row at two of them, not three."""
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(400, 12))
    v /= np.sqrt((v * v).sum(1))[:, None]
    heads = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").localCheckpoint()
    sent, whole = [], K._multiplied
    monkeypatch.setattr(K, "_multiplied", lambda left, right, *rest: (sent.append(left.count() + right.count()), whole(left, right, *rest))[1])
    got = (K.met if cells else K.all_met)(heads, 0.3, K._pairs, 200)
    s = v @ v.T
    assert {(r.a, r.b) for r in got.collect()} == {(a, b) for a in range(400) for b in range(a + 1, 400) if s[a, b] >= 0.3 - 1e-12}
    assert sent[0] <= 2 * len(v)


@pytest.mark.parametrize("mixed", [False, True])
def test_copies_meet_by_their_hash(spark, monkeypatch, mixed):
    """No join sends vectors, unless different ones share a hash; these are told apart."""
    if mixed:
        monkeypatch.setattr(K, "vector_key", lambda v: F.pmod(F.xxhash64(v), F.lit(3)))
    unit = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)] + [(40, [-0.0, 1.0])], "id long, v array<double>")
    heads = unit.groupBy("v").agg(F.min("id").alias("id"))
    got = K.copies(unit, heads)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted([(i % 7, i) for i in range(7, 40)] + [(0, 40)])
    assert mixed or "v#" not in " ".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)


def test_a_length_is_taken_once():
    """Not again for each place of a vector: its square would stand inside the function that divides."""
    from medialake.operators.vectors import normed

    plan = lambda v: str(normed(v)._jc.toString()) if hasattr(normed(v), "_jc") else str(normed(v))
    assert plan(F.col("v")).lower().count("sqrt") == 1
