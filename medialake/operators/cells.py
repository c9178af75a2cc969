"""Exact similarity joins of unit vectors in cells around pivots: bounds decide which cells a vector can have partners in."""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.operators.graph import connected_components
from medialake.storage import stored

SLACK = 1e-7  # on all bounds, for rounding
STRIP = 2000  # rows of each side that are multiplied at once
BLOCKS = 32  # most cells
GROWING = 8  # blocks from which on these grow rather than their number; each two are a task, 36 in all
MOST_ROWS = 100_000  # of a block on average, at most half more; with 64 places about 50 MB


def pivots(heads: DataFrame, n: int, sample: int = 16, rounds: int = 4) -> np.ndarray:
    """``n`` centres of cells: a few rounds of spherical k-means over ``n * sample`` vectors that a hash of the id chooses.

    Any centres give the same pairs; good ones let fewer cells meet.
    """
    drawn = heads.orderBy(F.xxhash64("id"), "id").limit(n * sample).select("v").collect()  # bounded by n
    v = np.array([r["v"] for r in drawn], float)
    centre = v[:n].copy()
    for _ in range(rounds if len(v) > n else 0):
        home = np.concatenate([(part @ centre.T).argmax(1) for part in np.array_split(v, max(1, len(v) // 4096))])
        total = np.zeros_like(centre)
        np.add.at(total, home, v)
        size = np.sqrt((total * total).sum(1))
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1e-30)[:, None], centre)
    return centre


def _homes(shared):
    def run(batches):
        centre = shared.value
        for df in batches:
            if len(df):
                s = np.stack(df["v"].to_numpy()) @ centre.T
                home = s.argmax(1)
                yield df.assign(cell=home, own=s[np.arange(len(df)), home])

    return run


def _visits(shared, least: float):
    """The cells above a vector's own that may hold a partner of it.

    A partner is at most ``reach`` away. Partners of another cell lie beyond the plane between the two centres, so the plane is no farther; and they
    lie within their cell's radius, so the cell's centre is no farther than both angles together.
    """
    reach, angle = (2 - 2 * least) ** 0.5 + SLACK, np.arccos(np.clip(least, -1, 1)) + SLACK

    def run(batches):
        centre, radius = shared.value
        apart = np.sqrt(np.maximum(((centre[:, None] - centre[None]) ** 2).sum(2), 1e-30)) if len(centre) <= 512 else None
        for df in batches:
            for at in range(0, len(df), 1000):
                part = df.iloc[at : at + 1000]
                home = part["cell"].to_numpy()
                s = np.stack(part["v"].to_numpy()) @ centre.T
                between = apart[home] if apart is not None else np.sqrt(np.maximum(2 - 2 * centre[home] @ centre.T, 1e-30))
                may = (s[np.arange(len(part)), home][:, None] - s <= reach * between) & (np.arccos(np.clip(s, -1, 1)) <= radius[None, :] + angle)
                may &= np.arange(len(centre))[None, :] > home[:, None]
                row, cell = np.nonzero(may)
                if len(row):
                    yield pd.DataFrame({"id": part["id"].to_numpy()[row], "v": part["v"].to_numpy()[row], "cell": cell})

    return run


def _pairs(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    keep = a[x] != b[y]
    p, q, s = a[x][keep], b[y][keep], s[x, y][keep]
    return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q), "score": s})


def _forest(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    """For each linked row the smallest id that it reaches within the two blocks; no more rows than there are, however many pairs."""
    return _tree(a[x], b[y])


def _tree(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """For each end of the links (a, b) but the smallest of its component a link to that one."""
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = where[: len(a)], where[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[label[linked]], "b": ids[linked], "score": np.ones(len(linked))})


def _guests(shared, least: float):
    """How many vectors visit each cell."""

    def run(batches):
        n = np.zeros(len(shared.value[0]), np.int64)
        for df in _visits(shared, least)(batches):
            np.add.at(n, df["cell"].to_numpy(), 1)
        cell = np.flatnonzero(n)
        yield pd.DataFrame({"cell": cell, "n": n[cell]})

    return run


def hits(x: dict, y: dict, least: float, same: bool, slack: float = 1e-12) -> Iterator[tuple]:
    """(i, j, p, q, s) for each strip of ``x`` from row i and of ``y`` from row j, two blocks (id, v): s[p, q] are the scores that reach ``least``, but for ``slack``. ``same``: the block meets itself."""
    for i in range(0, len(x["id"]), STRIP):
        for j in range(0, len(y["id"]), STRIP):
            if same and j + STRIP <= i:
                continue
            s = x["v"][i : i + STRIP] @ y["v"][j : j + STRIP].T
            p, q = np.divmod(np.flatnonzero(s >= least - slack), s.shape[1])
            if same:
                one = p + i < q + j
                p, q = p[one], q[one]
            if len(p):
                yield i, j, p, q, s


def product(x: dict, y: dict, least: float, shape: Callable, same: bool) -> Iterator[pd.DataFrame]:
    """(a, b, score) by ``shape`` for the rows of two blocks (id, v) that reach ``least``; ``same``: the block meets itself.

    A strip of ``x`` and one of ``y`` are multiplied at a time and what they give is sent on, so that a task holds two blocks and 4 million scores, however
    many pairs it finds. Only a class (``linkage.Nearest``) and trees, which become one, gather: no more rows than the blocks have.
    """
    if isinstance(shape, type):
        yield from shape(x, y, same, least).found()
        return
    trees, row = [], 0
    for i, j, p, q, s in hits(x, y, least, same):
        if i > row and len(trees) > 1:
            trees, row = [_joined(trees)], i
        found = shape(p, q, x["id"][i : i + STRIP], y["id"][j : j + STRIP], s)
        if shape is _forest:
            trees.append(found)
        else:
            yield found
    if trees:
        yield _joined(trees)


def _joined(trees: list[pd.DataFrame]) -> pd.DataFrame:
    return _tree(np.concatenate([t["a"].to_numpy() for t in trees]), np.concatenate([t["b"].to_numpy() for t in trees]))


def block_rows(n: int, least_rows: int, blocks: int = GROWING, most_rows: int = MOST_ROWS) -> int:
    """Rows of a block: with more than ``blocks`` blocks of ``least_rows`` the blocks grow, not their number, up to what a task holds.

    So a vector is sent to about ``blocks`` tasks, and what is shuffled grows as the rows do (from ``blocks * least_rows`` to ``blocks * most_rows`` rows).
    """
    return min(max(least_rows, -(-n // blocks)), max(least_rows, most_rows))


def _parts(n: int, each: int) -> int:
    """Blocks for ``n`` rows: as near to ``each`` as may be, at most half above it, so that a cell a little above it isn't sent twice."""
    return max(1, (n + each // 2) // each) if n else 0


def met(heads: DataFrame, least: float, shape: Callable, per_cell: int = 2000, most_cells: int = BLOCKS) -> DataFrame:
    """(a, b, score) by ``shape`` for the distinct unit vectors ``heads`` (id, v), a stored table, with a dot product of at least ``least``, above 0.

    There is a cell for every block of ``block_rows``, up to ``most_cells``. A vector is sent to its own cell and visits those above it in which its bounds
    leave a partner possible. A cell's vectors are dealt in such blocks, and each two blocks are a task, so a
    cell that holds a third of all rows is no task of its own. Visits are counted first and made again when they are sent; they aren't stored.
    """
    spark = heads.sparkSession
    heads = heads.select("id", "v")
    total = heads.count()
    each = block_rows(total, per_cell)
    n = min(most_cells, -(-total // each))
    if not n:
        return spark.createDataFrame([], "a long, b long, score double")
    centre = pivots(heads, n)
    kind = "id long, v array<double>, cell int"
    homes = stored(heads.mapInPandas(_homes(spark.sparkContext.broadcast(centre)), f"{kind}, own double"), "homes")
    radius = np.zeros(len(centre))
    sizes = {}
    for r in homes.groupBy("cell").agg(F.min("own").alias("own"), F.count("*").alias("n")).collect():  # a row a cell
        radius[r["cell"]], sizes[r["cell"]] = np.arccos(np.clip(r["own"], -1, 1)), r["n"]
    bounds = spark.sparkContext.broadcast((centre, radius))
    going = homes.select("id", "v", "cell")
    guests = {r["cell"]: r["n"] for r in going.mapInPandas(_guests(bounds, least), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    blocks = [(c, _parts(k, each), _parts(guests.get(c, 0), each)) for c, k in sizes.items()]
    of = F.broadcast(spark.createDataFrame(blocks, "cell int, own_blocks int, guest_blocks int"))  # a row a cell
    block = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    own = homes.select("id", "v", "cell").join(of, "cell").withColumn("k", block("own_blocks"))
    guest = going.mapInPandas(_visits(bounds, least), kind).join(of, "cell").withColumn("k", F.col("own_blocks") + block("guest_blocks"))
    left = own.select("cell", F.col("k").alias("i"), F.explode(F.sequence("k", F.col("own_blocks") + F.col("guest_blocks") - 1)).alias("j"), "id", "v")
    right = own.where("k > 0").select("cell", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), F.col("k").alias("j"), "id", "v")
    right = right.union(guest.select("cell", F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("i"), F.col("k").alias("j"), "id", "v"))

    return _multiplied(left, right, ["cell", "i", "j"], least, shape)


def _multiplied(left: DataFrame, right: DataFrame, at: list[str], least: float, shape: Callable) -> DataFrame:
    """The products of blocks that have the same place ``at`` (its last two columns are the blocks' numbers); a block that meets itself is sent in ``left`` alone."""
    i, j = at[-2:]

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vs, same = ([], []), ([], []), False
        for df in batches:
            same = df[i].iloc[0] == df[j].iloc[0]
            for side in (0, 1):
                part = df[df["side"] == side]
                if len(part):
                    ids[side].append(part["id"].to_numpy())
                    vs[side].append(np.stack(part["v"].to_list()))
        if ids[0] and (ids[1] or same):
            x = {"id": np.concatenate(ids[0]), "v": np.concatenate(vs[0])}
            yield from product(x, x if same else {"id": np.concatenate(ids[1]), "v": np.concatenate(vs[1])}, least, shape, same)

    sides = left.select(*at, "id", "v", F.lit(0).alias("side")).union(right.select(*at, "id", "v", F.lit(1).alias("side")))
    return sides.groupBy(*at).applyInPandas(multiply, "a long, b long, score double")


def all_met(heads: DataFrame, least: float, shape: Callable, block: int = 2000) -> DataFrame:
    """As ``met``, without cells: each two blocks of the vectors ``heads`` (id, v) are a task."""
    total = heads.count()
    n = max(1, -(-total // block_rows(total, block)))
    dealt = heads.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    # Block i meets block j >= i in the task (i, j).
    left = dealt.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(n - 1))).alias("j"), "id", "v")
    right = dealt.where("block > 0").select(F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), "id", "v")
    return _multiplied(left, right, ["i", "j"], least, shape)


def _heads(rows: DataFrame, vector: str, row_id: str, normed) -> tuple[DataFrame, DataFrame]:
    unit = rows.where(f"{vector} is not null and {row_id} is not null").select(F.col(row_id).alias("id"), normed(F.col(vector)).alias("v"))
    return unit, stored(unit.groupBy("v").agg(F.min("id").alias("id")), "distinct")


def vector_key(v: str) -> Column:
    return F.xxhash64(v)


def copies(unit: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, b): each row b of ``unit`` (id, v) with the head a of its vector, but heads themselves; ``heads`` (id, v) has each vector of ``unit`` once.

    Rows meet by a hash: where one head has it, all rows with it are of that head. Vectors are sent only where different ones share a hash.
    """
    keyed = unit.select("id", vector_key("v").alias("key"))
    named = stored(heads.select(vector_key("v").alias("key"), "id").groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("vectors")), "keys")
    found = keyed.join(named.where("vectors = 1"), "key").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    shared = named.where("vectors > 1").select("key")
    if shared.isEmpty():
        return found
    mixed = unit.withColumn("key", vector_key("v")).join(shared, "key", "left_semi").select("id", "v")
    return found.union(mixed.join(heads.withColumnRenamed("id", "head"), "v").where("id <> head").select("head", "id"))


def pairs(rows: DataFrame, vector: str, row_id: str, least: float, per_cell: int = 2000) -> DataFrame:
    """All pairs (a < b, score) of different vectors with a cosine of at least ``least``; of equal ones the smallest id stands for all."""
    from medialake.operators.vectors import normed

    return met(_heads(rows, vector, row_id, normed)[1], least, _pairs, per_cell)


def stack_members(rows: DataFrame, vector: str, row_id: str, least: float, per_cell: int = 2000) -> DataFrame:
    """(``row_id``, head) for each row in a stack of two or more: connected components of a cosine of at least ``least``, named by their smallest id.

    Tasks give a tree for what they find, not its pairs, and equal vectors meet once, so a stack that holds a third of all rows costs no square. Null
    ids and vectors are left out.
    """
    from medialake.operators.vectors import normed

    unit, heads = _heads(rows, vector, row_id, normed)
    edges = met(heads, least, _forest, per_cell).select("a", "b").union(copies(unit, heads))
    return connected_components(edges, "a", "b").withColumnsRenamed({"node": row_id, "component": "head"})
