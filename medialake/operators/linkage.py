"""Average linkage by nearest neighbours: what each cluster is nearest to is kept, and no list of links.

The mean cosine of two clusters is the product of their mean vectors. The pair of two that are nearest to one another (ties by ids) merges at any time,
with the result of merging one best pair after the other; a merged cluster is no nearer to a third than the nearer of its two parts was. So all such pairs
merge at once, only clusters that merged or whose nearest one did search anew, and one that has no other at ``least`` or above is done.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.operators.cells import MOST_ROWS, STRIP, _joined, _tree, hits

SEEKS = 9.0  # in place of the similarity of a cluster that searches; above any cosine
CHUNK = 100_000  # pairs whose vectors are multiplied at once
MOST_SENT = 20_000  # that search, sent to every task; with 64 places about 10 MB
FEW_MERGE = 30  # a round that merges less than this part of the clusters is as dear as others, but leaves the next nearly as many
TASKS = 36  # of a search, about; as many as eight blocks that meet one another have


class Nearest:
    """Gathers from the products of two blocks (id, v) the nearest other row of each: the greatest score to 12 digits, of ties the smallest id.

    Rows of ``y`` may come with what they have so far (``o`` at ``s``); only what is nearer is found for them. No vector is longer than 1. Products are made of
    short floats; scores that may be a row's best but for their error are summed again in one order, so that a pair has the same score in every block and both ways.
    """

    def __init__(self, x: dict, y: dict, same: bool, least: float):
        none = lambda ids: (np.full(len(ids), -np.inf), np.array(ids))
        self.a, self.b, self.v, self.w, self.same, self.least = x["id"], y["id"], x["v"], y["v"], same, least
        self.x = none(self.a)
        self.before = (y["s"], y["o"]) if "s" in y else none(self.b)
        self.y = self.x if same else tuple(part.copy() for part in self.before)
        slack = (self.v.shape[1] + 8) * 2.0**-24  # above the error of a sum of as many short products
        left, right = ({"id": block["id"], "v": block["v"].astype(np.float32)} for block in (x, y))
        for i, j, p, q, s in hits(left, left if same else right, least, same, slack):
            self.add(i, j, p, q, s[p, q].astype(float), slack)

    def add(self, i: int, j: int, p: np.ndarray, q: np.ndarray, s: np.ndarray, slack: float) -> None:
        p, q = p + i, q + j
        if not self.same:
            other = self.a[p] != self.b[q]
            s, p, q = s[other], p[other], q[other]
        if not len(p):
            return
        self.linked(self.a[p], self.b[q])
        near = _may(self.x[0], p, s, slack) | _may(self.y[0], q, s, slack)
        if near.sum() > CHUNK:  # many as good as equal: products of long floats tell more of them apart
            s = (self.v[i : i + STRIP] @ self.w[j : j + STRIP].T)[p - i, q - j]
            near = _may(self.x[0], p, s, 1e-12) | _may(self.y[0], q, s, 1e-12)
        near = np.flatnonzero(near)
        for at in range(0, len(near), CHUNK):
            l, r = p[near[at : at + CHUNK]], q[near[at : at + CHUNK]]
            s = np.round((self.v[l] * self.w[r]).sum(1), 12)
            keep = s >= self.least
            l, r, s = l[keep], r[keep], s[keep]
            if len(l):
                _nearer(*self.x, l, s, self.b[r])
                _nearer(*self.y, r, s, self.a[l])

    def linked(self, a: np.ndarray, b: np.ndarray) -> None:
        """Called with all links, and with some that are below ``least`` by no more than the error."""

    def found(self) -> Iterator[pd.DataFrame]:
        sides = [(self.a, *self.x, self.x[0] > -np.inf)]
        if not self.same:
            sides.append((self.b, *self.y, (self.y[0] != self.before[0]) | (self.y[1] != self.before[1])))
        for ids, top, of, new in sides:
            if new.any():
                yield pd.DataFrame({"a": ids[new], "b": of[new], "score": top[new]})


class NearestAndTree(Nearest):
    """Besides, a tree of the links, as rows with the score -1: no more than there are rows. One that is below ``least`` by the error only joins more than need be."""

    def __init__(self, x: dict, y: dict, same: bool, least: float):
        self.trees, self.held = [], 0
        super().__init__(x, y, same, least)

    def linked(self, a: np.ndarray, b: np.ndarray) -> None:
        self.trees.append(_tree(a, b))
        self.held += len(self.trees[-1])
        if self.held > 4 * (len(self.a) + len(self.b)):
            self.joined()

    def joined(self) -> None:
        self.trees = [_joined(self.trees)]
        self.held = len(self.trees[0])

    def found(self) -> Iterator[pd.DataFrame]:
        yield from super().found()
        if self.trees:
            self.joined()
            yield self.trees[0].assign(score=-1.0)


def _may(top: np.ndarray, at: np.ndarray, s: np.ndarray, slack: float) -> np.ndarray:
    """Which scores ``s`` of the rows ``at`` may be their rows' greatest, with an error of ``slack`` each and rounding."""
    best = np.full(at.max() + 1, -np.inf)
    np.maximum.at(best, at, s)
    return s >= np.maximum(best[at], top[at]) - 2 * slack - 1e-11


def _nearer(top: np.ndarray, of: np.ndarray, at: np.ndarray, s: np.ndarray, o: np.ndarray) -> None:
    """Puts in place, for the rows ``at``, what is nearer than they have."""
    best = np.full(at.max() + 1, -np.inf)
    np.maximum.at(best, at, s)
    keep = (s == best[at]) & (s >= top[at])
    at, s, o = at[keep], s[keep], o[keep]
    order = np.lexsort((o, at))
    at, s, o = at[order], s[order], o[order]
    first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    at, s, o = at[first], s[first], o[first]
    new = (s > top[at]) | (o < of[at])
    top[at[new]], of[at[new]] = s[new], o[new]


def linked(least: float):
    """Average linkage of some clusters (c, n, v), given with their mean vectors, in one task: (c, cluster). It holds the vectors and one strip of scores.

    They may come with the nearest of each (``o`` at ``s``), else these are searched first.
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("c", ignore_index=True)
        n, v = df["n"].to_numpy(float), np.stack(df["v"].to_list())
        at, into = np.arange(len(df)), np.arange(len(df))  # rows are in the order of ids
        if "o" in df:
            top, of = df["s"].to_numpy(float).copy(), np.searchsorted(df["c"].to_numpy(), df["o"].to_numpy())
        else:
            rows = {"id": at, "v": v}
            top, of = Nearest(rows, rows, True, least).x
        while True:
            live = np.flatnonzero(top > -np.inf)
            if not len(live):
                break
            if 2 * len(live) < len(at):
                place = np.zeros(len(at), np.int64)
                place[live] = np.arange(len(live))
                at, n, v, top, of = at[live], n[live], v[live], top[live], place[of[live]]
                live = np.arange(len(at))
            a = live[(of[of[live]] == live) & (live < of[live])]
            b = of[a]
            if not len(a):
                raise RuntimeError("no two clusters are nearest to one another")
            moved = np.zeros(len(at), bool)
            moved[a] = moved[b] = True
            into[at[b]] = at[a]
            v[a] = (v[a] * n[a, None] + v[b] * n[b, None]) / (n[a] + n[b])[:, None]
            n[a] += n[b]
            seek = live[moved[live] | moved[of[live]]]
            v[b], top[b], of[b] = 0, -np.inf, b  # meets nothing from now on
            seek = np.setdiff1d(seek, b)
            top[seek], of[seek] = SEEKS, seek
            got = Nearest({"id": seek, "v": v[seek]}, {"id": np.arange(len(at)), "v": v, "s": top, "o": of}, False, least)
            top, of = got.y
            top[seek], of[seek] = got.x
        while (into[into] != into).any():
            into = into[into]
        ids = df["c"].to_numpy()
        return pd.DataFrame({"c": ids, "cluster": ids[into]})

    return run


def marked(best: DataFrame, merges: DataFrame) -> DataFrame:
    """(c, into, o, s) for the clusters with a nearest one (c, o, s) after ``merges`` (a, b): who has to search, as it merged or its nearest one did, has ``SEEKS`` for ``s``."""
    moved = merges.select(F.col("b").alias("c"), F.col("a").alias("into")).union(merges.select("a", "a"))
    marks = best.join(moved, "c", "left").join(moved.select(F.col("c").alias("o"), F.lit(True).alias("lost")), "o", "left")
    seeks = F.col("into").isNotNull() | F.col("lost").isNotNull()
    return marks.select("c", "into", F.when(seeks, F.col("c")).otherwise(F.col("o")).alias("o"), F.when(seeks, F.lit(SEEKS)).otherwise(F.col("s")).alias("s"))


def merged(clusters: DataFrame, marks: DataFrame) -> DataFrame:
    """The clusters (c, n, v, o, s) after the merges in ``marks``, from those before (c, n, v); those without a nearest one are left out, as they are done."""
    met = clusters.select("c", "n", "v").join(marks, "c")
    two = met.where("into is not null").groupBy("into").agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", "v")).alias("t"))
    weighed = lambda k: F.transform(F.col("t")[k]["v"], lambda x: x * F.col("t")[k]["n"])
    mean = F.zip_with(weighed(0), weighed(1), lambda x, y: (x + y) / F.col("n"))
    return met.where("into is null").select("c", "n", "v", "o", "s").union(two.select("into", "n", mean, "into", F.lit(SEEKS)))


def sought(clusters: DataFrame, seekers: int, number: int, least: float, most_sent: int = MOST_SENT, most_rows: int = MOST_ROWS, least_rows: int = 2000) -> DataFrame:
    """(c, o, s): the nearest cluster of each of ``clusters`` (c, n, v, o, s; a stored table) that searches, and for others what is nearer than they have.

    Up to ``most_sent`` that search (they were counted) are sent to all tasks that read the table, and no vector is shuffled. Else blocks of those that search meet one another
    and blocks of the others in about ``TASKS`` products.
    """
    if seekers <= most_sent:
        found = clusters.where(F.col("s") == SEEKS).select("c", "v").toArrow()
        sent = clusters.sparkSession.sparkContext.broadcast({"id": found["c"].to_numpy(), "v": np.array(found["v"].combine_chunks().flatten()).reshape(len(found), -1)})

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                if len(df) and len(sent.value["id"]):
                    yield from _search(sent.value, _block(df), least)

        return clusters.select("c", "v", "o", "s").mapInPandas(visit, "c long, o long, s double")

    own, rest = _blocks(seekers, number - seekers, most_rows, least_rows)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, same = ([], []), False
        for df in batches:
            same = df["i"].iloc[0] == df["j"].iloc[0]
            for side in (0, 1):
                part = df[df["side"] == side]
                if len(part):
                    got[side].append(_block(part))
        x, y = ({k: np.concatenate([part[k] for part in side]) for k in side[0]} if side else None for side in got)
        if x and (y or same):
            yield from _search(x, x if same else y, least, same)

    # Block i of those that search meets block j >= i in the task (i, j); the others' blocks come after.
    block = lambda n: F.pmod(F.xxhash64("c"), F.lit(n)).cast("int")
    to = lambda first, last: F.explode(F.sequence(first, last))
    seek = clusters.where(F.col("s") == SEEKS).select("c", "v", F.col("c").alias("o"), F.lit(float("-inf")).alias("s"), block(own).alias("k"))
    others = clusters.where(F.col("s") < SEEKS).select("c", "v", "o", "s", (own + block(rest)).alias("j"))
    left = seek.select(F.col("k").alias("i"), to(F.col("k"), F.lit(own + rest - 1)).alias("j"), "c", "v", "o", "s", F.lit(0).alias("side"))
    right = seek.where("k > 0").select(to(F.lit(0), F.col("k") - 1).alias("i"), F.col("k").alias("j"), "c", "v", "o", "s", F.lit(1).alias("side"))
    right = right.union(others.select(to(F.lit(0), F.lit(own - 1)).alias("i"), "j", "c", "v", "o", "s", F.lit(1).alias("side")))
    return left.union(right).groupBy("i", "j").applyInPandas(search, "c long, o long, s double")


def _blocks(seekers: int, others: int, most_rows: int, least_rows: int) -> tuple[int, int]:
    """Into how many blocks those that search and the others are dealt: no product is over twice a ``TASKS``th of all, with the fewest vectors sent."""
    most = max(2 * (seekers * seekers / 2 + seekers * others) / TASKS, least_rows**2)
    fewest = max(1, -(-seekers // most_rows), int(np.ceil(seekers / most**0.5)))
    choices = []
    for own in range(fewest, fewest + 8):
        rest = max(1, -(-others // most_rows), int(np.ceil(seekers / own * others / most)))
        choices.append((seekers * (own + rest) + others * own, own, rest))
    return min(choices)[1:]


def _block(df: pd.DataFrame) -> dict:
    return {"id": df["c"].to_numpy(), "v": np.stack(df["v"].to_list()), "o": df["o"].to_numpy(), "s": df["s"].to_numpy()}


def _search(x: dict, y: dict, least: float, same: bool = False) -> Iterator[pd.DataFrame]:
    yield from (df.set_axis(["c", "o", "s"], axis=1) for df in Nearest(x, y, same, least).found())
