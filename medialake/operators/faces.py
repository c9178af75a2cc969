"""Faces of one picture or clip: the same person kept once, boxes paired with new ones, names carried over.

A picture has tens of faces at most, so each picture is one small group; pictures are spread over all tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.functions.geometry import iou


def same_person_once(faces: DataFrame, photo: str, face: str, vector: str, least: float = 0.55) -> DataFrame:
    """(photo, face): of faces with a cosine of ``least`` or more the best one, by ``frontality`` (null last), ``score``, ``area``.

    Faces are taken by id; each joins the kept face most like it, or is kept itself. Faces without a vector are left out.
    """
    kind = dict(faces.dtypes)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        kept, units = [], []
        group = group.sort_values(face)
        rank = list(zip(group["frontality"].fillna(-1.0), group["score"].fillna(0.0), group["area"].fillna(0.0), strict=True))
        for n, (key, v) in enumerate(zip(group[face], group[vector], strict=True)):
            v = np.asarray(v, float)
            v = v / (np.linalg.norm(v) or 1.0)
            like = np.array(units) @ v if units else np.array([-1.0])
            twin = int(like.argmax())
            if like[twin] < least:
                kept.append((rank[n], key))
                units.append(v)
            elif rank[n] > kept[twin][0]:
                kept[twin], units[twin] = (rank[n], key), v
        return pd.DataFrame({photo: [group[photo].iloc[0]] * len(kept), face: [key for _, key in kept]})

    rows = faces.where(F.col(vector).isNotNull()).select(photo, face, vector, "frontality", "score", "area")
    return rows.groupBy(photo).applyInPandas(fold, f"{photo} {kind[photo]}, {face} {kind[face]}")


def paired_boxes(old: DataFrame, new: DataFrame, photo: str, least: float = 0.3) -> DataFrame:
    """(photo, old_id, new_id, iou): boxes (id, x1, y1, x2, y2) of one picture paired one to one, the greatest overlap first; ties go to greater ids."""
    corners = ("x1", "y1", "x2", "y2")
    a = old.select(photo, F.col("id").alias("old_id"), *(F.col(x).alias(f"o_{x}") for x in corners))
    b = new.select(photo, F.col("id").alias("new_id"), *(F.col(x).alias(f"n_{x}") for x in corners))
    overlap = iou([F.col(f"o_{x}") for x in corners], [F.col(f"n_{x}") for x in corners])
    met = a.join(b, photo).select(photo, "old_id", "new_id", overlap.alias("iou")).where(F.col("iou") >= least)

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        group, left, right, rows = group.sort_values(["iou", "old_id", "new_id"], ascending=False), set(), set(), []
        for n, (x, y) in enumerate(zip(group["old_id"], group["new_id"], strict=True)):
            if x not in left and y not in right:
                left.add(x)
                right.add(y)
                rows.append(n)
        return group.iloc[rows]

    return met.groupBy(photo).applyInPandas(greedy, met.schema)


def chosen_frame(as_is: DataFrame, turned: DataFrame, photo: str) -> DataFrame:
    """The pairs of each picture in the reading that gives more of them, then the greater sum of overlaps; ``turned`` must win."""
    told = lambda pairs, n, s: pairs.groupBy(photo).agg(F.count("*").alias(n), F.sum("iou").alias(s))
    tally = told(as_is, "n", "s").join(told(turned, "tn", "ts"), photo, "full").fillna(0, ["n", "s", "tn", "ts"])
    raw = tally.select(photo, ((F.col("tn") > F.col("n")) | ((F.col("tn") == F.col("n")) & (F.col("ts") > F.col("s")))).alias("raw"))
    both = as_is.withColumn("_raw", F.lit(False)).union(turned.withColumn("_raw", F.lit(True)))
    return both.join(raw, photo).where("_raw = raw").drop("_raw")


def carry_over(old: DataFrame, new: DataFrame, pairs: DataFrame, photo: str) -> DataFrame:
    """What becomes of each picture's names: ``verdict`` (stamp only, renewed, names lost), transferred and lost names, sorted.

    ``old`` is (photo, id, name), ``pairs`` what ``chosen_frame`` gives. A picture whose every old box has a new one as it lies, and no box
    more, only needs its stamp; names without a new box are lost, and such a picture is refused.
    """
    hit = old.join(pairs.select(photo, F.col("old_id").alias("id"), "new_id", "raw"), [photo, "id"], "left")
    named = F.col("name").isNotNull()
    names = lambda keep: F.array_sort(F.collect_list(F.when(named & keep, F.col("name"))))
    per = hit.groupBy(photo).agg(names(F.col("new_id").isNotNull()).alias("transferred"), names(F.col("new_id").isNull()).alias("lost"), F.count("*").alias("n_old"), F.count("new_id").alias("n_pairs"), F.max("raw").alias("raw"))
    per = per.join(new.groupBy(photo).agg(F.count("*").alias("n_new")), photo, "left")
    steady = ~F.coalesce("raw", F.lit(False)) & (F.col("n_old") == F.col("n_pairs")) & (F.col("n_pairs") == F.col("n_new"))
    return per.select(photo, F.when(steady, "stamp only").when(F.size("lost") > 0, "names lost").otherwise("renewed").alias("verdict"), "transferred", "lost")
