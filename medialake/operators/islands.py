"""Density islands of points in a plane: core points by a count within a radius, islands of core points that reach one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.operators.graph import connected_components
from medialake.storage import stored

FINE = 8  # boxes along a cell's side
SURE = 1e-9  # relative; boxes nearer to the radius than this are decided by their points


def _apart(p: str, q: str) -> tuple[Column, Column]:
    """Squares of the least and the largest distance of points in two bounding boxes."""
    c = lambda side, name: F.col(f"{side}.{name}")
    gap = lambda v: F.greatest(c(q, f"{v}0") - c(p, f"{v}1"), c(p, f"{v}0") - c(q, f"{v}1"), F.lit(0.0))
    span = lambda v: F.greatest(c(q, f"{v}1") - c(p, f"{v}0"), c(p, f"{v}1") - c(q, f"{v}0"))
    return gap("x") * gap("x") + gap("y") * gap("y"), span("x") * span("x") + span("y") * span("y")


def _boxes(points: DataFrame) -> DataFrame:
    ends = (F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return points.groupBy("cx", "cy", "bx", "by").agg(F.count("*").alias("n"), *ends)


def _around(rows: DataFrame, half: bool = False) -> DataFrame:
    """``rows`` once for each cell that may hold points within the radius (tx, ty); half: of two different cells only the greater."""
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i * j) < 4 and (not half or (i, j) > (0, 0))]
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    return rows.withColumn("_step", step).withColumn("tx", F.col("cx") + F.col("_step.i")).withColumn("ty", F.col("cy") + F.col("_step.j")).drop("_step")


def islands(points: DataFrame, row_id: str, x: str, y: str, radius: float, least: int = 5, smallest: int = 60) -> DataFrame:
    """(``row_id``, core, island) for each row: the smallest id among the core points of its island, or null if it is loose.

    A core point has at least ``least`` points, itself included, within ``radius``. Core points within it of one another are of
    one island; any other point joins the island of its nearest core point within it (ties: the smallest id), else it is loose. Islands of
    fewer than ``smallest`` points are loose as well. Ids are unique; rows without a place are loose; equal points are points of their own.

    Points lie in cells whose diagonal is the radius: a cell of ``least`` points holds core points only, and a cell's core
    points are of one island, so islands are components of cells. A cell has 64 boxes; boxes decide by their bounds, and single points meet
    only where these leave it open, so a cell that holds a third of all points is not compared with itself.
    """
    side = radius / 1.4143 / FINE
    box = lambda v: F.floor(F.col(v) / side).alias(f"b{v}")
    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    placed = placed.select(F.col(row_id).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).select("*", box("x"), box("y"))
    placed = stored(placed.withColumn("cx", F.floor(F.col("bx") / FINE)).withColumn("cy", F.floor(F.col("by") / FINE)), "placed")
    boxes = stored(_boxes(placed), "boxes")
    thin = boxes.groupBy("cx", "cy").agg(F.sum("n").alias("of")).where(F.col("of") < least).select("cx", "cy")
    square, near, far = radius * radius, radius * radius * (1 - SURE), radius * radius * (1 + SURE)
    distance = lambda: (F.col("p.x") - F.col("q.x")) * (F.col("p.x") - F.col("q.x")) + (F.col("p.y") - F.col("q.y")) * (F.col("p.y") - F.col("q.y"))
    lone = stored(placed.join(thin, ["cx", "cy"], "left_semi"), "lone")  # fewer than ``least`` a cell
    as_box = lone.select("*", F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))

    def reached(rows: DataFrame, others: DataFrame) -> DataFrame:
        """Lone points with each box of others that isn't beyond the radius, and whether it lies within as a whole."""
        low, high = _apart("p", "q")
        met = _around(rows).alias("p").join(others.alias("q"), (F.col("p.tx") == F.col("q.cx")) & (F.col("p.ty") == F.col("q.cy")))
        return met.where(low <= far).select("p.id", "p.x", "p.y", F.col("q.bx").alias("bx"), F.col("q.by").alias("by"), F.col("q.n").alias("n"), (high <= near).alias("whole"))

    met = stored(reached(as_box, boxes), "reached")
    single = met.where("not whole").alias("p").join(placed.alias("q"), ["bx", "by"]).where(distance() <= square).select("p.id", F.lit(1).cast("long").alias("n"))
    counted = met.where("whole").select("id", "n").union(single).groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    chosen = stored(counted.select("id"), "chosen")
    core = stored(placed.join(thin, ["cx", "cy"], "left_anti").unionByName(lone.join(chosen, "id", "left_semi")), "core")
    held = stored(_boxes(core), "held")

    low, high = _apart("p", "q")
    pairs = _around(held, half=True).alias("p").join(held.alias("q"), (F.col("p.tx") == F.col("q.cx")) & (F.col("p.ty") == F.col("q.cy"))).where(low <= far)
    cell = lambda side: F.concat_ws(",", F.col(f"{side}.cx"), F.col(f"{side}.cy"))
    pairs = stored(pairs.select(cell("p").alias("a"), cell("q").alias("b"), F.col("p.bx").alias("ax"), F.col("p.by").alias("ay"), F.col("q.bx").alias("qx"), F.col("q.by").alias("qy"), (high <= near).alias("whole")), "pairs")
    sure = stored(pairs.where("whole").select("a", "b").distinct(), "sure")
    open_ = pairs.join(sure, ["a", "b"], "left_anti")
    one = core.select(F.col("bx").alias("ax"), F.col("by").alias("ay"), F.struct("x", "y").alias("p"))
    two = core.select(F.col("bx").alias("qx"), F.col("by").alias("qy"), F.struct("x", "y").alias("q"))
    linked = open_.join(one, ["ax", "ay"]).join(two, ["qx", "qy"]).where(distance() <= square).select("a", "b").distinct()
    own = F.concat_ws(",", "cx", "cy")
    alone = held.select(own.alias("a"), own.alias("b")).distinct()
    label = connected_components(sure.union(linked).union(alone), "a", "b")

    inside = core.select("id", own.alias("node")).join(label, "node").select("id", "component", F.lit(True).alias("core"))
    rest = as_box.join(chosen, "id", "left_anti")
    close = reached(rest, held).alias("p").join(core.alias("q"), ["bx", "by"]).where(distance() <= square)
    close = close.groupBy("p.id").agg(F.min(F.struct(distance().alias("d"), F.col("q.id").alias("core_id"))).alias("m")).select("id", F.col("m.core_id").alias("core_id"))
    border = close.join(inside.select(F.col("id").alias("core_id"), "component"), "core_id").select("id", "component", F.lit(False).alias("core"))
    members = stored(inside.union(border), "members")
    named = members.groupBy("component").agg(F.min(F.when(F.col("core"), F.col("id"))).alias("island"), F.count("*").alias("n")).where(F.col("n") >= smallest)
    found = members.join(named, "component", "left").select(F.col("id").alias(row_id), "core", "island")
    return points.select(row_id).join(found, row_id, "left").select(row_id, F.coalesce("core", F.lit(False)).alias("core"), "island")
