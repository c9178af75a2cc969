"""Boxes, coordinates and degrees; native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upright(box: list[Column], orientation: Column, width: Column, height: Column) -> list[Column]:
    """A box (x1, y1, x2, y2) on the raw image, on the image turned upright for EXIF orientations 1 to 8."""
    x1, y1, x2, y2 = box

    def pick(*by_orientation: tuple[Column, Column]) -> tuple[Column, Column]:
        a, b = by_orientation[0]
        for k, (p, q) in enumerate(by_orientation[1:], 2):
            a, b = F.when(orientation == k, p).otherwise(a), F.when(orientation == k, q).otherwise(b)
        return a, b

    def corner(x: Column, y: Column) -> tuple[Column, Column]:
        return pick((x, y), (width - x, y), (width - x, height - y), (x, height - y), (y, x), (height - y, x), (height - y, width - x), (y, width - x))

    (a, b), (c, d) = corner(x1, y1), corner(x2, y2)
    return [F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d)]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    both = area(a) + area(b) - w * h
    return F.when(both > 0, w * h / both).otherwise(0.0)


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    return (degrees + minutes / 60 + seconds / 3600) * F.when(ref.isin("S", "W"), -1).otherwise(1)


def frontality(marks: Column, box: Column) -> Column:
    """How frontal a face is, 0 to 1, from eyes and nose among five landmarks; null without landmarks or box.

    Eyes stand about 0.4 of the box apart in a frontal face, and the nose midway between them.
    """
    left, right, nose = marks[0], marks[1], marks[2]
    apart = F.sqrt(F.pow(right[0] - left[0], 2) + F.pow(right[1] - left[1], 2))
    spread = F.least(F.lit(1.0), apart / F.greatest(F.lit(1.0), box[2] - box[0]) / 0.4)
    centred = F.greatest(F.lit(0.0), 1 - F.abs(nose[0] - (left[0] + right[0]) / 2) / apart / 0.75)
    return F.when((F.size(marks) >= 5) & (F.size(box) == 4), F.when(apart < 1e-3, 0.0).otherwise(spread * centred))


def reading_order(box: Column, row_height: int = 200) -> Column:
    """A sort key: rows of ``row_height`` from the top, in them from the left; boxes that are none come last."""
    good = F.coalesce(F.size(box) == 4, F.lit(False))
    row = F.floor((F.get(box, F.lit(1)) + F.get(box, F.lit(3))) / 2 / row_height)
    return F.struct(F.when(good, 0).otherwise(1).alias("bad"), F.when(good, row).otherwise(0).alias("row"), F.when(good, F.get(box, F.lit(0))).otherwise(0).alias("x"))
