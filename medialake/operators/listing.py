"""What a scan takes up, which spaces its paths make, who is on the pictures, and texts of dates as sure as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions import paths as P
from medialake.functions.text import MONTHS


def media_listing(files: DataFrame, roots: list[str], excluded: list[str] = (), path: str = "path", size: str = "size") -> DataFrame:
    """The distinct files (path, size, root) under any of the ``roots`` that a scan takes: media by suffix, of 32 bytes at least, no dot names and no dot directories
    below their root, nothing under an excluded directory.

    Overlapping roots give a file once, with the first root that takes it. Paths are compared by whole segments; null paths are left out.
    """
    taken = F.lit(None).cast("string")
    for root in reversed([r.rstrip("/\\") for r in roots]):
        rest = F.substring(F.col(path), F.lit(len(root) + 1), F.length(path))
        taken = F.when(F.col(path).startswith(f"{root}/") & ~rest.rlike(r"/\."), F.lit(root)).otherwise(taken)
    out = files.where(F.col(path).isNotNull()).withColumn("root", taken).where(F.col("root").isNotNull())
    for directory in (e.rstrip("/\\") for e in excluded):
        out = out.where(~F.col(path).startswith(f"{directory}/") & (F.col(path) != directory))
    name = P.file_name(F.col(path))
    out = out.where(P.suffix(F.col(path)).isin(*P.VIDEO, *P.IMAGE) & (F.col(size) >= 32) & ~F.lower(name).isin("thumbs.db", "desktop.ini"))
    return out.groupBy(F.col(path).alias("path")).agg(F.max(size).alias("size"), F.first("root").alias("root"))


def indexed_spaces(rows: DataFrame, root: str, row_id: str, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(space, place) of all spaces in the order of the ids at which they first occur, from 0, and (``row_id``, place) of each row.

    A space is the first level under ``root``; rows without a path, or right in the root, are of the space ``?``. There are as many spaces as top directories.
    """
    told = rows.select(row_id, F.coalesce(P.space(F.col(path), root), F.lit("?")).alias("space"))
    first = told.groupBy("space").agg(F.min(row_id).alias("_first"))
    names = first.select("space", (F.row_number().over(Window.orderBy("_first")) - 1).alias("place"))  # a row a space
    return names, told.join(names, "space").select(row_id, "place")


def people_list(faces: DataFrame, meta: DataFrame) -> DataFrame:
    """One row for each person with a face: person_id, name, faces, cover, aliases, pin and rank, by which the list goes: favourites, then others, then muted ones, each by name in lower case, then by id.

    faces: face_id, person_id, person_name; the name and the cover are those of the smallest face id, pseudo persons aren't listed. meta: person_id, aliases, pin; persons may lack it.
    """
    real = faces.where("person_id is not null and person_id <> '' and not startswith(person_id, '_')")
    found = real.groupBy("person_id").agg(F.coalesce(F.nullif(F.min_by("person_name", "face_id"), F.lit("")), F.col("person_id")).alias("name"), F.count("*").alias("faces"), F.min("face_id").alias("cover"))
    told = meta.groupBy("person_id").agg(F.max("aliases").alias("aliases"), F.max("pin").alias("pin"))
    rank = F.when(F.col("pin") == "favorite", 0).when(F.col("pin") == "muted", 2).otherwise(1)
    return found.join(told, "person_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).withColumn("rank", rank)


def date_text(date: Column, confidence: Column) -> Column:
    """A date as sure as it is: the day from 0.9 on (or without a confidence), the month from 0.6 on, else about the month; only the year, if more can't be read."""
    month, day = F.substring(date, 6, 2).try_cast("int"), F.substring(date, 9, 2).try_cast("int")
    name = F.get(F.array(*map(F.lit, MONTHS)), F.when(month.between(1, 12), month - 1))
    year, sure = F.substring(date, 1, 4), F.coalesce(confidence, F.lit(1.0))
    whole = (F.length(date) >= 10) & name.isNotNull() & day.isNotNull()
    text = F.when(sure >= 0.9, F.concat(day.cast("string"), F.lit(". "), name, F.lit(" "), year)).when(sure >= 0.6, F.concat_ws(" ", name, year)).otherwise(F.concat(F.lit("um "), name, F.lit(" "), year))
    return F.when(F.length(date) >= 4, F.when(whole, text).otherwise(year))


def season_text(date: Column) -> Column:
    """The season of a date's month."""
    month = F.substring(date, 6, 2).try_cast("int")
    return F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Frühling").when(month.isin(6, 7, 8), "Sommer").when(month.isin(9, 10, 11), "Herbst")


def page_of(rows: DataFrame, order: list, offset: int, limit: int, most: int = 500) -> DataFrame:
    """A page in a total order with total, returned and has_more; the limit is kept between 1 and ``most``, the offset at 0 or above."""
    limit, offset = max(1, min(limit, most)), max(0, offset)
    total = rows.agg(F.count("*").alias("total"))  # one row
    held = F.greatest(F.least(F.col("total") - offset, F.lit(limit)), F.lit(0))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total.select("total", held.alias("returned"), (F.col("total") > offset + held).alias("has_more"))))
