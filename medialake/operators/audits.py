"""Audits of what is there against what should be: rows whose file is gone, artefacts that belong to nothing, groups whose size was foretold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.storage import stored


def parent(path: Column) -> Column:
    """The directory of a path; the root's is empty."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def directories(listing: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """(dir): every directory that holds a listed file (path) at some depth, and those of ``dirs`` (path), which may be empty, with what is above them."""
    folders = listing.where("path is not null").select(parent(F.col("path")).alias("dir"))
    if dirs is not None:
        folders = folders.union(dirs.where("path is not null").select("path"))
    folders = folders.distinct()  # few against the files; their ancestors are named once
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return folders.select(F.explode(above).alias("dir")).distinct()


def ghosts(rows: DataFrame, listing: DataFrame, dirs: DataFrame | None = None, row_id: str = "asset_id") -> DataFrame:
    """(``row_id``, path, verdict, dest) of each row with a path: live, duplicate, migrate or gone.

    A row whose file isn't listed has moved if its directory is gone, the directory above is there, and exactly one directory in that holds a
    file of the row's name: ``dest``. It is a duplicate if a row has that path already, else it migrates; any other row is gone. Rows
    without a path are left out; rows of one path get one verdict each.
    """
    there = stored(directories(listing, dirs), "directories")
    files = listing.where("path is not null").select("path").distinct()
    asked = rows.where("path is not null and path <> ''").select(row_id, "path")
    live = asked.join(files, "path", "left_semi").select(row_id, "path", F.lit("live").alias("verdict"), F.lit(None).cast("string").alias("dest"))
    lost = asked.join(files, "path", "left_anti")
    name = F.element_at(F.split("path", "/"), -1)
    lost = lost.withColumn("_dir", parent(F.col("path"))).withColumn("_above", parent(F.col("_dir"))).withColumn("_name", name)
    lost = lost.withColumn("_deep", F.contains("_dir", F.lit("/")))
    moved = lost.join(there.select(F.col("dir").alias("_dir")), "_dir", "left_anti").join(there.select(F.col("dir").alias("_above")), "_above", "left_semi")
    by_name = files.select(parent(parent(F.col("path"))).alias("_above"), name.alias("_name"), "path").where(F.contains(parent(F.col("path")), F.lit("/"))).groupBy("_above", "_name").agg(F.count("*").alias("n"), F.min("path").alias("dest")).where("n = 1")
    found = moved.where("_deep").join(by_name, ["_above", "_name"]).select(row_id, "path", "dest")
    taken = rows.where("path is not null").select(F.col("path").alias("dest"), F.lit(True).alias("_taken")).distinct()
    found = stored(found.join(taken, "dest", "left").select(row_id, "path", F.when(F.col("_taken"), "duplicate").otherwise("migrate").alias("verdict"), "dest"), "moved")
    gone = lost.select(row_id, "path").join(found.select("path").distinct(), "path", "left_anti").select(row_id, "path", F.lit("gone").alias("verdict"), F.lit(None).cast("string").alias("dest"))
    return live.union(found).union(gone)


def repair_plan(verdicts: DataFrame, faces: DataFrame, row_id: str = "asset_id") -> DataFrame:
    """(``row_id``, action, path, dest, folder, faces): duplicates and what is gone are deleted with their faces, moved rows take their new path and its directory's name.

    faces: ``row_id`` of each face. Live rows have no plan.
    """
    many = faces.groupBy(row_id).agg(F.count("*").alias("faces"))
    drop = F.col("verdict").isin("duplicate", "gone")
    folder = F.when(~drop, F.element_at(F.split(parent(F.col("dest")), "/"), -1))
    planned = verdicts.where("verdict <> 'live'").join(many, row_id, "left")
    return planned.select(row_id, F.when(drop, "delete").otherwise("move").alias("action"), "path", F.when(~drop, F.col("dest")).alias("dest"), folder.alias("folder"), F.when(drop, F.coalesce("faces", F.lit(0))).otherwise(0).cast("long").alias("faces"))


def claims(expected: DataFrame, stock: DataFrame, row_id: str = "asset_id") -> DataFrame:
    """(``row_id``, verdict, key): each row's first key, in the order of ``keys`` (an array), that the stock (key, bytes) has, or its first key and ``missing``.

    Rows without keys are left out.
    """
    each = expected.where(F.size("keys") > 0).select(row_id, F.posexplode("keys").alias("at", "key"))
    met = each.join(stock.select("key", F.lit(True).alias("there")).distinct(), "key", "left")
    first = met.groupBy(row_id).agg(F.min(F.when(F.col("there"), F.struct("at", "key"))).alias("held"), F.min(F.struct("at", "key")).alias("wanted"))
    return first.select(row_id, F.when(F.col("held").isNull(), "missing").otherwise("present").alias("verdict"), F.coalesce("held.key", "wanted.key").alias("key"))


def artefacts(expected: DataFrame, stock: DataFrame, others: DataFrame | None = None, row_id: str = "asset_id") -> DataFrame:
    """(key, bytes, verdict) of each artefact: good if it is some row's, duplicate if a row could use it but has a better one, valid if only ``others`` (key) claim it, else orphan."""
    keys = expected.select(F.explode("keys").alias("key")).distinct().withColumn("_wanted", F.lit(True))
    good = claims(expected, stock, row_id).where("verdict = 'present'").select("key").distinct().withColumn("_good", F.lit(True))
    met = stock.join(keys, "key", "left").join(good, "key", "left")
    if others is not None:
        met = met.join(others.select("key").distinct().withColumn("_other", F.lit(True)), "key", "left")
    else:
        met = met.withColumn("_other", F.lit(None).cast("boolean"))
    verdict = F.when(F.col("_good"), "good").when(F.col("_wanted"), "duplicate").when(F.col("_other"), "valid").otherwise("orphan")
    return met.select("key", "bytes", verdict.alias("verdict"))


def artefact_report(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(verdict, n, bytes): artefacts by verdict, and the rows of ``claims`` that miss theirs, at the mean size of a good one."""
    have = found.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    mean = found.where("verdict = 'good'").agg(F.avg("bytes").alias("mean"))  # one row
    missing = rows.where("verdict = 'missing'").select("key").distinct().agg(F.count("*").alias("n")).crossJoin(F.broadcast(mean))
    return have.union(missing.select(F.lit("missing"), "n", F.floor(F.col("n") * F.coalesce("mean", F.lit(0.0)))))


def shifted(rows: DataFrame, groups: DataFrame, by: list[str], ts: str, row_id: str, path: str | None = None, writable: tuple[str, ...] = ("jpg", "jpeg")) -> DataFrame:
    """(``row_id``, old_at, new_at) of the rows of each group (``by``, offset_s, expected), moved by its offset.

    The plan fails, before a row comes out, if a group has other than ``expected`` rows with a time (none at all as well), a null expectation, or, where ``path`` is given, a row whose file type
    can't be written: counts are joined to every row and asserted.
    """
    met = rows.where(F.col(ts).isNotNull()).join(groups, by)
    bad = F.lit(False) if path is None else ~F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*writable)
    counts = met.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(F.when(bad, 1).otherwise(0)).alias("_bad"))
    told = groups.join(counts, by, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    name = F.concat_ws(" / ", *(F.col(x).cast("string") for x in by))
    wrong = F.when(F.col("expected").isNull() | (F.col("_n") != F.col("expected")), F.concat(name, F.lit(": expected "), F.coalesce(F.col("expected").cast("string"), F.lit("nothing")), F.lit(", found "), F.col("_n").cast("string")))
    wrong = wrong.when(F.coalesce("_bad", F.lit(0)) > 0, F.concat(name, F.lit(": files that can't be written")))
    verdict = told.agg(F.max(wrong).alias("_wrong"))  # one row, from all groups
    guarded = met.crossJoin(F.broadcast(verdict)).where(F.coalesce(F.assert_true(F.col("_wrong").isNull(), F.col("_wrong")).isNull(), F.lit(True)))
    return guarded.select(row_id, F.col(ts).alias("old_at"), (F.col(ts) + F.make_dt_interval(secs=F.col("offset_s").cast("decimal(18,6)"))).alias("new_at"))
