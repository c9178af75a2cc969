"""Changes to who is on what: assignments of faces, renamed persons, the persons of a picture told again from its faces, and the registry of event names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions.text import slug
from medialake.operators.curation import latest
from medialake.storage import stored

# Who stands for faces that nobody is to be asked about again, and for those put aside.
IGNORED, SKIPPED = "_ignored", "_skipped"


def assigned(faces: DataFrame, requests: DataFrame) -> DataFrame:
    """``faces`` (face_id, photo_id, person_id, person_name, ...) after ``requests`` (seq, action, face_id, person_id, name), with ``changed``.

    Actions: assign (to person_id, under the name its faces have, else the id), create and move (to the person of a name; its id is the name's slug), skip, ignore, unassign (one face), and
    dissolve (all faces of a person_id). Of several requests that reach a face the one with the greatest ``seq`` holds; requests without a name or person that they need, and faces that aren't there, do nothing. A dissolved
    person's faces are those it has before the requests.
    """
    asked = requests.withColumn("name", F.nullif(F.trim("name"), F.lit("")))
    names = faces.where("person_id is not null").groupBy(F.col("person_id").alias("_known")).agg(F.min_by("person_name", "face_id").alias("_name"))
    action, ids = F.col("action"), F.col("person_id")
    told = asked.join(names, F.col("person_id") == F.col("_known"), "left")
    to = F.when(action == "assign", ids).when(action.isin("create", "move"), slug(F.col("name"))).when(action == "skip", SKIPPED).when(action == "ignore", IGNORED)
    called = F.when(action == "assign", F.coalesce("_name", "person_id")).when(action.isin("create", "move"), F.col("name")).when(action == "skip", "skipped").when(action == "ignore", "ignored")
    named = told.select("seq", "face_id", "action", to.alias("to"), called.alias("called"), ids.alias("of")).where("action in ('unassign', 'dissolve') or to <> ''")
    single = named.where("action <> 'dissolve' and face_id is not null").select("face_id", "seq", "to", "called")
    whole = named.where("action = 'dissolve'").select("seq", "of", "to", "called").join(faces.select("face_id", F.col("person_id").alias("of")), "of").select("face_id", "seq", "to", "called")
    last = latest(single.union(whole), ["face_id"], ["seq", "to"]).select("face_id", "to", "called", F.lit(True).alias("_asked"))
    met = faces.join(last, "face_id", "left")
    moved = F.coalesce("_asked", F.lit(False))
    changed = moved & ~F.col("to").eqNullSafe(F.col("person_id"))
    pick = {"person_id": F.when(moved, F.col("to")).otherwise(F.col("person_id")), "person_name": F.when(moved, F.col("called")).otherwise(F.col("person_name"))}
    return met.select(*(pick[c].alias(c) if c in pick else F.col(c) for c in faces.columns), changed.alias("changed"))


def photo_persons(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """(photo_id, person_ids, person_names) of the ``photos`` (photo_id, person_ids, person_names) whose persons, told from all their ``faces``, are others than they say.

    Persons come by id, each with the name of its first face; pseudo persons don't. A photo whose last face is gone has none. Null lists are empty ones.
    """
    real = faces.where("person_id is not null and not startswith(person_id, '_')").groupBy("photo_id", "person_id").agg(F.min_by(F.coalesce("person_name", "person_id"), "face_id").alias("_name"))
    told = real.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("person_id", "_name"))).alias("_p"))
    none = F.array().cast("array<string>")
    was = [F.coalesce(c, none) for c in ("person_ids", "person_names")]
    now = photos.select("photo_id", was[0].alias("_ids"), was[1].alias("_names")).join(told, "photo_id", "left").select("photo_id", "_ids", "_names", F.coalesce("_p.person_id", none).alias("person_ids"), F.coalesce("_p._name", none).alias("person_names"))
    return now.where((F.col("_ids") != F.col("person_ids")) | (F.col("_names") != F.col("person_names"))).select("photo_id", "person_ids", "person_names")


def renamed(faces: DataFrame, photos: DataFrame, meta: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``faces``, ``photos`` and ``meta`` that change when persons get new names (``renames``: person_id, name).

    A person's new id is the slug of its new name; renames are taken at once, each by the old id, of repeated ones that of the greatest name. On a photo (photo_id, person_ids, person_names) the
    old id and the old name, that of the person's first face, are replaced, the new name is added where it is missing, and both lists are made distinct in order.
    The person's row in meta (person_id, ...) moves to the new id, unless that has one already: then it is merged there (``into``). Persons without a face, and empty names, do nothing.
    """
    asked = renames.withColumn("name", F.trim("name")).where("name <> ''").groupBy("person_id").agg(F.max("name").alias("_new"))
    first = faces.where("person_id is not null").groupBy("person_id").agg(F.min_by("person_name", "face_id").alias("_old"))
    plan = stored(asked.join(first, "person_id").select(F.col("person_id").alias("_of"), F.coalesce("_old", "person_id").alias("_old"), "_new", slug(F.col("_new")).alias("_to")), "renames")
    met = faces.join(plan, F.col("person_id") == F.col("_of"))
    faces_out = met.select(*(F.col("_to").alias(c) if c == "person_id" else F.col("_new").alias(c) if c == "person_name" else F.col(c) for c in faces.columns))
    each = photos.select("photo_id", F.explode(F.array_distinct("person_ids")).alias("_of")).join(plan, "_of")
    per = each.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("_of", "_old", "_new", "_to"))).alias("_plan"))  # at most a photo's persons
    swap = lambda values, key, to: F.transform(values, lambda x: F.coalesce(F.get(F.filter("_plan", lambda p: p[key] == x), F.lit(0))[to], x))
    names = F.array_distinct(F.concat(swap(F.coalesce("person_names", F.array().cast("array<string>")), "_old", "_new"), F.transform("_plan", lambda p: p["_new"])))
    photos_out = photos.join(per, "photo_id").select(*(F.array_distinct(swap(F.col(c), "_of", "_to")).alias(c) if c == "person_ids" else names.alias(c) if c == "person_names" else F.col(c) for c in photos.columns))
    there = meta.select(F.col("person_id").alias("_to"), F.lit(True).alias("into"))
    meta_out = meta.join(plan.where("_of <> _to").select("_of", "_to"), F.col("person_id") == F.col("_of")).join(there, "_to", "left").select(*(F.col("_to").alias(c) if c == "person_id" else F.col(c) for c in meta.columns), F.col("_of").alias("previous"), F.coalesce("into", F.lit(False)).alias("into"))
    return faces_out, photos_out, meta_out


def span_key(channel: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("|", channel, start.cast("string"), end.cast("string"))


def registry(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Named spans and rejected pairs after ``requests`` (seq, action, channel, start_at, end_at, name, photos, and other_channel, other_start, other_end of a second span).

    ``name`` names a span, again if need be; ``forget`` drops it; ``merge`` forgets both spans and then names the one that covers them, be it one of the two, with the first's channel and the photos of both; ``reject`` says that two spans
    are not one. The last request by ``seq`` on a span holds. Names are trimmed, empty ones say nothing; a rejected pair is the same in either order.
    """
    rows = requests.withColumn("name", F.trim("name"))
    span = lambda c, s, e, name, photos: F.struct(F.col(c).alias("channel"), F.col(s).alias("start_at"), F.col(e).alias("end_at"), name.alias("name"), photos.alias("photos"))
    gone, none = F.lit(None).cast("string"), F.lit(0).cast("long")
    first, second = span("channel", "start_at", "end_at", gone, none), span("other_channel", "other_start", "other_end", gone, none)
    whole = F.struct(F.col("channel"), F.least("start_at", "other_start").alias("start_at"), F.greatest("end_at", "other_end").alias("end_at"), F.col("name"), F.col("photos").cast("long").alias("photos"))
    action, said = F.col("action"), F.coalesce(F.col("name") != "", F.lit(False))
    steps = F.when((action == "name") & said, F.array(span("channel", "start_at", "end_at", F.col("name"), F.col("photos").cast("long")))).when(action == "forget", F.array(first)).when((action == "merge") & said, F.array(first, second, whole))
    each = rows.where(action.isin("name", "forget", "merge")).select("seq", F.posexplode(steps).alias("_step", "s")).select("seq", "_step", "s.*")
    held = latest(each, ["channel", "start_at", "end_at"], ["seq", "_step"]).where("name is not null").select("channel", "start_at", "end_at", "name", "photos")
    one, two = span_key(F.col("channel"), F.col("start_at"), F.col("end_at")), span_key(F.col("other_channel"), F.col("other_start"), F.col("other_end"))
    rejected = rows.where("action = 'reject'").select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()
    return held, rejected


def album_list(rows: DataFrame, album: str, folder: str, event: str, row_id: str, generic: Column, whole: float = 0.9) -> DataFrame:
    """One row for each album: path, folder_name, photos, named, cover, event_names, generic, rename_whole and its place in the list.

    Names that tell nothing come first, then short ones, then by name in lower case, then by path. The folder's name and the cover are those of the smallest id; event names are distinct, in the order of the ids at which they first
    occur. A generic album is renamed as a whole only if nearly all its photos (``whole``) are of one event. ``generic`` is a condition on folder_name.
    """
    named = F.nullif(F.trim(event), F.lit(""))
    base = rows.where(F.col(album).isNotNull()).groupBy(F.col(album).alias("path")).agg(F.min_by(folder, row_id).alias("folder_name"), F.count("*").alias("photos"), F.count(named).alias("named"), F.min(row_id).alias("cover"))
    events = rows.where(F.col(album).isNotNull() & named.isNotNull()).groupBy(F.col(album).alias("path"), named.alias("_e")).agg(F.min(row_id).alias("_at"))
    events = events.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_at", "_e"))).alias("_l")).select("path", F.col("_l._e").alias("event_names"))
    met = base.join(events, "path", "left").withColumn("event_names", F.coalesce("event_names", F.array().cast("array<string>"))).withColumn("generic", F.coalesce(generic, F.lit(False)))
    return met.withColumn("rename_whole", ~F.col("generic") | ((F.col("named") / F.col("photos") >= whole) & (F.size("event_names") == 1)))


def timeline(rows: DataFrame, session: str, start: str, channel: str, months_from: int = 60) -> tuple[DataFrame, DataFrame]:
    """Years (year, photos, channels) and months (year, month, photos, events) of rows that belong to sessions; rows without a session are the year ``undated``.

    A row counts in the year and month in which its session starts. A year is told by months only if it has ``months_from`` rows and two months at least. ``channels`` is a map of counts.
    """
    year, month = F.coalesce(F.date_format(start, "yyyy"), F.lit("undated")), F.coalesce(F.date_format(start, "yyyy-MM"), F.lit(""))
    cells = stored(rows.groupBy(year.alias("year"), month.alias("month"), F.col(channel).alias("channel"), F.col(session).alias("session")).agg(F.count("*").alias("n")), "cells")
    per_channel = cells.groupBy("year", "channel").agg(F.sum("n").alias("n"))
    years = per_channel.groupBy("year").agg(F.sum("n").alias("photos"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("channel", F.lit("camera")).alias("channel"), "n")))).alias("channels"))
    months = cells.groupBy("year", "month").agg(F.sum("n").alias("photos"), F.count_distinct("session").alias("events"))
    told = months.groupBy("year").agg(F.sum("photos").alias("_all"), F.count("*").alias("_months")).where((F.col("_all") >= months_from) & (F.col("_months") >= 2)).select("year")
    return years, months.join(told, "year", "left_semi").select("year", "month", "photos", "events")
