"""What a new listing means for an index: what is known already, what has only moved, what the user's own fields survive, and what a row's state is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that no file can give back, of assets and of faces.
OWN_FIELDS = ("caption", "caption_source", "caption_locked", "annotations", "person_ids", "person_names", "event_name", "event_excluded", "trashed_at")
OWN_FACE_FIELDS = ("person_id", "person_name")
# The bits of a row's state.
FLAGS = ("person", "caption", "exif_date", "event", "gps", "no_clock", "faces_unnamed", "in_stack", "stack_head", "video")


def truthy(name: str, kind: str) -> Column:
    """Whether a column says anything: not null, and neither false, zero, nor empty."""
    value = F.col(name)
    if kind.startswith("array"):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    return value.isNotNull() & ~F.coalesce(value.cast("string").isin("", "0", "0.0"), F.lit(False))


def unseen(listing: DataFrame, index: DataFrame, key: str = "path") -> DataFrame:
    """The listed rows whose ``key`` the index doesn't have; rows without a key are unseen."""
    return listing.join(index.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(listing.columns)


def moved(listing: DataFrame, index: DataFrame, row_id: str = "asset_id", path: str = "path", content: str = "content") -> DataFrame:
    """(``row_id``, old_path, new_path) of rows whose file has moved: their path isn't listed, no other such row has their content, and a listed file that isn't indexed has it.

    Of several such files the first by path is taken; the others are new. Rows and files without content match nothing. Counting comes before
    the join, so a content that a third of all files share meets as one row.
    """
    orphans = unseen(index, listing, path).where(F.col(content).isNotNull()).groupBy(content).agg(F.count("*").alias("_n"), F.min(row_id).alias(row_id), F.min(path).alias("old_path")).where("_n = 1")
    fresh = unseen(listing, index, path).where(F.col(content).isNotNull()).groupBy(content).agg(F.min(path).alias("new_path"))
    return orphans.join(fresh, content).select(row_id, "old_path", "new_path")


def kept_fields(fresh: DataFrame, old: DataFrame, key: str, face: bool = False) -> DataFrame:
    """``fresh`` rows with the user's own fields of the ``old`` rows of their key; both have the columns of ``OWN_FIELDS`` (of faces: ``OWN_FACE_FIELDS``).

    Of faces, an old value that says something stays. Of assets, an old row counts if any of its own fields says something. Then persons, notes and the trash stamp
    are the old ones, empty or not, and so is the exclusion from events; an old event name stays if there is one. A locked caption stays with its source (``manual`` if it has none); any other gives way to
    a fresh one. Old keys are unique; rows without one are as they come.
    """
    names = OWN_FACE_FIELDS if face else OWN_FIELDS
    kinds = dict(old.dtypes)
    said = {c: truthy(c, kinds[c]) for c in names}
    prior = old.select(F.col(key).alias("_key"), *(F.when(said[c], F.col(c)).alias(f"_{c}") for c in names))
    any_said = F.lit(False)
    for c in names:
        any_said = any_said | F.col(f"_{c}").isNotNull()
    prior = prior.where(any_said).withColumn("_prior", F.lit(True))
    met = fresh.join(prior, F.col(key) == F.col("_key"), "left")
    new = {c: F.when(truthy(c, dict(fresh.dtypes)[c]), F.col(c)) for c in names}
    has = F.coalesce("_prior", F.lit(False))
    if face:
        pick = {c: F.coalesce(f"_{c}", c) for c in names}
    else:
        locked = F.coalesce("_caption_locked", F.lit(False))
        caption = F.when(locked, F.col("_caption")).otherwise(F.coalesce(new["caption"], "_caption"))
        source = F.when(locked, F.coalesce("_caption_source", F.lit("manual"))).when(new["caption"].isNotNull(), F.col("caption_source")).otherwise(F.coalesce("_caption_source", "caption_source"))
        none = F.array().cast("array<string>")
        pick = {c: F.when(has, F.coalesce(f"_{c}", none)).otherwise(F.col(c)) for c in ("person_ids", "person_names", "annotations")}
        pick |= {
            "caption": F.when(has, caption).otherwise(F.col("caption")), "caption_source": F.when(has, source).otherwise(F.col("caption_source")), "caption_locked": F.when(has & locked, True).otherwise(F.col("caption_locked")),
            "event_name": F.coalesce("_event_name", "event_name"), "event_excluded": F.when(has, F.coalesce("_event_excluded", F.lit(False))).otherwise(F.col("event_excluded")), "trashed_at": F.when(has, F.col("_trashed_at")).otherwise(F.col("trashed_at")),
        }
    return met.select(*(pick[c].alias(c) if c in pick else F.col(c) for c in fresh.columns))


def state_flags(persons: Column, caption: Column, date_source: Column, event: Column, gps: Column, taken_at: Column, faces: Column, in_stack: Column, is_head: Column, kind: Column) -> Column:
    """A row's state as bits, in the order of ``FLAGS``."""
    some = F.coalesce(F.size(persons) > 0, F.lit(False))
    stack = F.coalesce(in_stack, F.lit(False))
    marks = (
        some, F.coalesce(caption != "", F.lit(False)), F.coalesce(date_source == "exif", F.lit(False)), F.coalesce(event != "", F.lit(False)), F.coalesce(gps, F.lit(False)), F.coalesce(F.date_trunc("day", taken_at) == taken_at, F.lit(False)),
        F.coalesce(faces > 0, F.lit(False)) & ~some, stack, stack & F.coalesce(is_head, F.lit(False)), F.coalesce(kind == "video", F.lit(False)),
    )
    return sum((F.when(mark, 1 << bit).otherwise(0) for bit, mark in enumerate(marks)), F.lit(0))


def tidiness(flags: Column) -> Column:
    """How many of the four things that make a row complete it has."""
    return F.bit_count(flags.bitwiseAND(15))


def stack_heads(members: DataFrame, evidence: list[Column], stack: str = "head", row_id: str = "vec_id") -> DataFrame:
    """(``stack``, shown): the member of each stack with the most evidence, compared in the order given; of equal ones the smallest id."""
    best = F.max_by(row_id, F.struct(*(F.coalesce(e.cast("long"), F.lit(0)).alias(f"_{i}") for i, e in enumerate(evidence)), -F.col(row_id)))
    return members.groupBy(stack).agg(best.alias("shown"))


def gallery(faces: DataFrame, group: str) -> DataFrame:
    """One row for each group of faces: faces, photos, and its cover, the face of the least score (no score counts as 1; ties: the smallest id).

    faces: face_id, photo_id, score. Rows without a group are left out.
    """
    rows = faces.where(F.col(group).isNotNull())
    return rows.groupBy(group).agg(F.count("*").alias("faces"), F.count_distinct("photo_id").alias("photos"), F.min(F.struct(F.coalesce("score", F.lit(1.0)).alias("score"), "face_id")).alias("_c")).select(group, "faces", "photos", F.col("_c.face_id").alias("cover"))
