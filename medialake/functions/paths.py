"""Columns derived from paths; native expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of media files.
VIDEO = ("mp4", "mov", "m4v", "avi", "mkv", "3gp", "mts", "webm")
IMAGE = ("jpg", "jpeg", "png", "heic", "webp", "tif", "tiff", "cr2", "gif", "bmp")


# Names of files and directories that tell where a file comes from.
SCREENSHOT_NAME = r"(?i)^(screenshot|bildschirmfoto|scr_)"
MESSENGER_NAME = r"(?i)^(IMG|VID)-\d{8}-WA\d+"
SOCIAL_NAME = r"(?i)^(FB_IMG|Snapchat|Instagram|received_|Screenshot)"
DIRECTORY_CHANNELS = {
    "sent": "sent", "screenshots": "screenshot", "office lens": "document", "scans": "document", "documents": "document", "whatsapp": "whatsapp",
    "download": "download", "downloads": "download", "instagram": "download", "ebay": "download", "chatgpt": "download", "telegram": "download",
}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind(path: Column) -> Column:
    """``video`` by suffix, else ``photo``."""
    return F.when(suffix(path).isin(*VIDEO), "video").otherwise("photo")


def channel(path: Column) -> Column:
    """Where a file comes from: a screenshot's name, a messenger's name (sent or received), the deepest directory with a rule, a
    social network's name, else the camera."""
    norm = F.translate(path, "\\", "/")
    name = file_name(norm)
    dirs = F.reverse(F.slice(F.split(F.lower(norm), "/"), F.lit(1), F.size(F.split(norm, "/")) - 1))
    rules = F.create_map(*(F.lit(x) for pair in DIRECTORY_CHANNELS.items() for x in pair))
    ruled = F.get(F.filter(dirs, lambda d: d.isin(*DIRECTORY_CHANNELS)), F.lit(0))
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "camera")
        .when(name.rlike(SCREENSHOT_NAME), "screenshot")
        .when(name.rlike(MESSENGER_NAME), F.when(F.array_contains(dirs, "sent"), "sent").otherwise("whatsapp"))
        .when(ruled.isNotNull(), rules[ruled])
        .when(name.rlike(SOCIAL_NAME), "download")
        .otherwise("camera")
    )


def sequence(path: Column) -> Column:
    """The camera's running number in a name (``IMG_0042``, ``WA0120``), or null."""
    return F.nullif(F.regexp_extract(file_name(path), r"(?:IMG_|DSC_?|WA)(\d{3,6})(?:\D|$)", 1), F.lit("")).cast("int")


def collapsed(path: Column) -> Column:
    """Without ``.``, ``..`` and empty segments."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def under(path: Column, root: str) -> Column:
    """Whether a path is ``root`` or below it, by whole segments."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def space(path: Column, root: str) -> Column:
    """The first level below ``root``; ``?`` for files in it or elsewhere."""
    rest = F.split(F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path)), "/")
    return F.when(under(path, root) & (F.size(rest) > 1), rest[0]).otherwise("?")


def album(path: Column) -> Column:
    """The directory that names the album: at most two camera folders above the file are climbed over."""
    dirs = F.split(folder(path), "/")
    camera = lambda x: x.rlike(r"(?i)^(\d{3}[A-Z_]{3,8}|DCIM|Camera|Sent)$")
    last, before = F.element_at(dirs, -1), F.try_element_at(dirs, F.lit(-2))
    return F.when(~camera(last), last).when(before.isNotNull() & ~camera(before), before).otherwise(F.try_element_at(dirs, F.lit(-3)))


def rebased(path: Column, old: str, new: str) -> Column:
    """``old`` replaced by ``new`` at the start of paths below it."""
    return F.when(under(path, old), F.concat(F.lit(new.rstrip("/")), F.substring(path, F.lit(len(old.rstrip("/")) + 1), F.length(path)))).otherwise(path)


def date_hint(path: Column) -> Column:
    """The date that a name spells, the leftmost of separated and compact forms, as a string; runs of more digits are no date."""
    name = file_name(path)
    compact = F.regexp_extract(name, r"(?:^|\D)((?:19|20)\d\d)(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?:\D|$)", 0)
    apart = F.regexp_extract(name, r"(?:^|\D)((?:19|20)\d\d)[-_.](0[1-9]|1[0-2])[-_.](0[1-9]|[12]\d|3[01])(?:\D|$)", 0)
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    both = F.when(apart != "", digits(apart)).otherwise(digits(compact))
    first = F.when((apart != "") & (compact != "") & (F.position(compact, name) < F.position(apart, name)), digits(compact)).otherwise(both)
    return F.when(first != "", F.concat_ws("-", F.substring(first, 1, 4), F.substring(first, 5, 2), F.substring(first, 7, 2)))


def folder_year(path: Column) -> Column:
    """A year that the album's name spells, or null."""
    return F.nullif(F.regexp_extract(album(path), r"(?:^|\D)((?:19|20)\d\d)(?:\D|$)", 1), F.lit("")).cast("int")


def generic(name: Column) -> Column:
    """Whether an album's name says nothing."""
    return F.coalesce(F.trim(name) == "", F.lit(True)) | name.rlike(r"(?i)^(src[0-9]|camera|dcim|download|new folder|whatsapp images|sent|\d{3}[A-Z_]+)$")


def scannable(path: Column, size: Column, least: int = 32) -> Column:
    """Whether a scan takes the file: a media suffix, no dot names, enough bytes."""
    return suffix(path).isin(*VIDEO, *IMAGE) & ~path.rlike(r"(^|/)\.") & (size >= least) & ~F.lower(file_name(path)).isin("thumbs.db", "desktop.ini")


def name_ok(name: Column) -> Column:
    """Whether a folder may bear the name."""
    return (F.trim(name) != "") & ~name.rlike(r'[<>:"/\\|?*\x00-\x1F]') & ~name.rlike(r"[. ]$")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def common_root(path: Column) -> Column:
    """An aggregate: the directory that all paths of a group share, cut at segments; that of one path, or of equal ones, is its parent.

    Null and empty paths don't count; a single path without a directory is its own root, as there is nothing above it; without paths it is empty.
    """
    path = F.nullif(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(""))
    ends = [F.split(F.regexp_replace(end, "/?[^/]*$", ""), "/") for end in (F.min(path), F.max(path))]  # what all share, the least and the greatest share
    same = F.zip_with(*ends, lambda x, y: F.coalesce(x == y, F.lit(False)))
    upto = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)), F.size(same) + 1) - 1
    shared = F.array_join(F.slice(ends[0], 1, upto.cast("int")), "/")
    alone = (F.count(path) == 1) & ~F.contains(F.min(path), F.lit("/"))
    return F.when(F.count(path) == 0, "").when(alone, F.min(path)).otherwise(shared)


# Fixed value: the name space of domain names.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, space: str = DNS) -> Column:
    """The name-based UUID (version 5) of a text: SHA-1 over the name space's bytes and the name's UTF-8, with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    part = lambda at, size: F.substring(digest, at, size)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def point_id(uid: Column) -> Column:
    """The point of an asset's identity."""
    return uuid5(uid)


def face_point_id(asset: Column, index: Column, box: Column, frame_s: Column) -> Column:
    """The point of a face: asset, number, box (array of whole numbers) and, on a video, the frame's second (written as Python writes a float)."""
    written = F.concat(F.lit("["), F.array_join(F.transform(box, lambda x: x.cast("string")), ", "), F.lit("]"))
    return uuid5(F.concat_ws(":", asset.cast("string"), frame_s.cast("string"), index.cast("string"), written))
