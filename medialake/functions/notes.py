"""Metadata notes (``mark:key=value;...``), capture stamps, salvaged captions and verdicts on written clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medialake.functions import dates as D

# What a note lists first, sources whose clock came from the file's time, suffixes that can be written,
# and what a name with a clock of its own looks like.
ORDER = ("src", "prev", "mtime", "cap")
FILE_CLOCK = ("filename", "folder", "folder_name", "folder_json", "album")
WRITABLE = ("jpg", "jpeg", "tif", "tiff")
OWN_CLOCK = r"(^|\D)(19|20)\d\d[-_]?\d\d[-_]?\d\d[-_ T]?([01]\d|2[0-3])[-_.:]?[0-5]\d[-_.:]?[0-5]\d(\D|$)"
NAMED_DAY = r"((?:19|20)\d\d)-?(\d\d)-?(\d\d)"


def note_fields(note: Column, mark: str) -> Column:
    """The map that a note holds after ``mark:``; empty without the mark. Of a repeated key the last value counts."""
    body = F.when(F.instr(note, f"{mark}:") > 0, F.substring_index(note, f"{mark}:", -1)).otherwise("")
    pairs = F.transform(F.regexp_extract_all(body, F.lit(r"(\w+=[^;]*)"), F.lit(1)), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, r"^\w+=", "").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def note_text(fields: Column, mark: str) -> Column:
    """The note of a map: known keys in their order, then the others by name; blank values are left out, and an empty map is ''."""
    entries = F.filter(F.map_entries(fields), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    place = lambda e: F.when(F.array_position(F.array(*map(F.lit, ORDER)), e["key"]) > 0, F.array_position(F.array(*map(F.lit, ORDER)), e["key"])).otherwise(99)
    told = F.array_sort(F.transform(entries, lambda e: F.struct(place(e).alias("n"), e["key"].alias("k"), F.trim(e["value"]).alias("v"))))
    text = F.array_join(F.transform(told, lambda e: F.concat(e["k"], F.lit("="), e["v"])), ";")
    return F.when(F.size(told) > 0, F.concat(F.lit(f"{mark}:"), text)).otherwise("")


def capture_stamp(stamps: list[tuple[str, Column]], note: Column, mark: str, derived: dict[str, float]) -> Column:
    """(stamp, field, confidence) of the first of ``stamps`` that can be read; a note of one's own lowers the confidence by its source."""
    src = F.substring_index(F.coalesce(note_fields(note, mark)["src"], F.lit("")), "+", 1)
    sure = F.when(F.instr(note, f"{mark}:") > 0, F.coalesce(F.create_map(*(F.lit(x) for kv in derived.items() for x in kv))[src], F.lit(0.5))).otherwise(1.0)
    read = [(name, F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))) for name, text in stamps]
    return F.coalesce(*(F.when(at.isNotNull(), F.struct(at.alias("stamp"), F.lit(name).alias("field"), sure.alias("confidence"))) for name, at in read))


def salvaged(text: Column, key: str, most: int = 4) -> Column:
    """The sentence under ``key`` of a text that may be a JSON blob, cut off or up to ``most`` times nested; plain text stays, a blob without it is ''."""

    def opened(now: Column) -> Column:
        cut = F.regexp_extract(now, rf'(?s)"{key}"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, r"\\n", "\n"), r"\\t", "\t"), r'\\(["\\/])', "$1")
        whole = F.get_json_object(now, "$").isNotNull()
        return F.when(~now.startswith("{"), now).otherwise(F.trim(F.when(whole, F.coalesce(F.get_json_object(now, f"$.{key}"), F.lit(""))).otherwise(plain)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.trim(F.coalesce(text, F.lit(""))), lambda now, _: opened(now))


def noon(name: Column, day: Column, source: Column) -> Column:
    """Noon of a day that the file's name tells, unless that name has a clock of its own."""
    return F.when((source == "filename") & ~name.rlike(OWN_CLOCK), F.try_to_timestamp(F.concat(day, F.lit(" 12:00:00"))))


def noted_source(source: Column) -> Column:
    """How a note names a source whose clock is the file's."""
    source = F.coalesce(source, F.lit("derived"))
    return F.when(source.isin(*FILE_CLOCK), F.concat(source, F.lit("+mtime"))).otherwise(source)


def write_back(path: Column, name: Column, day: Column, source: Column, taken: Column, zone: str) -> Column:
    """(stamp, source) to write where a file has no capture time: the file's clock if its local day is the day, else noon of a named day; null if neither."""
    clock = F.when(F.substring(taken, 12, 8) != "00:00:00", F.coalesce(D.utc(taken), F.try_to_timestamp(F.substring(taken, 1, 19))))
    off = D.utc(taken).isNotNull() & (F.date_format(D.local_day(taken, zone), "yyyy-MM-dd") != day)
    midday = noon(name, day, source)
    said = F.when(clock.isNotNull() & ~off, F.struct(clock.alias("stamp"), noted_source(source).alias("source"))).when(midday.isNotNull(), F.struct(midday.alias("stamp"), F.lit("filename+noon").alias("source")))
    return F.when(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*WRITABLE) & (source != "exif"), said)


def clock_verdict(path: Column, name: Column, note: Column, offset: Column, original: Column, mark: str, zone: str) -> Column:
    """What to do about a written clock that may be UTC in place of local time, as the first of the cases below that holds."""
    fields = note_fields(note, mark)
    src = F.coalesce(fields["src"], F.lit(""))
    written = F.try_to_timestamp(original, F.lit("yyyy:MM:dd HH:mm:ss"))
    mtime = F.try_to_timestamp(F.substring(F.regexp_replace(fields["mtime"], "Z$", ""), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    local = F.from_utc_timestamp(mtime, zone)
    named = F.concat_ws("-", *(F.regexp_extract(name, NAMED_DAY, k) for k in (1, 2, 3)))
    return (
        F.when(~F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*WRITABLE), "other format")
        .when(src == "", "no note")
        .when(F.instr(src, "+") > 0, "new form")
        .when(~src.isin(*FILE_CLOCK, "file_time", "derived"), F.concat(F.lit("source "), src))
        .when(offset.isNotNull(), "has an offset")
        .when(written.isNull(), "no stamp")
        .when(mtime.isNull(), "no file time")
        .when(written != mtime, "another clock")
        .when(local == written, "local is UTC")
        .when((src != "file_time") & (F.to_date(local) != F.to_date(written)), F.when((named == F.date_format(written, "yyyy-MM-dd")) & noon(name, named, src).isNotNull(), "noon").otherwise("day would change"))
        .otherwise("to correct")
    )
