"""Columns derived from times as text; native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = r"((?:19|20)\d\d)[-_](\d\d)[-_](\d\d)"


def utc(text: Column) -> Column:
    """The instant of a text that names its zone (``Z`` or an offset); null without a zone, as nobody knows what is meant."""
    text = F.trim(text)
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d.*(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))


def local_day(text: Column, zone: str) -> Column:
    """The calendar day at ``zone``; texts without a zone are taken as they stand."""
    return F.coalesce(F.to_date(F.from_utc_timestamp(utc(text), zone)), F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))))


def iso_day(hint: Column) -> Column:
    """A hint as a day: a year is its first of January, else the first separated date, else the first ten characters."""
    hint = F.trim(hint)
    named = F.concat_ws("-", *(F.regexp_extract(hint, DAY, k) for k in (1, 2, 3)))
    return F.when(hint.rlike(r"^\d{4}$"), F.concat(hint, F.lit("-01-01"))).when(hint.rlike(DAY), named).otherwise(F.substring(hint, 1, 10))


def decided(exif: Column, hint: Column, hint_source: Column, name: Column, folder: Column, times: list[Column], zone: str) -> Column:
    """The day of a row with its source and confidence: camera, hint, name, folder's year, older file time; null if nothing tells."""
    said = lambda day, source, sure: F.struct(day.alias("day"), source.alias("source"), F.lit(sure).alias("confidence"))
    spelled = F.concat_ws("-", *(F.regexp_extract(name, DAY, k) for k in (1, 2, 3)))
    year = F.regexp_extract(folder, r"\b(19\d\d|20\d\d)\b", 1)
    oldest = F.array_min(F.array(*(F.date_format(local_day(t, zone), "yyyy-MM-dd") for t in times)))
    hinted = F.coalesce(hint, F.lit("")) != ""
    return (
        F.when(exif.isNotNull(), said(F.substring(exif, 1, 10), F.lit("exif"), 1.0))
        .when(hinted & (hint_source == "folder_json"), said(iso_day(hint), hint_source, 0.9))
        .when(hinted, said(iso_day(hint), F.coalesce(hint_source, F.lit("folder")), 0.75))
        .when(name.rlike(DAY), said(spelled, F.lit("filename"), 0.7))
        .when(year != "", said(F.concat(year, F.lit("-01-01")), F.lit("folder"), 0.8))
        .when(oldest.rlike("^(19|20)"), said(oldest, F.lit("file_time"), 0.3))
    )


def taken_at(day: Column, exif: Column, mtime: Column, zone: str) -> Column:
    """The instant of a row: the camera's time on its day, else the file's time if its local day is the day, else midnight."""
    return (
        F.when(F.substring(exif, 1, 10) == day, F.try_to_timestamp(exif))
        .when(local_day(mtime, zone) == F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))), F.coalesce(utc(mtime), F.try_to_timestamp(F.substring(mtime, 1, 19))))
        .otherwise(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
    )


def day_number(ts: Column) -> Column:
    """Days since 1970, -1 if unknown."""
    return F.coalesce(F.datediff(F.to_date(ts), F.lit("1970-01-01")), F.lit(-1))


def date_bound(text: str, end: bool) -> str:
    """The first or last second of the year or day that a text spells; any other text as it is."""
    text = text.strip()
    if len(text) == 4 and text.isdigit():
        return f"{text}-12-31T23:59:59Z" if end else f"{text}-01-01T00:00:00Z"
    return f"{text}T{'23:59:59' if end else '00:00:00'}Z" if len(text) == 10 else text


def date_bounds(text: Column, end: bool) -> Column:
    """The same of a column, as an instant; null if it isn't one."""
    text = F.trim(text)
    year, clock = ("-12-31T23:59:59Z", "T23:59:59Z") if end else ("-01-01T00:00:00Z", "T00:00:00Z")
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit(year))).when(F.length(text) == 10, F.concat(text, F.lit(clock))).otherwise(text))
