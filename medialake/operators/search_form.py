"""The search form: persons, dates, place, tags, notes and folder, all or any of them, within a scope, and words that must stand in the row."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.functions.dates import date_bound
from medialake.operators.filters import media_scope, visible
from medialake.operators.substrings import holding, lengths_of, sized, starts
from medialake.storage import stored

# Words that a search leaves out.
STOP_WORDS = (
    "der die das den dem des ein eine einer einem eines und oder mit ohne auf aus bei nach von zu zum zur im in am an als wie ist sind war fuer für uber über the and or of a"
).split()
TEXTS = ("caption", "folder", "location", "event_name")
LISTS = ("tags", "annotations")


def match_fold(text: Column) -> Column:
    """Lower case, ß as ss, umlauts to their vowel; other accents stay."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "äöü", "aou")


def terms_of(query: str) -> list[str]:
    """The words of a query that say something: three characters at least, no stop word, each once, folded."""
    folded = query.casefold().translate(str.maketrans({"ä": "a", "ö": "o", "ü": "u"}))
    return list(dict.fromkeys(w for w in re.split(r"[^\w]+", folded) if len(w) >= 3 and w not in STOP_WORDS))


def haystack(rows: DataFrame, texts: tuple[str, ...] = TEXTS, lists: tuple[str, ...] = LISTS) -> Column:
    """All that words are looked for in, folded; of the columns those that ``rows`` has."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts if c in rows.columns]
    parts += [F.array_join(F.col(c), " ") for c in lists if c in rows.columns]
    return match_fold(F.concat_ws(" ", *parts))


def holds_words(text: Column, terms: list[str]) -> Column:
    """Whether every term starts a word of the folded ``text``; an empty text holds none, and no terms hold everywhere."""
    return reduce(lambda out, t: out & text.rlike(r"(?<![a-z0-9])\Q" + t.replace(r"\E", "") + r"\E"), terms, F.lit(True) if not terms else text != "")


@dataclass(frozen=True)
class SearchForm:
    """What a user asks for; empty fields say nothing."""

    persons: tuple[str, ...] = ()
    persons_match: str = "all"
    match: str = "all"
    date_from: str = ""
    date_to: str = ""
    location: str = ""
    tags: tuple[str, ...] = ()
    annotations: tuple[str, ...] = ()
    folder: str = ""
    spaces: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    words: str = ""
    ids: tuple = field(default=())


def resolve_people(tokens: DataFrame, people: DataFrame) -> DataFrame:
    """(token, id, tier) of the people (id, name, aliases) that each token means; unknown and empty tokens have a null id.

    The first tier that anyone reaches counts: 1 exactly the id, name or an alias; 2 the start of a word of the name, of an alias, or, with blanks as hyphens, of the id or a part of it; 3 any
    part of a name, id or alias. Starts are met by equality: only those of lengths that some token has are made. Tokens of the last tier
    meet texts by ``holding``. Case is ignored; null aliases are skipped.
    """
    asked = tokens.select("token", F.lower(F.trim("token")).alias("t")).where("t <> ''").distinct().withColumn("slug", F.replace("t", F.lit(" "), F.lit("-")))
    asked = stored(asked, "asked")
    aliases = F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a)), lambda a: a != "")
    known = people.where("id is not null").select("id", F.lower(F.coalesce("name", "id")).alias("name"), aliases.alias("aliases"))
    # Dealt anew: a file of a few MB is one task, however many starts and runs its rows unfold to.
    known = stored(known.withColumn("texts", F.concat(F.array("name"), F.col("aliases"))).repartition("id", "name"), "known")
    exact = known.select("id", F.explode(F.array_distinct(F.concat(F.array("id"), F.col("texts")))).alias("t"))
    first = stored(exact.join(sized(asked), "t").select("token", "id", F.lit(1).alias("tier")).distinct(), "exact")

    without = lambda left, found: left.join(sized(stored(found.select("token").distinct(), "met")), "token", "left_anti")
    rest = stored(without(asked, first), "rest")
    by_text = known.select("id", F.explode(starts(F.concat(F.split("name", r"\s+"), F.col("aliases")), lengths_of(rest, "t"))).alias("t"))
    by_id = known.select("id", F.explode(starts(F.concat(F.array("id"), F.split("id", "-")), lengths_of(rest, "slug"))).alias("slug"))
    second = by_text.join(sized(rest), "t").select("token", "id").union(by_id.join(sized(rest), "slug").select("token", "id")).distinct().withColumn("tier", F.lit(2))
    second = stored(second, "starts")

    rest = stored(without(rest, second), "unknown")
    held = known.select("id", F.explode(F.concat(F.transform("texts", lambda x: F.struct(x.alias("x"), F.lit(False).alias("side"))), F.array(F.struct(F.col("id").alias("x"), F.lit(True).alias("side"))))).alias("s")).select("id", "s.x", "s.side")
    wanted = rest.select("token", F.explode(F.array(F.struct(F.col("t").alias("part"), F.lit(False).alias("side")), F.struct(F.col("slug").alias("part"), F.lit(True).alias("side")))).alias("w")).select("token", "w.part", "w.side")
    wanted = stored(wanted, "wanted")
    third = holding(wanted.select("part", "side"), held).join(sized(wanted), ["part", "side"]).select("token", "id", F.lit(3).alias("tier")).distinct()
    return tokens.select("token").distinct().join(first.union(second).union(third).hint("merge"), "token", "left")


def search(rows: DataFrame, form: SearchForm, people: DataFrame | None = None, row_id: str = "asset_id", person_ids: str = "person_ids", day: str = "taken_at") -> DataFrame:
    """The rows that a form lets through.

    Each person is a condition: any of those that the name means (``resolve_people``), or, if it means nobody, the id that it spells, so an unknown name
    finds nothing rather than everything. ``persons_match`` joins these among themselves, ``match`` all conditions. The scope (spaces, kinds), the words and the trash stay outside.
    """
    out, parts, met = rows, [], []
    tokens = [p for p in form.persons if p.strip()]
    if tokens:
        spark = rows.sparkSession
        asked = spark.createDataFrame([(p,) for p in tokens], "token string")
        found = resolve_people(asked, people) if people is not None else asked.withColumn("id", F.lit(None).cast("string"))
        meant = stored(found.select("token", F.coalesce("id", F.lower(F.trim("token"))).alias("_id")).distinct(), "meant")
        on = rows.select(row_id, F.explode(F.array_distinct(person_ids)).alias("_id")).join(meant, "_id").groupBy(F.col(row_id).alias("_row")).agg(F.collect_set("token").alias("_met"))  # at most as many as the form has
        out = rows.join(on, F.col(row_id) == F.col("_row"), "left").drop("_row")
        met = [F.coalesce(F.array_contains("_met", p), F.lit(False)) for p in tokens]
        parts += [reduce(lambda a, b: a | b, met)] if form.persons_match == "any" else met
    at = []
    if form.date_from:
        at.append(F.col(day) >= F.lit(date_bound(form.date_from, end=False)).cast("timestamp"))
    if form.date_to:
        at.append(F.col(day) <= F.lit(date_bound(form.date_to, end=True)).cast("timestamp"))
    if at:
        parts.append(reduce(lambda a, b: a & b, at))
    if form.location.strip():
        parts.append(F.col("location_key") == form.location.lower().strip())
    parts += [F.array_contains("tags", t.lower()) for t in form.tags] + [F.array_contains("annotations", t.strip()) for t in form.annotations]
    if form.folder:
        parts.append(F.col("folder") == form.folder)
    condition = reduce((lambda a, b: a | b) if form.match == "any" else (lambda a, b: a & b), [F.coalesce(p, F.lit(False)) for p in parts]) if parts else None
    kept = out.where(visible(condition))
    if form.spaces:
        kept = kept.where(F.col("space").isin(*form.spaces))
    if form.kinds:
        kept = kept.where(media_scope(list(form.kinds)))
    if form.words.strip():
        kept = kept.where(holds_words(haystack(rows), terms_of(form.words)))
    return kept.select(*rows.columns)


def people_table(spark: SparkSession, rows: list[tuple[str, str, list[str]]]) -> DataFrame:
    return spark.createDataFrame(rows, "id string, name string, aliases array<string>")
