"""Dictionaries of phrases met with texts: by the grams of their words, or by the rarest word of each phrase. Nothing is collected or crossed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.functions.places import PLACES, place_words
from medialake.storage import stored

WORD = r"[\p{L}\p{M}\p{N}_]+"


def place_dictionary(spark: SparkSession, overrides: DataFrame | None = None, fixed: dict[str, str | None] = PLACES) -> DataFrame:
    """(gram, n, key, label, place): what to look for, of how many words, and the order in which one wins over another.

    ``overrides`` (term, label): another label for a fixed term, which keeps its place, or a further term behind the fixed ones, by term. Terms are
    folded; null and empty terms and labels say nothing. A fixed term without a label is looked for only if it is overridden.
    """
    own = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(fixed.items())], "key string, label string, place long")
    if overrides is not None:
        said = overrides.where("label is not null and label <> ''").select(F.array_join(place_words(F.col("term")), " ").alias("key"), F.col("label").alias("_said")).where("key <> ''").groupBy("key").agg(F.min("_said").alias("_said"))
        at = F.coalesce("place", F.lit(len(fixed)).cast("long"))
        own = own.join(said, "key", "full").select("key", F.coalesce("_said", "label").alias("label"), at.alias("place"))
    return own.where("label is not null").select(F.col("key").alias("gram"), F.size(F.split("key", " ")).alias("n"), "key", "label", "place")


def detected(texts: DataFrame, dictionary: DataFrame, row_id: str, most_words: int = 4) -> DataFrame:
    """(``row_id``, label, key) of rows in whose ``texts`` (an array, null ones are skipped) a phrase of the dictionary stands in whole words.

    The first text with a phrase decides, and of its phrases the one that comes first in the dictionary, ties by key. Each distinct gram of
    a text is met with the dictionary once; rows without a phrase are left out. Phrases of more than ``most_words`` words aren't found.
    """
    each = texts.select(row_id, F.posexplode("texts").alias("_text", "_t")).where("_t is not null").withColumn("_w", place_words(F.col("_t")))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice("_w", i, n), " "))
    some = [F.when(F.size("_w") >= n, grams(n)).otherwise(F.array().cast("array<string>")) for n in range(1, most_words + 1)]
    met = each.select(row_id, "_text", F.explode(F.array_distinct(F.concat(*some))).alias("gram")).join(dictionary, "gram")
    return met.groupBy(row_id).agg(F.min(F.struct("_text", "place", "key", "label")).alias("_b")).select(row_id, "_b.label", "_b.key")


# What never belongs in a published text, and what it is called.
SENSITIVE = (
    (r"sk-[A-Za-z0-9_\-]{16,}", "api key"),
    (r"(?i)\b(password|passwd|passwort)\s*[:=]\s*['\"][^'\"]{3,}", "password"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "private key"),
    (r"\b192\.168\.\d{1,3}\.\d{1,3}\b", "private address"),
    (r"\b10\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "private address"),
    (r"\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b", "mail address"),
    (r"\bfritz\.box\b", "router"),
)
# Addresses set aside for documentation.
DOCUMENTATION = r"192\.0\.2\.\d+|198\.51\.100\.\d+|203\.0\.113\.\d+"


def name_terms(names: DataFrame, allowed: DataFrame, extra: DataFrame | None = None, longer_than: int = 3) -> DataFrame:
    """(term) to look for: whole names, their parts of more than ``longer_than`` characters unless ``allowed`` (word, in any case) has them, and ``extra`` terms as they are.

    names: name. Names that start with ``_`` are none; null and empty ones are skipped.
    """
    given = names.where("name is not null and trim(name) <> '' and not startswith(name, '_')").select(F.trim("name").alias("name"))
    parts = given.select(F.explode(F.split("name", r"\s+")).alias("term")).where(F.length("term") > longer_than)
    parts = parts.join(allowed.select(F.lower("word").alias("_word")).distinct(), F.lower("term") == F.col("_word"), "left_anti")
    terms = given.select(F.col("name").alias("term")).union(parts)
    if extra is not None:
        terms = terms.union(extra.where("term is not null and trim(term) <> ''").select(F.trim("term")))
    return terms.distinct()


def named_lines(lines: DataFrame, terms: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """(keys, term): for each line the longest term that stands in it between word boundaries, ties by code points.

    Terms and lines meet on the term's rarest word, by the number of lines that hold it, so a term of common words costs no more than its rarest one; what meets is then
    verified. Only words that a term holds are counted and sent. A term without a word is never found.
    """
    words = terms.select("term", F.explode(F.array_distinct(F.regexp_extract_all("term", F.lit(WORD), F.lit(0)))).alias("word"))
    asked = words.select("word").distinct()
    held = lines.select(*keys, F.col(line).alias("_line"), F.explode(F.array_distinct(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))).alias("word"))
    often = stored(held.select("word").join(asked, "word").groupBy("word").agg(F.count("*").alias("often")), "often")
    # A term with a word that no line holds is in no line.
    rare = words.join(often, "word", "left").groupBy("term").agg(F.min(F.struct("often", "word")).alias("r"), F.max(F.col("often").isNull()).alias("never")).where("not never").select("term", F.col("r.word").alias("word"))
    exact = F.concat(F.lit(r"(?U)\b\Q"), F.replace("term", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b"))
    met = held.join(stored(rare, "rare"), "word").where(F.col("_line").contains(F.col("term")) & F.rlike("_line", exact))
    return met.groupBy(*keys).agg(F.min(F.struct((-F.length("term")).alias("size"), "term")).alias("t")).select(*keys, "t.term")


def _first_matches(line: Column, patterns, allowed: str) -> Column:
    """An array of (why, found): each pattern's first match, unless what it found is allowed."""
    found = [F.struct(F.lit(why).alias("why"), F.lit(i).alias("pattern"), F.nullif(F.regexp_extract(line, p, 0), F.lit("")).alias("found")) for i, (p, why) in enumerate(patterns)]
    return F.filter(F.array(*found), lambda x: x["found"].isNotNull() & ~x["found"].rlike(allowed))


def sensitive(lines: DataFrame, terms: DataFrame, keys: list[str], line: str = "line", patterns=SENSITIVE, allowed: str = DOCUMENTATION) -> DataFrame:
    """(keys, why, found): hits of ``named_lines`` (why: name) and the first match of each pattern in a line, unless ``allowed`` is in it."""
    named = named_lines(lines, terms, keys, line).select(*keys, F.lit("name").alias("why"), F.col("term").alias("found"))
    by_pattern = lines.select(*keys, F.explode(_first_matches(F.col(line), patterns, allowed)).alias("x")).select(*keys, "x.why", "x.found")
    return named.union(by_pattern)
