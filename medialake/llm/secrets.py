"""Secret scans over an incremental blob ledger, in SQL expressions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds the findings of each
(blob, rule version) pair that has been scanned; a run scans only pairs the ledger lacks, each blob once however
many paths or versions carry it, and joins the findings back to all paths.

A match's place comes from splitting the text at the rule's pattern: pieces and matches alternate, so their
lengths add up to the places (code points, end exclusive).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.storage import stored


class Rule(NamedTuple):
    """A pattern whose leftmost, non-overlapping matches are findings if the group has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    base: bool = True


# Kinds in the order in which they break ties, patterns and least lengths.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 40, False),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 30, False),
)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's findings in ``text`` as structs (begin, rank, finish, kind); none costs one pass only."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    steps = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("long"), F.transform(group, lambda x: F.length(x)).alias("value")
    )
    none = F.array().cast("array<struct<begin:int,rank:int,finish:int,kind:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        finish = begin + F.coalesce(x["long"], F.lit(0))
        hit = F.array(F.struct(begin.alias("begin"), F.lit(order).alias("rank"), finish.alias("finish"), F.lit(rule.kind).alias("kind")))
        return F.struct(finish.alias("at"), F.when(x["value"] >= rule.least, F.concat(state["found"], hit)).otherwise(state["found"]).alias("found"))

    return F.when(text.rlike(rule.pattern), F.aggregate(steps, start, step, lambda s: s["found"])).otherwise(none)


def rules_table(spark, rules=RULES) -> DataFrame:
    """The rules' kinds and versions, as the ledger names them."""
    return spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], "blob binary, kind string, version int, found array<struct<begin:int,rank:int,finish:int,kind:string>>")


def address(text: Column) -> Column:
    """The SHA-256 of a text (null: of the empty text)."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, path: str = "doc_id", text: str = "text", version: str | None = None, hint: str | None = "merge") -> tuple[DataFrame, DataFrame]:
    """Scans what the ledger lacks; returns the findings of all paths and the grown ledger.

    ``versions`` has a row for each version of each path; ``version`` names a column that tells them apart, if there is
    one. Findings: one row for each row of ``versions``, with ``path``, ``version`` (if named), ``blob`` and ``found``
    (spans by begin, then by the rules' order; empty if none). The ledger has a row for each (blob, rule kind, rule
    version), and is a stored table that a later run takes. A rule with a new version is scanned again in all blobs;
    rows of old versions stay and are not reported.

    Places and addresses decide what is scanned. ``hint`` says how texts meet what is not to be scanned: a merge moves
    each text once at any size; with None Spark may broadcast, and moves no text where little is left out. Null or empty text is the empty blob, without findings. Null paths and repeated rows come back as they
    are. An empty table gives no findings and leaves the ledger as it is. Other columns are ignored.
    """
    spark = versions.sparkSession
    key = [F.col(path).alias("path")] + ([F.col(version).alias("version_")] if version else [])
    names = ["path"] + (["version_"] if version else [])
    places = stored(versions.select(*key, address(F.col(text)).alias("blob")), "places")
    # A blob is scanned where it stands first.
    first = places.groupBy("blob").agg(F.min(F.struct(*names)).alias("first"))
    others = places.join(first, "blob").where(~F.struct(*names).eqNullSafe(F.col("first"))).select("blob", *names)
    known = None
    if ledger is not None:
        current = ledger.join(F.broadcast(rules_table(spark, rules)), ["kind", "version"], "left_semi")  # as many rows as rules
        known = current.groupBy("blob").agg(F.collect_set("kind").alias("known"))  # at most one entry for each rule
        over = known.where(F.size("known") == len(rules)).select("blob")
        others = others.union(places.join(over, "blob", "left_semi").select("blob", *names))
    others = stored(others.distinct().select(F.col("blob").alias("blob_"), *(F.col(x).alias(f"{x}_") for x in names)), "elsewhere")
    bodies = versions.select(*key, address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    same = F.col("blob") == F.col("blob_")
    for x in names:
        same = same & F.col(x).eqNullSafe(F.col(f"{x}_"))
    todo = bodies.join(others.hint(hint) if hint else others, same, "left_anti")
    none = F.array().cast("array<string>")
    if known is not None:
        todo = todo.join(known.where(F.size("known") < len(rules)), "blob", "left").withColumn("known", F.coalesce("known", none))
    else:
        todo = todo.withColumn("known", none)
    unseen = [
        F.when(~F.array_contains("known", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(F.col("body"), r, k).alias("found"))) for k, r in enumerate(rules)
    ]
    fresh = todo.select("blob", F.explode(F.filter(F.array(*unseen), lambda x: x.isNotNull())).alias("x")).select("blob", "x.*")
    fresh = stored(fresh.dropDuplicates(["blob", "kind"]), "ledger")  # a row that is repeated as it is
    grown = fresh if ledger is None else ledger.select("blob", "kind", "version", "found").union(fresh)
    current = fresh if ledger is None else grown.join(F.broadcast(rules_table(spark, rules)), ["kind", "version"], "left_semi")
    by_blob = current.where(F.size("found") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    found = places.join(by_blob, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<begin:int,rank:int,finish:int,kind:string>>")))
    return found.select("path", *([F.col("version_").alias("version")] if version else []), "blob", "found"), grown


def spelled(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["begin"], x["finish"])), ",")


def digest(findings: DataFrame, rules=RULES) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans, for each path."""
    base = [r.kind for r in rules if r.base]
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return findings.select(
        F.col("path").alias("doc_id"), *(n(k).alias(f"n_{k}") for k in base), F.sha2(spelled(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans")
    )


def redacted(text: Column, found: Column) -> Column:
    """``text`` with every span of ``found`` (sorted; overlaps are merged) replaced by ``[kind]``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, x["begin"] - state["at"])
        out = F.when(x["begin"] >= state["at"], F.concat(state["out"], gap, F.lit("["), x["kind"], F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["finish"]).alias("at"), out.alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))).otherwise(text)
