"""Predicates: boolean query trees, scopes, text match, visibility; all fold to one Column."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.operators.substrings import holding, lengths_of, sized, starts
from medialake.storage import stored


def leaf(field: str, value: Any, columns: dict[str, str], day: str = "taken_at") -> Column | None:
    """One condition; unknown fields and empty values say nothing. Array columns hold any of their values."""
    if value in (None, "", []):
        return None
    if field == "year":
        return F.year(day) == int(value)
    if field in ("date_from", "date_to"):
        bound = F.to_timestamp(F.lit(str(value)))
        return F.col(day) >= bound if field == "date_from" else F.col(day) < bound + F.expr("INTERVAL 1 DAY")
    if field not in columns:
        return None
    name = columns[field]
    if name.endswith("[]"):
        return F.array_contains(name[:-2], value)
    return F.col(name) == value


def tree(node: dict | None, columns: dict[str, str], day: str = "taken_at") -> Column | None:
    """A query tree as a Column: leaves ``{field, value}``, groups ``{op: and|or, children}``. Empty groups vanish, single children stand alone."""
    if not node:
        return None
    if "field" in node:
        return leaf(node["field"], node.get("value"), columns, day)
    parts = [c for c in (tree(x, columns, day) for x in node.get("children", [])) if c is not None]
    if not parts:
        return None
    return reduce((lambda a, b: a | b) if node.get("op") == "or" else (lambda a, b: a & b), parts)


def visible(condition: Column | None = None, trashed: str = "trashed_at") -> Column:
    """``condition`` on rows that aren't in the trash; the trash stays outside of any OR."""
    shown = F.col(trashed).isNull()
    return shown if condition is None else shown & condition


def media_scope(kinds: list[str], kind: str = "kind") -> Column:
    """Rows of these kinds; no kind means photo."""
    return F.coalesce(kind, F.lit("photo")).isin(*kinds)


def resolved(tokens: DataFrame, people: DataFrame) -> DataFrame:
    """Which people a token names: an exact id or name, else a word's start, else any part; only the best tier counts.

    tokens: token; people: id, name. Unknown and empty tokens come back with a null id. Tokens meet the starts of words, of
    those lengths that some token has; those still unknown meet names by ``holding``.
    """
    named = stored(people.select("id", F.coalesce(F.lower("name"), F.lit("")).alias("name")).repartition("id", "name"), "named")  # a small file is one task, however much its rows unfold
    t = stored(tokens.select("token", F.lower("token").alias("folded")).where("folded <> ''").distinct(), "asked")
    words = F.concat(F.array("name", F.lower("id")), F.split("name", r"[\s#-]+"))
    begun = named.select("id", "name", F.explode(starts(words, lengths_of(t, "folded"))).alias("folded"))
    tier = F.when((F.col("folded") == F.col("name")) | (F.col("folded") == F.lower("id")), 1).otherwise(2)
    tiers = stored(begun.join(sized(t), "folded").groupBy("token", "id").agg(F.min(tier).alias("tier")), "tiers")
    least = stored(tiers.groupBy("token").agg(F.min("tier").alias("tier")), "least")
    best = tiers.join(sized(least), ["token", "tier"])
    unknown = stored(t.join(sized(least.select("token")), "token", "left_anti"), "unknown")
    side = F.lit(False).alias("side")
    inside = holding(unknown.select(F.col("folded").alias("part"), side), named.select("id", F.col("name").alias("x"), side))
    inside = inside.withColumnRenamed("part", "folded").join(sized(unknown), "folded").select("token", "id", F.lit(3).alias("tier")).distinct()
    return tokens.join(best.select("token", "id", "tier").union(inside).hint("merge"), "token", "left").select("token", "id", "tier")


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies inside a polygon: the bounding box as a conjunct of its own, then the parity of crossings."""
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 == y2:
            continue
        crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit((x2 - x1) / (y2 - y1)) * (y - y1) + x1)
        crossings = crossings + crosses.cast("int")
    return box & (crossings % 2 == 1)


def resolved_tree(rows: DataFrame, node: dict | None, resolver: DataFrame, field: str, row_value: str, columns: dict[str, str], day: str = "taken_at") -> DataFrame:
    """The rows that a query tree lets through, where leaves of ``field`` hold tokens and ``resolver`` (token, id) says which values they mean.

    Each token is one join with its distinct ids, in the way that Spark picks by their size; a token without ids lets nothing through.
    """
    tokens: list = []

    def named(n: dict) -> dict:
        if "children" in n:
            return {**n, "children": [named(x) for x in n["children"]]}
        if n.get("field") != field or n.get("value") in (None, "", []):
            return n
        tokens.append(n["value"])
        return {"field": f"_token{len(tokens)}", "value": True}

    asked = named(node) if node else None
    known = dict(columns)
    out = rows
    for n, token in enumerate(tokens, 1):
        flag = f"_token{n}"
        ids = resolver.where(F.col("token") == token).select(F.col("id").alias(f"{flag}_id")).distinct().withColumn(f"{flag}_met", F.lit(True))
        out = out.join(ids, F.col(row_value) == F.col(f"{flag}_id"), "left").withColumn(flag, F.coalesce(f"{flag}_met", F.lit(False)))
        known[flag] = flag
    condition = tree(asked, known, day)
    return (out if condition is None else out.where(condition)).select(*rows.columns)
