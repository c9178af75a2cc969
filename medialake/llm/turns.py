"""Conversation structure repair: the cheapest edits that give alternating turns, by a checkpointed dynamic programme.

A conversation may begin with a system turn; then user and assistant turns alternate, and the assistant has the last word. A cost vector
holds, for each state (start, after system, after user, after assistant), the least cost of repairing the rows from a place
on. Vectors are computed backward and kept at checkpoints only; walking forward, the vectors of one block are computed again from
the checkpoint behind it, and the ASCII-least edit that is tight, that is, that keeps to the least cost, is taken.

Conversations of any length are dealt in segments of bounded size by ranges of (conversation, turn). A segment acts on cost vectors as a
4 x 4 matrix of (min, +), so the vectors at the ends of segments follow from matrices alone; each segment is then walked from
each state in which it can be entered, and what its predecessors leave decides which walk holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.storage import stored

ROWS = 1024  # of a segment
NONE = 1 << 50  # the cost of what can't be
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # by state: a kept turn's initial, the state behind it
ADD = (2, 2, 3, 2)  # by state: the state behind an inserted or reroled turn
ROLE = {2: "user", 3: "assistant"}
SPACE = r"\x20\x09-\x0D"


def _with_inserts(v: tuple[int, ...]) -> tuple[int, ...]:
    s, t, u, a = v
    u, a = min(u, 5 + a), min(a, 5 + u)
    return min(s, 5 + u), min(t, 5 + u), u, a


END = _with_inserts((0, NONE, NONE, 0))


def _before(code: str, n: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a row and its ``n - 1`` copies. code: D (must be deleted), or a role's initial, in capitals if truncated."""
    if code == "D":
        return tuple(x + 2 * n for x in v)
    rest, role, out = 2 * (n - 1), code.lower(), []
    more = 5 if code != role else 0
    for state in range(4):
        keep = NEXT[state].get(role)
        out.append(rest + min(2 + v[state], more + v[keep] if keep else NONE, 1 + more + v[ADD[state]]))
    return _with_inserts(tuple(out))


def matrix(codes: str, counts: tuple[int, ...]) -> list[int]:
    """What a segment makes of the vector behind it: for each state before, the least cost to each state behind."""
    columns = [_with_inserts(tuple(0 if x == y else NONE for x in range(4))) for y in range(4)]
    for code, n in zip(reversed(codes), reversed(counts), strict=True):
        columns = [_before(code, n, v) for v in columns]
    return [min(columns[y][x], NONE) for x in range(4) for y in range(4)]


@lru_cache(1024)
def walks(codes: str, counts: tuple[int, ...], end: tuple[int, ...], entries: tuple[int, ...], last: bool) -> list[tuple[list[str], list[int], int, int] | None]:
    """By state of entry: the edits of each row, the states before the rows, the state behind all and the cost."""
    size = isqrt(len(codes)) + 1
    checks, v = {}, end
    for i in range(len(codes), 0, -1):
        if i == len(codes) or i % size == 0:
            checks[min(i, len(codes))] = v
        v = _before(codes[i - 1], counts[i - 1], v)
    walked = {x: ([], [], x, 0) for x in entries}
    for start in range(0, len(codes), size):
        stop = min(start + size, len(codes))
        vectors = [checks[stop]]
        for i in range(stop - 1, start - 1, -1):
            vectors.append(_before(codes[i], counts[i], vectors[-1]))
        vectors.reverse()
        for entry, (edits, states, state, cost) in walked.items():
            for i in range(start, stop):
                states.append(state)
                done, state, spent = _row(codes[i], counts[i], state, vectors[i - start], vectors[i - start + 1])
                edits.append(done)
                cost += spent
            walked[entry] = edits, states, state, cost
    if last:
        for entry, (edits, states, state, cost) in walked.items():
            while state not in (0, 3):
                edits[-1] += "I"
                state, cost = ADD[state], cost + 5
            walked[entry] = edits, states, state, cost
    return [walked.get(x) for x in range(4)]


def _row(code: str, n: int, state: int, here: tuple[int, ...], behind: tuple[int, ...]) -> tuple[str, int, int]:
    """The ASCII-least tight edits of a row and its copies, the state behind them and their cost."""
    done, spent = "", 0
    role, copies = code.lower(), 2 * (n - 1)
    more = 5 if code != role and code != "D" else 0
    while True:
        if here[state] == 2 + copies + behind[state]:
            return done + "D" * n, state, spent + 2 + copies
        if here[state] == 5 + here[ADD[state]]:
            done, spent, state = done + "I", spent + 5, ADD[state]
            continue
        keep = NEXT[state].get(role)
        if keep and here[state] == copies + more + behind[keep]:
            return done + "K" + "D" * (n - 1), keep, spent + more + copies
        return done + "R" + "D" * (n - 1), ADD[state], spent + 1 + more + copies


def _parts(rows) -> tuple[str, tuple[int, ...]]:
    return "".join(r["code"] for r in rows), tuple(int(r["n"]) for r in rows)


def _matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        yield pd.DataFrame({"_c": df["_c"], "block": df["block"], "part": df["part"], "m": [matrix(*_parts(rows)) for rows in df["rows"]]})


def _checkpoints(df: pd.DataFrame) -> pd.DataFrame:
    """The vector behind each segment of a conversation, from the last one on."""
    df = df.sort_values(["block", "part"], ascending=False)
    v, out = list(END), []
    for m in df["m"]:
        out.append(v)
        v = [min(min(m[4 * x + y] + v[y] for y in range(4)), NONE) for x in range(4)]
    return df[["_c", "block", "part"]].assign(end=out, last=[True] + [False] * (len(df) - 1))


def _walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        out = {"edits": [], "states": [], "exits": [], "costs": []}
        for rows, end, first, last in zip(df["rows"], df["end"], df["first"], df["last"], strict=True):
            found = walks(*_parts(rows), tuple(map(int, end)), (0,) if first else (0, 1, 2, 3), bool(last))
            for at, name in enumerate(out):
                out[name].append([x[at] if x else None for x in found])
        yield df[["_c", "block", "part"]].assign(**out)


def _entries(df: pd.DataFrame) -> pd.DataFrame:
    """The state in which each segment of a conversation is entered."""
    df = df.sort_values(["block", "part"])
    state, out = 0, []
    for exits in df["exits"]:
        out.append(state)
        state = int(exits[state])
    return df[["_c", "block", "part"]].assign(entry=out)


def key_of(conv: Column) -> Column:
    """A key that parts null from all else."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; null roles and texts become one space) with faults put in.

    crc32 of ``conv_id:turn`` (nulls: one space) modulo 20 decides: 0 drops the row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it
    the user's.
    """
    blank = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    text = F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(fate == 3, 2).otherwise(1).alias("_n"), fate.alias("_fate"))
    return out.where("_fate <> 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_fate")


def _keyed(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(key_of(F.col("conv_id")).alias("_c"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("hash"))


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows (_c, turn, role, hash, n copies) with ``fault``: blank, duplicate, truncated or null, that of the first copy.

    A row is a duplicate if its role and text stand at an earlier turn; nulls come first. Copies are counted before anything moves.
    """
    empty, open_ = ~F.col("text").rlike(f"[^{SPACE}]"), ~F.col("text").rlike(f"[.!?][{SPACE}]*+\\z")
    slim = _keyed(rows).select("_c", "turn", "role", "hash", F.when(empty, "blank").when(open_, "truncated").alias("own")).groupBy("_c", "turn", "role", "hash", "own").agg(F.count("*").alias("n"))
    slim = stored(slim, "turns")
    first = slim.groupBy("_c", "role", "hash").agg(F.min("turn").alias("_first"), F.max(F.col("turn").isNull()).alias("_none"))
    later = F.col("turn").isNotNull() & (F.col("_none") | (F.col("turn") > F.col("_first")))
    fault = F.when(F.col("own") == "blank", "blank").when(later, "duplicate").otherwise(F.col("own"))
    return slim.join(first, ["_c", "role", "hash"]).select("_c", "turn", "role", "hash", "n", fault.alias("fault"))


def segments(marked: DataFrame, size: int = ROWS) -> DataFrame:
    """Rows of conversations in order, in arrays of at most ``size``: _c, block, part, rows.

    Rows are dealt by ranges of (conversation, turn, role, hash), so a long conversation lies in several blocks; blocks and parts count in order.
    """
    order = ["_c", "turn", "role", "hash"]
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    dealt = marked.repartitionByRange(*order).withColumn("block", F.spark_partition_id()).withColumn("initial", initial).withColumn("code", code)
    place = F.row_number().over(Window.partitionBy("_c", "block").orderBy(*order[1:]))
    placed = dealt.withColumn("place", place).withColumn("part", F.floor((F.col("place") - 1) / size).cast("int"))
    return placed.groupBy("_c", "block", "part").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "role", "hash", "initial", "code", "n", "fault"))).alias("rows"))


def repair(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """The cheapest edits of each segment of each conversation: _c, block, part, rows, edits, states, cost; conversations in order of block and part.

    rows: conv_id, turn, role, text; other columns are not read. ``edits`` has for each distinct row (its ``n`` copies together) the initials of: Insert
    an empty user or assistant turn (5), Keep (0), Rerole to user or assistant (1), Delete (2; blank and duplicate rows must go); a truncated row
    that stays costs 5 more. Of the cheapest edits the ASCII-least hold. Rows are taken by turn, nulls first, ties by role and SHA-256 of the text, so copies
    lie together; null ids are one conversation; null roles and texts are one space. Texts don't move here. An empty table gives an empty result.
    """
    cut = stored(segments(faults(rows), size), "segments")
    several = cut.groupBy("_c").count().where("count > 1").select("_c")
    many = cut.join(several, "_c", "left_semi")
    ends = stored(many.mapInPandas(_matrices, "_c string, block int, part int, m array<long>").groupBy("_c").applyInPandas(_checkpoints, "_c string, block int, part int, end array<long>, last boolean"), "ends")
    asked = cut.join(ends, ["_c", "block", "part"], "left")
    asked = asked.select("_c", "block", "part", "rows", F.coalesce("end", F.array(*map(F.lit, END)).cast("array<long>")).alias("end"), F.col("last").isNull().alias("first"), F.coalesce("last", F.lit(True)).alias("last"))
    walked = stored(asked.mapInPandas(_walked, "_c string, block int, part int, edits array<array<string>>, states array<array<int>>, exits array<int>, costs array<long>"), "walked")
    entries = walked.join(ends.select("_c").distinct(), "_c", "left_semi").select("_c", "block", "part", "exits").groupBy("_c").applyInPandas(_entries, "_c string, block int, part int, entry int")
    entry = F.coalesce("entry", F.lit(0)) + 1
    held = walked.join(stored(entries, "entries"), ["_c", "block", "part"], "left")
    held = held.select("_c", "block", "part", F.element_at("edits", entry).alias("edits"), F.element_at("states", entry).alias("states"), F.element_at("costs", entry).alias("cost"))
    return stored(cut.join(held, ["_c", "block", "part"]), "repair")


def _lines(batches) -> Iterator[tuple[str, str | None, str | None]]:
    """(conversation, role, text) of repaired rows, in order; (conversation, None, None) where one begins.

    Batches are sorted by conversation and order of rows; each row's edits come before its text and the text's copies.
    """
    current, asked = None, None
    for batch in batches:
        for c, edits, state, role, text in zip(*(batch.column(x).to_pylist() for x in ("_c", "edits", "state", "role", "text")), strict=True):
            if c != current:
                current = c
                yield c, None, None
            if edits is not None:
                asked = edits, state
            elif asked:
                (edits, state), asked = asked, None
                for edit in edits:
                    if edit == "K":
                        state = NEXT[state][role[0]]
                        yield c, role, text
                    elif edit in "IR":
                        state = ADD[state]
                        yield c, ROLE[state], text if edit == "R" else ""


def _rows_out(batches):
    import pyarrow as pa

    held, size, at, current = [], 0, 0, None
    for c, role, text in _lines(batches):
        if role is None:
            current, at = c, 0
            continue
        held.append((current, at, role, text))
        at, size = at + 1, size + len(text)
        if size > 1 << 20 or len(held) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names=["_c", "place", "role", "text"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names=["_c", "place", "role", "text"])


def _digests(batches):
    import pyarrow as pa

    done, current, hashed, some = [], None, None, False
    for c, role, text in _lines(batches):
        if role is None:
            if current is not None:
                done.append((current, hashed.hexdigest()))
            current, hashed, some = c, hashlib.sha256(), False
        else:
            hashed.update((("\n" if some else "") + f"{role}:").encode())
            hashed.update(text.encode())
            some = True
    if current is not None:
        done.append((current, hashed.hexdigest()))
    for at in range(0, len(done), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done[at : at + 10_000], strict=True)], names=["_c", "sha256"])


def _laid(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Edits and texts of each conversation, sorted; a conversation streams through a task, no task holds one."""
    each = repairs.select("_c", F.explode(F.arrays_zip("rows", "edits", "states")).alias("x"))
    edits = each.select("_c", "x.rows.turn", "x.rows.role", "x.rows.hash", F.col("x.edits").alias("edits"), F.col("x.states").alias("state"), F.lit(None).cast("string").alias("text"))
    texts = _keyed(rows).select("_c", "turn", "role", "hash", F.lit(None).cast("string").alias("edits"), F.lit(None).cast("int").alias("state"), "text")
    return edits.union(texts).repartition("_c").sortWithinPartitions("_c", "turn", "role", "hash", F.col("edits").isNull()).select("_c", "edits", "state", "role", "text")


def repaired(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""
    out = _laid(rows, repairs).mapInArrow(_rows_out, "_c string, place long, role string, text string")
    names = rows.select("conv_id", key_of(F.col("conv_id")).alias("_c")).distinct()
    return out.join(names, "_c").select("conv_id", "place", "role", "text")


def report(conversations: DataFrame, rows: DataFrame, size: int = ROWS) -> DataFrame:
    """One row for each conv_id of ``conversations``, of what ``rows`` hold of it: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Without rows: zeros, an empty audit and the hash of nothing. The audit and the hash are of a whole conversation; its texts stream through one task in order.
    """
    repairs = repair(rows, size)
    flat = repairs.select("_c", F.explode("rows").alias("r")).select("_c", "r.turn", "r.n", "r.fault")
    n, kind = F.col("n"), F.coalesce("fault", F.lit(""))
    counted = {"blank": F.when(kind == "blank", n), "duplicate": F.when(kind == "duplicate", n).when(kind != "blank", n - 1), "truncated": F.when(kind == "truncated", 1)}
    turns = flat.groupBy("_c", "turn").agg(*(F.sum(x).alias(name) for name, x in counted.items()))
    counts = turns.groupBy("_c").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), *(F.sum(name).alias(name) for name in counted))
    inside = F.expr("size(filter(sequence(1, greatest(size(rows) - 1, 1)), i -> i < size(rows) and concat(rows[i - 1].initial, rows[i].initial) not in ('su', 'ua', 'au')))")
    inside = inside + F.aggregate("rows", F.lit(0).cast("long"), lambda s, r: s + r["n"] - 1)
    ends = repairs.select("_c", "block", "part", F.col("rows")[0]["initial"].alias("_head"), F.element_at("rows", -1)["initial"].alias("_tail"), inside.alias("_inside"), "cost", F.concat_ws("", "edits").alias("_audit"))
    ends = ends.withColumn("_from", F.lag("_tail").over(Window.partitionBy("_c").orderBy("block", "part")))
    met = F.when(F.concat("_from", "_head").isin("su", "ua", "au"), 0).when(F.col("_from").isNotNull(), 1).otherwise(0)
    audits = ends.groupBy("_c").agg(F.sum(F.col("_inside") + met).alias("illegal"), F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("block", "part", "_audit"))).alias("_audits"))
    audits = audits.select("_c", "illegal", "cost", F.concat_ws("", F.col("_audits._audit")).alias("audit"))
    hashes = _laid(rows, repairs).mapInArrow(_digests, "_c string, sha256 string")
    out = conversations.select("conv_id", key_of(F.col("conv_id")).alias("_c")).distinct()
    for part in (counts, audits, hashes):
        out = out.join(part, "_c", "left")
    numbers = (F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
