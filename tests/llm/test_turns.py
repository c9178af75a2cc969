"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from medialake.llm import queries, turns

SF = "/root/testdata/sf0.01"
ROWS = "conv_id long, turn long, role string, text string, n int, block string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) by trying every edit at every place, in the order of cost and audit."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    n = len(rows)

    @lru_cache(None)
    def best(i, last, inserts):
        found = []
        if i == n and last in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            for x in after[last].replace("s", ""):
                cost, audit, lines = best(i, x, inserts + 1)
                found.append((cost + 5, "I" + audit, (({"u": "user", "a": "assistant"}[x], ""), *lines)))
        if i < n:
            role, text, fault = rows[i]
            cost, audit, lines = best(i + 1, last, 0)
            found.append((cost + 2, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] and role[0] in after[last]:
                    cost, audit, lines = best(i + 1, role[0], 0)
                    found.append((cost + more, "K" + audit, ((role, text), *lines)))
                for x in after[last].replace("s", ""):
                    cost, audit, lines = best(i + 1, x, 0)
                    found.append((cost + more + 1, "R" + audit, (({"u": "user", "a": "assistant"}[x], text), *lines)))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    return best(0, "", 0)


def plain(original):
    by = defaultdict(list)
    for row in plain_damage(original):
        by[row[0]].append(row[1:])
    out = {}
    for conv in {r[0] for r in original}:
        rows = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked, counts = set(), [], defaultdict(int)
        for _, role, text in rows:
            last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        numbers = [r[0] for r in rows if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit, lines = cheapest(tuple(marked))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in lines))
        repaired = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, repaired)
    return out


def made(seed, conversations, most):
    rnd = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rnd.randint(0, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "superuser"])
            text = rnd.choice(["Hello.", "What? ", "Cut of", "", None, " \t", "Yes!\n", f"number {t}.", "a.b", "é."])
            rows.append((c if c else None, rnd.choice([t, t, t, t + 3, None, t - 1]), role, text))
    return rows + rows[:9]


@pytest.mark.parametrize(("seed", "size"), [(1, 1024), (2, 3), (3, 1)])
def test_repair_equals_plain_search(spark, seed, size):
    original = made(seed, 60, 9)
    df = spark.createDataFrame([(*r, 1, "x") for r in original], ROWS)
    rows = turns.report(df, turns.damaged(df), size).collect()
    want = plain(original)
    assert len(rows) == len(want)
    for r in rows:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_repair_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    rows = queries.QUERIES["op12_conversation_repair"](spark, SF).collect()
    assert {r.conv_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)


def test_long_conversation_and_repaired_rows(spark):
    rnd = random.Random(9)
    original = [(1, t, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"t{t}.", f"t{t}", "again.", ""])) for t in range(700)] + [(2, 0, "user", "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in original], ROWS)
    rows = {r.conv_id: tuple(r)[1:] for r in turns.report(df, df, 64).collect()}
    want = cheapest_of(original, 1)
    assert rows[1][5:7] == want[:2]
    lines = [(r.role, r.text) for r in sorted(turns.repaired(df, turns.repair(df, 64)).where("conv_id = 1").collect(), key=lambda r: r.place)]
    assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest() == rows[1][7] and lines == list(want[2])


def cheapest_of(original, conv):
    import sys

    sys.setrecursionlimit(20_000)
    seen, marked = set(), []
    for _, _, role, text in sorted(r for r in original if r[0] == conv):
        last = text.strip()[-1:]
        marked.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None))
        seen.add((role, text))
    return cheapest(tuple(marked))


def test_empty_and_dropped(spark):
    empty = spark.createDataFrame([], ROWS)
    assert turns.report(empty, empty).collect() == []
    df = spark.createDataFrame([(5, 1, "user", "a.", 1, "x")], ROWS)
    assert [tuple(r) for r in turns.report(df, df.limit(0)).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
