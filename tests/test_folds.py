"""Folds and the coalescing of event cards against plain Python."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from medialake.operators import cards as C
from medialake.operators import folds as D

CARDS = "event_key string, key string, start_at timestamp, end_at timestamp, folder array<string>, path array<string>, name string, day_level boolean, size long, cover array<long>"
BASE = datetime(2024, 3, 1)
GENERIC = ("camera",)


def plain(cards):
    out, last = {}, {}
    for c in sorted(cards, key=lambda c: (c["key"] or "", c["start_at"] or datetime.min, c["event_key"])):
        a = last.get(c["key"])
        if a and not a["day_level"] and not c["day_level"] and a["end_at"] and c["start_at"]:
            folders, paths = (list(dict.fromkeys([x for x in (a[n] or []) + (c[n] or []) if x])) for n in ("folder", "path"))
            if not (a["name"] and c["name"] and a["name"] != c["name"]) and len(folders) == 1 and folders[0] not in GENERIC and len(paths) <= 1 and c["start_at"] - a["end_at"] <= timedelta(hours=12):
                a |= {"folder": folders, "path": paths, "end_at": max(filter(None, (a["end_at"], c["end_at"])))}
                out[c["event_key"]] = a["event_key"]
                continue
        last[c["key"]] = dict(c)
        out[c["event_key"]] = c["event_key"]
    return out


def made(seed, n):
    rnd, cards = random.Random(seed), []
    for i in range(n):
        start = BASE + timedelta(hours=rnd.uniform(0, 400)) if rnd.random() > 0.03 else None
        end = start + timedelta(hours=rnd.choice([0, 1, 1, 2, 40])) if start and rnd.random() > 0.03 else None
        folder = rnd.choice([["a"], ["a"], ["a"], ["a"], ["camera"], ["a", "b"], [], ["b"]])
        path = rnd.choice([[], ["/x/a"], ["/x/a"], ["/y/a"], ["/x/a", "/y/a"]]) if rnd.random() < 0.3 else ["/x/a"]
        cards.append({"event_key": f"e{i:04d}", "key": rnd.choice(["k", "l", None]), "start_at": start, "end_at": end, "folder": folder, "path": path, "name": rnd.choice([None, None, "", "N", "M"]), "day_level": rnd.random() < 0.05, "size": i, "cover": [i, i + 1]})
    return cards


def test_coalesce_equals_plain(spark):
    for seed in (1, 2):
        cards = made(seed, 250)
        got = {r.event_key: r.series for r in D.coalesce(spark.createDataFrame(cards, CARDS), "key", lambda f: f in GENERIC).collect()}
        want = plain(cards)
        alone = {c["event_key"] for c in cards if c["start_at"] is None}
        assert {k: v for k, v in got.items() if k not in alone} == {k: v for k, v in plain([c for c in cards if c["event_key"] not in alone]).items()}
        assert all(got[k] == k for k in alone) and len(set(want.values())) < 250


def test_a_long_ended_series_is_not_revived(spark):
    """The end that counts is that of the series, not the latest of all before."""
    h = lambda n: BASE + timedelta(hours=n)
    row = lambda k, a, b, name: {"event_key": k, "key": "k", "start_at": h(a), "end_at": h(b), "folder": ["a"], "path": [], "name": name, "day_level": False, "size": 1, "cover": [1]}
    cards = spark.createDataFrame([row("x", 0, 100, "X"), row("y", 1, 2, "Y"), row("z", 50, 51, None)], CARDS)
    assert {r.event_key: r.series for r in D.coalesce(cards, "key", lambda f: False).collect()} == {"x": "x", "y": "y", "z": "z"}


def test_fold_streams_in_order(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).repartition(5)

    def step(state, row):
        state = (state or 0) + row.v
        return state, state

    got = D.fold(rows, ["k"], ["v"], step, "total", "long").collect()
    sums = {}
    for r in sorted(got, key=lambda r: r.v):
        sums[r.k] = sums.get(r.k, 0) + r.v
        assert r.total == sums[r.k]


def test_merged_lists(spark):
    cards = [c for c in made(3, 60) if c["start_at"]]
    joined = D.coalesce(spark.createDataFrame(cards, CARDS), "key", lambda f: f in GENERIC)
    series = plain(cards)
    for r in D.merged(joined, "key", ["folder", "path"]).collect():
        parts = sorted((c for c in cards if series[c["event_key"]] == r.series), key=lambda c: (c["start_at"], c["event_key"]))
        assert r.parts == len(parts) and r["size"] == sum(c["size"] for c in parts) and r.start_at == parts[0]["start_at"]
        assert r.folder == list(dict.fromkeys(x for c in parts for x in c["folder"])) and r.cover == list(dict.fromkeys(x for c in parts for x in c["cover"]))[:8]


def test_empty(spark):
    empty = spark.createDataFrame([], CARDS)
    joined = D.coalesce(empty, "key", lambda f: False)
    assert joined.collect() == [] and D.merged(joined, "key", ["folder"]).collect() == []


ROWS = "id long, at timestamp, key string, folder string, person string"


def test_cards_equal_plainly_and_deal_rows_once(spark):
    """Sessions over midnight and over days, rows without key or time; the rows are shuffled once, then only days and pieces of sessions."""
    rnd, rows, at = random.Random(5), [], dict.fromkeys(("k", "l", None), BASE)
    for i in range(600):
        key = rnd.choice(list(at))
        at[key] += timedelta(minutes=rnd.choice([0, 1, 100, 179, 180, 181, 2000]))
        rows.append((i, at[key] if rnd.random() > 0.03 else None, key, rnd.choice(["a", "b", None]), rnd.choice(["p", "q", "r", None])))
    made = C.cards(spark.createDataFrame(rows, ROWS).repartition(3), "key", "at", "id", ["folder", "person"])
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 6
    want = []
    for key in at:
        last = None
        for r in sorted((r for r in rows if r[2] == key and r[1]), key=lambda r: (r[1], r[0])):
            if last is None or r[1] - last > timedelta(hours=3):
                want.append([])
            want[-1].append(r)
            last = r[1]
    seen = lambda session, n: list(dict.fromkeys(r[n] for r in session if r[n]))
    want = sorted(((s[0][2] or "", s[0][1], s[-1][1], len(s), [r[0] for r in s[:8]], seen(s, 3), seen(s, 4)) for s in want), key=repr)
    assert any(s[2].date() > s[1].date() for s in want) and max(s[3] for s in want) > 8
    assert sorted(((r.key or "", r.start_at, r.end_at, r["size"], r.cover, r.folder, r.person) for r in made.collect()), key=repr) == want


def test_the_fold_gets_no_lists(spark, monkeypatch):
    given, fold = {}, D.fold
    monkeypatch.setattr(D, "fold", lambda rows, *rest: given.update(dict(rows.dtypes)) or fold(rows, *rest))
    D.coalesce(spark.createDataFrame(made(4, 20), CARDS), "key", lambda f: f in GENERIC)
    assert given and not any(kind.startswith("array") for kind in given.values())
