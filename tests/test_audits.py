"""Moved files, artefacts, identities, foretold groups, places and names against plain Python."""

import random
import re
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from medialake.functions import paths as P
from medialake.operators import audits as A
from medialake.operators import phrases as H


def plain_ghost(path, listing, dirs, index):
    if path in listing:
        return "live", None
    folder, name = path.rsplit("/", 1)
    above = folder.rsplit("/", 1)[0] if "/" in folder else None
    there = {p.rsplit("/", n)[0] for p in [*listing, *(d + "/x" for d in dirs)] for n in range(1, p.count("/") + 1)}
    if folder in there or above is None or above not in there:
        return "gone", None
    hits = [p for p in listing if p.rsplit("/", 1)[1] == name and p.rsplit("/", 2)[0] == above and p.count("/") == above.count("/") + 2]
    if len(hits) != 1:
        return "gone", None
    return ("duplicate" if hits[0] in index else "migrate"), hits[0]


def test_ghosts_equal_plain(spark):
    rnd = random.Random(3)
    made = lambda: "/".join(["", "r", rnd.choice("ab"), rnd.choice(["x", "y", "z", "w/v"]), rnd.choice(["1.jpg", "2.jpg", "3.jpg"])])
    listing = {made() for _ in range(9)} | {"/r/a/only/2.jpg", "/r/a/only/9.jpg"}
    index = {i: made() for i in range(80)} | {90: "/r/a/lost/9.jpg", 91: "/q/p/1.jpg", 92: "name", 93: "/r/a/empty/1.jpg", 94: "/top.jpg"}
    rows = spark.createDataFrame([*index.items(), (95, None), (96, "")], "asset_id long, path string")
    dirs = ["/r/a/empty"]
    got = {r.asset_id: (r.verdict, r.dest) for r in A.ghosts(rows, spark.createDataFrame([(p,) for p in listing] + [(None,)], "path string"), spark.createDataFrame([(d,) for d in dirs], "path string")).collect()}
    assert got == {i: plain_ghost(p, listing, dirs, set(index.values())) if "/" in p else ("gone", None) for i, p in index.items()}
    assert {"live", "migrate", "duplicate", "gone"} == {v for v, _ in got.values()}
    assert A.ghosts(rows.limit(0), rows.limit(0).select("path")).collect() == []


def test_artefacts(spark):
    expected = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "d"]), (3, ["e", "f"]), (4, []), (5, ["a", "x"])], "asset_id long, keys array<string>")
    stock = spark.createDataFrame([("a", 10), ("b", 20), ("d", 30), ("o", 5), ("v", 7)], "key string, bytes long")
    others = spark.createDataFrame([("v",), ("a",)], "key string")
    claims = A.claims(expected, stock)
    assert {tuple(r) for r in claims.collect()} == {(1, "present", "a"), (2, "present", "d"), (3, "missing", "e"), (5, "present", "a")}
    found = A.artefacts(expected, stock, others)
    assert {(r.key, r.verdict) for r in found.collect()} == {("a", "good"), ("b", "duplicate"), ("d", "good"), ("o", "orphan"), ("v", "valid")}
    assert {tuple(r) for r in A.artefact_report(claims, found).collect()} == {("good", 2, 40), ("duplicate", 1, 20), ("orphan", 1, 5), ("valid", 1, 7), ("missing", 1, 20)}


def test_uuid5(spark):
    names = ["", "abc", "Grüße 😀", "x" * 500] + [str(i) for i in range(300)]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", P.uuid5(F.col("name")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.name)) for r in rows)
    face = spark.createDataFrame([("p", 2, [1, -2, 30, 4], None), ("p", 0, [1, 2, 3, 4], 2.5)], "a string, i int, box array<int>, s double")
    got = [r.u for r in face.select(P.face_point_id(F.col("a"), F.col("i"), F.col("box"), F.col("s")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, k)) for k in ("p:2:[1, -2, 30, 4]", "p:2.5:0:[1, 2, 3, 4]")]


def test_offsets_are_guarded(spark):
    at = datetime(2020, 1, 1)
    rows = spark.createDataFrame([(i, "ab"[i % 2], at + timedelta(hours=i), f"/p/{i}.{'cr2' if i == 4 else 'jpg'}") for i in range(6)] + [(9, "a", None, "/p/9.jpg")], "asset_id long, album string, taken_at timestamp, path string")
    groups = lambda *g: spark.createDataFrame(g, "album string, offset_s double, expected long")
    moved = A.shifted(rows, groups(("a", 90.5, 3), ("b", -60.0, 3)), ["album"], "taken_at", "asset_id").collect()
    assert {r.asset_id: (r.new_at - r.old_at).total_seconds() for r in moved} == {i: 90.5 if i % 2 == 0 else -60.0 for i in range(6)}
    for wrong in (groups(("a", 1.0, 4)), groups(("a", 1.0, None)), groups(("none", 1.0, 1))):
        plan = A.shifted(rows, wrong, ["album"], "taken_at", "asset_id")
        if wrong.first().album == "a":
            with pytest.raises(Exception, match="expected"):
                plan.collect()
    with pytest.raises(Exception, match="found 3"):
        A.shifted(rows, groups(("a", 1.0, 4), ("b", 1.0, 3)), ["album"], "taken_at", "asset_id").write.format("noop").mode("overwrite").save()
    with pytest.raises(Exception, match="can't be written"):
        A.shifted(rows, groups(("a", 1.0, 3)), ["album"], "taken_at", "asset_id", "path").collect()


def test_places(spark):
    fixed = {"bali": "Bali", "essen": None, "rom": "Rom", "prag": "Prag"}
    over = spark.createDataFrame([("Sankt  Märgen", "St. Märgen"), ("ROM", "Roma"), ("essen", ""), (None, "x"), ("zwei", None)], "term string, label string")
    cases = {1: ["Essen 2010", None], 2: ["Promenade", "Prag"], 3: ["prag und bali"], 4: [None, "Urlaub in sankt-maergen"], 5: ["Römer"], 6: ["rom"], 7: [], 8: ["sankt", "maergen"], 9: ["", "BALI!"]}
    texts = spark.createDataFrame(list(cases.items()), "asset_id long, texts array<string>")
    got = {r.asset_id: r.label for r in H.detected(texts, H.place_dictionary(spark, over, fixed), "asset_id").collect()}
    assert got == {2: "Prag", 3: "Bali", 4: "St. Märgen", 6: "Roma", 9: "Bali"}


def test_named_lines_equal_plain(spark):
    rnd = random.Random(6)
    words = ["Anna", "Baum", "Ölbaum", "Kim", "Li", "von", "Behr", "der", "x_y", "Straße", "A.B."]
    names = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 2, 3]))) for _ in range(25)] + ["_skipped", "", None, "O'Neil\\E x"]
    lines = [(i, rnd.choice(["", " ", ","]).join(rnd.choice([*words, "baum", "Annas", "und", "O'Neil\\E x"]) + rnd.choice([" ", "-", ""]) for _ in range(rnd.randint(0, 8)))) for i in range(300)] + [(999, None)]
    allow = ["BAUM"]
    terms = H.name_terms(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(a,) for a in allow], "word string"), spark.createDataFrame([("der",), (" ",)], "term string"))
    kept = {n.strip() for n in names if n and n.strip() and not n.startswith("_")}
    want_terms = kept | {p for n in kept for p in n.split() if len(p) > 3 and p.lower() not in ("baum",)} | {"der"}
    assert {r.term for r in terms.collect()} == want_terms
    got = {r.i: r.term for r in H.named_lines(spark.createDataFrame(lines, "i long, line string"), terms, ["i"]).collect()}
    want = {}
    for i, line in lines:
        hits = [t for t in want_terms if line and re.search(r"\b" + re.escape(t) + r"\b", line)]
        if hits:
            want[i] = min(hits, key=lambda t: (-len(t), t))
    assert got == want and len(want) > 50


def test_patterns(spark):
    lines = ["key sk-abcdefghijklmnop1234", "Passwort: 'geheim'", "-----BEGIN RSA PRIVATE KEY-----", "host 192.168.1.20", "at 192.0.2.7 x@example.org", "10.1.2.3 and 192.0.2.1", "none", "fritz.box", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    none = spark.createDataFrame([], "term string")
    assert sorted((r.i, r.why) for r in H.sensitive(rows, none, ["i"]).collect()) == [(0, "api key"), (1, "password"), (2, "private key"), (3, "private address"), (4, "mail address"), (5, "private address"), (7, "router")]
