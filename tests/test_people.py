"""Who is on what: tokens, forms, assignments, renames, albums; against plain Python where the tables don't hold the case."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from medialake.functions import dates as D
from medialake.operators import people as P
from medialake.operators import search_form as S

PEOPLE = "id string, name string, aliases array<string>"


def plain_resolve(token, people):
    t = token.strip().lower()
    if not t:
        return set(), None
    low = [(i, (n or i).lower(), [a.lower() for a in al or [] if a]) for i, n, al in people]
    slug = t.replace(" ", "-")
    tiers = (
        lambda i, n, al: i == t or n == t or t in al,
        lambda i, n, al: any(p.startswith(t) for p in n.split()) or any(a.startswith(t) for a in al) or any(p.startswith(slug) for p in i.split("-")) or i.startswith(slug),
        lambda i, n, al: t in n or slug in i or any(t in a for a in al),
    )
    for tier, fits in enumerate(tiers, 1):
        hit = {i for i, n, al in low if fits(i, n, al)}
        if hit:
            return hit, tier
    return set(), None


def test_people_are_resolved_as_plainly(spark):
    people = [("anna-wolf", "Anna Wolf", ["Karo", None]), ("bo-annan", "Bo Annan", []), ("lee", "Hanna-Lee", None), ("li", "Li", ["Wölfchen", ""]), ("kim-li", "Kim Li", ["Der Wolf"]), ("x", None, ["Karo B"])]
    tokens = ["anna wolf", "Anna", "ann", "karo", "KARO ", "wolf", "wöl", "li", "l", "ee", "na-l", "kim l", "im li", "der", "zz", "", " ", None, "o", "x", "anna-wolf", "-", "a wolf"]
    got = S.resolve_people(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame(people, PEOPLE)).collect()
    found = {}
    for r in got:
        found.setdefault(r.token, set()).add((r.id, r.tier))
    for t in tokens:
        ids, tier = plain_resolve(t or "", people)
        assert found[t] == ({(i, tier) for i in ids} or {(None, None)}), t


def test_forms(spark):
    rows = [(1, ["a", "b"], datetime(2015, 5, 1), "prag", ["Toxic".lower()], ["n"], "f", None, None, "photo", "Balkone am Haus"), (2, ["a"], datetime(2015, 12, 31, 23, 59, 59), None, None, None, "g", None, "s", None, "Straße"), (3, None, None, "rom", [], ["n"], "f", datetime(2020, 1, 1), "s", "video", None), (4, ["zz"], datetime(2016, 1, 1), "rom", ["x"], [], None, None, "t", "video", "")]
    df = spark.createDataFrame(rows, "asset_id long, person_ids array<string>, taken_at timestamp, location_key string, tags array<string>, annotations array<string>, folder string, trashed_at timestamp, space string, kind string, caption string")
    people = S.people_table(spark, [("a", "Anna", []), ("b", "Bert", ["Anni"])])
    find = lambda **form: {r.asset_id for r in S.search(df, S.SearchForm(**form), people).collect()}
    assert find() == {1, 2, 4}
    assert find(persons=("Anna", "bert")) == {1} and find(persons=("Anna", "bert"), persons_match="any") == {1, 2} and find(persons=("ann",)) == {1, 2}
    assert find(persons=("nobody",)) == set() and find(persons=("ZZ",)) == {4} and find(persons=(" ",)) == {1, 2, 4}
    assert find(date_from="2015", date_to="2015") == {1, 2} and find(date_from="2015-05-02") == {2, 4} and find(date_to="2015-05-01") == {1}
    assert find(location=" Rom ", tags=("TOXIC",), match="any") == {1, 4} and find(location="rom", spaces=("s",)) == set()
    assert find(annotations=(" n ",), folder="f") == {1} and find(kinds=("video",)) == {4}
    assert find(words="am Balkon") == {1} and find(words="strasse") == {2} and find(words="der die") == {1, 2, 4} and find(words="alkon") == set()


def test_date_bounds(spark):
    for text in ("2015", " 2015-02-03 ", "2015-02-03T04:05:06Z"):
        for end in (True, False):
            row = spark.createDataFrame([(text,)], "t string").select(D.date_bounds(F.col("t"), end).alias("b"), F.lit(D.date_bound(text, end)).cast("timestamp").alias("p")).first()
            assert row.b == row.p is not None
    assert spark.createDataFrame([("x",), (None,)], "t string").select(D.date_bounds(F.col("t"), True).alias("b")).where("b is not null").count() == 0


def test_assignments_follow_their_order(spark):
    rnd = random.Random(2)
    faces = [(i, f"f{i // 3}", *rnd.choice([(None, None), ("p1", "Anna"), ("p2", "Bo"), ("_skipped", "skipped")])) for i in range(40)]
    actions = ["assign", "move", "create", "skip", "ignore", "unassign", "dissolve"]
    requests = [(s, rnd.choice(actions), rnd.choice([*range(44), None]), rnd.choice(["p1", "p2", "new", None]), rnd.choice(["Zoë B", " ", None])) for s in range(60)]
    df = spark.createDataFrame(faces, "face_id long, photo_id string, person_id string, person_name string")
    got = {r.face_id: (r.person_id, r.person_name, r.changed) for r in P.assigned(df, spark.createDataFrame(requests, "seq long, action string, face_id long, person_id string, name string")).collect()}
    first = {}
    for i, _, p, n in faces:
        first.setdefault(p, n)
    now = {i: (p, n) for i, _, p, n in faces}
    was = dict(now)
    for _, action, face, person, name in requests:
        name = (name or "").strip()
        to = {"assign": (person, first.get(person) or person), "skip": ("_skipped", "skipped"), "ignore": ("_ignored", "ignored"), "unassign": (None, None), "move": ("zoe-b", name), "create": ("zoe-b", name)}.get(action)
        if action == "dissolve":
            now.update({i: (None, None) for i, (p, _) in was.items() if p is not None and p == person})
        elif face in now and (action != "assign" or person) and (action not in ("move", "create") or name):
            now[face] = to
    assert got == {i: (*now[i], now[i][0] != was[i][0]) for i in now}


def test_photos_are_told_from_faces(spark):
    faces = spark.createDataFrame([(1, "x", "p2", "Bo"), (2, "x", "p1", None), (3, "x", "p2", "Bob"), (4, "y", "_ignored", "ignored"), (5, "z", None, None)], "face_id long, photo_id string, person_id string, person_name string")
    photos = spark.createDataFrame([("x", ["p1", "p2"], ["p1", "Bo"]), ("y", ["p9"], ["Q"]), ("z", None, None), ("w", [], [])], "photo_id string, person_ids array<string>, person_names array<string>")
    assert [tuple(r) for r in P.photo_persons(faces, photos).collect()] == [("y", [], [])]
    assert {r.photo_id: r.person_ids for r in P.photo_persons(faces, photos.withColumn("person_names", F.array(F.lit("?")))).collect()} == {"x": ["p1", "p2"], "y": [], "z": [], "w": []}


def test_renames(spark):
    faces = spark.createDataFrame([(1, "x", "p1", "Anna"), (2, "y", "p1", "Anna"), (3, "x", "p2", "Bo")], "face_id long, photo_id string, person_id string, person_name string")
    photos = spark.createDataFrame([("x", ["p1", "p2"], ["Anna", "Bo"]), ("y", ["p1", "bo"], ["other"]), ("z", None, None)], "photo_id string, person_ids array<string>, person_names array<string>")
    meta = spark.createDataFrame([("p1", "note"), ("bo", "there"), ("p2", "kept")], "person_id string, note string")
    out = P.renamed(faces, photos, meta, spark.createDataFrame([("p1", " Bo "), ("p3", "X"), ("p2", "")], "person_id string, name string"))
    assert {(r.face_id, r.person_id, r.person_name) for r in out[0].collect()} == {(1, "bo", "Bo"), (2, "bo", "Bo")}
    assert {r.photo_id: (r.person_ids, r.person_names) for r in out[1].collect()} == {"x": (["bo", "p2"], ["Bo"]), "y": (["bo"], ["other", "Bo"])}
    assert [tuple(r) for r in out[2].collect()] == [("bo", "note", "p1", True)]


def test_registry_merges_spans(spark):
    at = lambda d: datetime(2024, 1, d)
    steps = [(1, "name", "cam", at(1), at(2), "A", 3, None, None, None), (2, "name", "cam", at(3), at(4), "B", 4, None, None, None), (3, "merge", "cam", at(1), at(2), " C ", 7, "cam", at(3), at(4)), (4, "name", "cam", at(9), at(9), "D", 1, None, None, None), (5, "forget", "cam", at(9), at(9), None, None, None, None, None), (6, "merge", "cam", at(5), at(8), "E", 2, "cam", at(6), at(7)), (7, "reject", "cam", at(9), at(9), None, None, "cam", at(5), at(6)), (8, "reject", "cam", at(5), at(6), None, None, "cam", at(9), at(9))]
    held, rejected = P.registry(spark.createDataFrame(steps, "seq long, action string, channel string, start_at timestamp, end_at timestamp, name string, photos long, other_channel string, other_start timestamp, other_end timestamp"))
    assert {(r.start_at, r.end_at, r.name, r.photos) for r in held.collect()} == {(at(1), at(4), "C", 7), (at(5), at(8), "E", 2)}
    assert rejected.count() == 1
