"""Invariants on small literal rows."""

import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialake.functions import paths
from medialake.operators import events, filters, vectors
from medialake.operators.graph import connected_components
from medialake.operators.rowwise import map_rows
from medialake.sources import rules
from medialake.streaming import jobs

T0 = datetime(2024, 5, 1, 22, 0)


def test_gap_boundary_and_midnight(spark):
    steps = [0, 3 * 3600, 6 * 3600 + 1 + 3 * 3600, 50 * 3600]
    rows = [(i, "a", T0 + timedelta(seconds=s)) for i, s in enumerate(steps)] + [(9, "a", None), (10, "b", T0)]
    df = spark.createDataFrame(rows, "id long, channel string, t timestamp")
    for parts in (1, 7):
        got = sorted((r.channel, r.size) for r in events.gap_sessions(df.repartition(parts), "channel", "t", "id").collect())
        assert got == [("a", 1), ("a", 1), ("a", 2), ("b", 1)]


def test_overlap_needs_half(spark):
    e = spark.createDataFrame([("e1", "c", T0, T0 + timedelta(hours=10)), ("e2", "c", T0, T0)], "event_key string, channel string, start_at timestamp, end_at timestamp")
    s = spark.createDataFrame([("short", "c", T0 + timedelta(hours=6), T0 + timedelta(hours=12)), ("other", "d", T0, T0 + timedelta(hours=12))], "name string, channel string, start_at timestamp, end_at timestamp")
    assert events.overlapping(e, s).count() == 0
    s = s.union(spark.createDataFrame([("long", "c", T0 - timedelta(hours=1), T0 + timedelta(hours=6))], s.schema))
    assert sorted((r.event_key, r.name) for r in events.overlapping(e, s).collect()) == [("e1", "long"), ("e2", "long")]


def test_query_tree(spark):
    df = spark.createDataFrame([(1, "a", ["x"], None), (2, "b", ["y"], None), (3, "a", ["y"], T0)], "id long, folder string, tags array<string>, trashed_at timestamp")
    cols = {"folder": "folder", "tag": "tags[]"}
    tree = {"op": "or", "children": [{"field": "folder", "value": "a"}, {"field": "tag", "value": "y"}, {"field": "?", "value": 1}]}
    assert [r.id for r in df.where(filters.visible(filters.tree(tree, cols))).orderBy("id").collect()] == [1, 2]
    assert filters.tree({"op": "and", "children": [{"op": "or", "children": []}]}, cols) is None


def test_path_rules(spark, tmp_path):
    names = ["/p/Sent/IMG-20130713-WA0000.jpg", "/p/a/IMG-20130713-WA0000.jpg", "/p/Screenshot_2024.png", "/p/xIMG-20130713-WA0000.jpg", "", "/p/VID_20250509_173920_00_031.mp4", "/p/123456789012.jpg", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, path string")
    got = {r.id: (r.c, r.d) for r in df.select("id", paths.channel(F.col("path")).alias("c"), paths.date_hint(F.col("path")).alias("d")).collect()}
    assert [got[i][0] for i in range(5)] == ["sent", "whatsapp", "screenshot", "camera", "camera"]
    assert (got[5][1], got[6][1], got[1][1]) == ("2025-05-09", None, "2013-07-13")
    (tmp_path / "rules.txt").write_text("# all\n/p\n- /p/x\n\n")
    assert sorted(tuple(r) for r in rules.path_rules(spark, str(tmp_path / "rules.txt")).collect()) == [("/p", True), ("/p/x", False)]
    side = spark.createDataFrame([("/p", '{"type": "far"}'), ("/p/Sent", '{"type": "near"}'), ("/p/a", "{broken")], "dir string, body string")
    near = {r.id: r.sidecar for r in rules.nearest_sidecar(df.where("id < 2"), "path", side).collect()}
    assert near[0].type == "near" and (near[1] is None or near[1].type is None)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 160)) and got[200] == 200
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_similar_pairs_and_linkage(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(1, 16)) + 0.25 * r.normal(size=(12, 16)) for _ in range(6)])
    x = np.concatenate([x, x[:3]])
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    got = {tuple(sorted((r.a, r.b))) for r in vectors.similar_pairs(df, "v", "id", 0.8, block=10).collect()}
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.8}
    assert {p for p in want if p[1] < 72} <= got and {(0, 72), (1, 73), (2, 74)} <= got
    label = {i: {i} for i in range(len(x))}
    while True:  # plain average linkage over all rows
        best = max(((np.mean([s[a, b] for a in p for b in q]), -i, -j) for i, p in label.items() for j, q in label.items() if i < j), default=(-1, 0, 0))
        if best[0] < 0.8:
            break
        label[-best[1]] |= label.pop(-best[2])
    found = {}
    for row in vectors.average_linkage(df, "v", "id", 0.8).collect():
        found.setdefault(row.cluster, set()).add(row.id)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, label.values()))


def test_linkage_leaves_no_row_out(spark):
    r = np.random.default_rng(3)
    a, b, c = np.eye(3)
    vs = [a] * 3100 + [a + 0.1 * b] * 5 + [b, b + 0.1 * c, c, None, np.zeros(3), np.zeros(3)]  # one component of over 3,000 rows
    order = r.permutation(len(vs))
    df = spark.createDataFrame([(int(i), None if vs[k] is None else [float(y) for y in vs[k]]) for i, k in enumerate(order)], "id long, v array<double>")
    found = {}
    for row in vectors.average_linkage(df, "v", "id", 0.9).collect():
        found.setdefault(row.cluster, set()).add(row.id)
        assert not row.truncated
    at = lambda *ks: {i for i, k in enumerate(order) if k in ks}
    want = [at(*range(3105)), at(3105, 3106), *(at(k) for k in range(3107, 3111))]
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want)) and all(k == min(v) for k, v in found.items())


@pytest.mark.parametrize("together", [3000, 5])
def test_linkage_by_rounds_is_that_of_single_merges(spark, together):
    r = np.random.default_rng(11)
    x = r.normal(size=(1, 6)) + 0.9 * r.normal(size=(48, 6))
    x[40:] = x[:8]  # copies weigh
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    label = {i: [i] for i in range(len(x))}
    while True:
        best = max(((round(s[np.ix_(p, q)].mean(), 12), -i, -j) for i, p in label.items() for j, q in label.items() if i < j), default=(-1, 0, 0))
        if best[0] < 0.5:
            break
        label[-best[1]] += label.pop(-best[2])
    got = {row.id: row.cluster for row in vectors.average_linkage(df, "v", "id", 0.5, together).collect()}
    assert got == {i: min(p) for p in label.values() for i in p} and 1 < len(label) < 40


def test_linkage_of_many_groups_in_both_ways(spark):
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(25, 8)), 12, axis=0) + 0.35 * r.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")
    both = [{row.id: row.cluster for row in vectors.average_linkage(df, "v", "id", 0.6, together).collect()} for together in (3000, 9)]
    assert both[0] == both[1] and 10 < len(set(both[0].values())) < 150


def test_tokens_are_resolved_in_three_tiers(spark):
    people = [("p1", "Anna Berg"), ("p2", "Bo Annan"), ("p3", "Hanna-Lee"), ("p4", "Li"), ("xy", "Zoë #12"), ("p6", None)]
    tokens = ["anna berg", "P2", "ann", "an", "b", "li", "l", "nn", "erg", "annal", "na-l", "ë", "12", "q", "zzz", "", None, "ERG", "a b", "p"]
    want = set()
    for t in tokens:
        tiers = {1: set(), 2: set(), 3: set()}
        for i, n in people:
            n, f = (n or "").lower(), (t or "").lower()
            if f:
                tiers[1] |= {i} if f in (n, i) else set()
                tiers[2] |= {i} if any(w.startswith(f) for w in [n, i, *re.split(r"[\s#-]+", n)]) else set()
                tiers[3] |= {i} if f in n else set()
        k = next((k for k in tiers if tiers[k]), None)
        want |= {(t, i, k) for i in tiers[k]} if k else {(t, None, None)}
    got = filters.resolved(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame(people, "id string, name string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want)) and {k for *_, k in want} == {1, 2, 3, None}


def test_bad_rows_stay_alone(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x"), (3, "6")], "id long, value string")
    got = {r.id: (r.ok, r.result) for r in map_rows(df, "id", "value", lambda v: str(int(v) * 2)).collect()}
    assert got == {1: (True, "8"), 2: (False, None), 3: (True, "12")}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "a", T0, "x"), (2, "a", T0 + timedelta(hours=1), "x"), (3, "a", T0 + timedelta(hours=9), "y"), (4, "a", T0 + timedelta(days=9), "z")]
    spark.createDataFrame(rows, "id long, channel string, t timestamp, body string").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("id long, channel string, t timestamp, body string").parquet(src)

    def result(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r["size"] for r in result(jobs.sessions(stream(), "channel", "t"), "s1")) == [1, 2]
    assert sorted(r.id for r in result(jobs.unseen_content(stream(), "t", "body"), "s2"))[1:] == [3, 4]
    assert [r.beats for r in result(jobs.heartbeats(stream(), "channel", "id"), "s3", "update")] == [4]
    assert sorted(r["size"] for r in result(jobs.open_events(stream(), "channel", "t"), "s4")) == [1, 2]
    jobs.incremental_ingest(stream().select("id", "body"), str(tmp_path / "out"), "id", ["body"], str(tmp_path / "s5")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_rows_without_a_key_have_sessions(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp '2024-01-01 10:00:00', 'a'), (2, timestamp '2024-01-01 11:00:00', null), (3, timestamp '2024-01-01 23:30:00', null), (4, timestamp '2024-01-02 00:30:00', null) AS t(id, ts, k)")
    found = sorted((r.k or "", r.size) for r in events.gap_sessions(rows, "k", "ts", "id").collect())
    assert found == [("", 1), ("", 2), ("a", 1)]


def test_targets_never_collide(spark):
    from medialake.operators.curation import collision_free

    names = ["a.txt", "a.txt", "a-1.txt", "a.txt", "a-1.txt", "a-3.txt", "b", "b", "a-01.txt"]
    rows = spark.createDataFrame([(k, "f", n) for k, n in enumerate(names)] + [(99, "g", "a.txt"), (100, None, "a.txt")], "id int, folder string, name string")
    got = {r.id: r.target for r in collision_free(rows, "folder", "name", "id").collect()}
    inside = [got[k] for k in range(len(names))]
    assert len(set(inside)) == len(names) and got[0] == "a.txt" and got[1] == "a-2.txt" and got[3] == "a-4.txt" and got[4] == "a-1-1.txt" and got[7] == "b-1"
    assert got[99] == got[100] == "a.txt"


def test_sidecars_keep_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "/r/a/b/x.jpg"), (1, "/r/a/b/x.jpg"), (2, "/q/y.jpg")], "id int, path string")
    side = spark.createDataFrame([("/r/a", '{"location": "Hut"}'), ("/r", '{"location": "far"}')], "dir string, body string")
    got = sorted((r.id, r.sidecar.location if r.sidecar else None) for r in rules.nearest_sidecar(rows, "path", side).collect())
    assert got == [(1, "Hut"), (1, "Hut"), (2, None)]


def test_long_paths_stay_whole(spark):
    from medialake.functions import paths

    long = "/old/" + "x" * 20_000
    assert spark.createDataFrame([(long,)], "path string").select(paths.rebased(F.col("path"), "/old", "/new").alias("p")).first().p == "/new/" + "x" * 20_000


def test_channels(spark):
    from medialake.functions import paths

    want = {
        "/r/Alps/IMG-20180102-WA0003.jpg": "whatsapp", "/r/phone/Sent/IMG-20180102-WA0003.jpg": "sent", "/r/phone/Sent/hut.jpg": "sent", "/r/x/Bildschirmfoto 3.png": "screenshot",
        "/r/Screenshots/hut.png": "screenshot", "/r/Office Lens/a.jpg": "document", "/r/Scans/Ebay/a.jpg": "download", "/r/Ebay/Scans/a.jpg": "document", "/r/alps/FB_IMG_12.jpg": "download", "/r/xIMG-20180102-WA0003.jpg": "camera", "": "camera", "C:\\pics\\Telegram\\a.jpg": "download",
    }
    got = {r.path: r.c for r in spark.createDataFrame([(p,) for p in want], "path string").withColumn("c", paths.channel(F.col("path"))).collect()}
    assert got == want


def test_word_forms_and_titles(spark):
    from medialake.functions import text

    def plain_related(a, b):
        short, long = sorted((a, b), key=len)
        same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a == b or (len(short) >= 4 and (long.startswith(short) or long.endswith(short))) or (same >= 5 and len(a) - same <= 3 and len(b) - same <= 3)

    words = ["meadow", "meadows", "oak", "oaken", "surface", "woodsurface", "gardens", "gas", "gardener", "walking", "walked", "walker", "lakes", "lake", "lak"]
    kept = []
    for w in words:
        if len(kept) < 6 and not any(plain_related(w, k) for k in kept):
            kept.append(w)
    row = spark.createDataFrame([(words,)], "w array<string>").select(text.distinct_stems(F.col("w"), 6).alias("k")).first()
    assert row.k == kept
    titles = {" -  Lake \n  walk. ": "Lake walk", "one two three four five six": None, "x" * 41: None, " .": None}
    got = {r.t: r.c for r in spark.createDataFrame([(t,) for t in titles], "t string").withColumn("c", text.clean_title(F.col("t"))).collect()}
    assert got == titles
    named = {"Noras garden feast": "Garden feast", "Nora und Tim": None, "Lake walk": "Lake walk", "feast of Tim's": "Feast of"}
    got = {r.t: r.c for r in spark.createDataFrame([(t,) for t in named], "t string").withColumn("c", text.without_names(F.col("t"), ["nora", "tim"])).collect()}
    assert got == named


def test_same_person_once(spark):
    from medialake.operators.faces import same_person_once

    rows = [(1, 1, [1.0, 0.0], 0.2, 0.9, 5.0), (1, 2, [0.9, 0.1], 0.8, 0.5, 5.0), (1, 3, [0.0, 1.0], None, 0.9, 5.0), (1, 4, [0.1, 2.0], None, 0.9, 6.0), (1, 5, None, 1.0, 1.0, 9.0), (2, 6, [1.0, 0.0], None, None, None)]
    df = spark.createDataFrame(rows, "photo int, face long, v array<double>, frontality double, score double, area double")
    # 2 is more frontal than 1, 4 is larger than 3, 5 has no vector.
    assert sorted((r.photo, r.face) for r in same_person_once(df, "photo", "face", "v").collect()) == [(1, 2), (1, 4), (2, 6)]
    assert same_person_once(df.limit(0), "photo", "face", "v").count() == 0


def _greedy(old, new, least):
    def area(b):
        return (b[2] - b[0]) * (b[3] - b[1])

    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        return both / (area(a) + area(b) - both)

    told, x, y = {}, set(), set()
    for s, i, j in sorted(((overlap(a, b), i, j) for i, a in old.items() for j, b in new.items()), reverse=True):
        if s >= least and i not in x and j not in y:
            told[i] = j
            x.add(i)
            y.add(j)
    return told


def test_paired_boxes_and_carry_over(spark):
    import random

    from medialake.operators.faces import carry_over, chosen_frame, paired_boxes

    rng = random.Random(3)
    box = lambda: (lambda x, y, s: (x, y, x + s, y + s))(rng.randrange(60), rng.randrange(60), rng.randrange(20, 50))
    old = {p: {n: box() for n in range(rng.randrange(1, 6))} for p in range(20)}
    new = {p: {100 + n: box() for n in range(rng.randrange(1, 6))} for p in range(20)}
    schema = "photo int, id long, x1 int, y1 int, x2 int, y2 int"
    frame = lambda boxes: spark.createDataFrame([(p, n, *b) for p, of in boxes.items() for n, b in of.items()], schema)
    got = {}
    pairs = paired_boxes(frame(old), frame(new), "photo")
    for r in pairs.collect():
        got.setdefault(r.photo, {})[r.old_id] = r.new_id
    assert got == {p: t for p in old if (t := _greedy(old[p], new[p], 0.3))}

    lying = spark.createDataFrame([(1, 1, "Ann"), (1, 2, None), (2, 3, "Bo"), (2, 4, "Cy"), (3, 5, "Di")], "photo int, id long, name string")
    boxes = {1: {1: (0, 0, 10, 10), 2: (50, 0, 60, 10)}, 2: {3: (0, 0, 10, 10), 4: (50, 0, 60, 10)}, 3: {5: (0, 50, 10, 60)}}
    found = {1: {11: (0, 0, 10, 10), 12: (50, 0, 60, 10)}, 2: {13: (0, 0, 10, 10), 14: (90, 90, 99, 99)}, 3: {15: (50, 0, 60, 10)}}
    turned = {p: {n: (b[1], b[0], b[3], b[2]) for n, b in of.items()} for p, of in boxes.items()}
    new_boxes = frame(found)
    best = chosen_frame(paired_boxes(frame(boxes), new_boxes, "photo"), paired_boxes(frame(turned), new_boxes, "photo"), "photo")
    plan = {r.photo: (r.verdict, r.transferred, r.lost) for r in carry_over(lying, new_boxes, best, "photo").collect()}
    assert plan == {1: ("stamp only", ["Ann"], []), 2: ("names lost", ["Bo"], ["Cy"]), 3: ("renewed", ["Di"], [])}


def test_nearest_join_equals_brute_force(spark):
    import numpy as np

    from medialake.operators.search import nearest_join

    v = np.random.default_rng(5).normal(size=(90, 6))
    v[7] = v[3]  # a tie
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(200, None)], "id long, v array<double>")
    left, right = df.where("id >= 60"), df.where("id < 60")
    got = {}
    for r in nearest_join(left, right, 4, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    score = np.round(v[60:] @ v[:60].T, 9)
    assert got == {60 + q: np.lexsort((np.arange(60), -row))[:4].tolist() for q, row in enumerate(score)}
    assert nearest_join(left.limit(0), right, 4).count() == 0


def test_plane_layout_keeps_the_most_variance(spark):
    import numpy as np

    from medialake import registry

    registry.load()
    rows = registry.QUERIES["vc17_plane_layout"](spark, "/root/testdata/sf0.001").orderBy("vec_id").collect()
    raw = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").select("embedding").collect()
    x = np.array([r.embedding for r in raw], float)
    x -= x.mean(0)
    most = np.linalg.svd(x, compute_uv=False)[:2] ** 2
    got = np.array([(r.x, r.y) for r in rows])
    assert np.allclose(((got - got.mean(0)) ** 2).sum(0), most, rtol=1e-6)


def test_notes_round_trip(spark):
    from pyspark.sql import functions as F

    from medialake.functions import notes as N

    df = spark.createDataFrame([("x lake:mtime=2;src=a=b;zoom=1;src= c ;cap=",), ("nothing",), ("lake:",), ("",)], "note string")
    df = df.select("note", N.note_text(N.note_fields(F.col("note"), "lake"), "lake").alias("text"))
    assert [r.text for r in df.collect()] == ["lake:src=c;mtime=2;zoom=1", "", "", ""]
    blobs = spark.createDataFrame([('{"caption": "a\\nb"}',), ('{"caption": "cut \\"he',), (None,), ("{",), ('{"caption": 3, "x": 1}',)], "t string")
    assert [r.x for r in blobs.select(N.salvaged(F.col("t"), "caption").alias("x")).collect()] == ["a\nb", 'cut "he', "", "", "3"]
