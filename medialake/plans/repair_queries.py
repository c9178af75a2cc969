"""Registered queries over places, libraries, repair and retitle plans, map reports, resolved tokens and the labelling queue."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from medialake.operators import vectors as V
from medialake.operators.filters import resolved_tree
from medialake.plans.series_queries import MAP, _map
from medialake.registry import query, table
from medialake.sources.views import SQL, faces, oracle, view

c = F.col
# Places by word in their order (no label: the word alone doesn't tell which), and names of libraries.
PLACES = [("the", "Thebes"), ("und", "Undine"), ("en", None), ("que", "Quebec")]
LIBRARIES = ("Fotos", "Alben", "photos")
PLACE_ROWS = ", ".join(f"('{w}', {'NULL' if label is None else repr(label)}, {n})" for n, (w, label) in enumerate(PLACES))


@query("pr15_places", oracle("v_assets", f", p(word, label, ord) AS (VALUES {PLACE_ROWS}), w AS (SELECT asset_id, t, unnest(regexp_extract_all(lower(x), '[a-z]+')) AS word FROM (SELECT asset_id, 1 AS t, event_name AS x FROM v_assets UNION ALL SELECT asset_id, 2, caption FROM v_assets) q), h AS (SELECT asset_id, arg_min({{'word': p.word, 'label': p.label}}, t * 100 + ord) AS m FROM w JOIN p USING (word) GROUP BY 1) SELECT asset_id, m.word AS place_key, m.label AS label FROM h").replace(") , p(", "), p("))
def pr15(spark, sf_dir):
    """The place that a row's texts name by a whole word: the first text counts, then the dictionary's order."""
    places = spark.createDataFrame([(w, label, n) for n, (w, label) in enumerate(PLACES)], "word string, label string, ord int")
    rows = view(spark, sf_dir, "v_assets")
    texts = rows.select("asset_id", F.posexplode(F.array("event_name", "caption")).alias("t", "x"))
    words = texts.select("asset_id", "t", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("x"), F.lit("([a-z]+)"), F.lit(1)))).alias("word"))
    first = words.join(F.broadcast(places), "word").groupBy("asset_id").agg(F.min_by(F.struct("word", "label"), F.struct("t", "ord")).alias("m"))  # a fixed dictionary
    return first.select("asset_id", c("m.word").alias("place_key"), c("m.label").alias("label"))


SQL["v_places"] = f"SELECT asset_id, CASE WHEN asset_id % 5 = 0 THEN replace(replace(path, '/mnt/photo/', '/mnt/card/'), '/Fotos/', '/DCIM/') WHEN asset_id % 7 = 0 THEN replace(path, '/mnt/photo/Fotos/', '/mnt/disk/Alben/') ELSE path END AS path FROM ({SQL['v_paths']}) p"


@query("cu9_library_destination", oracle("v_places", ", a AS (SELECT asset_id, unnest(range(2, len(p))) AS depth, p FROM (SELECT asset_id, string_split(path, '/') AS p FROM v_places) q), d AS (SELECT asset_id, depth, array_to_string(p[1:depth], '/') AS dir, p[depth] AS name FROM a), k AS (SELECT DISTINCT dir FROM d WHERE name IN ('Fotos', 'Alben', 'photos')), o AS (SELECT asset_id, arg_max(dir, depth) AS dir FROM d WHERE name IN ('Fotos', 'Alben', 'photos') GROUP BY 1), s AS (SELECT asset_id, arg_max(k.dir, depth * 10 - CASE regexp_extract(k.dir, '[^/]*$') WHEN 'Fotos' THEN 0 WHEN 'Alben' THEN 1 ELSE 2 END) AS dir FROM d JOIN k ON regexp_extract(k.dir, '^(.*)/', 1) = d.dir GROUP BY 1) SELECT v.asset_id, coalesce(o.dir, s.dir) AS library FROM v_places v LEFT JOIN o ON v.asset_id = o.asset_id LEFT JOIN s ON v.asset_id = s.asset_id").replace(") , a AS", "), a AS"))
def cu9(spark, sf_dir):
    """Where a row belongs: its nearest ancestor with a library's name, else such a directory beside its nearest ancestor; null if neither is there."""
    rows = view(spark, sf_dir, "v_places").select("asset_id", "path")
    own = F.regexp_replace("path", "/[^/]*$", "")
    homes = rows.select(own.alias("own")).distinct()
    parts = F.split("own", "/")
    up = homes.select("own", F.posexplode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "dir")).withColumn("name", F.substring_index("dir", "/", -1))
    known = up.where(c("name").isin(*LIBRARIES))
    inside = known.groupBy("own").agg(F.max_by("dir", "depth").alias("inside"))
    choice = F.array_position(F.array(*map(F.lit, LIBRARIES)), F.substring_index("library", "/", -1))
    shelves = known.select(c("dir").alias("library"), F.regexp_replace("dir", "/[^/]*$", "").alias("dir")).distinct()
    beside = up.join(shelves, "dir").groupBy("own").agg(F.max_by("library", F.struct("depth", -choice)).alias("beside"))
    told = homes.join(inside, "own", "left").join(beside, "own", "left").select("own", F.coalesce("inside", "beside").alias("library"))
    return rows.withColumn("own", own).join(told, "own", "left").select("asset_id", "library")


@query("cu19_repair_plan", "WITH l AS (SELECT doc_id, source, n_chars, text FROM documents WHERE doc_id % 4 <> 0), u AS (SELECT n_chars, count(*) AS n, min(source) AS source, min(doc_id) AS there FROM l GROUP BY 1), f AS (SELECT CAST(floor(vec_id / 3) AS BIGINT) AS doc_id, count(*) AS faces FROM embeddings GROUP BY 1) SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'rekey' WHEN u.n = 1 AND u.source = d.source THEN 'drop duplicate' WHEN u.n = 1 THEN 'move' ELSE 'drop' END AS action, CASE WHEN l.doc_id IS NULL AND u.n = 1 AND u.source <> d.source THEN u.there END AS target, CASE WHEN l.doc_id IS NULL AND (u.n IS NULL OR u.n > 1 OR u.source = d.source) THEN coalesce(f.faces, 0) ELSE 0 END AS faces, CASE WHEN l.doc_id IS NOT NULL THEN md5(concat(d.source, '/', CAST(d.doc_id AS VARCHAR))) END AS old_key, CASE WHEN l.doc_id IS NOT NULL THEN md5(d.text) END AS new_key FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN u ON d.n_chars = u.n_chars LEFT JOIN f ON d.doc_id = f.doc_id")
def cu19(spark, sf_dir):
    """What to do about each row: live rows get a cache key by content, rows that moved adopt the one row of their size, others go with their faces."""
    d = table(spark, sf_dir, "documents")
    listing = d.where("doc_id % 4 <> 0")
    unique = listing.groupBy("n_chars").agg(F.count("*").alias("n"), F.min("source").alias("there"), F.min("doc_id").alias("adopted"))
    held = table(spark, sf_dir, "embeddings").groupBy(F.floor(c("vec_id") / 3).cast("long").alias("doc_id")).agg(F.count("*").alias("held"))
    met = d.join(listing.select("doc_id", F.lit(True).alias("live")), "doc_id", "left").join(unique, "n_chars", "left").join(held, "doc_id", "left")
    action = F.when(c("live"), "rekey").when((c("n") == 1) & (c("there") == c("source")), "drop duplicate").when(c("n") == 1, "move").otherwise("drop")
    only = lambda kind, value, name, other=None: F.when(c("action").startswith(kind), value).otherwise(other).alias(name)
    old_key = F.md5(F.concat("source", F.lit("/"), c("doc_id").cast("string")))
    return met.withColumn("action", action).select("doc_id", "action", only("move", c("adopted"), "target"), only("drop", F.coalesce("held", F.lit(0)), "faces", F.lit(0)), only("rekey", old_key, "old_key"), only("rekey", F.md5("text"), "new_key"))


@query("cu20_retitled_map", oracle("v_assets", ", m AS (SELECT label, asset_id, lang, folder FROM embeddings JOIN v_assets ON vec_id = asset_id), t AS (SELECT label, word, count(*) AS n FROM (SELECT label, unnest([lang, folder]) AS word FROM m) q WHERE word IS NOT NULL GROUP BY 1, 2), r AS (SELECT label, list(word ORDER BY n DESC, word)[1:2] AS words FROM t GROUP BY 1) SELECT label, concat(words[1], ' ', words[2]) AS title, concat(words[1], ' ', words[2]) <> concat('de ', words[2]) AS changed FROM r").replace(") , m AS", "), m AS"))
def cu20(spark, sf_dir):
    """New titles of a map's clusters from its rows as they are now; places and members stay."""
    member = table(spark, sf_dir, "embeddings").select("label", c("vec_id").alias("asset_id")).join(view(spark, sf_dir, "v_assets").select("asset_id", "lang", "folder"), "asset_id")
    words = member.select("label", F.explode(F.array_compact(F.array("lang", "folder"))).alias("word")).groupBy("label", "word").agg(F.count("*").alias("n"))
    best = words.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "word"))).where("k <= 2")
    told = best.groupBy("label").agg(F.max(F.when(c("k") == 1, c("word"))).alias("a"), F.max(F.when(c("k") == 2, c("word"))).alias("b"))
    title = F.concat_ws(" ", F.coalesce("a", F.lit("")), F.coalesce("b", F.lit("")))
    return told.select("label", title.alias("title"), (title != F.concat_ws(" ", F.lit("de"), F.coalesce("b", F.lit("")))).alias("changed"))


@query("ag25_map_report", oracle("v_faces", "").rstrip() + ", " + MAP + ", b AS (SELECT *, CASE WHEN head THEN 1 ELSE 0 END + CASE WHEN event IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN person IS NOT NULL THEN 4 ELSE 0 END AS flags FROM mp) SELECT concat('cluster ', CAST(label AS VARCHAR)) AS what, count(*) AS n FROM b GROUP BY label UNION ALL SELECT concat('year ', year), count(*) FROM b GROUP BY year UNION ALL SELECT concat('flag ', CAST(k AS VARCHAR)), count(*) FILTER ((flags & CAST(k AS BIGINT)) <> 0) FROM b, (VALUES (1), (2), (4)) v(k) GROUP BY k UNION ALL SELECT 'visible', count(*) FILTER ((flags & 1) <> 0) FROM b")
def ag25(spark, sf_dir):
    """A map's sizes: rows of each cluster and year, rows with each flag, and what is visible once stacks are folded."""
    flags = sum((F.when(x, F.lit(1 << n)).otherwise(0) for n, x in enumerate((c("head"), c("event").isNotNull(), c("person").isNotNull()))), F.lit(0))
    rows = _map(spark, sf_dir).withColumn("flags", flags)
    sized = lambda label, name: rows.groupBy(name).agg(F.count("*").alias("n")).select(F.concat(F.lit(f"{label} "), c(name).cast("string")).alias("what"), "n")
    bits = rows.agg(*(F.count_if(c("flags").bitwiseAND(b) != 0).alias(f"b{b}") for b in (1, 2, 4)))
    told = bits.select(F.explode(F.array(*(F.struct(F.lit(w).alias("what"), c(b).alias("n")) for w, b in (("flag 1", "b1"), ("flag 2", "b2"), ("flag 4", "b4"), ("visible", "b1"))))).alias("x")).select("x.what", "x.n")
    return sized("cluster", "label").union(sized("year", "year")).union(told)


@query("ud3_resolved_tokens", oracle("v_assets", "SELECT asset_id, person_id FROM v_assets WHERE lang = 'de' OR (person_id IN (SELECT DISTINCT concat('p', CAST(c_nationkey % 9 AS VARCHAR)) FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_nationkey < 12) AND quality >= 3)"))
def ud3(spark, sf_dir):
    """A query tree with a token whose meaning a table tells."""
    people = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.lower("c_mktsegment").alias("token"), F.concat(F.lit("p"), (c("c_nationkey") % 9).cast("string")).alias("id"))
    tree = {"op": "or", "children": [{"field": "lang", "value": "de"}, {"op": "and", "children": [{"field": "who", "value": "furniture"}, {"field": "good", "value": True}]}]}
    rows = view(spark, sf_dir, "v_assets").withColumn("good", c("quality") >= 3)
    return resolved_tree(rows, tree, people, "who", "person_id", {"lang": "lang", "good": "good"}).select("asset_id", "person_id")


@query("vc7_labelling_queue")
def vc7(spark, sf_dir):
    """What to label next: batches that look like known persons, then new clusters of three or more, by size and mean frontality."""
    every = faces(spark, sf_dir)
    open_faces = every.where("person_id is null")
    centres = V.centroids(every.where("person_id like 'p%'"), "person_id", "vector")
    best = V.nearest_centroid(open_faces, centres, "vector", "face_id", "person_id", 0.15)
    front = F.coalesce("frontality", F.lit(0.0))
    known = best.groupBy("person_id").agg(F.count("*").alias("size"), F.max_by("face_id", F.struct("score", -c("face_id"))).alias("cover"), F.max("score").alias("weight"))
    rest = open_faces.join(best.select("face_id"), "face_id", "left_anti")
    clusters = V.average_linkage(rest, "vector", "face_id", 0.35).join(rest.select("face_id", "frontality"), "face_id")
    new = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.max_by("face_id", F.struct(front, -c("face_id"))).alias("cover"), F.avg(F.coalesce("frontality", F.lit(0.5))).alias("mean")).where("size >= 3")
    cards = known.select(F.lit("known").alias("kind"), "person_id", "size", "cover", "weight").unionByName(new.select(F.lit("new").alias("kind"), F.lit(None).cast("string").alias("person_id"), "size", "cover", (c("size") * c("mean")).alias("weight")))
    return cards.orderBy("kind", F.desc(F.when(c("kind") == "known", c("size")).otherwise(c("weight"))), "cover")
