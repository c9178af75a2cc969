"""Registered queries over event cards, their suggestions, and searches from stated queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from medialake.operators import cards as C
from medialake.operators import search as S
from medialake.operators import vectors as V
from medialake.registry import query, table
from medialake.sources.views import SQL, oracle, view

c = F.col
SQL["v_cards"] = f"""
        SELECT asset_id, taken_at, key, CASE WHEN asset_id % 9 < 5 THEN concat('album ', CAST(key % 5 AS VARCHAR(9))) WHEN asset_id % 9 < 7 THEN 'camera' ELSE concat('trip ', CAST(asset_id % 3 AS VARCHAR(9))) END AS folder,
            CASE WHEN asset_id % 2 = 0 THEN concat('p', CAST(asset_id % 6 AS VARCHAR(9))) END AS person
        FROM ({SQL["v_stream"]}) s"""
GAP = 3 * 3600
CARDS = """, o AS (SELECT *, CASE WHEN lag(taken_at) OVER w IS NULL OR epoch_us(taken_at) - epoch_us(lag(taken_at) OVER w) > 10800000000 THEN 1 ELSE 0 END AS fresh FROM v_cards WHERE taken_at IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY taken_at, asset_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY taken_at, asset_id) AS sid FROM o),
f AS (SELECT key, sid, list(folder ORDER BY t, i) AS folder FROM (SELECT key, sid, folder, min(taken_at) AS t, arg_min(asset_id, (taken_at, asset_id)) AS i FROM g GROUP BY 1, 2, 3) q GROUP BY 1, 2),
p AS (SELECT key, sid, list(person ORDER BY t, i) AS person FROM (SELECT key, sid, person, min(taken_at) AS t, arg_min(asset_id, (taken_at, asset_id)) AS i FROM g WHERE person IS NOT NULL GROUP BY 1, 2, 3) q GROUP BY 1, 2),
s AS (SELECT key, sid, min(taken_at) AS start_at, max(taken_at) AS end_at, count(*) AS size, list(asset_id ORDER BY taken_at, asset_id)[1:8] AS cover FROM g GROUP BY 1, 2),
k AS (SELECT s.*, f.folder, coalesce(p.person, []) AS person, concat('ev-', s.key, '-', strftime(start_at, '%Y%m%dT%H%M%S'), '-', lpad(CAST(size AS VARCHAR), 4, '0')) AS event_key FROM s JOIN f ON s.key = f.key AND s.sid = f.sid LEFT JOIN p ON s.key = p.key AND s.sid = p.sid),
t AS (SELECT *, list_filter(folder, lambda x: NOT regexp_matches(x, '(?i)^(camera|dcim|download)$')) AS named FROM k)"""
NEIGHBOURS = """, n AS (SELECT event_key, named, folder, person, size, end_at, lead(event_key) OVER w AS next_key, lead(named) OVER w AS next_named, lead(folder) OVER w AS next_folder, lead(person) OVER w AS next_person, lead(size) OVER w AS next_size, (epoch_us(lead(start_at) OVER w) - epoch_us(end_at)) / 3.6e9 AS gap_h FROM t WINDOW w AS (PARTITION BY key ORDER BY start_at)),
m AS (SELECT *, len(list_intersect(person, next_person)) AS shared FROM n WHERE gap_h > 3 AND gap_h <= 12),
nb AS (SELECT event_key, next_key, round(gap_h, 4) AS gap_h, round(1 + 2.0 * least(shared, 3) + CASE WHEN list_has_any(named, next_named) THEN 1.5 WHEN len(named) + len(next_named) > 0 THEN 0.4 ELSE 0 END + (12 - gap_h) / 12, 3) AS score, size + next_size AS photos FROM m
    WHERE (len(named) + len(next_named) > 0 OR shared > 0) AND NOT (len(list_distinct(list_concat(folder, next_folder))) = 1 AND len(named) > 0)),
uf AS (SELECT event_key, CASE WHEN len(named) = len(folder) THEN 'split_named' WHEN len(named) > 0 THEN 'dump_plus_named' ELSE 'split_dump' END AS reason, round(2 + size / 100.0, 3) AS score, size AS photos FROM t WHERE len(folder) > 1)"""


def _cards(spark, sf_dir):
    return C.cards(view(spark, sf_dir, "v_cards"), "key", "taken_at", "asset_id", ["folder", "person"], GAP)


@query("ag4_event_cards", oracle("v_cards", "").rstrip() + CARDS + " SELECT event_key, size, round((epoch_us(end_at) - epoch_us(start_at)) / 6e7, 4) AS span_minutes, folder, person, cover FROM k")
def ag4(spark, sf_dir):
    return _cards(spark, sf_dir).select("event_key", "size", F.round("span_minutes", 4).alias("span_minutes"), "folder", "person", "cover")


@query("wn6_neighbour_suggestions", oracle("v_cards", "").rstrip() + CARDS + NEIGHBOURS + " SELECT event_key, next_key, gap_h, score, photos FROM nb")
def wn6_full(spark, sf_dir):
    return C.neighbour_suggestions(_cards(spark, sf_dir), "key", C.telling)


@query("wn7_folder_suggestions", oracle("v_cards", "").rstrip() + CARDS + NEIGHBOURS + " SELECT event_key, reason, score, photos FROM uf")
def wn7(spark, sf_dir):
    return C.folder_suggestions(_cards(spark, sf_dir), C.telling)


@query("wn8_ranked_suggestions", oracle("v_cards", "").rstrip() + CARDS + NEIGHBOURS + ", u AS (SELECT 'neighbor' AS kind, event_key, next_key, NULL AS reason, CAST(score AS DOUBLE) AS score, photos FROM nb UNION ALL SELECT 'unify_folders', event_key, NULL, reason, score, photos FROM uf) SELECT kind, event_key, next_key, reason, score, photos FROM u ORDER BY photos DESC, score DESC, event_key, kind LIMIT 200")
def wn8(spark, sf_dir):
    """Both kinds of suggestions, those that touch most photos first."""
    made = _cards(spark, sf_dir)
    both = C.neighbour_suggestions(made, "key", C.telling).withColumn("kind", F.lit("neighbor")).unionByName(C.folder_suggestions(made, C.telling).withColumn("kind", F.lit("unify_folders")), allowMissingColumns=True)
    return both.select("kind", "event_key", "next_key", "reason", "score", "photos").orderBy(F.desc("photos"), F.desc("score"), "event_key", "kind").limit(200)


UNIT = "u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.normed(c("embedding").cast("array<double>")).alias("v"))


@query("vc3_more_like_each", f"WITH {UNIT}, s AS (SELECT q.vec_id AS query_id, u.vec_id, list_dot_product(q.v, u.v) AS s FROM u q, u WHERE q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM r WHERE rank <= 20")
def vc3(spark, sf_dir):
    """More like each example: the nearest 20 of every row whose id is divisible by 100, the example itself left out."""
    rows = _vectors(spark, sf_dir).select(c("vec_id").alias("id"), "v")
    return S.nearest(rows.where("id % 100 = 0"), rows, 20).select("query_id", c("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query("vc4_person_suggestions", f"WITH {UNIT}, s AS (SELECT q.vec_id AS query_id, u.label, list_dot_product(q.v, u.v) AS s FROM u q, u WHERE q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id AND u.vec_id % 3 = 0), b AS (SELECT query_id, label, max(s) AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC) AS n FROM s WHERE s >= 0.1) q WHERE n <= 15 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, label) AS rank FROM b) SELECT query_id, label AS person, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM r WHERE rank <= 5")
def vc4(spark, sf_dir):
    """Persons for each asking face: its 15 most similar labelled faces of at least 0.1, the best of each person, five at most."""
    rows = _vectors(spark, sf_dir).select(c("vec_id").alias("id"), "label", "v")
    hits = S.nearest(rows.where("id % 100 = 0").select("id", "v"), rows.where("id % 3 = 0").select("id", "v"), 15, least=0.1)
    best = hits.join(rows.select("id", "label"), "id").groupBy("query_id", "label").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "label"))
    return best.withColumn("rank", place).where("rank <= 5").select("query_id", c("label").alias("person"), "rank", F.round("score", 6).alias("score"))


@query("ex8_softmax", "SELECT l_orderkey, l_linenumber, round(exp(l_discount * 100 - m) / sum(exp(l_discount * 100 - m)) OVER (PARTITION BY l_orderkey), 6) AS share FROM (SELECT *, max(l_discount * 100) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) q")
def ex8(spark, sf_dir):
    w = Window.partitionBy("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_discount") * 100).alias("s"))
    e = F.exp(c("s") - F.max("s").over(w))
    return rows.withColumn("e", e).select("l_orderkey", "l_linenumber", F.round(c("e") / F.sum("e").over(w), 6).alias("share"))


@query("ag12_tag_profile", oracle("v_assets", "SELECT tag, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM v_assets), 6) AS share FROM (SELECT unnest(list_filter([lang, folder, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS tag FROM v_assets) q GROUP BY tag ORDER BY n DESC, tag LIMIT 20"))
def ag12(spark, sf_dir):
    """The 20 most frequent tags with their share of the rows."""
    rows = view(spark, sf_dir, "v_assets")
    counts = rows.select(F.explode(F.array_compact(F.array("lang", "folder", F.when(c("toxic") == 1, "toxic")))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("rows"))
    return counts.join(F.broadcast(total), F.lit(True)).select("tag", "n", F.round(c("n") / c("rows"), 6).alias("share")).orderBy(F.desc("n"), "tag").limit(20)  # one row is broadcast


@query("ag9_vector_gaps", oracle("v_assets", "SELECT CAST(count(*) AS BIGINT) AS assets, CAST(count(*) FILTER (e.vec_id IS NULL) AS BIGINT) AS without_vector, CAST(count(*) FILTER (quality IS NULL) AS BIGINT) AS without_quality FROM v_assets a LEFT JOIN embeddings e ON a.asset_id = e.vec_id"))
def ag9(spark, sf_dir):
    held = table(spark, sf_dir, "embeddings").where("embedding is not null").select(c("vec_id").alias("asset_id"), F.lit(True).alias("held"))
    return view(spark, sf_dir, "v_assets").join(held, "asset_id", "left").agg(F.count("*").alias("assets"), F.count_if(c("held").isNull()).alias("without_vector"), F.count_if(c("quality").isNull()).alias("without_quality"))


@query("sc10_aligned_vector", oracle("v_assets", "SELECT asset_id, CAST(embedding[1] AS DOUBLE) AS first_number, embedding IS NULL AS missing FROM v_assets LEFT JOIN embeddings ON asset_id = vec_id"))
def sc10(spark, sf_dir):
    second = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("asset_id"), "embedding")
    return view(spark, sf_dir, "v_assets").join(second, "asset_id", "left").select("asset_id", c("embedding")[0].cast("double").alias("first_number"), c("embedding").isNull().alias("missing"))


@query("sc4_projected_scan", oracle("v_assets", "SELECT asset_id, folder, lang FROM v_assets WHERE lang IN ('de', 'fr') AND n_chars >= 200 AND trashed_at IS NULL"))
def sc4(spark, sf_dir):
    return view(spark, sf_dir, "v_assets").where(c("lang").isin("de", "fr") & (c("n_chars") >= 200) & c("trashed_at").isNull()).select("asset_id", "folder", "lang")


@query("cu6_event_name_stamp", oracle("v_assets", "SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN 'walk' WHEN asset_id % 4 = 1 THEN NULL ELSE event_name END AS event_name, asset_id % 4 = 1 AS excluded FROM v_assets"))
def cu6(spark, sf_dir):
    """A change set that names some rows and clears others, merged over all rows."""
    rows = view(spark, sf_dir, "v_assets").select("asset_id", "event_name")
    changes = rows.where("asset_id % 4 < 2").select("asset_id", F.when(c("asset_id") % 4 == 0, "walk").alias("name"), (c("asset_id") % 4 == 1).alias("excluded"))
    return rows.join(changes, "asset_id", "left").select("asset_id", F.when(c("excluded").isNull(), c("event_name")).otherwise(c("name")).alias("event_name"), F.coalesce("excluded", F.lit(False)).alias("excluded"))


@query("cu18_person_meta", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'favourite' WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS pin, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS note FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def cu18(spark, sf_dir):
    """An upsert that keeps what a change doesn't set, and clears what it sets to null by name."""
    people = table(spark, sf_dir, "customer")
    old = people.where("c_custkey % 5 = 0").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("pin"), c("c_name").alias("note"))
    change = people.where("c_custkey % 3 = 0").select(c("c_custkey").alias("id"), F.lit("favourite").alias("new_pin"), F.array(F.lit("note")).alias("cleared"))
    both = old.join(change, "id", "full")
    kept = lambda name, new: F.when(F.coalesce(F.array_contains("cleared", name), F.lit(False)), None).otherwise(F.coalesce(new, c(name)))
    return both.select("id", kept("pin", c("new_pin")).alias("pin"), kept("note", F.lit(None)).alias("note"))


@query("vc22_asset_suggestions", f"WITH {UNIT}, s AS (SELECT q.vec_id AS query_id, u.label, u.vec_id, round(list_dot_product(q.v, u.v), 9) AS s FROM u q, u WHERE q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id AND u.vec_id % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM s WHERE s >= 0.1) SELECT CAST(floor(query_id / 300) AS BIGINT) AS asset_id, list_sort(list(DISTINCT label)) AS persons FROM r WHERE n = 1 GROUP BY 1")
def vc22(spark, sf_dir):
    """For each asset the best person of each of its asking faces."""
    rows = _vectors(spark, sf_dir).select(c("vec_id").alias("id"), "label", "v")
    hits = S.nearest(rows.where("id % 100 = 0").select("id", "v"), rows.where("id % 3 = 0").select("id", "v"), 1, least=0.1)
    return hits.join(rows.select("id", "label"), "id").groupBy(F.floor(c("query_id") / 300).alias("asset_id")).agg(F.sort_array(F.collect_set("label")).alias("persons"))  # a set of at most all persons


@query("tx2_distinct_stems")
def tx2(spark, sf_dir):
    """The eight most frequent words of five letters or more of each language, of which none is a form of one before it."""
    from medialake.functions.text import distinct_stems

    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{5,})"), F.lit(1)))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where("k <= 60")
    terms = ranked.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("w"))
    return terms.select("lang", distinct_stems(c("w.word"), 8).alias("terms"))
