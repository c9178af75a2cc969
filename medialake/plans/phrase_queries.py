"""Registered queries over dictionaries of phrases: places in folder names, names and patterns in lines."""

from pyspark.sql import functions as F

from medialake.functions.places import PLACES
from medialake.operators import phrases as P
from medialake.registry import query, table
from medialake.sources.views import SQL, oracle, view

SQL["v_album_names"] = f"""
        SELECT asset_id, CASE asset_id % 7 WHEN 0 THEN 'Griechenland 2010' WHEN 1 THEN 'Grömitz_Ostsee' WHEN 2 THEN 'Essen 2010' WHEN 3 THEN 'Kastenlauf' WHEN 4 THEN concat('Bali-', regexp_extract(path, '([^/]*)/[^/]*$', 1)) WHEN 5 THEN NULL ELSE regexp_extract(path, '([^/]*)/[^/]*$', 1) END AS folder,
            concat(regexp_extract(path, '([^/]*)/[^/]*/[^/]*$', 1), CASE asset_id % 5 WHEN 0 THEN ' in Prag' WHEN 1 THEN ', New  York!' WHEN 2 THEN ' Promenade' ELSE '' END) AS above
        FROM ({SQL["v_paths"]}) p"""
OVERRIDES = [("New York", "New York"), ("src3", "Quelle 3"), ("PRAG", "Praha"), ("WhatsApp Images", "Handy"), ("Nirgends", "")]
FOLD = "regexp_replace(translate(replace(replace(replace(replace(lower({t}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'àáâãåçèéêëìíîïñòóôõùúûýÿ', 'aaaaaceeeeiiiinoooouuuyy'), '[^a-z0-9]+', ' ', 'g')"
QUOTED = ", ".join(f"('{k}', {'NULL' if v is None else repr(v)}, {i})" for i, (k, v) in enumerate(PLACES.items()))


@query(
    "pr15_album_places",
    oracle("v_album_names", f""", fixed(key, label, place) AS (VALUES {QUOTED}), said AS (SELECT trim({FOLD.format(t="term")}) AS key, label FROM (VALUES {", ".join(map(str, OVERRIDES))}) o(term, label) WHERE label <> ''),
    d AS (SELECT coalesce(said.key, fixed.key) AS key, coalesce(said.label, fixed.label) AS label, coalesce(place, {len(PLACES)}) AS place FROM fixed FULL JOIN said ON fixed.key = said.key WHERE coalesce(said.label, fixed.label) IS NOT NULL),
    t AS (SELECT asset_id, 0 AS nth, concat(' ', {FOLD.format(t="folder")}, ' ') AS words FROM v_album_names WHERE folder IS NOT NULL UNION ALL SELECT asset_id, 1, concat(' ', {FOLD.format(t="above")}, ' ') FROM v_album_names)
    SELECT asset_id, arg_min(label, (nth, place, key)) AS label, arg_min(key, (nth, place, key)) AS key FROM t JOIN d ON contains(words, concat(' ', key, ' ')) GROUP BY asset_id"""),
)
def pr15_albums(spark, sf_dir):
    """The place that each asset's folder names, else the directory above it, with overrides and phrases of two words."""
    dictionary = P.place_dictionary(spark, spark.createDataFrame(OVERRIDES, "term string, label string"))
    return P.detected(view(spark, sf_dir, "v_album_names").withColumn("texts", F.array("folder", "above")), dictionary, "asset_id")


# Names are the first two words of each item of the benchmark; the second words of some are allowed, the third ones of others are looked for as well.
WORDS = "(SELECT item_id, regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+') AS w FROM benchmark)"
EDGE = "[^0-9A-Za-z_À-ÖØ-öø-ÿ]"


def _pattern_sql() -> str:
    parts = []
    for i, (pattern, why) in enumerate(P.SENSITIVE):
        quoted = pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, line_no, '{why}' AS why, regexp_extract(line, '{quoted}') AS found FROM l WHERE regexp_matches(line, '{quoted}')")
    return " UNION ALL ".join(parts)


@query(
    "tx8_names_and_patterns",
    rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    n AS (SELECT item_id, w[1] AS a, w[2] AS b, w[3] AS c FROM {WORDS}),
    ok AS (SELECT DISTINCT lower(b) AS word FROM n WHERE item_id % 5 = 0),
    t AS (SELECT concat(a, ' ', b) AS term FROM n UNION SELECT x FROM (SELECT unnest([a, b]) AS x FROM n) q WHERE length(x) > 3 AND lower(x) NOT IN (FROM ok) UNION SELECT c FROM n WHERE item_id % 10 = 3),
    h AS (SELECT doc_id, line_no, arg_min(term, (-length(term), term)) AS found FROM l JOIN t ON contains(line, term) AND regexp_matches(line, '(^|{EDGE})' || term || '($|{EDGE})') GROUP BY ALL),
    p AS ({_pattern_sql()})
    SELECT doc_id, line_no, 'name' AS why, found FROM h UNION ALL SELECT doc_id, line_no, why, found FROM p WHERE NOT regexp_matches(found, '{P.DOCUMENTATION}')
    """,
)
def tx8_names(spark, sf_dir):
    """Lines that hold a name or what never belongs in a published text."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]+"), F.lit(0)).alias("w"))
    names = words.select(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("name"))
    terms = P.name_terms(names, words.where("item_id % 5 = 0").select(F.col("w")[1].alias("word")), words.where("item_id % 10 = 3").select(F.col("w")[2].alias("term")))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return P.sensitive(lines, terms, ["doc_id", "line_no"]).withColumn("line_no", F.col("line_no").cast("long"))
