"""DuckDB SQL of queries whose statement is long: rules of addresses, repaired conversations, spelling variants. Checksums and the programme are told step by step."""

from __future__ import annotations

LATIN = "".join(chr(c) for c in range(192, 256))
STAND_INS = "".join(chr(c) for c in range(33, 97)).replace("'", "''")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32_sql(text: str) -> str:
    """The crc32 of a text, not empty, of ASCII and letters up to U+00FF, bit by bit."""
    data = f"list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END).flatten()"
    step = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda a, b: {step}), 4294967295::BIGINT)"


OP13 = f"""
    WITH RECURSIVE w AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS word FROM documents),
    d AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 6 GROUP BY ALL),
    h AS (SELECT word, n, {crc32_sql("concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', word)")} AS h FROM d),
    v AS (SELECT CASE WHEN h % 199 = 0 THEN concat(left(word, h % length(word)), substr(word, h % length(word) + 2)) ELSE word END AS word, n FROM h),
    c AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    s AS (SELECT DISTINCT word, n, unnest(list_prepend(word, list_transform(range(0, length(word)), lambda i: concat(left(word, i), substr(word, i + 2))))) AS part FROM c),
    p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM s a JOIN s b ON a.part = b.part AND a.word <> b.word WHERE levenshtein(translate(a.word, '{LATIN}', '{STAND_INS}'), translate(b.word, '{LATIN}', '{STAND_INS}')) = 1),
    m AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
    f AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * c.n THEN near END AS form, CASE WHEN near_n >= 5 * c.n THEN near_n END AS form_n FROM c LEFT JOIN m ON m.word = c.word),
    r AS (SELECT word, word AS at, 0 AS steps FROM f UNION ALL SELECT r.word, form, steps + 1 FROM r JOIN f ON f.word = r.at WHERE form IS NOT NULL)
    SELECT f.word, form, (SELECT arg_max(r.at, steps) FROM r WHERE r.word = f.word) AS root, n, n_near, form_n FROM f
"""
NEXT = "CASE WHEN {s} = 2 THEN 3 ELSE 2 END"  # the state behind an inserted or reroled turn
KEPT = "CASE WHEN {s} = 0 AND init = 's' THEN 1 WHEN {s} <> 2 AND init = 'u' THEN 2 WHEN {s} = 2 AND init = 'a' THEN 3 END"
BIG = 1 << 40


def before_sql(s: int) -> str:
    """The least cost before a row in state ``s``, of the costs ``v`` behind it."""
    keep = KEPT.format(s=s)
    return f"least(2 + v[{s + 1}], CASE WHEN gone THEN {BIG} ELSE more + least(1 + v[{NEXT.format(s=s)} + 1], coalesce(v[{keep} + 1], {BIG})) END)"


OP12 = f"""
    WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS fate FROM conversations),
    d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM o, range(CASE WHEN fate = 3 THEN 2 ELSE 1 END) WHERE fate <> 0),
    n AS (SELECT coalesce(CAST(conv_id AS VARCHAR), 'null') AS c, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
    k AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS init FROM n),
    t AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM k),
    e AS (SELECT c, max(i) AS rows FROM t GROUP BY c),
    b AS (SELECT c, rows AS i, [0, 10, 5, 0]::BIGINT[] AS v FROM e
        UNION ALL SELECT c, i, [least(w[1], 5 + least(w[3], 5 + w[4])), least(w[2], 5 + least(w[3], 5 + w[4])), least(w[3], 5 + w[4]), least(w[4], 5 + w[3])] FROM (SELECT b.c, b.i - 1 AS i, [{", ".join(before_sql(s) for s in range(4))}]::BIGINT[] AS w FROM b JOIN t ON t.c = b.c AND t.i = b.i) q),
    g AS (SELECT c, 0::BIGINT AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS lines FROM e
        UNION ALL SELECT c, i + CASE WHEN edit = 'I' THEN 0 ELSE 1 END, CASE edit WHEN 'D' THEN s WHEN 'K' THEN {KEPT.format(s="s")} ELSE {NEXT.format(s="s")} END, audit || edit,
            CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN edit = 'R' THEN text ELSE '' END) END
        FROM (SELECT g.*, t.role, t.text, t.init, CASE WHEN t.i IS NULL THEN 'I' WHEN x.v[s + 1] = 2 + y.v[s + 1] THEN 'D' WHEN x.v[s + 1] = 5 + x.v[{NEXT.format(s="s")} + 1] THEN 'I' WHEN x.v[s + 1] = more + y.v[{KEPT.format(s="s")} + 1] THEN 'K' ELSE 'R' END AS edit
            FROM g JOIN b x ON x.c = g.c AND x.i = g.i LEFT JOIN t ON t.c = g.c AND t.i = g.i + 1 LEFT JOIN b y ON y.c = g.c AND y.i = g.i + 1 WHERE t.i IS NOT NULL OR s NOT IN (0, 3)) q),
    z AS (SELECT c, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM g GROUP BY c),
    m AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM t GROUP BY c),
    l AS (SELECT c, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT c, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair FROM t) q GROUP BY c)
    SELECT u.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.v[1], 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS c FROM conversations) u LEFT JOIN m ON m.c = u.c LEFT JOIN l ON l.c = u.c LEFT JOIN z ON z.c = u.c LEFT JOIN b ON b.c = u.c AND b.i = 0
"""
OP7 = rf"""
    WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path, row_number() OVER () AS n FROM pages),
    r(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
    f AS (SELECT n, arg_max(concat(h, q), length(h) + length(q)) AS rule, arg_max(v, length(h) + length(q)) AS v FROM p JOIN r ON (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, q) GROUP BY n)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f ON f.n = p.n
"""
