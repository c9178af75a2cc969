"""URL filters that see through redirects, in SQL expressions only.

Pages name other addresses by canonical links and by refreshes. Connected components over these edges make
classes of aliases; a block rule that fits one address of a class blocks the others that no rule fits, unless
an allow rule fits one of them. A page's own rule always comes first.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.operators.graph import connected_components
from medialake.storage import stored


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?is)<link\b(?=[^<>]*\brel\s*=\s*["']?canonical\b)[^<>]*\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REFRESH = r"""(?is)<meta\b(?=[^<>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^<>]*\bcontent\s*=\s*["']?\s*[0-9.]+\s*[;,]\s*url\s*=\s*["']?([^"'>\s]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or without ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or without ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule whose host is the page's or a parent of it and whose path starts the page's; a struct or null."""
    longest = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), r.host, r.path))
    table = F.array(*(F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in longest))
    fits = F.filter(table, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    return F.get(fits, F.lit(0))


def address(url: Column) -> Column:
    """What two names of one address share: host, path (``/`` if empty) and query, without scheme and fragment."""
    path = path_of(url)
    return F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1))


def aliases(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Edges (src, dst) between addresses: canonical links and refreshes of a page; relative ones are resolved."""
    text = F.col(html)
    link = F.coalesce(*(F.nullif(F.regexp_extract(text, _LINK, k), F.lit("")) for k in (1, 2, 3)))
    named = F.array(F.when(text.rlike("(?i)canonical"), link), F.when(text.rlike("(?i)http-equiv"), F.nullif(F.regexp_extract(text, _REFRESH, 1), F.lit(""))))
    found = pages.where(F.col(url).contains("://")).select(F.col(url).alias("from"), F.explode(named).alias("to")).where("to is not null").withColumn("to", F.trim("to"))
    scheme, origin = F.substring_index("from", "://", 1), F.regexp_extract("from", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(F.col("from")), r"[^/]*$", "")
    to = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(origin, F.col("to")))
        .when(F.col("to").rlike(r"^[?#]"), F.concat(origin, path_of(F.col("from")), F.col("to")))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), F.col("to")))
    )
    return found.select(address(F.col("from")).alias("src"), address(to).alias("dst")).where("src <> dst").distinct()


def judge(pages: DataFrame, rules: list[UrlRule], redirects: DataFrame | None = None, default: str = "allow", key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A verdict for each page: ``page_id, host, path, rule, verdict, alias_class``.

    ``redirects``: more edges, as URLs in columns ``src`` and ``dst``. ``rule`` is the page's own rule (host and
    path) or null. Without one, the verdict is that of the page's class of aliases (block if a block rule fits an
    address of it and no allow rule does), else ``default``. ``alias_class`` is the class's smallest address, or
    null for a page without edges.

    Null urls or such without ``://``: empty host and path, no rule, no class. Null html: no edges. Repeated rows
    and null ids come back as they are. Empty table: empty result. The rules are a parameter, not a table.
    """
    edges = aliases(pages, key, url, html)
    if redirects is not None:
        edges = edges.union(redirects.where("src like '%://%' and dst like '%://%'").select(address(F.col("src")), address(F.col("dst")))).where("src <> dst").distinct()
    edges = stored(edges, "aliases")
    own = fitting(F.col("host"), F.col("path"), rules)
    judged = pages.select(key, F.col(url).alias("_url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("own", own)
    name = F.concat(F.col("own.host"), F.col("own.path"))
    if not edges.limit(1).count():
        return judged.select(key, "host", "path", name.alias("rule"), F.coalesce("own.verdict", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("alias_class"))
    member = stored(connected_components(edges), "classes")
    parts = member.withColumn("at", F.concat(F.lit("x://"), F.col("node")))
    parts = parts.withColumn("own", fitting(host_of(F.col("at")), path_of(F.col("at")), rules)).groupBy("component").agg(F.max(F.col("own.verdict") == "allow").alias("allowed"), F.max(F.col("own.verdict") == "block").alias("blocked"))
    said = member.join(parts, "component").select(F.col("node").alias("_node"), F.col("component").alias("alias_class"), F.when(F.col("blocked") & ~F.coalesce("allowed", F.lit(False)), F.lit("block")).alias("said"))
    judged = judged.withColumn("_node", F.when(F.col("_url").contains("://"), address(F.col("_url")))).join(said, "_node", "left")
    return judged.select(key, "host", "path", name.alias("rule"), F.coalesce("own.verdict", "said", F.lit(default)).alias("verdict"), "alias_class")
