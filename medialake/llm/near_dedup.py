"""Near-duplicate documents by bottom-k sketches.

Each distinct shingle set (a class of documents) keeps the k smallest values of one hash function. Inverted
lists of the ``listed`` smallest values generate overlaps; the estimate from the union's sketch filters; the
Jaccard similarity of the full sets confirms. What a pair at
the threshold shares is binomial: of 40 values it is fewer than 15 with a probability below ``RISK``.

A list with at most ``short`` classes yields its pairs. A longer list is never expanded: a pair found by none of
the short lists shares that many values of long lists, one of them among the first 13 of either sketch, so only
classes with as many matter, by their first values, divided by the sizes of the sets; and of these only classes
that share enough of their whole sets with others of them. Lists with the same least member are taken together; in
them an estimate would not pay, and blocks of full sets are compared as products of matrices. Components need no more
than that pairs from different components are compared. In each round some members of a list, from different
components outside its largest, are pivots and are compared with the list's members; a list is done when all its
members outside its largest component have been pivots. What remains after ``rounds`` rounds is compared at once.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.llm.batches import SPACES, chunks, lowered, mixed, rolled, small_batches, spans, utf8, whole, word_hashes, WORD_BASES
from medialake.operators.graph import connected_components
from medialake.storage import stored

RISK = 1e-9


def sure(values: int, share: float) -> int:
    """The number of shared values that a pair of this similarity has among ``values`` of its union, but for a chance of RISK."""
    below = 0.0
    for n in range(values + 1):
        below += comb(values, n) * share**n * (1 - share) ** (values - n)
        if below > RISK:
            return n
    return values


def shingle_sets(text: pa.ChunkedArray, n: int):
    """For each text its distinct n-word shingles as ascending 63-bit hashes; fewer words are one shingle, none is no shingle."""
    data, offsets = utf8(text)
    data = lowered(data)
    starts, ends, first = spans(~SPACES[data], offsets)
    words = word_hashes(data, starts, ends)
    counts = np.diff(first)
    shingles = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    cuts = np.append(0, shingles.cumsum())
    at = np.arange(cuts[-1]) + np.repeat(first[:-1] - cuts[:-1], shingles)
    long = np.minimum(np.repeat(counts, shingles), n)
    values = mixed(rolled(words, at, at + long, WORD_BASES[0]) + long.astype(np.uint64)) >> np.uint64(1)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x = np.sort(values[a:b])
        yield x[np.append(True, x[1:] != x[:-1])] if b - a > 1 else x


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).astype(np.int64)))


def least_prefix(n: int, percent: int) -> int:
    """How many of its smallest values a set of ``n`` must show so that every set of this similarity shows one of them as well."""
    return n - -(-n * percent // 100) + 1


def _sketcher(n: int, k: int, percent: int | None, size: int):
    """``percent``: keep as many values as a sure search needs, if more than ``k``."""

    def run(batches):
        for table in chunks(batches, "text", size):
            sets = list(shingle_sets(table.column("text"), n))
            kept = [x[: max(k, least_prefix(len(x), percent)) if percent else k] for x in sets]
            yield pa.RecordBatch.from_arrays(
                [whole(table.column("doc_id")),
                 pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                 _lists(kept)],
                names=["doc_id", "n_shingles", "set_id", "sketch"],
            )

    return run


def _setter(n: int, size: int):
    def run(batches):
        for table in chunks(batches, "text", size):
            yield pa.RecordBatch.from_arrays([whole(table.column("id")), whole(table.column("crowded")), _lists(list(shingle_sets(table.column("text"), n)))], names=["id", "crowded", "shingles"])

    return run


def _estimated(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose union's bottom-k estimate is not far below the threshold."""
    sides = [sets.select(F.col("id").alias(x), F.size("shingles").alias(f"n_{x}"), F.slice("shingles", 1, k).alias(f"sketch_{x}")) for x in "ab"]
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    both = F.size(F.array_intersect("union", F.array_intersect("sketch_a", "sketch_b")))
    enough = F.when(F.size("union") < k, both * 100 >= percent * F.size("union")).otherwise(both >= sure(k, percent / 100))
    return pairs.join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b").where(f"least(n_a, n_b) * 100 >= {percent} * greatest(n_a, n_b)").withColumn("union", union).where(enough).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose full sets have the similarity."""
    sides = [sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"]
    same = F.size(F.array_intersect("set_a", "set_b"))
    sized = pairs.join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b").select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), same.alias("same"))
    return sized.where(f"same * 100 >= {percent} * (n_a + n_b - same)").select("a", "b")


_RARE = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("met", pa.int64()), ("rare", pa.list_(pa.int64()))])


def _rarer(size: int):
    """For each set how many of its shingles occur in another set of the batch, and those that don't; a row without id has the shingles that do."""

    def run(batches):
        for batch in batches:
            at, cuts = 0, np.asarray(batch.column("shingles").offsets)
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + size, "right")) - 1)
                part = batch.slice(at, to - at)
                lists = part.column("shingles")
                values = lists.flatten().to_numpy()
                counts = lists.value_lengths().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(counts)), counts)
                distinct, back, times = np.unique(values, return_inverse=True, return_counts=True)
                single = times[back] == 1
                alone = np.bincount(row[single], minlength=len(counts))
                ends = np.concatenate([[0], alone.cumsum(), [alone.sum() + (times > 1).sum()]]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([values[single], distinct[times > 1]])))
                ids = pa.concat_arrays([part.column("id").cast(pa.int64()), pa.nulls(1, pa.int64())])
                more = lambda x: pa.array(np.append(x, 0).astype(np.int64))
                yield pa.RecordBatch.from_arrays([ids, more(counts), more(counts - alone), rare], schema=_RARE)
                at = to

    return run


def _shareable(sets: DataFrame, percent: int, size: int = 1_000_000) -> DataFrame:
    """(id, n, shared): how many shingles of each set occur in another of the sets; sets that share too few for any link are left out.

    Tasks settle what their batches share; only shingles that are single there are joined with those of other batches.
    """
    drawn = stored(sets.select("id", "shingles").mapInArrow(_rarer(size), "id long, n long, met long, rare array<long>"), "rare")
    again = drawn.select(F.explode("rare").alias("shingle")).groupBy("shingle").count().where("count > 1").select("shingle")
    own = drawn.where("id is not null")
    more = own.select("id", F.explode("rare").alias("shingle")).join(again.hint("merge"), "shingle").groupBy("id").agg(F.count("*").alias("more"))
    shared = own.select("id", "n", "met").join(more.hint("merge"), "id", "left").select("id", "n", (F.col("met") + F.coalesce("more", F.lit(0))).alias("shared"))
    return shared.where(f"shared * 100 >= {percent} * n").dropDuplicates(["id"])


def _stars(crowded: DataFrame, able: DataFrame) -> DataFrame:
    """Members (id, n, shared, stars): each list goes by its least member, so that the lists of one group fall together."""
    rows = crowded.join(able.hint("merge"), "id").select("id", "n", "shared", F.explode("values").alias("value"))
    stars = rows.groupBy("value").agg(F.min("id").alias("star"), F.count("*").alias("n_")).where("n_ > 1").select("value", "star")
    return rows.join(stars.hint("merge"), "value").groupBy("id", "n", "shared").agg(F.collect_set("star").alias("stars"))


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _grid(percent: int, columns: int = 8192):
    """Links between two blocks of sets: intersection sizes are products of their incidence matrices, some columns at a time."""

    def run(table: pa.Table) -> pa.Table:
        sides = []
        for asks in (False, True):
            part = table.filter(pa.compute.equal(table.column("asks"), asks))
            lists = whole(part.column("shingles"))
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            sides.append([part.column("id").to_numpy(), part.column("component").to_numpy(), counts, lists.flatten().to_numpy(), np.repeat(np.arange(len(counts)), counts)])
        both = np.intersect1d(sides[0][3], sides[1][3])
        inside = []
        for ids, _, _, values, row in sides:
            at = np.searchsorted(both, values)
            hit = np.flatnonzero(both[np.minimum(at, max(len(both) - 1, 0))] == values) if len(both) else np.zeros(0, np.int64)
            order = hit[np.argsort(at[hit], kind="stable")]
            inside.append((at[order], row[order]))
        same = np.zeros((len(sides[0][0]), len(sides[1][0])), np.float32)
        for c in range(0, len(both), columns):
            width = min(columns, len(both) - c)
            parts = []
            for (at, row), side in zip(inside, sides, strict=True):
                lo, hi = np.searchsorted(at, [c, c + width])
                m = np.zeros((len(side[0]), width), np.float32)
                m[row[lo:hi], at[lo:hi] - c] = 1
                parts.append(m)
            same += parts[0] @ parts[1].T
        n = sides[0][2][:, None] + sides[1][2][None, :]
        x, y = np.nonzero((same * 100 >= percent * (n - same)) & (sides[0][1][:, None] != sides[1][1][None, :]))
        a, b = sides[0][0][x], sides[1][0][y]
        return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_LINKS)

    return run


def _crowded_links(members: DataFrame, links: DataFrame, sets: DataFrame, percent: int, pivots: int, rounds: int, block: int = 500_000) -> DataFrame:
    """Components (node, component) of ``links`` and of all links between the long lists' members (id, n, shared, stars).

    ``block`` bounds the shingles of a block of sets; a block has at most a 500th of that in sets.
    """
    pivoted = None
    known = stored(connected_components(links, "a", "b"), "components")
    for turn in range(rounds + 1):
        placed = members.join(known.hint("merge"), F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
        at = stored(placed.select("id", "component", "n", "shared", F.greatest("n", F.lit(500)).alias("weight"), F.explode("stars").alias("star")), "crowd")
        # A list's main component is its largest; pairs within a component need no comparison.
        sizes = at.groupBy("star", "component").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.sum("weight").alias("weight"))
        main = sizes.groupBy("star").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("main"), F.count("*").alias("parts"), F.min("least").alias("least"), F.ceil(F.sum("weight") / block).cast("int").alias("blocks")).where("parts > 1")
        outside = at.join(main.hint("merge"), "star").where("component <> main").where(f"shared * 100 >= {percent} * (n + least - shared)").select("star", "id", "component", "weight", "blocks", (F.col("n") / F.col("shared")).alias("alone"))
        if pivoted is not None:
            outside = outside.join(pivoted.hint("merge"), ["star", "id"], "left_anti")
        outside = stored(outside, "outside")
        if not outside.limit(1).count():
            break
        chosen = outside
        if turn < rounds:  # those that have the most in common with others, of each component one before others follow; at last the rest, however many
            turns = F.row_number().over(Window.partitionBy("star", "component").orderBy("alone", "id"))
            place = F.row_number().over(Window.partitionBy("star").orderBy("turns", "alone", "id"))
            chosen = outside.withColumn("turns", turns).withColumn("place", place).where(F.col("place") <= pivots * 16**turn)
        chosen = stored(chosen.select("star", "id", "component", "weight", "blocks"), "pivots")
        done = chosen.select("star", "id")
        pivoted = done if pivoted is None else pivoted.union(done)
        shape = chosen.groupBy("star").agg(F.first("blocks").alias("blocks"), F.ceil(F.sum("weight") / block).cast("int").alias("asking"))
        cell = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) as int)")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        listed = at.join(shape.hint("merge"), "star").select("star", "id", "component", F.lit(False).alias("asks"), cell("blocks").alias("x"), every("asking").alias("y"))
        asking = chosen.drop("blocks").join(shape.hint("merge"), "star").select("star", "id", "component", F.lit(True).alias("asks"), every("blocks").alias("x"), cell("asking").alias("y"))
        cells = listed.union(asking).join(sets.select("id", "shingles").hint("merge"), "id").groupBy("star", "x", "y").applyInArrow(_grid(percent), "a long, b long")
        known = _merged(known, stored(cells.distinct(), "links"))
    return known


def _merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links, by the components of a graph of components."""
    named = links
    for side in "ab":
        names = known.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        named = named.join(names, side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    new = stored(connected_components(named.where("c_a <> c_b").select("c_a", "c_b").distinct(), "c_a", "c_b").withColumnsRenamed({"node": "was", "component": "is"}), "merged")
    moved = known.join(new, F.col("component") == F.col("was"), "left").select("node", F.coalesce("is", "component").alias("component"))
    single = new.join(known, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("is").alias("component"))
    return stored(moved.union(single), "components")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = 64, listed: int = 40, short: int = 16, pivots: int = 8, rounds: int = 2, exact: bool = False, chunk_bytes: int = 1_500_000) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``percent`` per cent.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space; a set holds the distinct shingles of
    ``shingle`` words (fewer words: the whole sequence as one). Returns for each row ``doc_id, n_shingles,
    component_id`` (smallest ``doc_id`` reachable, itself included) and ``kept`` (``doc_id = component_id``).

    Every link is confirmed on full sets. A link is missed with a chance of at most about ``RISK``; with ``exact`` none is: each
    set then lists a fifth of its values at a similarity of 0.8 (``least_prefix``), of which any two similar sets share
    one, and no estimate filters.

    Null, empty or blank text: an empty set, linked with nothing. Equal sets are one class, joined by id only.
    Rows with a null ``doc_id`` come back with a null component and are kept. Repeated ids with one text are one
    document (each row comes back); an id with several texts counts as all of them. Empty table: empty result.
    """
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", "text")
    drawn = stored(source.mapInArrow(_sketcher(shingle, k, percent if exact else None, chunk_bytes), "doc_id long, n_shingles long, set_id binary, sketch array<long>"), "sketches")
    known = drawn.where("set_id is not null and doc_id is not null")
    heads = known.select("doc_id", "set_id").groupBy("set_id").agg(F.min("doc_id").alias("id"))
    # A class is its smallest document; other documents of it, exact copies, leave. Here and below joins are
    # merges at every size, so that small inputs show what large ones will cost.
    copies = stored(known.select("doc_id", "set_id").join(heads.hint("merge"), "set_id").where("doc_id <> id").select("doc_id", "set_id"), "copies")
    classes = known.join(copies.hint("merge"), ["doc_id", "set_id"], "left_anti").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch")
    share = percent / 100
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 if exact else F.lit(listed)
    need = F.lit(1) if exact else F.least(F.lit(sure(listed, share)), F.ceil(F.col("n") * percent / 100))
    first = 2**31 - 1 if exact else next(m for m in range(1, 10_000) if (1 - share) ** m < RISK)  # a similar pair shares one of its union's first values
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)))  # sizes that allow a link differ by at most one step
    entries = classes.select(F.posexplode(F.slice("sketch", F.lit(1), length.cast("int"))).alias("place", "value"), "id", "n").select("value", "id", (F.col("n") * 2 + (F.col("place") < first).cast("long")).alias("x"))
    sizes = entries.groupBy("value").count().where("count > 1")
    lists = stored(entries.join(sizes.hint("merge"), "value").select("value", "id", (F.col("x") % 2 == 1).alias("early"), F.expr("x div 2").alias("n"), "count").distinct().withColumns({"need": need, "step": step}), "inverted")
    hot = stored(lists.where(F.col("count") > short).groupBy("id").agg(F.count("*").alias("hot"), F.min("need").alias("need")), "hot")

    brief = lists.where(F.col("count") <= short)
    mine, other = brief.select("value", F.col("id").alias("a"), "need"), brief.select("value", F.col("id").alias("b"), F.col("need").alias("need_b"))
    pairs = mine.join(other.hint("merge"), "value").where("a < b").groupBy("a", "b").agg(F.count("*").alias("overlap"), F.min(F.least("need", "need_b")).alias("need"))
    for side in "ab":
        pairs = pairs.join(hot.select(F.col("id").alias(side), F.col("hot").alias(f"hot_{side}")), side, "left")
    pairs = pairs.where("overlap + least(coalesce(hot_a, 0), coalesce(hot_b, 0)) >= need").select("a", "b")
    pairs = stored(pairs, "pairs")

    # Longer lists are divided by size, with an overlap of a step.
    long = lists.where((F.col("count") > short) & F.col("early")).join(hot.where("hot >= need").select("id"), "id", "left_semi")
    divided = long.select("id", F.explode(F.array(F.xxhash64("value", "step"), F.xxhash64("value", F.col("step") + 1))).alias("value"))
    again = divided.groupBy("value").count().where("count > 1").select("value")
    crowded = stored(divided.join(again.hint("merge"), "value").groupBy("id").agg(F.collect_list("value").alias("values")), "crowded")  # at most twice ``first`` values each
    ends = [pairs.select(F.col(x).alias("id"), F.lit(False).alias("crowded")) for x in "ab"]
    wanted = stored(ends[0].union(ends[1]).union(crowded.select("id", F.lit(True))).groupBy("id").agg(F.max("crowded").alias("crowded")), "wanted")
    # From here on only classes matter that stand in a pair or a long list.
    sets = stored(source.withColumnRenamed("doc_id", "id").join(wanted.hint("merge"), "id").mapInArrow(_setter(shingle, chunk_bytes), "id long, crowded boolean, shingles array<long>"), "sets")
    links = stored(_linked(pairs if exact else _estimated(pairs, sets, k, percent), sets, percent), "links")
    able = stored(_shareable(sets.where("crowded"), percent), "shareable")
    crowded_sets = stored(sets.where("crowded").dropDuplicates(["id"]).join(able.hint("merge"), "id"), "sets")
    members = stored(_stars(crowded, able), "members")

    # Classes of one document (an id that names several texts) belong together as well.
    member = known.select("doc_id", "set_id").distinct().join(heads, "set_id").select("doc_id", "id")
    first_of = stored(member.groupBy("doc_id").agg(F.min("id").alias("head"), F.max("id").alias("last")), "heads")
    if first_of.where("head <> last").limit(1).count():
        links = links.union(member.join(first_of.where("head <> last"), "doc_id").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")))
    found = _crowded_links(members, links, crowded_sets, percent, pivots, rounds).withColumnRenamed("node", "head")
    placed = first_of.select("doc_id", "head").join(found, "head", "left").select("doc_id", F.coalesce("component", "head").alias("component_id"))
    return drawn.select("doc_id", "n_shingles").join(placed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
