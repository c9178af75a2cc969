"""Main text of web pages by a tree-structured graphical model.

A page is its DOM tree of blocks; inline markup belongs to the text around it, and each run of text is a leaf.
Every node is in one of three states: outside the article, inside it, or around both. Potentials between parent
and child, and of a node's features, are log likelihoods counted on labelled pages; sum-product messages, upward
and then downward, give each leaf's marginal, and leaves that are more likely inside are the text.

Labelled pages are made by ``labelled_pages`` below from fixed parts, and there is a bounded sample of the table's own pages that
mark their article themselves, by exactly one ``article`` or ``main`` element.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from html import unescape
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.batches import small_batches

OUTSIDE, INSIDE, AROUND = 0, 1, 2

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head script style noscript template svg select option button textarea iframe object canvas title datalist".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
STRUCTURE = frozenset("nav header footer aside form article main section search dialog menu address details fieldset".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "button": {"button"}, "select": {"select"}, "input": {"select"}, "textarea": {"select"}}
KEEP_IN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select", "datalist"}}
# Unseen elements that an item or cell around them doesn't reach into; controls hold no item or cell of the list or table around them.
WALLS = UNSEEN - {"select", "option", "button", "datalist"}
# What a head may hold, and what ends an unclosed svg.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
NOT_SVG = STRUCTURE | frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)([^>]*)>|<[!?/][^>]*>|<[A-Za-z/!?][^>]*\Z""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|data-main)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile("[a-z]+")
_ENDS = re.compile(r"[.!?…。](?:\s|$)")


class Node:
    """An element, or a run of text (``text`` is set)."""

    __slots__ = ("parent", "features", "text", "mark", "chars", "linked", "tag")

    def __init__(self, parent, tag, features, text=None, mark=None, chars=0, linked=0):
        self.parent, self.tag, self.features, self.text, self.mark, self.chars, self.linked = parent, tag, features, text, mark, chars, linked


def _size(n: int) -> int:
    return 0 if n < 15 else 1 if n < 40 else 2 if n < 100 else 3 if n < 250 else 4


def _share(linked: int, chars: int) -> int:
    return -1 if not chars else 0 if not linked else 1 if linked * 4 < chars else 2 if linked * 4 < chars * 3 else 3


def _attributes(tag: str, text: str) -> tuple[list[str], str | None]:
    features, mark = [f"{'tag' if tag in STRUCTURE else 'block'} {tag}"], None
    if text and not text.isspace():
        words = set()
        for m in _NAMED.finditer(text):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "data-main":
                mark = value
            elif name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    features.append("unseen")
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                features.append("unseen")
            else:
                words.update(_WORDS.findall(value))
        features += [f"word {w}" for w in sorted(words)]
    return features, mark


def parse(html: str) -> list[Node]:
    """The page's nodes, parents before children, in page order. Tolerates unclosed, misnested and cut-off markup.

    Elements that aren't seen, and what they hold, are on the stack of open elements as well, without nodes: an end tag
    of an outer element ends them, a new option, button or select ends the open one, what a head can't hold ends the
    head, and HTML's own blocks end an svg. As in browsers, an unclosed script, style, textarea, title or iframe
    takes all that follows.
    """
    nodes = [Node(-1, "", ["block "])]
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # element, its node (or that around it), whether it is unseen
    open_ = Counter()  # elements on the stack, by name
    run, at, linked, in_link = [], 0, 0, False

    def push(tag: str, node: int, unseen: bool):
        stack.append((tag, node, unseen))
        open_[tag] += 1

    def cut(k: int):
        for tag, _, _ in stack[k:]:
            open_[tag] -= 1
        del stack[k:]

    def flush():
        nonlocal run, linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                link = min(len(text), linked)
                nodes.append(Node(stack[-1][1], "", [f"size {_size(len(text))}", f"links {_share(link, len(text))}", f"ends {bool(_ENDS.search(text))}"], text, None, len(text), link))
            run, linked = [], 0

    def close(names, within=()) -> bool:
        """Ends the nearest open element of these names, and all inside it, unless one of ``within`` comes first."""
        if not any(open_[x] for x in names):
            return False
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in within:
                return False
            if stack[k][0] in names:
                flush()
                cut(k)
                return True
        return False

    end = len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        upto = m.start() if m else end
        if upto > at:
            if stack[-1][0] == "head" and not html[at:upto].isspace():
                cut(len(stack) - 1)
            if not stack[-1][2]:
                run.append(html[at:upto])
                if in_link:
                    linked += upto - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # a closing tag
            if tag == "a":
                in_link = False
            if tag in INLINE or tag in VOID:
                continue
            if not close({tag}) and tag == "p" and not stack[-1][2]:
                flush()
            continue
        alone = (m[3] or m[6] or "").endswith("/")
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            cut(len(stack) - 1)
        if stack[-1][2]:
            in_svg = False
            for k in range(len(stack) - 1, 0, -1) if open_["svg"] else ():
                if stack[k][0] in ("foreignobject", "desc"):  # holds HTML
                    break
                if stack[k][0] == "svg":
                    in_svg = True
                    break
            if in_svg and tag in NOT_SVG:
                cut(k)
            elif in_svg and alone:
                continue
            if tag == "body":
                while stack[-1][2]:
                    cut(len(stack) - 1)
        if tag in CLOSES:  # an item ends the item before it, up to their list or table
            close(CLOSES[tag], WALLS.union(KEEP_IN.get(tag, ())))
        if tag in UNSEEN:
            flush()
            if tag in RAW:
                ending = re.compile(rf"</{tag}\b[^<>]*+>", re.I).search(html, at)
                at = ending.end() if ending else end
            elif not alone:
                push(tag, stack[-1][1], True)
            continue
        unseen = stack[-1][2]
        if tag == "a" and not unseen:
            in_link = True
        if tag == "br" and not unseen:
            run.append(" ")
        if tag in INLINE:
            continue
        flush()
        if tag in VOID:
            continue
        if stack[-1][0] == "p":
            cut(len(stack) - 1)
        if unseen:
            push(tag, stack[-1][1], True)
            continue
        in_link = False
        features, mark = _attributes(tag, m[3] or m[6] or "")
        nodes.append(Node(stack[-1][1], tag, features, None, mark))
        push(tag, len(nodes) - 1, False)
    flush()
    for n in reversed(nodes):
        if n.parent >= 0:
            nodes[n.parent].chars += n.chars
            nodes[n.parent].linked += n.linked
    for n in nodes:
        if n.text is None:
            n.features.append(f"below {_share(n.linked, n.chars)} {_size(n.chars // 4)}")
    return nodes


def labels(nodes: list[Node]) -> list[int]:
    """States of a labelled page: ``data-main`` is 1 on what is inside and 0 on what is not; descendants inherit it."""
    marks: list[str | None] = []
    for n in nodes:
        marks.append(n.mark if n.mark is not None else marks[n.parent] if n.parent >= 0 else None)
    states = [INSIDE if m == "1" else OUTSIDE for m in marks]
    for k in range(len(nodes) - 1, 0, -1):  # children before parents
        if marks[k] == "1" or states[k] == AROUND:
            p = nodes[k].parent
            if marks[p] != "1":
                states[p] = AROUND
    return states


# What pages' own markup says: the article is inside, save what is never part of it.
_NOT_MAIN = frozenset("nav footer aside header form".split())


def self_labelled(html: str) -> list[Node] | None:
    """The nodes of a page that marks its article with exactly one ``article`` or else ``main`` element, marked alike."""
    nodes = parse(html)
    for name in ("article", "main"):
        found = [n for n in nodes if n.tag == name]
        if len(found) == 1:
            for n in nodes:
                n.mark = "1" if n is found[0] else "0" if n.tag in _NOT_MAIN else None
            return nodes
        if found:
            return None
    return None


def counted(nodes: list[Node], states: list[int]) -> Counter:
    """Counts of (state, feature), and of (parent's state, state, leaf or not)."""
    out: Counter = Counter()
    for n, s in zip(nodes, states, strict=True):
        for f in n.features:
            out[f"f\t{f}\t{s}"] += 1
        out[f"s\t{n.text is not None}\t{s}"] += 1
        if n.parent >= 0:
            out[f"e\t{n.text is not None}\t{states[n.parent]}\t{s}"] += 1
    return out


# How far each kind of feature is believed: sizes and links say much the same, so they count less.
TRUST = {"tag": 2.0, "block": 0.3, "word": 3.0, "unseen": 3.0, "below": 0.15, "size": 0.2, "links": 0.6, "ends": 0.2}


class Model:
    """Potentials from counts: smoothed likelihoods of features by state, and of a child's state by its parent's."""

    def __init__(self, counts: dict[str, float], smooth: float = 0.5, trust: dict[str, float] = TRUST):
        total, self.features, self.edges = {}, {}, {}
        for key, n in counts.items():
            if key[0] == "s":
                _, leaf, s = key.split("\t")
                total[leaf, int(s)] = total.get((leaf, int(s)), 0) + n
        seen: dict[str, list[float]] = {}
        for key, n in counts.items():
            if key[0] == "f":
                _, f, s = key.split("\t")
                seen.setdefault(f, [0.0, 0.0, 0.0])[int(s)] += n
        for f, n in seen.items():
            kind = f.split(" ")[0]
            leaf = str(kind in ("size", "links", "ends"))
            self.features[f] = tuple(trust[kind] * log((n[s] + smooth) / (total.get((leaf, s), 0) + 2 * smooth)) for s in range(3))
        for leaf in ("True", "False"):
            for p in range(3):
                row = [counts.get(f"e\t{leaf}\t{p}\t{s}", 0) + smooth * (1 if leaf == "False" or s < 2 else 0) for s in range(3)]
                if p == OUTSIDE:
                    row = [row[0], row[1] * 0.1, row[2] * 0.1]
                self.edges[leaf == "True", p] = tuple(x / sum(row) for x in row)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's probability of being inside, by one pass of messages up and one down."""
        own, none = [], (0.0, 0.0, 0.0)
        for n in nodes:
            a = b = c = 0.0
            for f in n.features:
                x, y, z = self.features.get(f, none)
                a, b, c = a + x, b + y, c + z
            if n.text is not None:
                c = -50.0
            top = max(a, b, c)
            own.append([exp(a - top), exp(b - top), exp(c - top)])
        up: list = [None] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            n, (a, b, c) = nodes[k], own[k]
            m = []
            for p in range(3):
                x, y, z = self.edges[n.text is not None, p]
                m.append(x * a + y * b + z * c)
            top = max(m)
            up[k] = m = [x / top for x in m]
            q = own[n.parent]
            q[0] *= m[0]
            q[1] *= m[1]
            q[2] *= m[2]
            if (top := max(q)) < 1e-100:
                q[:] = [x / top for x in q]
        belief, out = [None] * len(nodes), []
        for k, n in enumerate(nodes):
            a, b, c = own[k]  # holds all that came from below
            if n.parent >= 0:
                q, m = belief[n.parent], up[k]
                d = [q[p] / max(m[p], 1e-300) for p in range(3)]  # the parent's belief without this child
                e = [self.edges[n.text is not None, p] for p in range(3)]
                a, b, c = (y * sum(d[p] * e[p][s] for p in range(3)) for s, y in enumerate((a, b, c)))
            else:
                a, b = a * 1e-3, b * 1e-3  # the page as a whole is around the article
            t = a + b + c
            belief[k] = (a / t, b / t, c / t) if t > 0 else (1.0, 0.0, 0.0)
            out.append(belief[k][1])
        return out

    def blocks(self, html: str) -> list[str]:
        nodes = parse(html)
        if all(n.tag in ("", "html", "body") for n in nodes):  # text without markup
            return [n.text for n in nodes if n.text is not None]
        return [n.text for n, p in zip(nodes, self.marginals(nodes), strict=True) if n.text is not None and p > 0.5]


# What labelled pages are made of. Names of boxes that aren't the article, with the elements that may bear them.
_BOXES = {
    "nav": "nav navbar navigation menu topmenu breadcrumb breadcrumbs pagination pager toc skip links",
    "header": "header masthead topbar site logo top",
    "footer": "footer bottom copyright legal imprint colophon contentinfo",
    "aside": "sidebar aside widget related recommended trending popular complementary archive rail more",
    "form": "form search login signup register subscribe newsletter contact",
    "div": "ad ads advert advertisement adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert warning message popup modal overlay dialog share social sharing tags rating feedback toolbar paywall",
    "section": "comment comments commentlist reply replies responses discussion disqus respond reader",
}
_CONTENT = "content main article post entry body story text page maincontent postbody articlebody"
_AROUND = "container wrapper layout row column site page outer inner"
_SENTENCES = (
    "The river rose for three days, and on the fourth the old bridge gave way near the mill.", "Nobody was hurt, but the road to the valley was closed until spring.", "It was late when they came home.", "He did not answer.",
    "People had to walk over the hill to reach the market, which took them the better part of a day.", "The lamps were still burning in the hall", "A letter lay on the table", "Why had no one told her?",
)


def labelled_pages(n: int = 300) -> list[str]:
    """Pages with boxes around and inside an article; data-main="1" marks what is inside, "0" what stands in it and is not."""
    pages = []
    for k in range(n):
        r = random.Random(k)
        words = lambda least, most: " ".join(r.choice(_SENTENCES) for _ in range(r.randint(least, most)))
        link = lambda: f"<a href=/{r.random()}>{' '.join(r.choice(_SENTENCES).split()[: r.randint(1, 4)])}</a>"
        flow = lambda: "".join(r.choices([lambda: f"<p>{words(1, 4)}</p>", lambda: f"<h2>{r.choice(_SENTENCES)}</h2>", lambda: f"<ul><li>{words(1, 1)}</li><li>{words(1, 2)}</li></ul>", lambda: f"<blockquote>{words(1, 2)}</blockquote>", lambda: f"<table><tr><td>{words(1, 1)}</td><td>{words(1, 1)}</td></tr></table>"], [12, 2, 1, 1, 1])[0]() for _ in range(r.randint(1, 6)))

        def box(kind: str, inside: bool) -> str:
            name = " ".join(r.sample(_BOXES[kind].split(), r.choice([1, 1, 2])))
            tag = r.choice([kind, "div", "section"]) if r.random() < 0.7 else "div"
            given = f" {r.choice(['class', 'class', 'id'])}='{name}'" if tag == "div" or tag == "section" or r.random() < 0.5 else ""
            if kind in ("nav", "header"):
                inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 7))) + "</ul>" + (f"<p>{words(1, 1)}</p>" if r.random() < 0.3 else "")
            elif kind == "section":
                inner = "<h3>Comments</h3>" + "".join(f"<div class=comment><p>{words(1, 4)}</p></div>" if r.random() < 0.6 else f"<p>{words(1, 3)}</p>" for _ in range(r.randint(1, 4)))
            else:
                inner = r.choice(["", f"<h3>{words(1, 1)}</h3>"]) + r.choice([f"<p>{words(1, 3)}</p>", words(1, 3), f"<p>{words(1, 1)} {link()}</p>", f"{link()} {link()}", flow()])
            return f"<{tag}{given}{' data-main=0' if inside else ''}>{inner}</{tag}>"

        parts = [r.choice([f"<h1>{r.choice(_SENTENCES)}</h1>", ""]), *(flow() for _ in range(r.randint(1, 3)))]
        for kind in _BOXES:
            if r.random() < 0.18:
                parts.insert(r.randint(1, len(parts)), box(kind, True))
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        name = f" class='{' '.join(r.sample(_CONTENT.split(), r.choice([1, 2])))}'" if tag in ("div", "section") and r.random() < 0.9 or r.random() < 0.2 else ""
        main = f"<{tag}{name} data-main=1>{''.join(parts)}</{tag}>"
        if r.random() < 0.2:  # an article without an element of its own
            main = "".join(x if "data-main" in x else re.sub(r"<(p|h1|h2|ul|blockquote|table)>", r"<\1 data-main=1>", x) for x in parts)
        before = [box(kind, False) for kind in ("header", "nav", "div", "form", "aside") if r.random() < 0.5]
        after = [box(kind, False) for kind in ("section", "aside", "div", "form", "footer") if r.random() < 0.5]
        whole = "".join([*before, main, *after])
        if r.random() < 0.4:
            whole = f"<div class='{r.choice(_AROUND.split())}'>{whole}</div>"
        pages.append(f"<body>{whole}</body>")
    return pages


def train(pages: DataFrame, sample: int = 2000, share: float = 0.5) -> Model:
    """Counts over ``labelled_pages`` and about ``sample`` self-labelled pages, chosen by a hash; the table's weigh ``share`` times as much."""
    written: Counter = Counter()
    for html in labelled_pages():
        nodes = parse(html)
        written.update(counted(nodes, labels(nodes)))

    def run(batches):
        out: Counter = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                if nodes := self_labelled(html):
                    out.update(counted(nodes, labels(nodes)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array(list(out.values()), pa.int64())], names=["key", "n"])

    able = pages.where(F.lower("html").rlike("<(article|main)[ >]"))
    size = able.count()
    if size:
        drawn = able.where(F.expr("pmod(xxhash64(html), 1000000) / 1000000.0") < min(1.0, sample / size)).select("html")
        own = drawn.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
        # A feature that a single page of the sample has says little and could be without bound; the rest is bounded by the sample.
        found = {r["key"]: r["n"] for r in own.where("n > 1").collect()}
        scale = share * sum(written.values()) / max(1, sum(found.values()))
    else:
        found, scale = {}, 0.0
    return Model({k: written.get(k, 0) + scale * found.get(k, 0) for k in {*written, *found}})


def extract(pages: DataFrame, model: Model | None = None, sample: int = 2000) -> DataFrame:
    """The main text of each row's whole html: ``page_id, url, text, n_chars, n_blocks``.

    Character references are decoded, white space inside a block is one space, blocks are joined by a newline in
    page order. Null or empty html, and pages without an article: empty text. Null ids and urls and repeated rows
    come back as they are. Empty table: empty result (the model is then trained on ``labelled_pages`` alone).
    """
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or train(pages, sample))  # a few thousand potentials

    def run(batches):
        for batch in batches:
            blocks = [shared.value.blocks(html) if html else [] for html in batch.column("html").to_pylist()]
            texts = ["\n".join(b) for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, blocks), pa.int32())], names=["page_id", "url", "text", "n_chars", "n_blocks"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks int")
