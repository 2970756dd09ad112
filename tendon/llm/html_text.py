"""Main text of web pages by wrapper induction.

Pages of a host share a template. A page's DOM tree has runs of siblings with one label as one repeated node, which keeps
trees small and lets lists and paragraphs vary in number; labels of siblings then differ, so a node's place is the path of
labels to it. Spark counts, for every host, place and text, the pages that have it, over all pages (``wrappers``); the counted
places are the host's wrapper, children in their mean order. A page is aligned with it by simple tree matching: the largest set
of matched nodes with equal labels that keeps order and parenthood, so the best matching of two nodes' children is a heaviest
rising sequence.

A node of the wrapper keeps the texts seen at its place. Texts that most of the pages repeat are template, wherever
they stand, also inside the article; the rest varies. The content slot is found from the root by going to the child
that holds nearly all of the varying text; what an element is called (article, navigation, advert) only weighs the
children. Each page is aligned with its host's wrapper: what is matched to the content slot is its content, less
template texts. A page whose content would be template for the most part (a copy of other pages) keeps it; a page
that doesn't fit, or has a host of its own, is its own wrapper.

What the pages of a host can't tell, those of all hosts together do: Spark counts, for every place and text, the pages of all hosts that have it. A place nearly all of whose text is repeated, while most of all
places' text together is not, is template on every host (``template_places``). Blocks at such places are cut off before and
after the content; between its blocks they stay, as do headings and what an article element holds.

Names are a prior beside these counts, which ``names=False`` leaves out. Elements that are never part of an article (menus, forms, adverts and so on, by element, role or class) are left out;
weak marks (``_WEAK``) count only where links make up most of the text.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendon.llm.shared import looked_up, saved

#: A node of a host's wrapper is on one page in so many at least, so that ids of single pages make no nodes.
RARE = 64
#: Stands in a wrapper for all texts at a node that are no template; hashes of texts are not negative.
VARYING = -1
#: Pages that a text is repeated on to be template: so many, and this share of those that have its node.
REPEATED, REPEATED_SHARE = 3, 0.6
#: Times that a place must have been seen to be template, the share of its text that must be repeated, and the share of the
#: text of all places that must not be.
PLACE_SEEN, PLACE_SHARE, ALL_APART = 20, 0.9, 0.5
#: Share of the varying text that a child must hold to be looked into for the content slot.
MOST = 0.7
#: Nodes below so many others give no evidence to a wrapper; their texts are kept.
DEPTH = 150

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r">|=\s*+([\"'])")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math canvas object audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tfoot"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_FENCE = frozenset("ul ol dl table body article section div nav main aside header footer td th".split())

_NEVER = frozenset("head nav footer aside form button select input textarea menu dialog fieldset".split()) | _RAW
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_HINT = re.compile(r"(ads?|adverts?|advertisement|adbox|banner|sponsor(ed)?|nav(bar|igation)?|menu|breadcrumbs?|sidebar|footer|masthead|comments?|repl(y|ies)|respond|disqus|cookies?|consent|gdpr|notices?|alert|newsletter|popup|modal|pagination|pager)", re.I)
_WEAK = re.compile(r"(promo(tion)?|subscribe|subscription|share|sharing|social|related|recommended|overlay|widget|toolbar|login|signup|search)", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLE = frozenset("article main h1".split())
#: Elements that the content slot may be, and how their varying text weighs.
_SLOTS = {"#page": 1, "html": 1, "body": 1, "div": 1, "section": 1, "center": 1, "table": 1, "tbody": 1, "tr": 1, "td": 1, "main": 3, "article": 4}


class Node:
    __slots__ = ("tag", "label", "hint", "parent", "kids", "holds", "counts", "prose", "said")

    def __init__(self, tag: str, hint: str = "", parent: Node | None = None):
        self.tag, self.hint, self.parent, self.kids, self.holds = tag, hint, parent, [], False
        self.label = f"{tag}.{hint}" if hint else tag
        self.counts: tuple[int, int] | None = None
        self.prose: bool | None = None
        self.said: tuple[str, int] | None = None


def _hidden(attrs: dict[str, str]) -> bool:
    style = attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def tokens(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``(start, end, close, tag, attributes)`` of every tag; comments and declarations have an empty tag.

    Goes through the source once. A quotation mark that is never closed stands for itself; a tag that is never
    closed takes the rest of the source.
    """
    at, gone = source.find("<"), set()
    while at >= 0:
        m = _TAG.match(source, at)
        if m:
            end = m.end()
            while True:
                stop = _STOP.search(source, end)
                if stop is None:
                    yield at, len(source), "", "", ""
                    return
                end = stop.end()
                if stop[1] is None:
                    break
                if stop[1] not in gone:
                    close = source.find(stop[1], end)
                    if close < 0:
                        gone.add(stop[1])
                    else:
                        end = close + 1
            yield at, end, m[1], m[2].lower(), source[m.end() : end - 1]
        elif source.startswith("<!--", at):
            stop = _COMMENT_END.search(source, at + 2)
            end = stop.end() if stop else len(source)
            yield at, end, "", "", ""
        elif source[at + 1 : at + 2] in ("!", "?", "/"):
            end = source.find(">", at) + 1 or len(source)
            yield at, end, "", "", ""
        else:
            end = at + 1
        skip = raw_end(source, end, m[2].lower()) if m and not m[1] else end
        at = source.find("<", skip)


def raw_end(source: str, at: int, tag: str) -> int:
    """Where the contents of an element without markup end; ``at`` for others."""
    if tag not in _RAW:
        return at
    start = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
    end = source.find(">", start.end()) if start else -1
    return end + 1 if end >= 0 else len(source)


def parse(source: str) -> Node:
    """The page's tree: elements, and texts as strings. Tags that are never closed end where HTML ends them."""
    root = now = Node("#page")
    at, open_ = 0, Counter()

    def up_to(node: Node) -> Node:
        n = now
        while n is not node:
            open_[n.tag] -= 1
            n = n.parent
        return node

    for start, end, close, tag, attributes in tokens(source):
        if start > at:
            now.kids.append(source[at:start])
        at = end
        if not tag:
            continue
        if close:
            if open_[tag]:
                node = now
                while node.tag != tag:
                    node = node.parent
                now = up_to(node.parent)
            continue
        if tag in _ENDS_P and open_["p"]:
            node = now
            while node.tag in _INLINE and node.parent is not None:
                node = node.parent
            if node.tag == "p":
                now = up_to(node.parent)
        if tag in _SIBLINGS and any(open_[t] for t in _SIBLINGS[tag]):
            node, target, fence = now, now, _FENCE - _SIBLINGS[tag]
            while node.parent is not None and node.tag not in fence:
                if node.tag in _SIBLINGS[tag]:
                    target = node.parent
                    if tag in ("li", "dt", "dd", "option"):
                        break
                node = node.parent
            now = up_to(target)
        attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attributes)} if attributes else {}
        hint = " ".join(x for x in (attrs.get("id", ""), attrs.get("class", ""), attrs.get("role", "")) if x).lower()
        node = Node(tag, "!" if attrs and _hidden(attrs) else hint, now)
        now.kids.append(node)
        if tag in _ARTICLE:
            above = now
            while above is not None and not above.holds:
                above.holds = True
                above = above.parent
        if tag in _RAW:
            at = raw_end(source, end, tag)
        elif tag not in _VOID and not attributes.endswith("/"):
            now = node
            open_[tag] += 1
    if at < len(source):
        now.kids.append(source[at:])
    return root


def words_in(node: Node) -> tuple[int, int]:
    """Characters below a node, and those inside links; counted once for each node, from the leaves up."""
    stack = [node]
    while stack:
        n = stack[-1]
        open_ = [k for k in n.kids if not isinstance(k, str) and k.counts is None] if n.counts is None else []
        if open_:
            stack += open_
            continue
        stack.pop()
        if n.counts is None:
            parts = [(len(k.strip()), 0) if isinstance(k, str) else k.counts for k in n.kids]
            every = sum(x for x, _ in parts)
            n.counts = every, every if n.tag == "a" else sum(x for _, x in parts)
    return node.counts


def in_prose(node: Node) -> bool:
    """Whether an element stands among words of its parent's own, so that it is part of a sentence whatever its name."""
    above = node.parent
    if above is None:
        return False
    if above.prose is None:
        above.prose = any(isinstance(k, str) and k.strip() for k in above.kids)
    return above.prose


def excluded(node: Node, in_article: bool, names: bool = True) -> bool:
    """Whether an element is no part of an article, whatever it holds; without ``names`` only what no page shows."""
    if not names:
        return node.tag in _RAW or node.tag == "head" or node.hint == "!"
    if node.tag in _NEVER or node.hint == "!":
        return True
    if node.tag == "header":
        return not in_article and not node.holds
    if not node.hint or node.holds or node.tag in ("html", "body", "main"):
        return False
    if node.tag in _INLINE and in_prose(node):
        return False
    words = re.split(r"[^a-z0-9]+", node.hint)
    if any(w in _ROLES or _HINT.fullmatch(w) for w in words):
        return True
    if any(_WEAK.fullmatch(w) for w in words):
        every, linked = words_in(node)
        return 2 * linked > every
    return False


def clean(text: str) -> str:
    return " ".join(text.split())


def blocks(node: Node, in_article: bool = False, skip: set[int] = frozenset(), names: bool = True) -> list[str]:
    """Texts of the blocks below a node in order; ``skip`` has ids of nodes that are template."""
    return [text for text, _ in marked_blocks(node, in_article, skip, frozenset(), names)]


def marked_blocks(node: Node, in_article: bool, skip: set[int], edge: set[int], names: bool) -> list[tuple[str, bool]]:
    """The same with whether the element that holds the text is one of ``edge`` and in no article."""
    out: list[tuple[str, bool]] = []
    open_text: list[str] = []

    def close() -> None:
        if open_text:
            if text := clean("".join(open_text)):
                out.append((text, marked))
            open_text.clear()

    stack = [(iter(node.kids), in_article, False, id(node) in edge)]
    while stack:
        kids, inside, block, at_edge = stack[-1]
        marked = at_edge and not (names and inside)
        k = next(kids, None)
        if k is None:
            if block:
                close()
            stack.pop()
        elif isinstance(k, str):
            open_text.append(entities.unescape(k))
        elif k.tag == "br":
            open_text.append(" ")
        elif id(k) in skip or excluded(k, inside, names):
            if k.tag not in _INLINE:
                close()
        elif k.tag in _INLINE:
            stack.append((iter(k.kids), inside, False, at_edge))
        else:
            close()
            stack.append((iter(k.kids), inside or k.tag in ("article", "main"), True, id(k) in edge))
    close()
    return out


def trimmed(marked: list[tuple[str, bool]]) -> list[str]:
    """The texts without marked ones before and after all others; all of them if all are marked."""
    plain = [i for i, (_, m) in enumerate(marked) if not m]
    return [t for t, _ in (marked[plain[0] : plain[-1] + 1] if plain else marked)]


def placed(root: Node) -> Iterator[tuple[Node, int]]:
    """Every element that is no part of a line, with the hash of its place: the labels from the root to it."""
    stack = [(root, xxhash.xxh64_intdigest(root.label) >> 1)]
    while stack:
        node, place = stack.pop()
        if node.tag not in _INLINE:
            yield node, place
        for k in node.kids:
            if not isinstance(k, str) and k.tag not in _RAW and k.tag not in _VOID:
                own = k.label.encode("utf-8", "surrogatepass")
                stack.append((k, place if k.tag in _INLINE else xxhash.xxh64_intdigest(b"%d/" % place + own) >> 1))


class Shape:
    """A node of an aligned tree: a run of siblings with one label, with the texts seen in it.

    ``texts`` has, by the hash of a text that is one element's own, the number of pages with it and its length
    without links; ``seen`` is the number of pages with the node. ``nodes`` are a page's own elements.
    """

    __slots__ = ("label", "tag", "kids", "nodes", "own", "texts", "seen", "holds", "out", "vary")

    def __init__(self, label: str, kids: list[Shape], texts: dict[int, list[int]], seen: int = 1, holds: bool = False, out: bool = False):
        self.label, self.kids, self.texts, self.seen, self.holds, self.out = label, kids, texts, seen, holds, out
        self.tag = label.partition(".")[0]
        self.nodes: list[Node] = []
        self.own: list[int] = []
        self.vary = 0

    def template(self) -> set[int]:
        """Hashes of the texts that most pages repeat at this place."""
        return {h for h, (n, _) in self.texts.items() if n >= max(REPEATED, REPEATED_SHARE * self.seen)}

    def packed(self) -> list:
        return [self.label, self.seen, int(self.holds), int(self.out), [[h, *v] for h, v in self.texts.items()], [k.packed() for k in self.kids]]

    @staticmethod
    def unpacked(x: list) -> Shape:
        return Shape(x[0], [Shape.unpacked(k) for k in x[5]], {h: [n, size] for h, n, size in x[4]}, x[1], bool(x[2]), bool(x[3]))


def _own_text(node: Node) -> tuple[str, int]:
    """The text of an element that is in no block below it, and its length without links; made once."""
    if node.said is not None:
        return node.said
    parts, plain = [], 0
    stack: list[tuple[Node | str, bool]] = [(k, False) for k in reversed(node.kids)]
    while stack:
        n, linked = stack.pop()
        if isinstance(n, str):
            parts.append(entities.unescape(n))
            plain += 0 if linked else len(n.strip())
        elif n.tag in _INLINE:
            linked = linked or n.tag == "a"
            stack += [(k, linked) for k in reversed(n.kids)]
    node.said = clean("".join(parts)), plain
    return node.said


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def shape(root: Node, names: bool = True) -> Shape:
    """The tree of a page; children of all elements of a run are merged into runs of equal labels."""

    def made(nodes: list[Node], label: str) -> Shape:
        out = Shape(label, [], {}, 1, any(n.holds for n in nodes), excluded(nodes[0], False, names))
        out.nodes = nodes
        for n in nodes:
            text, plain = _own_text(n)
            h = text_hash(text) if text else 0
            out.own.append(h)
            if h:
                out.texts[h] = [1, plain]
        return out

    top = made([root], root.label)
    stack = [(top, 0)]
    while stack:
        at, depth = stack.pop()
        if depth >= DEPTH or at.out:
            continue
        runs: dict[str, list[Node]] = {}
        for n in at.nodes:
            for k in n.kids:
                if not isinstance(k, str) and k.tag not in _INLINE and k.tag not in _RAW and k.tag not in _VOID:
                    runs.setdefault(k.label, []).append(k)
        at.kids = [made(run, name) for name, run in runs.items()]
        stack += [(k, depth + 1) for k in at.kids]
    return top


def heaviest_rising(places: list[int], weights: list[int]) -> list[int]:
    """Indices of the rising subsequence of distinct places with the largest sum of positive weights."""
    tops: list[int] = []  # places and sums that rise together: the best sum of a sequence that ends at or before
    sums: list[int] = []
    ends: list[int] = []
    before = [-1] * len(places)
    for i, (place, weight) in enumerate(zip(places, weights)):
        at = bisect_left(tops, place)
        best = sums[at - 1] if at else 0
        before[i] = ends[at - 1] if at else -1
        total = best + weight
        stop = at
        while stop < len(tops) and sums[stop] <= total:
            stop += 1
        tops[at:stop], sums[at:stop], ends[at:stop] = [place], [total], [i]
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def matched(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: the number of matched nodes below and with two nodes of one label, and the pairs."""
    if a.label != b.label:
        return 0, []
    place = {k.label: j for j, k in enumerate(b.kids)}
    both = [(k, place[k.label]) for k in a.kids if k.label in place]
    below = [matched(k, b.kids[j]) for k, j in both]
    chosen = heaviest_rising([j for _, j in both], [n for n, _ in below])
    pairs = [(a, b)]
    for i in chosen:
        pairs += below[i][1]
    return 1 + sum(below[i][0] for i in chosen), pairs


def content_slot(wrapper: Shape, names: bool = True) -> Shape:
    """The node that holds nearly all of the varying text, and the article's heading if there is one."""
    order = [wrapper]
    for node in order:
        order += node.kids
    for node in reversed(order):
        fixed = node.template()
        own = sum(n * size for h, (n, size) in node.texts.items() if h not in fixed)
        node.vary = 0 if node.out else own + sum(k.vary for k in node.kids)
    node = wrapper
    while node.tag != "article":
        weighed = [k.vary * (_SLOTS.get(k.tag, 1) if names else 1) for k in node.kids]
        best = max(range(len(weighed)), key=weighed.__getitem__, default=None)
        if best is None or not weighed[best]:
            break
        kid = node.kids[best]
        own = node.vary - sum(k.vary for k in node.kids)
        if kid.tag not in _SLOTS or weighed[best] < MOST * (own + sum(weighed)) or node.holds and not (kid.holds or kid.tag in _ARTICLE):
            break
        node = kid
    return node


def extracted(page: str, wrapper: Shape | None, places: set[int] = frozenset(), names: bool = True) -> str:
    """The article of a page; empty if it has none. ``places`` are template on all hosts."""
    root = parse(page)
    tree = shape(root, names)
    edge = {id(n) for n, place in placed(root) if place in places and n.tag not in _HEADINGS} if places else frozenset()
    for fit in ([wrapper] if wrapper is not None and wrapper.seen > 1 else []) + [tree]:
        slot = content_slot(fit, names)
        template: set[int] = set()
        found: list[Node] = []
        for a, b in matched(fit, tree)[1]:
            if a is slot:
                found = b.nodes
            if fixed := a.template() if not b.kids else None:
                template |= {id(n) for n, h in zip(b.nodes, b.own) if h in fixed}
        inside = slot.tag in ("article", "main")
        whole = trimmed([x for n in found for x in marked_blocks(n, inside, frozenset(), edge, names)])
        if template:
            text = trimmed([x for n in found for x in marked_blocks(n, inside, template, edge, names)])
            if 2 * sum(map(len, text)) >= sum(map(len, whole)):
                whole = text
        if whole:
            return "\n".join(whole)
    return ""


def _shaped(root: Node, names: bool) -> list[tuple]:
    """``(place, text, size, parent, label, at, holds, out, below, own)`` of a page's runs of siblings, and of each text in them.

    The row of the run itself has the text 0; ``own`` is the length of its texts without links, ``below`` that of all texts of
    its subtree, ``at`` its number among the runs beside it. Elements left out weigh nothing.
    """
    top = shape(root, names)
    place = {id(top): (xxhash.xxh64_intdigest(top.label) >> 1, None, 0)}
    order = [top]
    for s in order:
        mine = place[id(s)][0]
        for at, k in enumerate(s.kids):
            place[id(k)] = xxhash.xxh64_intdigest(b"%d/" % mine + k.label.encode("utf-8", "surrogatepass")) >> 1, mine, at
        order += s.kids
    below: dict[int, int] = {}
    out = []
    for s in reversed(order):
        mine, parent, at = place[id(s)]
        own = sum(size for _, size in s.texts.values())
        below[id(s)] = 0 if s.out else own + sum(below[id(k)] for k in s.kids)
        out.append((mine, 0, 0, parent, s.label, at, s.holds, s.out, below[id(s)], 0 if s.out else own))
        out += [(mine, h, size, None, None, None, None, None, None, None) for h, (_, size) in s.texts.items()]
    return out


def _seen(batches: Iterator[pa.RecordBatch], names: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            root = parse(page)
            texts: dict[tuple[int, int], int] = {}
            for node, place in placed(root):
                if text := _own_text(node)[0]:
                    texts[place, text_hash(text)] = len(text)
            plain = [(p, t, size) for (p, t), size in texts.items()]
            runs = _shaped(root, names)
            rows = [(*x, *[None] * 7) for x in plain] + runs
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()])]
            kind = pa.array([False] * len(plain) + [True] * len(runs))
            own = [pa.repeat(pa.scalar(host, pa.string()), len(rows)), pa.repeat(pa.scalar(text_hash(page), pa.int64()), len(rows)), kind]
            yield pa.RecordBatch.from_arrays([*own, *columns], ["host", "page", "run", *_ROW])


#: What is kept of a run of siblings, or of an element's text.
_ROW = ["place", "text", "size", "parent", "label", "at", "holds", "out", "below", "own"]


def seen_rows(pages: DataFrame, names: bool = True) -> DataFrame:
    """What every page has at each place, from one parse: texts of elements (``run`` false), and runs of siblings with their texts (``_shaped``)."""
    rows = pages.select(host_of().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    kinds = "place long, text long, size long, parent long, label string, at int, holds boolean, out boolean, below long, own long"
    return saved(rows.mapInArrow(partial(_seen, names=names), f"host string, page long, run boolean, {kinds}"), "seen")


def template_places(pages: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``(place)``: places nearly all of whose text is repeated, over all pages of all hosts.

    A text is repeated that REPEATED pages have at that place. Texts are counted before places are, so a place that
    every page has is summed from its texts' counts by all tasks. If half of all text or more is repeated (copies of whole
    pages), repeats tell nothing and no place is template.
    """
    texts = (seen_rows(pages) if seen is None else seen).where("not run")
    texts = texts.groupBy("place", "text").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    mass = F.col("n") * F.col("size")
    sums = texts.groupBy("place").agg(
        F.sum("n").alias("seen"), F.sum(mass).alias("mass"), F.sum(F.when(F.col("n") < REPEATED, mass).otherwise(0)).alias("single")
    )
    sums = saved(sums, "places")
    every = sums.agg(F.sum("mass").alias("mass"), F.sum("single").alias("single")).first()
    tells = bool(every["mass"]) and every["single"] >= ALL_APART * every["mass"]
    return sums.where(F.lit(tells) & (F.col("seen") >= PLACE_SEEN) & (F.col("single") <= F.lit(1 - PLACE_SHARE) * F.col("mass"))).select("place")


def host_of(column: str = "url"):
    """The host of an address in small letters; addresses without one, and null ones, have the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def wrappers(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """``(host, n, wrapper)``: each host's number of pages and its wrapper as JSON, counted over all pages; equal pages count once.

    Pages and texts are counted by place, so no task has a host's pages. A place that fewer than one page in ``RARE`` has is
    no node of the wrapper; its texts weigh as varying ones of the node above.
    """
    runs = seen.where("run").groupBy("host", "place", "text", "page").agg(*(F.max(x).alias(x) for x in ("size", "parent", "label", "at", "holds", "out", "below", "own")))
    runs = saved(runs.groupBy("host", "place", "text").agg(
        F.count(F.lit(1)).alias("n"), *(F.max(x).alias(x) for x in ("size", "parent", "label", "holds")), F.avg("at").alias("at"), F.min("out").alias("out"), F.sum("below").alias("below"), F.sum("own").alias("own"),
    ), "runs")
    nodes = runs.where("text = 0").drop("text", "size").withColumnRenamed("n", "seen")
    hosts = saved(nodes.groupBy("host").agg(F.max(F.when(F.col("parent").isNull(), F.col("seen"))).alias("distinct"), F.count(F.lit(1)).alias("nodes")), "hosts")
    nodes = looked_up(nodes, hosts, ["host"], "nodes", nodes.count()).where(F.col("seen") * RARE >= F.col("distinct")).drop("distinct", "nodes")
    texts = runs.where("text <> 0").select("host", "place", "text", "n", "size")
    weight = texts.groupBy("host", "place").agg(F.count(F.lit(1)).alias("texts"))
    nodes = saved(nodes.join(weight, ["host", "place"], "left").withColumn("texts", F.coalesce("texts", F.lit(0))), "nodes")
    known = looked_up(texts, nodes.select("host", "place", "seen", "texts"), ["host", "place"], "texts", texts.count()).where("seen is not null")
    fixed = F.col("n") >= F.greatest(F.lit(float(REPEATED)), F.lit(REPEATED_SHARE) * F.col("seen"))
    own = known.groupBy("host", "place").agg(F.sum(F.when(~fixed, F.col("n") * F.col("size"))).alias("vary"), F.collect_list(F.when(fixed, F.struct("text", "n", "size"))).alias("fixed"))
    entries = nodes.drop("texts").join(own, ["host", "place"], "left")
    entries = entries.groupBy("host").agg(F.collect_list(F.struct(*(x for x in entries.columns if x != "host"))).alias("nodes"))
    counted = pages.groupBy(host_of().alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return entries.join(counted, "host").select("host", "n", "nodes").mapInArrow(_assemble, "host string, n long, wrapper string")


def assembled(nodes: list[dict]) -> Shape:
    """The wrapper of one host from its places: children in the order of their mean number among the runs beside them. What
    varies at a node weighs as one text that no page repeats, together with what is below it at places that are no nodes."""
    made = {x["place"]: Shape(x["label"], [], {t["text"]: [t["n"], t["size"]] for t in x["fixed"] or ()}, x["seen"], x["holds"], x["out"]) for x in nodes}
    rest = {x["place"]: (x["vary"] or 0) + x["below"] - x["own"] for x in nodes}
    top = Shape("#page", [], {})
    for x in sorted(nodes, key=lambda x: (x["at"], x["label"])):
        if x["parent"] is None:
            top = made[x["place"]]
        elif x["parent"] in made:
            made[x["parent"]].kids.append(made[x["place"]])
            rest[x["parent"]] -= x["below"]
    for place, size in rest.items():
        if size > 0:
            made[place].texts[VARYING] = [1, size]
    return top


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [json.dumps(assembled(nodes).packed(), separators=(",", ":")) for nodes in batch.column("nodes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("n"), pa.array(out, pa.string())], ["host", "n", "wrapper"])


def with_template_places(known: DataFrame, seen: DataFrame, places: DataFrame) -> DataFrame:
    """Each host of ``wrappers`` with those of its pages' places that are template, as ``fixed`` (null without any)."""
    pairs = seen.where("not run").select("host", "place").distinct()
    used = saved(pairs.groupBy("place").agg(F.count(F.lit(1)).alias("hosts")).join(places, "place"), "used-places")
    own = looked_up(pairs, used, ["place"], "hosts", pairs.count()).where("hosts is not null")
    own = own.groupBy("host").agg(F.sort_array(F.collect_list("place")).alias("fixed"))
    return known.join(own, "host", "left")


def _extract(batches: Iterator[pa.RecordBatch], names: bool) -> Iterator[pa.RecordBatch]:
    held: dict[str, Shape] = {}
    for batch in batches:
        texts = []
        for page, wrapper, fixed in zip(*(batch.column(c).to_pylist() for c in ("__html", "wrapper", "fixed"))):
            if wrapper is not None and wrapper not in held:
                if len(held) > 2_000:
                    held.clear()
                held[wrapper] = Shape.unpacked(json.loads(wrapper))
            texts.append(extracted(page, held.get(wrapper), set(fixed or ()), names) if page else "")
        rest = [c for c in batch.schema.names if c not in ("__html", "wrapper", "fixed")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, "text"])


def main_texts(pages: DataFrame, names: bool = True) -> DataFrame:
    """``(page_id, url, text)`` of every row, from the whole page.

    Blocks are joined by one newline in page order; white space inside a block is one space. A null or empty page
    has an empty text. Null and repeated ids and addresses are rows like any other; other columns are ignored; an
    empty table gives an empty result. Without ``names`` only the host's wrapper and the counts of all pages decide.
    """
    seen = seen_rows(pages, names)
    known = saved(wrappers(pages, seen), "wrappers")
    known = saved(with_template_places(known, seen, template_places(pages, seen)), "wrappers-with-places")
    rows = pages.select("page_id", "url", host_of().alias("host"), F.col("html").alias("__html"))
    joined = looked_up(rows, known, ["host"], "n", rows.count(), wide=True).drop("n")
    return joined.drop("host").mapInArrow(partial(_extract, names=names), f"page_id {dict(rows.dtypes)['page_id']}, url string, text string")
