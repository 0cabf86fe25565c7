"""Main text of web pages by wrapper induction.

For every host one page is the seed (that with the least hash).  The tree of every page of the host is aligned with that of
the seed by simple tree matching: nodes with equal labels match, their children are aligned in order for the largest number
of matches.  Siblings with equal labels are one node of the compared trees, as repeated records are.  Over all pages of the
host, tasks count for each block of the seed how many pages matched its node and how many of them had a block of the same text
there; pages whose text, blocks of most pages set aside, is mostly that of the seed (copies) say nothing and are not counted.  Constant blocks are template,
all else are slots.

The text of a page is that of its slots within the main region: an article, main element or the like if there is one, else
the subtree that holds the most text outside links and template, headings and text together.  Elements whose tag, or a whole class, id or role,
says menu, header, footer, sidebar, notice, advert, form or comment are left out unless they hold the article or most of the
text, and so are blocks that are template.

Character references are decoded, white space inside a block becomes one space, blocks are joined by two line feeds.  Null
html is empty and gives an empty text, as does a page without text.  Pages without a readable host, or without page_id, are
read without a wrapper or id; a host with too few different pages has no template.  Repeated rows each get their text; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierbook.llm.common import stored
from tierbook.llm.pages import BLOCK, RAW, Node, parsed

#: Pages that must differ from the seed before a host has a template, and the share that must agree on a constant text.
LEAST_PAGES = 4
CONSTANT = 0.8
#: Blocks that more than this share of the pages have too are set aside; a page tells something about the seed's template if at
#: most this share of the rest of its text is the seed's.
COPY = 0.5
#: Wrappers are broadcast up to so many bytes; beyond, pages are shuffled by host.
BROADCAST_BYTES = 16_000_000

#: What marks parts of a page that are not its article.
OUTSIDE_TAGS = frozenset("nav aside footer form dialog button select menu".split())
OUTSIDE_WORDS = frozenset(
    "ad ads alert advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent "
    "contentinfo cookie cookies discussion disqus footer gdpr login menu modal nav navbar navigation newsletter notice paywall popup "
    "promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar trending widget".split()
)
HEADER_WORDS = frozenset("header masthead site-header topbar".split())
MAIN_WORDS = frozenset({"main", "articlebody"})
#: What may stand beside such a word in one class, id or role.
AFFIXES = frozenset(
    "area bar block bottom box btn button buttons container form global group icons inner item left link links list main mobile outer page panel "
    "policy post posts primary right secondary section site slot thread title top unit wrap wrapper".split()
)
#: Ids that the headings of an article give to its sections as well.
SLUGS = frozenset("discussion navigation notice promotion related respond search share sharing subscription".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Marks are doubted for the sake of text only from so many characters.
LEAST_KEPT = 200
WORDS = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")


def marked_outside(node: Node, in_article: bool) -> bool:
    if node.tag in OUTSIDE_TAGS and not (node.tag == "form" and node.kept) or node.tag in RAW or node.tag == "head":
        return True
    if node.tag == "header" and not in_article:
        return True
    if not node.names or node.tag in ("body", "html", "article", "main") and "comment" not in node.names.get("class", ""):
        return False
    if node.kept:
        return False
    said = node.names.get("class", "").split() + node.names.get("role", "").split()
    name = node.names.get("id", "")
    if name and node.tag not in HEADINGS and not (name in SLUGS and node.tag in ("section", "div", "a", "span", "p")):
        said.append(name)
    return any(says(token, OUTSIDE_WORDS) or not in_article and says(token, HEADER_WORDS) for token in said)


def says(token: str, words: frozenset[str]) -> bool:
    """The whole token is one of the words, or made of them and of affixes."""
    if token in words:
        return True
    parts = WORDS.findall(token)
    return any(p in words for p in parts) and all(p in words or p in AFFIXES or p.isdigit() for p in parts)


def keep_articles(root: Node) -> None:
    """Marks hold for no element around a main element, the article, or (without either) most of the text outside links."""
    order: list[tuple[Node, int, bool]] = []
    todo = [(root, -1, False)]
    while todo:
        node, up, in_link = todo.pop()
        at = len(order)
        order.append((node, up, in_link))
        todo += [(c, at, in_link or c.tag == "a") for c in node.children if not isinstance(c, str) and c.tag not in RAW and c.tag != "head"]
    mass = [0] * len(order)
    for k in range(len(order) - 1, -1, -1):
        node, up, in_link = order[k]
        if not in_link:
            mass[k] += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if up >= 0:
            mass[up] += mass[k]
    # parents come before their children
    lost = [False] * len(order)
    for k, (node, up, _) in enumerate(order):
        lost[k] = up >= 0 and lost[up] or node.tag in OUTSIDE_TAGS and node.tag != "form"
    found = [k for k, (n, _, _) in enumerate(order) if n.tag == "main" and mass[k] and not lost[k]]
    if not found:
        articles = [k for k, (n, _, _) in enumerate(order) if n.tag == "article" and mass[k] and not lost[k] and not marked_outside(n, False)]
        top = max(articles, key=lambda k: mass[k], default=-1)
        # of several, that with most of their text: teasers are of a size
        if top >= 0 and 2 * mass[top] > sum(mass[k] for k in articles if order[k][1] < 0 or order[order[k][1]][0].tag != "article"):
            found = [top]
        elif not articles:
            found = [k for k in range(len(order)) if mass[k] >= LEAST_KEPT and 2 * mass[k] > mass[0] and not lost[k]]
    for k in found:
        while k >= 0 and not order[k][0].kept:
            order[k][0].kept = True
            k = order[k][1]


# ---- compared trees -------------------------------------------------------------------------------------------------


class Shape:
    """Siblings with one label; ``texts`` are those of each as a block, that is with the elements inside lines."""

    __slots__ = ("label", "nodes", "children", "texts", "number")

    def __init__(self, label: str, nodes: list[Node]):
        self.label, self.nodes, self.number = label, nodes, -1
        self.texts = [line_text(n) for n in nodes] if nodes[0].tag in BLOCK else []
        self.children: list[Shape] = []


def unrolled(walk):
    """A recursive walk at any depth: what the generator yields are the arguments of its calls, what it is sent their results."""

    def run(*args):
        stack, result = [walk(*args)], None
        while stack:
            try:
                call = stack[-1].send(result)
            except StopIteration as end:
                stack.pop()
                result = end.value
            else:
                stack.append(walk(*call))
                result = None
        return result

    return run


def line_text(node: Node) -> str:
    """The text of a block without that of the blocks in it."""
    out, todo = [], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.tag not in BLOCK and child.tag not in RAW:
            todo += reversed(child.children)
    return SPACE.sub(" ", "".join(out)).strip()


def shape_of(html: str) -> tuple[Node, Shape]:
    root = parsed(html)
    top = Shape("#page", [root])
    todo = [top]
    while todo:
        shape = todo.pop()
        groups: dict[str, list[Node]] = {}
        for node in shape.nodes:
            for child in node.children:
                if not isinstance(child, str) and child.tag not in RAW and child.tag != "head":
                    groups.setdefault(child.label, []).append(child)
        shape.children = [Shape(k, v) for k, v in groups.items()]
        todo += shape.children
    return root, top


def numbered(shape: Shape) -> list[Shape]:
    """The nodes in order of the page, each with its number."""
    out, todo = [], [shape]
    while todo:
        s = todo.pop()
        s.number = len(out)
        out.append(s)
        todo += reversed(s.children)
    return out


def matched(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching of two nodes with one label: the number of matches and the matches."""
    size, nested = _matched(a, b)
    out, todo = [], [nested]
    while todo:
        pair, below = todo.pop()
        out.append(pair)
        todo += below
    return size, out


@unrolled
def _matched(a: Shape, b: Shape):
    """The number of matches, and the pair with the nested ones below it."""
    m, n = len(a.children), len(b.children)
    if not m or not n:
        return 1, ((a, b), [])
    # labels are unique among the children of a node, so an alignment is a rising run of places in b: the heaviest one, by a
    # tree of maxima over places (weight, and its last match with the one before it)
    place = {y.label: j for j, y in enumerate(b.children, 1)}
    best: list[tuple[int, tuple | None]] = [(0, None)] * (n + 1)
    for x in a.children:
        j = place.get(x.label)
        if j is None:
            continue
        size, nested = yield x, b.children[j - 1]
        k, before = j - 1, (0, None)
        while k:
            before = max(before, best[k], key=lambda e: e[0])
            k &= k - 1
        entry, k = (before[0] + size, (nested, before[1])), j
        while k <= n:
            if entry[0] > best[k][0]:
                best[k] = entry
            k += k & -k
    k, whole = n, (0, None)
    while k:
        whole = max(whole, best[k], key=lambda e: e[0])
        k &= k - 1
    found, chain = [], whole[1]
    while chain is not None:
        found.append(chain[0])
        chain = chain[1]
    return 1 + whole[0], ((a, b), found)


def observed(page: Shape, seed: Shape) -> tuple[list[int], list[tuple[int, int, int]], int] | None:
    """Numbers of the seed's nodes that the page has, which of their blocks it has too and their size, and the size of all its
    text; None if nothing is its own."""
    nodes, blocks, shared = [], [], 0
    mass = sum(len(text) for s in numbered(page) for text in set(s.texts))
    for mine, theirs in matched(page, seed)[1]:
        texts = set(mine.texts) - {""}
        if not texts:
            continue
        nodes.append(theirs.number)
        for k, text in enumerate(theirs.texts):
            if text in texts and text not in theirs.texts[:k]:
                blocks.append((theirs.number, k, len(text)))
                shared += len(text)
    return (nodes, blocks, mass) if shared < mass else None


# ---- text of a page -------------------------------------------------------------------------------------------------


def main_regions(root: Node) -> list[Node]:
    """Outermost articles or main elements, without those of less than half the text of the largest, or else the subtree with the most text
    outside links."""
    regions: list[Node] = []
    mass: dict[int, int] = {}
    whole: dict[int, int] = {}
    links: dict[int, int] = {}
    heads: dict[int, int] = {}
    above: dict[int, Node] = {}
    nodes: list[Node] = []

    @unrolled
    def visit(node: Node, in_link: bool, constant: bool):
        """Characters of text, and of the paragraphs right below."""
        total = direct = linked = head = 0
        for child in node.children:
            if isinstance(child, str):
                size = 0 if constant else len(child.strip())
                n = 0 if in_link else size
                linked += size - n
                head += size if node.tag in HEADINGS else 0
                total += n
                direct += n
            elif not marked_outside(child, False):
                above[id(child)] = node
                below, own = yield child, in_link or child.tag == "a", bool(child.slot) if child.tag in BLOCK else constant
                total += below
                linked += links[id(child)]
                head += links[id(child)] + below if node.tag in HEADINGS else heads[id(child)]
                direct += own if child.tag not in BLOCK or child.tag == "p" or child.tag[0] == "h" and child.tag[1:].isdigit() else 0
        whole[id(node)], links[id(node)], heads[id(node)] = total, linked, head
        if node.tag in BLOCK and node.tag not in ("p", "html"):
            mass[id(node)] = direct
            nodes.append(node)
        return total, direct

    @unrolled
    def articles(node: Node):
        for child in node.children:
            if isinstance(child, str) or marked_outside(child, False):
                continue
            said = {child.names.get("role"), child.names.get("itemprop")}
            if child.tag == "article" or said & MAIN_WORDS:
                regions.append(child)
            else:
                yield (child,)

    articles(root)
    if not regions:
        todo = [root]
        while todo:
            node = todo.pop()
            for child in node.children:
                if not isinstance(child, str) and not marked_outside(child, False):
                    if child.tag == "main":
                        regions.append(child)
                    else:
                        todo.append(child)
    if len(regions) == 1:
        return regions
    visit(root, False, False)
    if regions:
        # beside the article itself, what is marked as one but far smaller is a card that leads elsewhere
        sizes = [whole.get(id(r), 0) for r in regions]
        return [r for r, size in zip(regions, sizes, strict=True) if 2 * size >= max(sizes)]
    best = max(nodes, key=lambda n: mass[id(n)], default=None)
    if best is None or not mass[id(best)]:
        return [root]
    # an article in several sections: upwards as long as that gains more text than links
    node = best
    while (node := above.get(id(node))) is not None:
        if whole[id(node)] - whole[id(best)] > links[id(node)] - links[id(best)]:
            best = node
    # beside lists of links, only what has a heading
    node, regions = best, [best]
    while (parent := above.get(id(node))) is not None:
        beside = [c for c in parent.children if c is node or id(c) in heads and heads[id(c)] and max(whole[id(c)], heads[id(c)]) >= links[id(c)]]
        k = next(i for i, c in enumerate(beside) if c is node)
        node, regions = parent, beside[:k] + regions + beside[k + 1 :]
    return regions


def blocks_of(region: Node) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = SPACE.sub(" ", unescape("".join(held))).strip()
        if text:
            out.append(text)
        held.clear()

    @unrolled
    def walk(node: Node, constant: bool):
        for child in node.children:
            if isinstance(child, str):
                if not constant:
                    held.append(child)
            elif child.tag == "br":
                held.append(" ")
            elif not marked_outside(child, True):
                block = child.tag in BLOCK
                if block:
                    close()
                yield child, bool(child.slot) if block else constant
                if block:
                    close()

    walk(region, bool(region.slot))
    close()
    return out


def main_text(root: Node, shape: Shape, seed: Shape | None, template: set[tuple[int, int]]) -> str:
    keep_articles(root)
    if seed is not None and template:
        for mine, theirs in matched(shape, seed)[1]:
            constant = {text for k, text in enumerate(theirs.texts) if (theirs.number, k) in template}
            if constant:
                for node, text in zip(mine.nodes, mine.texts, strict=True):
                    node.slot = text in constant
    return "\n\n".join(b for region in main_regions(root) for b in blocks_of(region))


# ---- jobs -----------------------------------------------------------------------------------------------------------


class Seeds(dict):
    """Trees of seed pages by their html, remembered up to a bounded number."""

    def __missing__(self, html: str) -> Shape:
        if len(self) > 500:
            self.clear()
        shape = self[html] = shape_of(html)[1]
        numbered(shape)
        return shape


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What every page with text of its own has of the seed."""
    seeds = Seeds()
    kind = pa.list_(pa.struct([("node", pa.int32()), ("block", pa.int32()), ("size", pa.int32())]))
    for batch in batches:
        rows = []
        for host, html, seed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found = observed(shape_of(html)[1], seeds[seed])
            if found is not None:
                nodes, blocks, mass = found
                rows.append((host, nodes, [{"node": n, "block": k, "size": size} for n, k, size in blocks], mass))
        if rows:
            host, nodes, blocks, mass = zip(*rows, strict=True)
            columns = [pa.array(host), pa.array(nodes, pa.list_(pa.int32())), pa.array(blocks, kind), pa.array(mass, pa.int64())]
            yield pa.record_batch(columns, ["host", "nodes", "blocks", "mass"])


def _shares(seen: DataFrame) -> DataFrame:
    """host, node, block, in how many pages the block is the seed's (n) and how many have its node (pages)."""
    nodes = seen.select("host", F.explode("nodes").alias("node")).groupBy("host", "node").agg(F.count("*").alias("pages"))
    blocks = seen.select("host", F.explode("blocks").alias("b")).groupBy("host", "b.node", "b.block").agg(F.count("*").alias("n"))
    return blocks.join(nodes, ["host", "node"])


def _templates(seen: DataFrame) -> DataFrame:
    """The constant blocks of every host, from pages that are no copies of the seed once what most pages have is set aside."""
    common = _shares(seen).where(F.col("n") > COPY * F.col("pages"))
    common = stored(common.groupBy("host").agg(F.collect_list(F.struct("node", "block")).alias("common")), "common")
    seen = seen.join(_sized(common, "16 * size(common)"), "host", "left").withColumn("common", F.expr("coalesce(common, array())"))

    def size_of(which: str) -> Column:
        return F.expr(f"aggregate(filter(blocks, b -> {which} array_contains(common, struct(b.node, b.block))), 0L, (s, b) -> s + b.size)")

    rest = F.col("mass") - size_of("")
    seen = seen.where((rest > 0) & (size_of("not") <= COPY * rest))
    template = _shares(seen).where((F.col("pages") >= LEAST_PAGES) & (F.col("n") >= CONSTANT * F.col("pages")))
    return template.groupBy("host").agg(F.collect_list(F.struct("node", "block")).alias("template"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = Seeds()
    for batch in batches:
        texts = []
        for html, seed, template in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            root, shape = shape_of(html)
            texts.append(main_text(root, shape, seeds[seed] if template else None, {(t["node"], t["block"]) for t in template or ()}))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _sized(df: DataFrame, size: str) -> DataFrame:
    held = df.agg(F.sum(F.expr(size))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    known = rows.where("host <> ''").select("host", "html", F.xxhash64("html").alias("mark"))
    first = stored(known.groupBy("host").agg(F.min("mark").alias("mark")), "firsts")
    picked = known.join(_sized(first, "length(host) + 8"), ["host", "mark"]).select("host", "html")
    # copies of the seed have its hash; one row a host is left
    seeds = stored(picked.groupBy("host").agg(F.first("html").alias("seed")), "seeds")
    read = known.join(_sized(seeds, "octet_length(seed)"), "host").select("host", "html", "seed")
    seen = stored(read.mapInArrow(_observe, "host string, nodes array<int>, blocks array<struct<node:int,block:int,size:int>>, mass long"), "seen")
    wrappers = stored(seeds.join(_templates(seen), "host"), "wrappers")
    joined = rows.join(_sized(wrappers, "octet_length(seed)"), "host", "left").select("page_id", "url", "html", "seed", "template")
    return joined.mapInArrow(_extract, "page_id long, url string, text string")
