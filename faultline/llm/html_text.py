"""Main text of HTML pages by wrapper induction over the pages of a host.

Each page becomes a tree of its block elements, in which siblings of one label
(tag and class, numbers aside) are one list node.  The commonest tree of a host
is its reference; every page of the host is aligned with it by simple tree
matching - elements match by tag, equal classes weigh more - and the blocks seen
at each aligned node are counted over all distinct pages (copies of a page are
no evidence).  Nodes of one block whose values recur on pages that otherwise
differ (constant, or rotating between a few) are template; of lists, the blocks
that recur are, such as menu items or a notice between the paragraphs.  Varying
slots are content, on a host of any size.  The wrapper of a host - its reference
tree, template nodes and template blocks - then judges all its pages, inside
articles as well as beside them.  Elements that HTML itself, or their class,
names as menus, adverts, forms and so on are never content; inside an article,
where such a word may mean something else ("market-share"), a class with other
words in it only adds to what the wrapper or the links say.

A host is never gathered: trees and values are counted by pre-aggregated
Spark aggregates, and pages meet only their host's wrapper.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small
from ..session import materialize
from .common import map_texts, text_or_empty
from .urls import host_of

#: A node is template if it was seen on so many distinct pages of the host, and
#: two of them have the same value at it with at least this chance.  Unlike the
#: number of values per page, that chance does not change with a host's size.
MIN_PAGES = 5
AGREE_SHARE = 1 / 3
#: Elements outside an article whose text is mostly links are menus.
LINK_SHARE = 0.5
#: Text of an article that recurs is the article itself (a near copy) if it is more than this share of it.
RECUR_SHARE = 0.5

# Element names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
SKIPPED = frozenset("head nav footer aside form button dialog menu".split())
MAIN = frozenset("article main".split())
#: A start tag ends open elements of these names, up to a table, list or section around them.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
        "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div main body html td th blockquote".split())
# Words in a class or id that name something beside the article.
BESIDE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice alert popup modal overlay newsletter subscribe signup comment comments disqus replies respond share sharing social related recommended widget pagination pager login search toolbar".split())
COMMENTS = frozenset("comment comments replies reply respond disqus".split())
# Words for parts of a page, which say nothing on their own.
PARTS = frozenset("area bar block blocks box button buttons container content form group icon icons inner item items link links list outer panel post posts section slot stories story title unit widget wrap wrapper".split())
LAYOUT = frozenset("has with no without is layout page".split())

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
DIGITS = re.compile("[0-9]+")


def beside(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    """Whether an element is no part of an article, by its name, role or class."""
    if tag in SKIPPED or tag == "header" and not in_main:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return True
    if attributes.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"):
        return True
    return named(tag, attributes, in_main) == 2


def named(tag: str, attributes: dict[str, str], in_main: bool) -> int:
    """What the class and id say: 2 for beside the article, 1 for a hint only:
    inside an article, where other words stand beside such a word."""
    found = 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in NAME.findall(name)]
        if words and words[0] not in LAYOUT and tag not in ("html", "body", "main"):
            if (COMMENTS if tag == "article" else BESIDE).intersection(words):
                sure = not in_main or COMMENTS.intersection(words) or (BESIDE | PARTS).issuperset(words)
                found = max(found, 2 if sure else 1)
    return found


class Page:
    """Blocks of a page in order, and its tree as label paths."""

    def __init__(self, html: str):
        self.nodes: dict[tuple[int, str], int] = {}  # (parent, label) -> node; siblings of one label are one
        self.tree: list[tuple[int, str]] = [(-1, "")]
        self.blocks: list[tuple[int, bool, bool, str, int, bool]] = []  # node, beside, in main, text, linked characters, hint
        self.stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]  # tag, node, beside, in main, hint
        self.text: list[str] = []
        self.links = self.linked = 0
        at = 0
        while m := MARKUP.search(html, at):
            self.add(html[at:m.start()])
            at = m.end()
            tag = (m.group(2) or "").lower()
            if not tag:
                continue
            if m.group(1):
                self.close(tag)
            else:
                self.open(tag, m.group(3))
                if tag in RAW and not m.group(3).endswith("/"):
                    end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                    at = end.start() if end else len(html)
        self.add(html[at:])
        self.flush()

    def add(self, raw: str) -> None:
        if raw:
            self.text.append(raw)
            self.linked += len(raw) if self.links else 0

    def flush(self) -> None:
        text = " ".join(unescape("".join(self.text)).split())
        if text:
            _, node, skip, main, hint = self.stack[-1]
            self.blocks.append((node, skip, main, text, min(self.linked, len(text)), hint))
        self.text, self.linked = [], 0

    def open(self, tag: str, rest: str) -> None:
        if tag in INLINE:
            self.links += tag == "a"
            if tag == "br":
                self.add(" ")
            return
        self.flush()
        self.links = 0
        if tag in VOID:
            return
        ends = ENDS.get(tag, {"p"})
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in ends:
                del self.stack[i:]
            elif self.stack[i][0] in SCOPES:
                break
        attributes = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(rest)} if rest.strip() else {}
        _, parent, skip, main, hint = self.stack[-1]
        label = ".".join([tag, *sorted({DIGITS.sub("#", c) for c in attributes.get("class", "").split()})])
        node = self.nodes.get((parent, label))
        if node is None:
            node = self.nodes[parent, label] = len(self.tree)
            self.tree.append((parent, label))
        skip = skip or tag in RAW or beside(tag, attributes, main)
        hint = hint or main and named(tag, attributes, main) == 1
        self.stack.append((tag, node, skip, main or tag in MAIN or attributes.get("role") == "main", hint))

    def close(self, tag: str) -> None:
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        self.flush()
        self.links = 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def skeleton(self) -> str:
        return "\n".join(f"{parent}\t{label}" for parent, label in self.tree)

    def values(self) -> list[tuple[int, int]]:
        """(node, hash) of the blocks that may be content, each once."""
        return sorted({(b[0], _value_hash(b[3])) for b in self.blocks if not b[1]})

    def content(self, nodes: frozenset[int], recurring: frozenset[tuple[int, int]] = frozenset()) -> str:
        """Blocks that are neither beside the article nor template: not at one
        of the template ``nodes``, nor a ``recurring`` block (node, hash)."""
        left = [b for b in self.blocks if not b[1] and b[0] not in nodes]
        total: dict[int, list[int]] = {}
        for node, _, _, text, linked, _ in left:
            t = total.setdefault(node, [0, 0])
            t[0] += len(text)
            t[1] += linked
        left = [b for b in left if b[2] and not b[5] or total[b[0]][1] <= LINK_SHARE * total[b[0]][0]]
        if recurring:
            again = [(b[0], _value_hash(b[3])) in recurring for b in left]
            main = sum(len(b[3]) for b in left if b[2])
            copy = sum(len(b[3]) for b, r in zip(left, again, strict=True) if r and b[2]) > RECUR_SHARE * main
            left = [b for b, r in zip(left, again, strict=True) if not r or copy and b[2]]
        return "\n".join(b[3] for b in left)


@lru_cache(maxsize=4096)
def aligned(skeleton: str, reference: str) -> tuple[int, ...]:
    """Simple tree matching: for each node of ``skeleton`` its partner in ``reference``, or -1."""
    def read(s):
        tree = [(int(p), x) for p, x in (line.split("\t", 1) for line in s.split("\n"))]
        below: list[list[int]] = [[] for _ in tree]
        for i, (p, _) in enumerate(tree[1:], 1):
            below[p].append(i)
        return [x for _, x in tree], below

    (names, below), (names2, below2) = read(skeleton), read(reference)
    tags, tags2 = ([x.split(".", 1)[0] for x in n] for n in (names, names2))
    # Only nodes whose parents can match are compared, so a deep page costs no more than its depth.
    pairs = [(0, 0)]
    for i, j in pairs:
        pairs += [(p, q) for p in below[i] for q in below2[j] if tags[p] == tags2[q]]
    weight: dict[tuple[int, int], int] = {}
    table: dict[tuple[int, int], list[list[int]]] = {}
    for i, j in reversed(pairs):  # children before their parents
        a, b = below[i], below2[j]
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x, p in enumerate(a, 1):
            for y, q in enumerate(b, 1):
                m[x][y] = max(m[x - 1][y], m[x][y - 1], m[x - 1][y - 1] + weight.get((p, q), 0))
        weight[i, j], table[i, j] = m[-1][-1] + 2 + (names[i] == names2[j]), m
    out = [-1] * len(names)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        out[i] = j
        m, x, y = table[i, j], len(below[i]), len(below2[j])
        while x and y:
            p, q = below[i][x - 1], below2[j][y - 1]
            if m[x][y] == m[x - 1][y]:
                x -= 1
            elif m[x][y] == m[x][y - 1]:
                y -= 1
            else:
                todo.append((p, q))
                x, y = x - 1, y - 1
    return tuple(out)


def _value_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def induce(pages: DataFrame, url: Column, html: Column) -> DataFrame:
    """The wrapper of each host: (host, reference, template nodes)."""
    def trees(hosts, texts):
        skeletons, nodes, values = [], [], []
        for t in texts:
            page = Page(t)
            found = page.values()
            skeletons.append(page.skeleton())
            nodes.append([n for n, _ in found])
            values.append([v for _, v in found])
        return hosts, skeletons, nodes, values

    seen = map_texts(pages, [host_of(url), html], trees, "host string, skeleton string, nodes array<int>, slots array<long>")
    seen = materialize(seen, "page_trees")
    # Pages of a host with the same values are copies: one of them counts.
    tree = F.struct("skeleton", "nodes", "slots")
    seen = seen.groupBy("host", F.xxhash64(F.sort_array("slots")).alias("page")).agg(F.min(tree).alias("tree"))
    seen = materialize(seen.select("host", "tree.*"), "distinct_pages")
    common = seen.groupBy("host", "skeleton").agg(F.count(F.lit(1)).alias("n"))
    reference = materialize(common.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "skeleton")).alias("reference")), "references")

    def places(hosts, skeletons, references, nodes, values):
        out: list[list] = [[], [], []]
        for h, s, r, own, found in zip(hosts, skeletons, references, nodes, values, strict=True):
            to = aligned(s, r)
            for n, v in zip(own, found, strict=True):
                if to[n] >= 0:
                    out[0].append(h)
                    out[1].append(to[n])
                    out[2].append(v)
        return out

    met = seen.join(broadcast_if_small(reference), "host")
    slots = map_texts(met, [F.col(c) for c in ("host", "skeleton", "reference", "nodes", "slots")], places, "host string, node int, value long")
    # Two nodes of a page never share a partner, so a block counts once a page.
    counted = materialize(slots.groupBy("host", "node", "value").agg(F.count(F.lit(1)).alias("n")), "slot_counts")
    on = materialize(met.select("host", "skeleton", "reference", "nodes").transform(_pages_at), "node_pages")
    n, pages = F.col("n").cast("double"), F.col("pages")
    nodes = counted.groupBy("host", "node").agg(F.sum(n).alias("blocks"), F.sum(n * (n - 1)).alias("again")).join(on, ["host", "node"])
    # A node of one block a page is judged as a whole; a list block by block, as its items need not be alike.
    fixed = (F.col("blocks") == pages) & (F.col("again") >= AGREE_SHARE * pages * (pages - 1))
    nodes = materialize(nodes.select("host", "node", "pages", fixed.alias("fixed")).filter(pages >= MIN_PAGES), "slot_nodes")
    fixed = nodes.filter("fixed").groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("template"))  # at most the nodes of one tree
    single = counted.filter(n >= MIN_PAGES).join(nodes.filter("NOT fixed"), ["host", "node"]).filter(n - 1 >= AGREE_SHARE * (pages - 1))
    # Each is on a third of the node's pages: at most three times the blocks of a page.
    single = single.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "value"))).alias("recurring"))
    return materialize(reference.join(fixed, "host", "left").join(single, "host", "left"), "wrappers")


def _pages_at(met: DataFrame) -> DataFrame:
    """(host, node, pages): distinct pages that have a block at the reference node."""
    def places(hosts, skeletons, references, nodes):
        out: list[list] = [[], []]
        for h, s, r, own in zip(hosts, skeletons, references, nodes, strict=True):
            to = aligned(s, r)
            for j in {to[n] for n in own} - {-1}:
                out[0].append(h)
                out[1].append(j)
        return out

    at = map_texts(met, [F.col(c) for c in ("host", "skeleton", "reference", "nodes")], places, "host string, node int")
    return at.groupBy("host", "node").agg(F.count(F.lit(1)).alias("pages"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): one row per row of ``pages``.

    Blocks in page order, joined by one newline; inside a block character
    references are decoded and white space becomes one space.  Null and empty
    pages give an empty text; pages without a url form a host of their own;
    hosts with few pages, or pages unlike their host's reference, are judged by
    the elements alone.  Repeated rows repeat their result; an empty table
    gives no rows; other columns are ignored; pages are read whole.
    """
    url, html = F.col(f"`{url_col}`").cast("string"), text_or_empty(html_col)
    wrappers = induce(pages, url, html)
    x = pages.select(F.col(f"`{id_col}`").alias("_id"), url.alias("_url"), html.alias("_html"), host_of(url).alias("host"))
    x = x.join(broadcast_if_small(wrappers), "host", "left")

    def texts(ids, urls, htmls, references, templates, recurring):
        found = []
        for h, reference, nodes, blocks in zip(htmls, references, templates, recurring, strict=True):
            page = Page(h)
            to = aligned(page.skeleton(), reference) if nodes or blocks else ()
            fixed, again = frozenset(nodes or ()), {}
            for b in blocks or ():
                again.setdefault(b["node"], []).append(b["value"])
            own = frozenset(i for i, j in enumerate(to) if j in fixed)
            found.append(page.content(own, frozenset((i, v) for i, j in enumerate(to) for v in again.get(j, ()))))
        return ids, urls, found, [len(t) for t in found]

    kind = pages.schema[id_col].dataType.simpleString()
    return map_texts(x, [F.col(c) for c in ("_id", "_url", "_html", "reference", "template", "recurring")], texts,
                     f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
