"""Main text of web pages by wrapper induction.

All pages of each host are parsed and their trees folded into one by simple tree matching: at every level, the children of
two nodes are aligned in order so that the number of matching nodes below is largest; neighbours with the same tag and
class are one repeated slot. Pages of one shape add up where they are read; different shapes are merged in groups of
``GROUP``, in the order of their digests, and the results again, so neither partitions nor order matter and no task holds
all shapes of a host. A name on fewer than two pages, or than one page in ``RARE`` of its host, counts as none, so names
that are new on each page do not make the tree grow. In the folded tree, nodes
whose text never changes are template, the others are slots. The content is the region that holds the varying text
outside links, menus, forms and the like; fixed blocks inside it, present on all pages, are template as well. Every
page of the host is aligned with that tree, its content nodes give the text. Pages of hosts without a varying region, or
which do not align, use the tags alone (article, main, or else the body).

Which blocks of running text never change is counted over all pages of the host, whether aligned or not: by the tags above a
block and its text, a constant one (see ``constants``) is template wherever it stands. Headings are never constant. Names
(class, id, role) leave a node out only if all of them name what is no article.

Only (host, tree) rows move, and pages are joined with them by broadcast within a checked size, else by a join that is
split at hot hosts. Null and empty pages give an empty text; a null or hostless url has no wrapper. Very deep nesting is
flattened at ``DEEPEST`` levels without losing text. Rows that repeat get a row each.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, look_up, map_texts, mapped, ship

#: Trees that are merged in one group.
GROUP = 64
#: A name is known if it is on one page of its host in so many.
RARE = 256
DEEPEST = 120
#: Different pages that a block has to be on before it can be called constant.
LEAST = 3
#: A region is entered if it holds this share of its parent's varying text.
SHARE = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table
tbody td tfoot th thead tr ul br""".split())
SKIP = RAW | frozenset("nav footer aside form head button select dialog menu svg object canvas audio video input".split())
REGION = frozenset("body div section article main table tbody tr td center html".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
WHOLE = TEXTUAL - HEADINGS | {"table"}
CLOSED_BY = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option"}}
#: Names of what is no article, and names that say nothing; a node is left out by name if all its names consist of these.
NOISE = re.compile(r"ads?|advert\w*|banners?|sponsor\w*|promos?|promotion|sidebar|nav|navbar|navigation|menus?|footer|header|masthead|cookies?"
                   r"|consent|notices?|popup|modal|comments?|replies|share|sharing|social|related|newsletter|subscribe|breadcrumbs?", re.I)
PLAIN = re.compile(r"site|page|top|bottom|left|right|side|box|block|list|bar|section|wrap|wrapper|container|widget|area|slot|inner|outer|posts?|links?"
                   r"|icons?|buttons?|item|main|global|primary|secondary|form|signup|user|clearfix|row|col|the|\d*", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(/?)([A-Za-z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<""", re.S | re.X)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


class Node:
    __slots__ = ("tag", "name", "children")

    def __init__(self, tag: str, name: str = "") -> None:
        self.tag, self.name = tag, name
        self.children: list[Node | str] = []

    @property
    def label(self) -> tuple[str, str]:
        return self.tag, self.name

    def skipped(self) -> bool:
        return self.tag in SKIP or bool(self.name) and self.tag not in ("body", "html", "article", "main") and noise(self.name)


@lru_cache(100_000)
def noise(names: str) -> bool:
    """Whether class, id and role name nothing but what is no article: ``ad-slot`` does, ``no-sidebar``, ``entry-header`` and
    ``social policy`` do not."""
    parts = re.split(r"[\s_-]+", names.strip())
    return any(NOISE.fullmatch(p) for p in parts) and all(NOISE.fullmatch(p) or PLAIN.fullmatch(p) for p in parts)


def parse(text: str) -> Node:
    root = Node("#")
    stack, at = [root], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0][0] != "<" or m[0] == "<":
                stack[-1].children.append(m[0])
            continue
        if m[1] or m[4]:  # an end tag closes what is open inside; without a start tag it is nothing
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        k = len(stack) - 1
        while k > 0:  # what is open and ends where this tag starts
            if tag in CLOSED_BY.get(stack[k].tag, ()):
                del stack[k:]
            elif stack[k].tag in BLOCK:
                break
            k -= 1
        names = " ".join(v.strip("\"'") for _, v in _NAMES.findall(m[3] or m[6] or ""))
        node = Node(tag, names)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(text, at)
            stop = end.start() if end else len(text)
            node.children.append(text[at:stop])
            at = stop
        elif tag not in VOID and not (m[3] or m[6] or "").endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    return root


def pieces(node: Node, out: list[str], dropped: frozenset[int] = frozenset(), inside: bool = False) -> None:
    """The text of a subtree in page order; blocks stand apart."""
    for c in node.children:
        if isinstance(c, str):
            out.append(html.unescape(c))
        elif c.skipped() or id(c) in dropped or (c.tag == "header" and not inside and not _first(c, "h1")):
            out.append(" ")
        else:
            edge = " " if c.tag in BLOCK else ""
            out.append(edge)
            pieces(c, out, dropped, inside or c.tag in ("article", "main"))
            out.append(edge)


def text_of(nodes: list[Node], dropped: frozenset[int] = frozenset()) -> str:
    out: list[str] = []
    for n in nodes:
        pieces(n, out, dropped, n.tag in ("article", "main"))
        out.append(" ")
    return " ".join("".join(out).split())


def runs(node: Node) -> list[list[Node]]:
    """Child elements, neighbours with one label together. Inline and skipped elements carry no structure."""
    out: list[list[Node]] = []
    for c in node.children:
        if isinstance(c, str) or not (c.tag in BLOCK or c.tag in SKIP) or c.tag == "br":
            continue
        if out and out[-1][0].label == c.label:
            out[-1].append(c)
        else:
            out.append([c])
    return out


class Slot:
    """A node of the folded tree. Of its texts, the least and the greatest digest tell whether they differ."""

    __slots__ = ("label", "children", "pages", "repeated", "least", "most", "chars", "mark", "names")

    def __init__(self, label: tuple[str, str]) -> None:
        self.label, self.children, self.pages = label, [], 0
        self.repeated, self.least, self.most, self.chars, self.mark = False, 1 << 32, -1, 0, ""

    def varies(self) -> bool:
        return self.least < self.most

    def add(self, pages: int, repeated: bool, least: int, most: int, chars: int) -> None:
        self.pages, self.repeated, self.chars = self.pages + pages, self.repeated or repeated, self.chars + chars
        self.least, self.most = min(self.least, least), max(self.most, most)

    def packed(self) -> list:
        return [*self.label, self.pages, self.repeated, self.least, self.most, self.chars, [c.packed() for c in self.children]]

    def shape(self) -> list:
        return [*self.label, [c.shape() for c in self.children]]


def aligned(own: list[list], slots: list[Slot], below: Callable = runs) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of children: the largest number of matching nodes, and which match."""
    if not own or not slots:
        return 0, []
    # Equal ends match by themselves; what is left is aligned by dynamic programming.
    a = b = 0
    while a < min(len(own), len(slots)) and own[a][0].label == slots[a].label:
        a += 1
    while b < min(len(own), len(slots)) - a and own[-1 - b][0].label == slots[-1 - b].label:
        b += 1
    found = [(i, i) for i in range(a)] + [(len(own) - 1 - k, len(slots) - 1 - k) for k in range(b)]
    score = len(found)
    mid, rest = own[a:len(own) - b], slots[a:len(slots) - b]
    if mid and rest:
        best = [[0] * (len(rest) + 1) for _ in range(len(mid) + 1)]
        match = {}
        for i, x in enumerate(mid):
            for j, y in enumerate(rest):
                value = max(best[i][j + 1], best[i + 1][j])
                if x[0].label == y.label:
                    match[i, j] = 1 + aligned(below(x[0]), y.children, below)[0]
                    value = max(value, best[i][j] + match[i, j])
                best[i + 1][j + 1] = value
        i, j = len(mid), len(rest)
        score += best[i][j]
        while i and j:
            if (i - 1, j - 1) in match and best[i][j] == best[i - 1][j - 1] + match[i - 1, j - 1]:
                i, j = i - 1, j - 1
                found.append((a + i, a + j))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return score, sorted(found)


def plain(node: Node) -> tuple[str, int]:
    """A subtree's text and its characters outside links and skipped parts."""
    out: list[str] = []
    pieces(node, out)
    linked: list[str] = []

    def links(n: Node) -> None:
        for c in n.children:
            if not isinstance(c, str):
                pieces(c, linked) if c.tag == "a" else links(c)

    links(node)
    text = " ".join("".join(out).split())
    return text, max(0, len(text) - len(" ".join("".join(linked).split())))


def fold(slot: Slot, nodes: list[Node]) -> None:
    """Take one page's run of nodes into the slot."""
    texts = [plain(n) for n in nodes]
    code = crc32("\n".join(t for t, _ in texts).encode())
    slot.add(1, len(nodes) > 1, code, code, sum(n for _, n in texts))
    for node in nodes:
        own = runs(node)
        pairs = dict(aligned(own, slot.children)[1])
        children, taken = [], 0
        for i, run in enumerate(own):
            if i in pairs:
                children += slot.children[taken:pairs[i] + 1]
                taken = pairs[i] + 1
                fold(children[-1], run)
            else:
                children.append(Slot(run[0].label))
                fold(children[-1], run)
        slot.children = children + slot.children[taken:]


def known(node: Node, names: frozenset[str]) -> Node:
    """Leave out names that are not known; all names of what is no article become one."""
    for c in node.children:
        if not isinstance(c, str):
            if c.name:
                c.name = "ads" if c.tag not in ("body", "html", "article", "main") and noise(c.name) else c.name if c.name in names else ""
            known(c, names)
    return node


def names_of(node: Node) -> set[str]:
    """Names in a tree that say something."""
    out: set[str] = set()
    for c in node.children:
        if not isinstance(c, str):
            if c.name and (c.tag in ("body", "html", "article", "main") or not noise(c.name)):
                out.add(c.name)
            out |= names_of(c)
    return out


def tree_of(page: str, names: frozenset[str]) -> Slot:
    """The folded tree of one page."""
    root = Slot(("#", ""))
    fold(root, [known(parse(page), names)])
    return root


def digest_of(root: Slot) -> str:
    return blake2b(json.dumps(root.shape(), ensure_ascii=False).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def added(into: Slot, tree: Slot) -> None:
    """Add up two trees of one shape."""
    into.add(tree.pages, tree.repeated, tree.least, tree.most, tree.chars)
    for a, b in zip(into.children, tree.children, strict=True):
        added(a, b)


def merged(into: Slot, tree: Slot) -> None:
    """Merge a folded tree into another by simple tree matching."""
    into.add(tree.pages, tree.repeated, tree.least, tree.most, tree.chars)
    pairs = dict(aligned([[c] for c in tree.children], into.children, lambda s: [[c] for c in s.children])[1])
    children, taken = [], 0
    for i, child in enumerate(tree.children):
        if i in pairs:
            children += into.children[taken:pairs[i] + 1]
            taken = pairs[i] + 1
            merged(children[-1], child)
        else:
            children.append(child)
    into.children = children + into.children[taken:]


def unpacked(given: list) -> Slot:
    slot = Slot((given[0], given[1]))
    slot.pages, slot.repeated, slot.least, slot.most, slot.chars = given[2:7]
    slot.children = [unpacked(c) for c in given[7]]
    return slot


def dumped(tree: list) -> str:
    return json.dumps(tree, ensure_ascii=False, separators=(",", ":"))


def merge_all(trees: list[tuple[str, str]]) -> tuple[str, str]:
    """(digest, packed tree) of trees given so: equal shapes are added up, then shapes merged in the order of their digests."""
    shapes: dict[str, Slot] = {}
    for digest, packed in sorted(trees):
        tree = unpacked(json.loads(packed))
        if digest in shapes:
            added(shapes[digest], tree)
        else:
            shapes[digest] = tree
    first, *others = shapes.values()
    for tree in others:
        merged(first, tree)
    return (digest_of(first) if others else next(iter(shapes))), dumped(first.packed())


def induce(root: Slot) -> str | None:
    """The folded tree of a host, with its content (c) and fixed blocks (d) marked, as JSON."""
    skip = lambda s: Node(*s.label).skipped()
    varies = Slot.varies
    region, entered = root, False
    while True:
        inner = [s for s in region.children if not skip(s)]
        textual = [s for s in inner if s.label[0] in TEXTUAL and varies(s)]
        regions = [s for s in inner if s.label[0] in REGION and varies(s)]
        named = [s for s in regions if s.label[0] in ("article", "main")]
        best = max(named or regions, key=lambda s: s.chars, default=None)
        if best is None or textual or (not named and best.chars < SHARE * sum(s.chars for s in inner)):
            break
        region, entered = best, True
        if named and best.label[0] == "article":
            break
    if not entered:
        return None
    region.mark = "c"

    def fixed(s: Slot) -> None:
        for c in s.children:
            if root.pages >= 4 and c.pages == s.pages >= 4 and not c.repeated and not varies(c) and c.label[0] in REGION:
                c.mark = "d"
            else:
                fixed(c)

    fixed(region)
    compact = lambda s: [*s.label, s.mark, [compact(c) for c in s.children]]
    return dumped(compact(root))


def _loaded(given: list) -> Slot:
    slot = Slot((given[0], given[1]))
    slot.mark = given[2]
    slot.children = [_loaded(c) for c in given[3]]
    slot.names = frozenset({given[1]}.union(*(c.names for c in slot.children)))
    return slot


def _marked(nodes: list[Node], slot: Slot, content: list[Node], dropped: set[int]) -> None:
    if slot.mark == "d":
        dropped.update(id(n) for n in nodes)
        return
    if slot.mark == "c":
        content += nodes
    for n in nodes:
        own = runs(n)
        for i, j in aligned(own, slot.children)[1]:
            _marked(own[i], slot.children[j], content, dropped)


def _first(node: Node, tag: str) -> list[Node]:
    """The outermost nodes with a tag."""
    out: list[Node] = []
    for c in node.children:
        if not isinstance(c, str):
            out += [c] if c.tag == tag else [] if c.tag in SKIP else _first(c, tag)
    return out


def main_text(page: str | None, wrapper: Slot | None, constant: frozenset[int] = frozenset()) -> str:
    """The text of a page without the constant blocks of its host; a page of nothing else keeps them."""
    if not page:
        return ""
    root = parse(page)
    content: list[Node] = []
    dropped: set[int] = set()
    if wrapper is not None:
        _marked([known(root, wrapper.names)], wrapper, content, dropped)
    content = content or _first(root, "article") or _first(root, "main") or _first(root, "body") or [root]
    fixed = {id(n) for k, n in blocks(root) if k in constant} if constant else set()
    return text_of(content, frozenset(dropped | fixed)) or text_of(content, frozenset(dropped))


def blocks(root: Node) -> list[tuple[int, Node]]:
    """Blocks of running text (paragraphs, lists, tables, and boxes without blocks inside) with a key of 64 bits from the tags
    above them and their text."""
    out: list[tuple[int, Node]] = []
    todo = [(root, "")]
    while todo:
        node, path = todo.pop()
        for c in node.children:
            if isinstance(c, str) or c.skipped() or c.tag not in BLOCK or c.tag in HEADINGS:
                continue
            where = f"{path}/{c.tag}"
            if c.tag in WHOLE or not any(not isinstance(x, str) and x.tag in BLOCK and x.tag != "br" for x in c.children):
                text = text_of([c])
                if text:
                    slot = blake2b(where.encode(), digest_size=4).digest()
                    key = slot + blake2b(text.encode(), digest_size=4).digest()
                    out.append((int.from_bytes(key, "big", signed=True), c))
            else:
                todo.append((c, where))
    return out


def constants(pages: DataFrame, url: str, page: str) -> DataFrame:
    """(host, constant): keys of the blocks that never change on a host, counted over all its pages.

    A block is constant if it is on at least ``LEAST`` different pages and on more than half of those that have a block at
    its place, so a place has one constant text at most. Equal pages count once.
    """
    keyed = pages.select(host_of(url).alias("host"), F.col(f"`{page}`").alias("page")).where("host IS NOT NULL AND page <> ''")

    def make():
        return lambda rows: [[sorted({k for k, _ in blocks(parse(p))}) for p in rows]]

    read = map_texts(keyed.select("host", "page", F.xxhash64("page").alias("h")), "page", ["host", "h"], "keys array<long>", make)
    once = read.select("host", "h", "_found.keys").groupBy("host", "h").agg(F.first("keys").alias("keys"))
    # Both counts of a place are partial sums; a hot host is reduced before it moves.
    key = once.select("host", F.explode("keys").alias("key"))
    counts = key.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    place = F.shiftright("key", 32)
    held = once.select("host", F.explode(F.array_distinct(F.transform("keys", lambda k: F.shiftright(k, 32)))).alias("place"))
    held = held.groupBy("host", "place").agg(F.count(F.lit(1)).alias("of"))
    kept = counts.where(F.col("n") >= LEAST).withColumn("place", place).join(held, ["host", "place"]).where("2 * n > of")
    return kept.groupBy("host").agg(F.array_sort(F.collect_list("key")).alias("constant"))


def host_of(url: str) -> Column:
    host = F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def known_names(keyed: DataFrame) -> DataFrame:
    """(host, names): the names that are on enough of a host's pages, counted over all of them."""
    def make():
        return lambda rows: [[sorted(names_of(parse(p))) for p in rows]]

    read = map_texts(keyed, "page", ["host"], "names array<string>", make)
    pages = keyed.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    counts = read.select("host", F.explode("_found.names").alias("name")).groupBy("host", "name").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.join(pages, "host").where((F.col("n") >= 2) & (F.col("n") * RARE >= F.col("of")))
    return kept.groupBy("host").agg(F.array_sort(F.collect_list("name")).alias("names"))


def shapes(keyed: DataFrame) -> DataFrame:
    """(host, digest, tree): the trees of all pages, added up for each shape of a host as far as a task reads them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], Slot] = {}

        def out() -> pa.RecordBatch:
            rows = [(host, digest, dumped(tree.packed())) for (host, digest), tree in found.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["host", "digest", "tree"])

        for batch in batches:
            for r in batch.to_pylist():
                tree = tree_of(r["page"], frozenset(r["names"] or ()))
                key = r["host"], digest_of(tree)
                if key in found:
                    added(found[key], tree)
                else:
                    found[key] = tree
                if len(found) >= 2000:
                    yield out()
        yield out()

    return mapped(keyed.select("host", "page", "names"), run, "host string, digest string, tree string")


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper): one row a host that has one."""
    keyed = pages.select(host_of(url).alias("host"), F.col(f"`{page}`").alias("page")).where("host IS NOT NULL AND page <> ''")
    named = look_up(keyed, keep(known_names(keyed), "names"), ["host"])

    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        digest, tree = merge_all(list(zip(rows["digest"], rows["tree"], strict=True)))
        return pd.DataFrame({"host": rows["host"].iloc[:1], "digest": [digest], "tree": [tree]})

    def of_host(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"host": rows["host"], "wrapper": [induce(unpacked(json.loads(t))) for t in rows["tree"]]})

    ship(pages.sparkSession)
    result = "host string, digest string, tree string"
    trees = keep(shapes(named).groupBy("host", "digest").applyInPandas(of_group, result), "shapes")
    while True:  # each time there are a part in GROUP as many
        many = trees.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"), F.count(F.lit(1)).alias("n")).where("n > 1")
        many = keep(many, "groups")
        if many.isEmpty():
            break
        group = F.pmod(F.xxhash64("digest"), F.coalesce("groups", F.lit(1))).alias("group")
        dealt = look_up(trees, many, ["host"]).select("host", "digest", "tree", group)
        trees = keep(dealt.groupBy("host", "group").applyInPandas(of_group, result), "trees")
    return keep(trees.select("host", "tree").mapInPandas(of_host, "host string, wrapper string").where("wrapper IS NOT NULL"), "wrappers")


def extract(pages: DataFrame, url: str = "url", page: str = "html", page_id: str = "page_id",
            carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (default: all) and a struct ``_found`` with the main text."""
    carry = pages.columns if carry is None else carry
    packed = pages.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_carried"), host_of(url).alias("host"),
                          F.col(f"`{page}`").alias("_page"))
    known_hosts = keep(wrappers(pages, url, page).join(constants(pages, url, page), "host", "full"), "hosts")
    met = look_up(packed, known_hosts, ["host"])

    def make():
        known: dict[str, Slot] = {}

        def work(rows: list) -> list:
            out = []
            for r in rows:
                given = r["wrapper"]
                if given is not None and given not in known:
                    if len(known) >= 2000:
                        known.clear()
                    known[given] = _loaded(json.loads(given))
                out.append(main_text(r["page"], known[given] if given is not None else None, frozenset(r["constant"] or ())))
            return [out]

        return work

    both = met.select("_carried", F.struct(F.col("_page").alias("page"), "wrapper", "constant").alias("_both"))
    out = map_texts(both, "_both", ["_carried"], "text string", make)
    return out.select(*(F.col("_carried").getField(c).alias(c) for c in carry), "_found")


def digest(pages: DataFrame) -> DataFrame:
    found = extract(pages.select("page_id", "url", "html"), carry=["page_id", "url"])
    return found.select("page_id", "url", "_found.text", F.length("_found.text").cast("long").alias("n_chars"))
