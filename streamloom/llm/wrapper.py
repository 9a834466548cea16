"""Main text of web pages by wrapper induction over the pages of a host.

Every page is reduced to the tree of its containers (children of one label in a row are one repeated
node). Of a host's commonest tree the page of least id is its reference; each page is aligned with it by simple tree
matching (Yang, 1991): the largest mapping of nodes that keeps labels, parents and order. Over all pages of a host,
a node whose text is the same as the reference's in most pages where it is matched is template, and
one whose text varies is a slot. Pages that share most of their text with the reference are copies of it and say nothing.
From the body the wrapper goes down to the lowest container that holds all varying content text, or to the
article or main element with most of it; that is the host's content root. Template containers inside it are left out of
the pages where they have the template's text; slots that are mostly links don't count as content text.

Names come second. An element that says that it isn't content (nav, footer, form, a class such as sidebar, advert,
cookie or comment) is believed where its text varies, as adverts and comments do, unless the wrapper finds most
of the host's varying text in it. A host without varying slots (one page, or copies of one) has no root; then
the page's article or main element, else its body, is the root, and names are all there is. Paragraphs and headings of the
root are kept whatever they say, so lines that many pages share are not lost.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, small, spent, table, written

#: Shares that make a wrapper: of pages in which a template node has the reference's text, of the
#: pages in which it is matched at all, of varying text that a child with an article or main element must hold.
SAME, MATCHED, HOLDS = 0.9, 0.5, 0.6
#: Elements open at once; deeper ones become siblings, as in browsers, so that no text is lost.
DEPTH = 200
#: Share of a slot's text in links from which it is navigation, of a page's text that makes it a copy of the reference.
LINKS, COPY = 0.6, 0.8

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article aside body center details div fieldset figure footer form header html main menu nav section table ul ol dl".split())
CLOSES_P = BLOCK - frozenset("option td th tr tbody thead tfoot legend summary head title".split())
NEVER = frozenset("head title nav footer aside form script style noscript template button select option iframe svg object dialog menu canvas textarea search".split())
#: Words of a class, id or role that name what isn't content.
SAYS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs complementary comment comments comentarios consent contentinfo cookie cookies copyright disqus footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation navigationbar newsletter notice notices pager pagination popup promo promoted promotion related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = frozenset("ul ol dl table".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style textarea noscript template iframe svg".split()}
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "label", "says", "children", "parent", "depth", "own")

    def __init__(self, tag: str, label: str, says: bool, parent: "Node | None"):
        self.tag, self.label, self.says, self.parent = tag, label, says, parent
        self.depth: int = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.own: list[str] = []


@lru_cache(65_536)
def named(tag: str, attributes: str) -> tuple[str, bool]:
    """Label of an element, and whether its names say that it isn't content."""
    label, says = tag, tag in NEVER
    for m in _NAMES.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            says = True
        elif name in ("class", "id", "role"):
            words = _WORD.findall(value)
            says |= tag not in ("html", "body", "article", "main") and not SAYS.isdisjoint(words)
            if name == "class":
                label += "." + ".".join(words)
    return label, says


def tags(page: str):
    """(start, end, closing, name, attributes) of each tag and comment (name None); elements of raw text are skipped
    whole, as comments are. Every character is looked at a bounded number of times, however broken the markup."""
    at, last, lone = 0, page.rfind(">"), set()
    while 0 <= (start := page.find("<", at)) < last:
        m = _TAG.match(page, start)
        if m is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 2)
                at = len(page) if end < 0 else end + 3
            elif page[start + 1] in "!?":
                at = page.index(">", start) + 1
            else:
                at = start + 1
                continue
            yield start, at, False, None, ""
            continue
        end = m.end()
        while (end := _PLAIN.match(page, end).end()) < len(page) and page[end] != ">":
            quote = page[end]
            close = -1 if quote in lone else page.find(quote, end + 1)
            if close < 0:  # an open quote is a character like others
                lone.add(quote)
                end += 1
            else:
                end = close + 1
        if end == len(page):  # every end is quoted, so from here on quotes don't count
            lone |= {'"', "'"}
            end = page.find(">", m.end())
        name, attributes = m[2].lower(), page[m.end() : end]
        at = end + 1
        if not m[1] and name in _RAW:
            close = _RAW[name].search(page, at)
            at = close.end() if close else len(page)
            name = None
        yield start, at, bool(m[1]), name, attributes
    if page.startswith("<!--", start) and start >= 0:
        yield start, len(page), False, None, ""


def walk(page: str, on_text, on_edge) -> Node:
    """Read a page: on_text(node, raw text) for each run of text, on_edge(node) where a block starts or
    ends. Missing and stray end tags are met as browsers do in the cases that matter here."""
    root = Node("#", "#", False, None)
    node, at = root, 0

    def close(target: Node) -> None:
        nonlocal node
        while node is not target:
            if node.tag in BLOCK:
                on_edge(node)
            node = node.parent
        if node.tag in BLOCK:
            on_edge(node)
        node = node.parent

    for start, end, closing, tag, attributes in tags(page):
        if start > at:
            on_text(node, page[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                close(up)
            continue
        if tag in VOID:
            if tag == "hr":
                on_edge(node)
            else:
                on_text(node, " ") if tag == "br" else None
            continue
        if tag in CLOSES_P or tag in SAME_CLOSES:
            ends = SAME_CLOSES.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
            up, found = node, None
            while up.parent is not None and up.tag not in LIMITS and (up.tag not in CONTAINER or up.tag in ends):
                if up.tag in ends:
                    found = up
                    if up.tag != "p":
                        break
                up = up.parent
            if found is not None:
                close(found)
        if node.depth == DEPTH:
            close(node)
        label, says = named(tag, attributes)
        own = Node(tag, label, says, node)
        if tag in BLOCK:
            on_edge(node)
        node.children.append(own)
        if not attributes.endswith("/"):
            node = own
    if at < len(page):
        on_text(node, page[at:])
    while node.parent is not None:
        close(node)
    on_edge(root)
    return root


def clean(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


def skeleton(page: str) -> list:
    """[label, content?, hash, size, children, hash of the content text in no container child, size of links] of the
    page's container tree."""

    def text(node: Node, raw: str) -> None:
        node.own.append(raw)

    return folded(walk(page, text, lambda node: None))


def folded(root: Node, seen=None) -> list:
    """skeleton of a tree whose text is in own; seen(node, tree) is called for containers, where repeated ones share a tree."""

    def fold(node: Node) -> list:
        h, size, children, rest, links = xxhash.xxh3_64(), 0, [], [], 0
        own = "".join(node.own)
        if own:
            own = clean(own)
            h.update(own)
            size += len(own)
        if own:
            rest.append(own)
        for child in node.children:
            c = fold(child)
            h.update(c[2].to_bytes(8, "little"))
            size += c[3]
            links += c[6]
            if child.tag in CONTAINER:
                if children and children[-1][0] == c[0]:  # a repeated node
                    last = children[-1]
                    last[2], last[3], last[6] = xxhash.xxh3_64_intdigest(last[2].to_bytes(8, "little") + c[2].to_bytes(8, "little")), last[3] + c[3], last[6] + c[6]
                else:
                    children.append(c)
                if seen:
                    seen(child, children[-1])
            elif c[3] and not child.says:
                rest.append(str(c[2]))
        return [node.label, not node.says, h.intdigest(), size, children, xxhash.xxh3_64_intdigest("\0".join(rest)) if rest else 0, size if node.tag == "a" else links]

    return fold(root)


def shape(node: list) -> tuple:
    return node[0], tuple(shape(c) for c in node[4])


def paths(node: tuple, at: tuple = ()):
    yield at
    for i, c in enumerate(node[1]):
        yield from paths(c, (*at, i))


@lru_cache(65_536)
def match(a: tuple, b: tuple) -> tuple[int, tuple[tuple[tuple, tuple], ...]]:
    """Simple tree matching of two shapes: pairs in the mapping, and of the pairs the paths (child
    numbers from the root) in a and in b."""
    if a[0] != b[0]:
        return 0, ()
    if a == b:  # all nodes, which only one mapping has
        both = tuple((x, x) for x in paths(a))
        return len(both), both
    p, q = a[1], b[1]
    head = 0  # equal subtrees at either end are matched in some largest mapping
    while head < min(len(p), len(q)) and p[head] == q[head]:
        head += 1
    tail = 0
    while tail < min(len(p), len(q)) - head and p[-1 - tail] == q[-1 - tail]:
        tail += 1
    n, m = len(p) - head - tail, len(q) - head - tail
    equal = [(i, i) for i in range(head)] + [(len(p) - 1 - i, len(q) - 1 - i) for i in range(tail)]
    pairs = [((), ()), *(((i, *x), (j, *x)) for i, j in equal for x in paths(p[i]))]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    sub = {}
    for i in range(n):
        for j in range(m):
            x, y = p[head + i], q[head + j]
            sub[i, j] = match(x, y) if x[0] == y[0] else (0, ())
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + sub[i, j][0])
    i, j = n, m
    while i and j:
        if sub[i - 1, j - 1][0] and best[i][j] == best[i - 1][j - 1] + sub[i - 1, j - 1][0]:
            i, j = i - 1, j - 1
            pairs += [((head + i, *x), (head + j, *y)) for x, y in sub[i, j][1]]
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return len(pairs), tuple(pairs)


def at_path(node: list, path: tuple) -> list:
    for i in path:
        node = node[4][i]
    return node


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def named_content(node: list) -> bool:
    """Whether the tree has an article or main element."""
    return node[1] and (node[0].split(".")[0] in ("article", "main") or any(map(named_content, node[4])))


def induce(reference: list, stats: dict[tuple, tuple[int, int, int, int, int]]) -> tuple[list[str] | None, list[list], list[list[str]]]:
    """(label path of the content root or None, [label path, hash] of template containers inside it, label paths of
    navigation beside its text) from the reference tree and, by path in it, sums over the other pages that aren't copies:
    (matched, same, varying size, of it in links, pages with other content text in no child)."""
    none = (0, 0, 0, 0, 0)

    def varying(path: tuple) -> bool:
        matched, same, *_ = stats.get(path, none)
        return matched > 0 and same < SAME * matched

    def linked(path: tuple) -> bool:
        return stats.get(path, none)[3] > LINKS * stats.get(path, none)[2]

    node, path, labels = reference, (), [reference[0]]
    if not varying(()):
        return None, [], []
    while True:
        slots = [(stats.get((*path, i), none)[2], i) for i, c in enumerate(node[4]) if not linked((*path, i))]
        inner = [(size, i) for size, i in slots if node[4][i][1] and node[4][i][0].split(".")[0] != "header"]
        most = max(slots, key=lambda x: (x[0], -x[1]), default=(0, 0))
        if most not in inner and most[0] >= HOLDS * sum(size for size, _ in slots):
            inner = [most]  # it says that it isn't content, but most of what varies is in it
        size, i = max(inner, key=lambda x: (x[0], -x[1]), default=(0, 0))
        if not size or not varying((*path, i)):
            break
        if named_content(node[4][i]):
            if size < HOLDS * stats[path][2] and node[0] not in ("#", "html"):
                break
        elif stats[path][4] or any(x for x, k in inner if k != i):  # text that the child doesn't hold
            break
        node, path = node[4][i], (*path, i)
        labels.append(node[0])
        if node[0].split(".")[0] in ("article", "main"):
            break
    beside = [[*labels, c[0]] for i, c in enumerate(node[4]) if varying((*path, i)) and linked((*path, i)) and labels[-1].split(".")[0] not in ("article", "main")]
    drops = []
    pages = stats[()][0]

    def inside(n: list, p: tuple, names: list[str]) -> None:
        for i, c in enumerate(n[4]):
            matched, same, *_ = stats.get((*p, i), none)
            if matched and matched >= MATCHED * pages and same >= SAME * matched and c[0].split(".")[0] in ("div", "section", "ul", "ol", "table"):
                drops.append([[*names, c[0]], c[2]])
            else:
                inside(c, (*p, i), [*names, c[0]])

    inside(node, path, labels)
    return labels, drops, beside


def main_text(page: str, root: list[str] | None, drops: list[list], beside: list[list[str]]) -> str:
    """Blocks of the page's content root, one a line, without containers that have a template's path and text, and
    those at the paths ``beside`` that are mostly links."""
    root_at, drop_at, beside_at = tuple(root or ()), {(tuple(d), h) for d, h in drops}, set(map(tuple, beside))
    tree_of: dict[int, list] = {}
    levels = {"wrapper": [], "article": [], "body": []}
    depth: dict[int, tuple] = {}
    held: list[tuple[int, str]] = []

    def facts(node: Node) -> tuple:
        """(path of labels, excluded, within the wrapper's root, within article or main)"""
        if id(node) not in depth:
            if node.parent is None:
                depth[id(node)] = ((node.label,), False, False, False, node)
            else:
                path, out, wrapped, article, _ = facts(node.parent)
                kept_path = (*path, node.label) if node.tag in CONTAINER else path
                is_root = bool(root_at) and node.tag in CONTAINER and kept_path == root_at
                article = article or node.tag in ("article", "main") and not out
                tree = tree_of.get(id(node))
                # a header inside the article holds its headings
                says = node.says or node.tag == "header" and not article
                if node.tag in CONTAINER and root_at[: len(kept_path)] == kept_path:
                    says = False  # the wrapper knows better
                out = out or says or tree is not None and ((kept_path, tree[2]) in drop_at or kept_path in beside_at and tree[6] > LINKS * tree[3])
                depth[id(node)] = (kept_path, out, wrapped or is_root, article, node)
        return depth[id(node)]

    def flush(_=None) -> None:
        for level, at in (("wrapper", 2), ("article", 3), ("body", None)):
            text = clean("".join(raw for f, raw in held if not f[1] and (at is None or f[at])))
            if text:
                levels[level].append(text)
        held.clear()

    runs: list[tuple[Node, str | None]] = []

    def text(node: Node, raw: str) -> None:
        node.own.append(raw)
        runs.append((node, raw))

    top = walk(page, text, lambda node: runs.append((node, None)))
    if drop_at or beside_at:
        folded(top, lambda node, tree: tree_of.__setitem__(id(node), tree))
    for node, raw in runs:
        if raw is None:
            flush()
        else:
            held.append((facts(node), raw))
    return "\n".join(levels["wrapper"] or levels["article"] or levels["body"])


def _skeletons(batches):
    for batch in pieces(batches):
        k, u, h = (c.to_pylist() for c in batch.columns)
        trees = [skeleton(x or "") for x in h]
        shapes = [xxhash.xxh3_64_intdigest(repr(shape(t))) - 2**63 for t in trees]
        columns = [batch.column(0), pa.array([host_of(x) for x in u], pa.string()), pa.array([json.dumps(t, separators=(",", ":")) for t in trees], pa.string()), pa.array(shapes, pa.int64()), pa.array([t[3] for t in trees], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "tree", "shape", "size"])


_SUMS = ["matched", "same", "size", "links", "rest"]


def aligned(tree: list, ref: list, ref_shape: tuple, add) -> None:
    """add(path in ref, what a page says of it) for every node of ref that the page has, unless it is a copy of it."""
    pairs = match(shape(tree), ref_shape)[1]
    mapped = {p for p, _ in pairs}
    facts, equal = [], 0
    for p, q in pairs:
        a, b = at_path(tree, p), at_path(ref, q)
        same = a[2] == b[2]
        if same and (not p or at_path(tree, p[:-1])[2] != at_path(ref, q[:-1])[2]):
            equal += a[3]
        # text outside the matched containers that isn't the reference's
        rest = not same and (a[5] != b[5] or any(c[1] and c[3] and (*p, i) not in mapped for i, c in enumerate(a[4])))
        facts.append((q, (1, int(same), 0 if same else a[3], 0 if same else a[6], int(rest))))
    if equal < COPY * max(tree[3], 1):
        for q, x in facts:
            add(q, x)


def _align(batches):
    """Sums over the pages of a task: by host and path in the reference, what ``induce`` reads."""
    sums: dict = defaultdict(lambda: [0, 0, 0, 0, 0])

    def out():
        rows = [(h, json.dumps(p), *v) for (h, p), v in sums.items()]
        columns = list(zip(*rows)) or [()] * 7
        kinds = (pa.string(), pa.string(), *[pa.int64()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["host", "path", *_SUMS])

    def add(host: str, path: tuple, values: tuple) -> None:
        own = sums[host, path]
        for k, v in enumerate(values):
            own[k] += v

    @lru_cache(256)
    def loaded(text: str):
        tree = json.loads(text)
        return tree, shape(tree)

    for batch in pieces(batches):
        for host, own, reference in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "reference"))):
            tree = json.loads(own)
            ref, ref_shape = loaded(reference)
            aligned(tree, ref, ref_shape, lambda q, x: add(host, q, x))
        if len(sums) > 100_000:
            yield out()
            sums.clear()
    yield out()


def _wrap(batches):
    for batch in pieces(batches):
        roots = []
        for tree, nodes in zip(*(batch.column(c).to_pylist() for c in ("reference", "nodes"))):
            stats = {tuple(json.loads(n["path"])): tuple(n[c] for c in _SUMS) for n in nodes}
            roots.append(json.dumps(induce(json.loads(tree), stats)))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(roots, pa.string())], ["host", "wrapper"])


def _extract(batches):
    load = lru_cache(4096)(json.loads)
    for batch in pieces(batches):
        texts = [main_text(h or "", *(load(w) if w else (None, [], []))) for h, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) for each host of pages (page_id, url, html): JSON of what ``induce`` returns."""
    trees = written(arrow_map(pages.select("page_id", "url", "html"), _skeletons, "page_id long, host string, tree string, shape long, size long"), "trees")
    shapes = trees.where("size > 0").groupBy("host", "shape").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "tree")).alias("least"))
    best = F.max_by("least.tree", F.struct("n", -F.col("least.page_id"), "shape"))
    references = written(shapes.groupBy("host").agg(best.alias("reference")), "references")
    paired = trees.join(small(references, 20_000), "host").select("host", "tree", "reference")
    sums = arrow_map(paired, _align, "host string, path string, " + ", ".join(f"{c} long" for c in _SUMS))
    nodes = sums.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in _SUMS))
    nodes = nodes.groupBy("host").agg(F.collect_list(F.struct("path", *_SUMS)).alias("nodes"))  # one per node of one page
    out = written(arrow_map(references.join(nodes.hint("merge"), "host"), _wrap, "host string, wrapper string"), "wrappers")
    spent(trees)
    return out


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    A null or empty html has an empty text; a null or malformed url counts to the host without a name.
    Character references are decoded, white space inside a block is one space, blocks are joined by a
    newline in page order. Broken markup is read as far as it goes. Repeated rows get equal texts. Other
    columns aren't read.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    own = wrappers(pages)
    host = F.udf(host_of, "string", useArrow=True)
    joined = pages.withColumn("host", host("url")).join(small(own), "host", "left").select("page_id", "url", "html", "wrapper")
    return arrow_map(joined, _extract, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
