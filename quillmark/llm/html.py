"""Main text of web pages by wrapper induction.

Pages of one host are taken in groups, in the order of a hash, so a group depends on the host's pages alone. The pages of a group are parsed
into trees; those whose sets of element paths are alike are one layout. The trees of a layout are aligned with its first by simple tree
matching, which gives the wrapper: its slots are the places of texts, its elements those of the first tree. A slot with one text on
``SAME`` of the pages that have it is template, the others vary. Varying text outside of links is evidence of content: each block gives its share of a page's varying
characters to the element that holds it, half of that to the next one up, and so on; the element of the wrapper with the most
evidence over all pages is the content region, with headings right before it and siblings of its kind that hold ``KIN`` of its evidence. The
region's counterpart in each page, without template blocks and regions of links, is the main text.

Words of classes, roles and element names that mark menus, notices or comments halve the evidence of what they mark, and marked regions within the
content region go, as comparison alone cannot tell a comment or a form from an article. Pages with fewer than
``LEAST_PAGES`` unlike pages of their layout in the group have nothing to be compared with; only there such marks decide: what they
mark goes, and the article element, or main, or else the whole body is content.

The weight of a match depends on the elements alone, so it is remembered by the two subtrees' forms and
the alignment of two lists of children is one pass of vector operations a row.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.urls import host_and_path

#: Pages of a group (the last of a host has up to twice as many) and characters after which a group ends, which bounds a task's memory; children of an element that are matched at a time.
GROUP, GROUP_CHARS, STRETCH = 32, 8_000_000, 2000
#: Share of pages on which a template text is the same; of paths that pages of a layout have in common; of the region's evidence that a sibling holds; of links in a menu's text.
SAME, ALIKE, KIN, LINKS = 0.9, 0.5, 0.25, 0.5
#: A host with more than one in SHARES of all pages is dealt over several tasks.
SHARES = 1 << 16
#: Elements nested deeper than this hold nothing; what they would hold follows them.
DEEPEST = 200
#: Unlike pages of one layout that a wrapper is induced from, at least.
LEAST_PAGES = 3

# Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside form button select dialog menu object canvas audio video map datalist head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of classes and ids that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promotion promoted sidebar sidebars rail nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer footers copyright cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies respond disqus pagination pager pagenav widget widgets skip search toolbar paywall".split()
)
#: Of these, what takes a region out even if it holds articles (a list of comments, say), unless it holds main.
STRONG = frozenset("ad ads adv advert adverts advertisement advertisements sponsored comment comments reply replies respond disqus related recommended recommendations cookie cookies consent newsletter popup modal".split())
#: A region so named is one only outside the article.
HEADER = frozenset(("header",))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
FENCES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "optgroup": ("select",)}

_MARKUP = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_TAG_END = re.compile(r"(?:[^\"'>]|\"[^\"]*\"|'[^']*')*?>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.IGNORECASE) for name in RAW}


class Node:
    """An element. children: nodes and texts; form: the subtree's elements, as a number."""

    __slots__ = ("tag", "marked", "children", "form")

    def __init__(self, tag: str, marked: int = 0):
        self.tag, self.marked, self.children, self.form = tag, marked, [], 0


@lru_cache(maxsize=4096)
def _marks(attributes: str) -> int:
    """How attributes mark an element as something else than the article: 0 not, 1 by a word or role,
    2 as a header, 3 by a strong word."""
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "itemprop" and value.lower() == "comment":
            return 3
        if name == "role" and value.lower() in ROLES:
            found = max(found, 1)
        if name in ("class", "id"):
            words = {w.lower() for w in _WORDS.findall(value)}
            found = max(found, 3 if words & STRONG else 1 if words & MARKS else 2 if words & HEADER else 0)
    return found


def parse(page: str) -> Node:
    """The tree of a page; tags left open or closed out of turn are mended."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        start = m.start() if m else n
        if start > at:
            text = page[at:start]
            stack[-1].children.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        if m[1]:
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if not m[3]:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        close = _TAG_END.match(page, m.end())
        if close is None:  # a quote left open, or the page ends in the tag
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            if end < 0:
                break
        else:
            at = close.end()
        tag = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("table", "article", "main") and tag not in BLOCKS:
                    break
            else:
                if tag == "p":
                    stack[-1].children.append(Node("p"))
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                elif stack[k].tag in FENCES[tag]:
                    break
        attributes = page[m.end() : at - 1]
        node = Node(tag, _marks(attributes) if attributes.strip(" /\n\t\r") else 0)
        stack[-1].children.append(node)
        if tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)
    return root


def _has(node: Node, tags: frozenset, unmarked: bool = False) -> bool:
    todo = [c for c in node.children if type(c) is Node]
    while todo:
        x = todo.pop()
        if x.tag in tags and not (unmarked and x.marked):
            return True
        todo += [c for c in x.children if type(c) is Node]
    return False


_MAIN, _ONLY_MAIN = frozenset(("article", "main")), frozenset(("main",))


def _aside(c: Node, inside: bool) -> bool:
    """Whether a region is not the article. One that holds the article is kept, whatever its class."""
    if c.tag in DROPPED:
        return True
    if c.tag in ("html", "body", "main"):
        return False
    if c.marked == 3:
        return not _has(c, _ONLY_MAIN)
    if c.marked == 1:
        return not _has(c, _MAIN, unmarked=True)
    return (c.tag == "header" or c.marked == 2) and not inside and not _has(c, _MAIN)


def prune(node: Node, inside: bool = False) -> None:
    """Takes out the regions that are not the article; of a header inside the article the headings stay."""
    kept = []
    for c in node.children:
        if type(c) is Node:
            if _aside(c, inside):
                continue
            if c.tag == "header" and inside:
                c.children = [x for x in c.children if type(x) is Node and (x.tag in HEADINGS or _has(x, HEADINGS))]
            prune(c, inside or c.tag in _MAIN)
        kept.append(c)
    node.children = kept


def content_root(root: Node) -> Node:
    """The part of a pruned tree that holds the article: its outermost articles, or main, or all."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.tag == tag:
                found.append(x)
            else:
                todo += [c for c in reversed(x.children) if type(c) is Node]
        if found:
            out = Node("#root")
            out.children = found
            return out
    return root


_forms: dict[tuple, int] = {}
_shapes: list[tuple] = []
_weights: dict[tuple[int, int], int] = {}


def _number(node: Node) -> int:
    """Numbers the forms of a subtree: the element and its children's forms, 0 being a text."""
    todo = [(node, False)]
    while todo:
        x, ready = todo.pop()
        if not ready:
            todo.append((x, True))
            todo += [(c, False) for c in x.children if type(c) is Node]
            continue
        key = (x.tag, *(c.form if type(c) is Node else 0 for c in x.children))
        if key not in _forms:
            if not _shapes:
                _shapes.append(("#text",))
            _forms[key] = len(_shapes)
            _shapes.append(key)
        x.form = _forms[key]
    return node.form


def _table(a: tuple[int, ...], b: tuple[int, ...]) -> np.ndarray:
    """Best total weight of an order-preserving match of the first i of a and j of b."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    rows: dict[int, np.ndarray] = {}
    for i, x in enumerate(a):
        if x not in rows:
            known = {y: _weight(x, y) for y in set(b)}
            rows[x] = np.array([known[y] for y in b], np.int64)
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + rows[x]))
    return best


def _weight(a: int, b: int) -> int:
    """Nodes of the largest match of two forms: simple tree matching."""
    if a == 0 or b == 0:
        return int(a == b)
    key = (a, b)
    if key not in _weights:
        x, y = _shapes[a], _shapes[b]
        if x[0] != y[0]:
            w = 0
        else:
            w = 1 + sum(int(_table(x[1:][k : k + STRETCH], y[1:][k : k + STRETCH])[-1, -1]) for k in range(0, max(len(x), len(y)), STRETCH))
        _weights[key] = w
    return _weights[key]


def aligned(a: Node, b: Node) -> tuple[list[tuple[tuple[int, int], str, tuple[int, int], str]], list[tuple[Node, Node]]]:
    """Pairs of texts in matched places of two trees, (parent, position) and text of each; and pairs of matched elements. Lists of children
    longer than STRETCH are matched in consecutive stretches of it."""
    out, todo, nodes = [], [(a, b)], []
    while todo:
        x, y = todo.pop()
        nodes.append((x, y))
        for s in range(0, max(len(x.children), len(y.children)), STRETCH):
            p, q = x.children[s : s + STRETCH], y.children[s : s + STRETCH]
            if not p or not q:
                break
            fp, fq = (tuple(c.form if type(c) is Node else 0 for c in z) for z in (p, q))
            if fp == fq:
                pairs = [(k, k) for k in range(len(p))]
            else:
                best, pairs, i, j = _table(fp, fq), [], len(p), len(q)
                while i and j:
                    w = _weight(fp[i - 1], fq[j - 1])
                    if w and best[i, j] == best[i - 1, j - 1] + w:
                        i, j = i - 1, j - 1
                        pairs.append((i, j))
                    elif best[i, j] == best[i - 1, j]:
                        i -= 1
                    else:
                        j -= 1
            for i, j in pairs:
                if type(p[i]) is Node:
                    todo.append((p[i], q[j]))
                else:
                    out.append(((id(x), s + i), p[i], (id(y), s + j), q[j]))
    return out, nodes


def texts(root: Node, template: frozenset | set = frozenset(), left_out: Callable[[Node], bool] = lambda x: False) -> list[str]:
    """The blocks of a tree in page order, without those of which every text stands at a template place, and without what is left out."""
    blocks, run, varies = [], [], False

    def flush() -> None:
        if varies and (words := "".join(run).split()):
            blocks.append(" ".join(words))
        run.clear()

    todo: list = [(root, False)]
    while todo:
        x, constant = todo.pop()
        if x is None:
            flush()
            varies = False
        elif type(x) is str:
            run.append(x)
            varies = varies or not constant and not x.isspace()
        elif x.tag == "br":
            run.append(" ")
        elif x is root or not left_out(x):
            if x.tag in BLOCKS:
                flush()
                varies = False
                todo.append((None, False))
            for k in range(len(x.children) - 1, -1, -1):
                todo.append((x.children[k], bool(template) and (id(x), k) in template))
    flush()
    return blocks


def _walk(root: Node) -> Iterator[tuple[Node, tuple[Node, ...], bool]]:
    """Elements of a tree with what holds them, outermost first, and whether they lie in a link."""
    todo: list[tuple[Node, tuple[Node, ...], bool]] = [(root, (), False)]
    while todo:
        x, above, link = todo.pop()
        link = link or x.tag == "a"
        yield x, above, link
        within = (*above[-(DEEP - 1) :], x) if x.tag in BLOCKS or x.tag == "#root" else above
        todo += [(c, within, link) for c in reversed(x.children) if type(c) is Node]


#: Holders of a block that get evidence of it.
DEEP = 6


def _paths(root: Node) -> frozenset:
    """The paths of element names in a tree."""
    found: set[tuple] = set()
    todo: list[tuple[Node, tuple]] = [(root, ())]
    while todo:
        x, path = todo.pop()
        found.add(path)
        todo += [(c, hash((path, c.tag))) for c in x.children if type(c) is Node]
    return frozenset(found)


def layouts(trees: list[Node]) -> list[list[int]]:
    """The trees' numbers by layout: each joins the first layout whose first tree shares ALIKE of their paths."""
    leaders: list[tuple[frozenset, list[int]]] = []
    for k, tree in enumerate(trees):
        paths = _paths(tree)
        for other, members in leaders:
            if len(paths & other) >= ALIKE * len(paths | other):
                members.append(k)
                break
        else:
            leaders.append((paths, [k]))
    return [members for _, members in leaders]


def evidence(tree: Node, template: set) -> tuple[Counter, Counter, Counter]:
    """By id of element: its evidence of content, as a share of the page's; and characters of varying text in it, and of those in links."""
    score, chars, links = Counter(), Counter(), Counter()
    marked = {id(tree): 1.0}
    for x, above, link in _walk(tree):
        holder = above[-1] if above else tree
        weight = marked[id(x)] = marked[id(holder)] * (0.5 if x is not tree and (x.marked in (1, 3) or x.tag in DROPPED) else 1.0)
        own = sum(len("".join(t.split())) for k, t in enumerate(x.children) if type(t) is str and (id(x), k) not in template)
        if not own:
            continue
        block, above = (x, above) if x.tag in BLOCKS else (holder, above[:-1])
        for y in (block, *above):
            chars[id(y)] += own
            links[id(y)] += own * link
        if not link:
            for k, y in enumerate(reversed(above)):
                score[id(y)] += own * weight / 2**k
    total = sum(score.values()) or 1.0
    return Counter({k: v / total for k, v in score.items()}), chars, links


class Wrapper:
    """What the pages of one layout have in common. slots: template places by page; names: the wrapper's element of each page's elements."""

    def __init__(self, trees: list[Node]):
        self.trees, self.first = trees, trees[0]
        self.names: list[dict[int, int]] = []
        places: dict[tuple[int, int], list[tuple[int, tuple[int, int], str]]] = {}
        for k, tree in enumerate(trees):
            pairs, nodes = aligned(self.first, tree)
            self.names.append({id(y): id(x) for x, y in nodes})
            for place, _, other, text in pairs:
                places.setdefault(place, []).append((k, other, " ".join(text.split())))
        self.slots: list[set] = [set() for _ in trees]
        unlike: dict[tuple, int] = {}
        for k, tree in enumerate(trees):  # equal pages are one witness
            unlike.setdefault((tree.form, *(t for x, _, _ in _walk(tree) for t in x.children if type(t) is str)), k)
        witnesses = set(unlike.values())
        self.able = len(witnesses) >= LEAST_PAGES
        if not self.able:
            return
        for found in places.values():
            text, n = Counter(t for k, _, t in found if k in witnesses).most_common(1)[0] if any(k in witnesses for k, _, _ in found) else ("", 0)
            seen = sum(k in witnesses for k, _, _ in found)
            if n >= LEAST_PAGES and n >= SAME * seen and 2 * seen >= len(witnesses):
                for k, place, own in found:
                    if own == text:
                        self.slots[k].add(place)
        score, self.chars, self.links = Counter(), Counter(), Counter()
        for k, tree in enumerate(trees):
            if k in witnesses:
                for total, own in zip((score, self.chars, self.links), evidence(tree, self.slots[k]), strict=True):
                    for node, value in own.items():
                        if node in self.names[k]:
                            total[self.names[k][node]] += value
        self.score = score
        order = {id(x): n for n, (x, _, _) in enumerate(_walk(self.first))}
        self.region = max(score, key=lambda x: (score[x], -order[x]), default=None)

    def _menu(self, x: Node, names: dict[int, int]) -> bool:
        """Whether an element's text is links for the most part, over all pages."""
        name = names.get(id(x))
        return x.tag in BLOCKS and x.tag != "p" and x.tag not in HEADINGS and name is not None and self.links[name] > LINKS * self.chars[name]

    def content(self, k: int) -> list[str] | None:
        """The blocks of a page's content, or None if the page has no counterpart of the region."""
        names, tree = self.names[k], self.trees[k]
        if self.region is None:
            return None
        for x, _, _ in _walk(tree):
            at = next((n for n, c in enumerate(x.children) if type(c) is Node and names.get(id(c)) == self.region), None)
            if at is not None:
                break
        else:
            if names.get(id(tree)) != self.region:
                return None
            x, at = Node("#root"), 0
            x.children = [tree]
        # Template places are told by parent and position, so what goes is left out of a copy, not cut from the tree.
        region, kept = x.children[at], []
        for n, c in enumerate(x.children):
            if type(c) is str:
                continue
            if n == at or self._kin(c, region, names):
                kept.append((c, False))
            elif n < at and (c.tag in HEADINGS or c.tag == "header" and _has(c, HEADINGS)) and not c.marked == 3:
                kept.append((c, True))
        out, whole = [], []
        for c, heading in kept:
            out += self._blocks(c, heading, names, self.slots[k])
            whole += self._blocks(c, heading, names, set())
        return out or whole  # where all of it is template the page is a copy of most others

    def _kin(self, c: Node, region: Node, names: dict[int, int]) -> bool:
        return c.tag == region.tag and c.marked == 0 and self.score[names.get(id(c))] >= KIN * self.score[self.region] and not self._menu(c, names)

    def _blocks(self, c: Node, heading: bool, names: dict[int, int], slots: set) -> list[str]:
        if heading and c.tag == "header":
            return [b for x, _, _ in _walk(c) if x.tag in HEADINGS for b in texts(x, slots)]
        return texts(c, slots, lambda x: _aside(x, True) or self._menu(x, names))


def plain(page: str | None) -> str:
    """The main text of a page that has nothing to be compared with."""
    tree = parse(page or "")
    prune(tree)
    return "\n\n".join(texts(content_root(tree)))


def extract(pages: list[str | None]) -> list[str]:
    """The main texts of pages of one host."""
    if len(_shapes) > 200_000 or len(_weights) > 1_000_000:
        _forms.clear()
        _shapes.clear()
        _weights.clear()
    trees = [parse(page or "") for page in pages]
    for tree in trees:
        _number(tree)
    out: list[str | None] = [None] * len(pages)
    for members in layouts(trees):
        if len(members) < LEAST_PAGES:
            continue
        wrapper = Wrapper([trees[k] for k in members])
        for n, k in enumerate(members if wrapper.able else ()):
            blocks = wrapper.content(n)
            out[k] = None if blocks is None else "\n\n".join(blocks)
    return [plain(page) if text is None else text for page, text in zip(pages, out, strict=True)]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Main texts of rows (host, salt, page_id, url, html) in order of the first two; a group ends with its host, at GROUP pages if as many follow, or at GROUP_CHARS."""

    def done(held: list[tuple]) -> pa.RecordBatch:
        found = extract([x[2] for x in held])
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.string()), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    rows = (row for batch in batches for row in zip(*(c.to_pylist() if k < 4 else c for k, c in enumerate(batch.columns)), strict=True))
    for _, own in groupby(rows, key=lambda row: row[:2]):
        held: list[tuple] = []
        size = 0
        for _, _, page_id, url, page in own:
            if size > GROUP_CHARS:
                yield done(held)
                held, size = [], 0
            elif len(held) == 2 * GROUP:
                yield done(held[:GROUP])
                held = held[GROUP:]
                size = sum(len(x[2] or "") for x in held)
            text = page.as_py()
            held.append((page_id, url, text))
            size += len(text or "")
        yield done(held)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row of (page_id, url, html); text is empty if there is none.

    A null html is an empty page, a null url an empty host. Rows that repeat a page count as pages of their
    own, but not as witnesses of a template. The result depends on the rows, not on their partitions. An empty table gives an empty result."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host, _ = host_and_path(F.col("url"))
    rows = rows.select(host.alias("host"), "page_id", "url", "html")
    counts = rows.groupBy("host").agg(F.count("*").alias("n"))
    # Hosts with over one in SHARES of all pages: fewer than SHARES of them, so this may be broadcast.
    parts = F.least(F.ceil(F.col("n") * SHARES / F.col("total")), F.floor(F.col("n") / (2 * GROUP)))
    hot = counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).select("host", parts.alias("parts")).filter("parts > 1")
    key = F.xxhash64("page_id", "url")
    rows = rows.join(F.broadcast(hot), "host", "left").withColumn("salt", F.coalesce(F.pmod(key, F.col("parts")), F.lit(0)).cast("int"))
    dealt = rows.repartition("host", "salt").sortWithinPartitions("host", "salt", key, "page_id", "url", F.xxhash64("html"))
    return dealt.select("host", "salt", "page_id", "url", "html").mapInArrow(_extracted, "page_id long, url string, text string")


def op9(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
