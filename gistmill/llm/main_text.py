"""Main text of web pages by composite text density."""

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gistmill.llm import tables

_RAW = "script|style|textarea|title|iframe|xmp"
_TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*\Z)|<({_RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>(?:.*?</\1(?=[\s/>])[^>]*>|.*\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_FOREIGN = frozenset("svg math object select noscript template".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
_DROPPED_TAGS = _FOREIGN | frozenset("nav footer aside form button menu dialog input iframe canvas audio video head".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Parts of class names and ids by which pages mark what isn't the article.
_DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adslot sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs topbar masthead toc "
    "footer copyright colophon sidebar sidebars aside widget widgets "
    "cookie cookies consent gdpr notice notices alert alerts banner banners popup modal overlay newsletter subscribe subscription signup paywall "
    "comment comments commentlist disqus respond reply replies reactions "
    "share sharing social related recommended recommendations teaser teasers trending pagination pager "
    "login search searchbox form skip skiplink".split()
)
#: Parts that say nothing about what a marked block is.
_PLAIN_NAMES = frozenset(
    "area article articles bar block blocks body bottom box button buttons card col column container content count entry footer group header icons "
    "inline inner item items label left link links list main outer page panel post posts region right row section site slot "
    "story thread title tools top unit wrap wrapper zone".split()
)
_SITE_HEADER = frozenset("header site page global top main masthead".split())
_ROOTS = frozenset(("article", "main"))
_LISTS = frozenset("ul ol dl table".split())


_NAMED = re.compile(r"""\b(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_COMMENTS = re.compile(r"comment|disqus|respond|repl(y|ies)|reaction|related|recommend|teaser", re.I)


class _Node:
    __slots__ = ("tag", "parent", "children", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "sum", "soft", "hard", "plain")

    def __init__(self, tag: str, parent: "_Node | None", dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[_Node | str] = []
        # dropped by a name or as a form, which may be the page's wrapper; dropped for good; no name of furniture
        self.soft, self.hard, self.plain = False, False, True


def _is_dropped(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _DROPPED_TAGS or (tag == "header" and not inside):
        return True
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                # within an article a paragraph is the article's, whatever its name
                if not (inside and tag == "p") and any(_names_furniture(word, inside) for word in value.split()):
                    return True
            elif name == "role" and value in _DROPPED_ROLES:
                return True
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
    return False


def _names_furniture(word: str, inside: bool) -> bool:
    """Whether a class name or id begins or ends with a name of what isn't the article, as in post-comments, ad_slot."""
    parts = [x for x in re.split(r"[^a-z0-9]+", word) if x]
    if not parts or parts[0] in ("has", "with", "without", "no", "not", "is"):
        return False
    if parts[-1] == "header" and not inside:
        return set(parts) <= _SITE_HEADER
    # within an article other words may be about anything: share-price, reply-to-critics, ad-hoc
    if inside and not all(x in _DROPPED_NAMES or x in _PLAIN_NAMES or x.isdigit() for x in parts):
        return False
    return parts[0] in _DROPPED_NAMES or parts[-1] in _DROPPED_NAMES


class _Open:
    """The elements that are open, and by tag how deep they lie, so that no start or end tag has to walk up the tree."""

    def __init__(self, root: _Node):
        self.path, self.depths, self.blocks, self.inside = [root], defaultdict(list), [], 0

    def push(self, node: _Node) -> None:
        self.depths[node.tag].append(len(self.path))
        if node.tag not in _INLINE:
            self.blocks.append(len(self.path))
        self.inside += node.tag in _ROOTS
        self.path.append(node)

    def close(self, depth: int) -> None:
        """Close the element at ``depth`` and all within it."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.depths[tag].pop()
            if tag not in _INLINE:
                self.blocks.pop()
            self.inside -= tag in _ROOTS

    def last(self, tags) -> int:
        """How deep the innermost of these elements lies; 0 if none is open."""
        return max((self.depths[tag][-1] for tag in tags if self.depths.get(tag)), default=0)

    def first(self, tags, above: int) -> int:
        """How deep the outermost of these elements within the one at ``above`` lies; 0 if none is open."""
        found = [(x, bisect_right(x, above)) for x in (self.depths.get(tag, ()) for tag in tags)]
        return min((x[at] for x, at in found if at < len(x)), default=0)

    def holds(self, depth: int, node: _Node, barrier: str = "") -> bool:
        """Whether ``node`` is still open at ``depth``, without an element ``barrier`` within it."""
        return len(self.path) > depth and self.path[depth] is node and self.last([barrier]) <= depth


def _parse(page: str, forms: bool = False) -> _Node:
    """The page's tree; text is kept undecoded. Missing end tags are supplied as browsers do for p, li, table parts.

    ``forms``: forms are kept, for pages that wrap everything in one.
    """
    root = _Node("#root", None, False)
    # elements that end at the first tag that may not stand in them, and their depths
    head = loose = None
    opened, lists, ends, judged = _Open(root), [], {}, {}
    # beyond the last bracket nothing is a tag; only a comment may begin there
    place, limit = 0, page.rfind(">") + 1
    page = page[:limit] + page[limit:].partition("<!--")[0].replace("<", "&lt;")
    for found in _TOKEN.finditer(page):
        node = opened.path[-1]
        if found.start() > place:
            if head is not None and node is head[1] and not page[place:found.start()].isspace():
                opened.close(head[0])
                node, head = opened.path[-1], None
            node.children.append(page[place:found.start()])
        place = found.end()
        tag = (found[3] or found[6] or "").lower()
        if not tag:
            continue
        if found[2] or found[5]:
            depth = opened.last([tag])
            # a stray inline end tag doesn't close blocks
            if depth and not (tag in _INLINE and opened.blocks and opened.blocks[-1] > depth):
                opened.close(depth)
            continue
        if head is not None and tag not in _IN_HEAD:
            if opened.holds(*head, "template"):
                opened.close(head[0])
            head = None
        elif loose is not None and tag in _CLOSES_P:
            if not opened.holds(*loose):
                loose = None
            elif opened.holds(*loose, "foreignobject"):
                opened.close(loose[0])
                loose = None
        closes = {"p"} if tag in _CLOSES_P else _CLOSES.get(tag)
        if closes and any(opened.depths.get(x) for x in closes):
            barrier = _SCOPE.get(tag, ("table", "ul", "ol", "td", "th", "article", "section", "div", "main", "body") if "p" in closes else ("table",))
            depth = opened.first(closes, opened.last(barrier))
            if depth:
                opened.close(depth)
        node, inside = opened.path[-1], opened.inside > 0
        attributes = found[4] or found[7] or ""
        if (tag, attributes, inside) not in judged:
            dropped = _is_dropped(tag, attributes, inside) and not (forms and tag == "form")
            soft = dropped and (tag == "form" or not _is_dropped(tag, _NAMED.sub("", attributes), inside))
            judged[tag, attributes, inside] = dropped, soft, not (attributes and _COMMENTS.search(attributes))
        dropped, soft, plain = judged[tag, attributes, inside]
        child = _Node(tag, node, node.dropped or dropped)
        child.soft, child.hard, child.plain = soft, dropped and not soft, node.plain and plain
        if child.soft and child.plain and inside and tag in _LISTS and not node.dropped:
            lists.append(child)
        node.children.append(child)
        if tag not in _VOID and not attributes.endswith("/") or tag in _ROOTS:
            depth = len(opened.path)
            opened.push(child)
            if tag == "head":
                head = depth, child
            elif tag in _FOREIGN and (loose is None or not opened.holds(*loose)) and _is_loose(page, place, tag, ends):
                loose = depth, child
    if place < len(page):
        opened.path[-1].children.append(page[place:])
    for child in lists:
        _keep_without_links(child)
    return root


def _keep_without_links(node: _Node) -> None:
    """A list or table in an article is furniture by its name only if it has links: a restaurant's menu is text."""
    below, stack = [], [node]
    while stack:
        below.append(stack.pop())
        stack.extend(x for x in below[-1].children if isinstance(x, _Node))
    if any(x.tag == "a" for x in below):
        return
    node.soft = False
    for x in below:
        x.dropped = x.hard or x.soft or x.parent.dropped


def _is_loose(page: str, place: int, tag: str, ends: dict[str, tuple[list[int], list[bool]]]) -> bool:
    """Whether a block's start ends the element: always for svg, math and select, for others if they have no end tag of their own."""
    if tag in ("svg", "math", "select"):
        return True
    if tag not in ends:
        found = [(x.start(), bool(x[1])) for x in re.finditer(rf"<(/?){tag}(?=[\s/>])", page, re.I)]
        ends[tag] = [x for x, _ in found], [x for _, x in found]
    places, closing = ends[tag]
    following = bisect_left(places, place)
    return following == len(places) or not closing[following]


def _nodes(root: _Node) -> list[_Node]:
    """Nodes that aren't dropped, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.children) if isinstance(x, _Node) and not x.dropped)
    return out


def _own_chars(node: _Node) -> int:
    return sum(len(x) - x.count(" ") for x in node.children if isinstance(x, str) and not x.isspace())


def _measure(nodes: list[_Node]) -> None:
    for node in reversed(nodes):
        chars = _own_chars(node)
        kept = [x for x in node.children if isinstance(x, _Node) and not x.dropped]
        node.chars = chars + sum(x.chars for x in kept)
        node.tags = len(kept) + sum(x.tags for x in kept)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(x.link_chars for x in kept)
        node.link_tags = node.tags if link else sum(x.link_tags + (x.tag == "a") for x in kept)
    body = nodes[0]
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        tags, links, plain = max(node.tags, 1), max(node.link_chars, 1), max(node.chars - node.link_chars, 1)
        if node.chars:
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            ratio = node.chars / links * (tags / max(node.link_tags, 1))
            node.density = node.chars / tags * max(math.log(max(ratio, 1)), 0) / max(math.log(base + 1), 1e-9)
        else:
            node.density = 0.0
        node.sum = sum(x.density for x in node.children if isinstance(x, _Node) and not x.dropped)


def _restore(root: _Node) -> None:
    """Keep a node dropped by name or as a form if it wraps the article.

    It does if the largest density sum of the tree with such nodes lies in it, and it holds an article or main
    element where none with text is kept outside, or ten times the text kept outside and no poorer a heading.
    """
    everything, stack = [], [root]
    while stack:
        node = stack.pop()
        everything.append(node)
        stack.extend(x for x in reversed(node.children) if isinstance(x, _Node))
    if not any(x.soft for x in everything):
        return
    for node in everything:
        node.dropped = node.hard or (node.parent is not None and node.parent.dropped)
    whole = _nodes(root)
    _measure(whole)
    wrappers = [x for x in reversed(_path(max(whole, key=lambda x: x.sum))) if x.soft]
    if wrappers:
        _keep_wrappers(root, whole, wrappers)
    for node in everything:
        node.dropped = node.hard or node.soft or (node.parent is not None and node.parent.dropped)


def _keep_wrappers(root: _Node, whole: list[_Node], wrappers: list[_Node]) -> None:
    """Keep as many of the wrappers around the core, from the outermost inwards, as pass ``_restore``'s rule."""
    rank = {x: 0 if not (x.chars and x.plain) else 2 if x.tag in _ROOTS else x.tag == "h1" for x in whole}
    within = dict(rank)
    # the number of wrappers to keep until a node is kept, and until text of it is
    never = len(wrappers) + 1
    level, seen = {root: 0}, {}
    for node in whole[1:]:
        at = level[node.parent]
        if node.soft:
            at = at + 1 if at < len(wrappers) and node is wrappers[at] else never
        level[node] = at
    chars, ranks = [0] * (never + 1), [0] * (never + 1)
    for node in reversed(whole):
        own = _own_chars(node)
        chars[level[node]] += own
        seen[node] = min(seen.get(node, never), level[node] if own else never)
        ranks[seen[node]] = max(ranks[seen[node]], rank[node])
        if node.parent is not None:
            within[node.parent] = max(within[node.parent], within[node])
            seen[node.parent] = min(seen.get(node.parent, never), seen[node])
    # from the outermost wrapper inwards
    outside = other = 0
    for at, wrapper in enumerate(wrappers):
        outside, other = outside + chars[at], max(other, ranks[at])
        if not wrapper.plain or not (within[wrapper] == 2 > other or (within[wrapper] >= other and wrapper.chars >= 10 * outside)):
            break
        wrapper.soft = False


def _path(node: _Node) -> list[_Node]:
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def _content(root: _Node) -> _Node:
    """The subtree with the article.

    The node with the largest sum of child densities is the core; the smallest density on its
    path to the body is the threshold; the subtree that holds the core and all nodes reaching the
    threshold beside its path is the article. If an article or main element surrounds it, that is taken whole.
    """
    _restore(root)
    nodes = _nodes(root)
    _measure(nodes)
    core = max(nodes, key=lambda x: x.sum)
    path = _path(core)
    threshold = min(x.density for x in path)
    chosen = core
    for lower, node in zip(path, path[1:]):
        beside = [x for x in node.children if isinstance(x, _Node) and not x.dropped and x is not lower]
        if any(x.density >= threshold and x.chars for x in beside):
            chosen = node
    surrounding = [x for x in _path(chosen) if x.tag in _ROOTS]
    return surrounding[-1] if surrounding else chosen


def _blocks(node: _Node) -> list[str]:
    """Texts of blocks in page order, decoded, white space as one space."""
    out, run = [], []

    def close() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(text)
            run.clear()

    stack: list[object] = [node]
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            # a reference ends with its text node
            run.append(html.unescape(item))
        elif not item.dropped:
            if item.tag == "br":
                run.append(" ")
                continue
            block = item.tag not in _INLINE
            if block:
                close()
                stack.append(None)
            stack.extend(reversed(item.children))
        elif item.tag not in _INLINE and item.tag not in _FOREIGN:
            close()
    close()
    return out


def page_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = _blocks(_content(_parse(page)))
    if not blocks and "<form" in page.lower():
        blocks = _blocks(_content(_parse(page, forms=True)))
    return "\n".join(blocks)


def main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Columns of ``pages`` without the html, and ``text`` and ``n_chars`` (its code points), which replace such columns.

    Every page is parsed whole, one at a time, in an Arrow batch; missing end tags are supplied.
    Menus, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known by
    element, role, class or id, and headers outside an article are left out (a form or marked element that wraps the article isn't). Within
    an article or main element a name counts only if all its parts are such names or say nothing (not share-price), never on a
    paragraph, and on a list or table only if it holds links. Of the rest, link-adjusted
    characters per tag are computed for every node and summed over children; the subtree of the
    largest sum, extended by the smallest density on its path to the body, is the article, and all
    its blocks are returned in page order.

    Null or empty html, or a page without text: an empty text. Broken markup never raises. A page
    nested very deep is walked without recursion. No rows in, no rows out.
    """
    schema = tables.with_fields(pages.schema, ("text", "string"), ("n_chars", "long"))
    schema.fields = [f for f in schema.fields if f.name != html_column]
    names = [f.name for f in schema.fields]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(x.as_py()) for x in batch.column(html_column)]
            yield tables.replaced(
                batch, text=pa.array(texts, pa.string()), n_chars=pa.array([len(x) for x in texts], pa.int64())
            ).select(names)

    return tables.in_arrow(pages, extract, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields))
