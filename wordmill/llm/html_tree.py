"""Block trees of HTML pages and their alignment by simple tree matching."""

from __future__ import annotations

import re
from html import unescape

from xxhash import xxh64_hexdigest

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
            "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
            "tbody": ("thead", "tbody"), "tfoot": ("tbody",)}
#: Where a search for an element to end stops.
SCOPE = frozenset("html body table ul ol dl article section main div td th".split())

#: What is never an article's text, by element, by role and by words of class or id.
OFF_TAGS = frozenset("nav footer aside form button select svg object dialog menu head".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert "
                      "alertdialog menu menubar toolbar".split())
OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar "
    "navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted "
    "related respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe "
    "taboola toolbar widget widgets".split())
#: Words that say nothing beside one of the above (as in ``related-links``).
PLAIN_WORDS = frozenset(
    "area articles bar block body bottom box button buttons col column container content entry footer "
    "form group head header holder inline inner item items left line link links list main more news "
    "outer panel post posts right row section slot small story stories strip text title top unit "
    "wrap wrapper zone".split())


class Node:
    """A block element: ``content`` holds strings and child nodes in page order. ``path`` is a hash
    of the labels from the root on. ``off``: no part of an article; ``soft``: marked by a word, but
    inside an article and among other words, so the host's wrapper decides."""
    __slots__ = ("tag", "label", "path", "off", "soft", "content", "parent")

    def __init__(self, tag, label, parent, off, soft=False):
        self.tag, self.label, self.parent, self.off, self.soft = tag, label, parent, off, soft
        self.path = xxh64_hexdigest(f"{parent.path}/{label}") if parent else label
        self.content: list = []

    @property
    def children(self):
        return [c for c in self.content if type(c) is Node]

    def text(self) -> str:
        """The node's own text, without its child blocks."""
        return " ".join("".join(c if type(c) is str else " " for c in self.content).split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(raw)}


def _mark(tag: str, raw: str, inside: bool) -> tuple[str, bool, bool]:
    """Label (tag, class and id without digits), whether the element can't be part of an article,
    and whether that is for the wrapper to say."""
    off = tag in OFF_TAGS or (tag == "header" and not inside)
    if not raw or raw == "/":
        return tag, off, False
    a, soft = _attributes(raw), False
    mine = f"{a.get('class', '')} {a.get('id', '')}".lower()
    if "hidden" in a or a.get("role", "").lower() in OFF_ROLES:
        off = True
    elif tag not in ("html", "body", "article", "main") and mine.strip():
        words = {w for w in re.split(r"[^a-z]+", mine) if w}
        if not OFF_WORDS.isdisjoint(words):
            soft = inside and not off and not words <= OFF_WORDS | PLAIN_WORDS
            off = off or not soft
    key = " ".join(re.sub(r"\d+", "", mine).split())      # ids such as post-123 differ by page
    return (f"{tag}.{key}" if key else tag), off, soft


def _text_size(top: Node, forms: bool) -> int:
    """Characters below a node that may be an article's; those in forms only if asked for."""
    size, todo = 0, [top]
    while todo:
        n = todo.pop()
        size += len(n.text())
        todo.extend(c for c in n.children if not c.off or (forms and c.tag == "form"))
    return size


def _keep_wide_forms(root: Node, forms: list) -> None:
    """A form round most of a page's text is a frame of the page, not a form in it."""
    for f in forms:
        inner = _text_size(f, False)
        if inner and inner >= _text_size(root, False):
            f.off = False


def parse(html: str) -> Node:
    """The page's block tree. Inline elements melt into their block (those marked as no part of
    an article become nodes), character references are decoded, comments, scripts and styles
    are left out; unclosed and stray tags are taken as browsers do for the common cases."""
    root = node = Node("#", "#", None, False)
    stack: list[tuple[str, Node | None]] = []   # open elements; a node for blocks
    at, inside, forms = 0, 0, []
    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            node.content.append(unescape(html[at:m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    node, inside = _pop(stack, i, node, inside)
                    break
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>|\\Z", re.I).search(html, at)
            at = end.end()
            continue
        if tag in VOID:
            if tag == "br" or tag == "hr":
                node.content.append(" ")
            continue
        if tag in ENDS_P:
            node, inside = _end(stack, ("p",), node, inside)
        elif tag in SIBLINGS:
            node, inside = _end(stack, SIBLINGS[tag], node, inside)
        label, off, soft = _mark(tag, m[3].strip(), inside > 0)
        if tag in INLINE and not off:
            if not m[3].endswith("/"):
                stack.append((tag, None))
            continue
        child = Node(tag, label, node, off, soft)
        node.content.append(child)
        if tag == "form" and not _mark("div", m[3].strip(), False)[1]:
            forms.append(child)
        if not m[3].endswith("/") or tag in ENDS_P:
            stack.append((tag, child))
            node = child
            inside += tag in ("article", "main")
    if at < len(html):
        node.content.append(unescape(html[at:]))
    _keep_wide_forms(root, forms)
    return root


def _pop(stack, i, node, inside):
    for tag, n in stack[i:]:
        if n is not None and tag in ("article", "main"):
            inside -= 1
    first = next((n for _, n in stack[i:] if n is not None), None)
    del stack[i:]
    return (first.parent if first is not None else node), inside


def _end(stack, tags, node, inside):
    """Close the nearest open element of ``tags`` unless a container lies between."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in tags:
            return _pop(stack, i, node, inside)
        if stack[i][0] in SCOPE:
            break
    return node, inside


def match(a: Node, b: Node, pairs: list) -> float:
    """Simple tree matching: the best order-preserving matching of equal labels below two roots
    of equal label; equal texts count half a node more. Matched pairs are added to ``pairs``."""
    memo: dict = {}

    def score(x: Node, y: Node) -> float:
        return memo[id(x), id(y)] if x.label == y.label else 0.0

    def fill(x: Node, y: Node) -> None:
        """Scores of all pairs below, deepest first; a stack of its own, for deep pages."""
        todo = [(x, y)]
        while todo:
            x, y = todo[-1]
            open_ = [(u, v) for u in x.children for v in y.children
                     if u.label == v.label and (id(u), id(v)) not in memo]
            if open_:
                todo.extend(open_)
                continue
            todo.pop()
            if (id(x), id(y)) not in memo:
                memo[id(x), id(y)] = 1.0 + (0.5 if x.text() == y.text() else 0.0) + table(x, y)[-1][-1]

    def table(x: Node, y: Node):
        xs, ys = x.children, y.children
        t = [[0.0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, u in enumerate(xs):
            row, up = t[i + 1], t[i]
            for j, v in enumerate(ys):
                row[j + 1] = max(row[j], up[j + 1], up[j] + score(u, v))
        return t

    todo = [(a, b)] if a.label == b.label else []
    if todo:
        fill(a, b)
    total = score(a, b)
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        xs, ys, t = x.children, y.children, table(x, y)
        i, j = len(xs), len(ys)
        while i and j:
            if t[i][j] == t[i - 1][j]:
                i -= 1
            elif t[i][j] == t[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((xs[i], ys[j]))
    return total
