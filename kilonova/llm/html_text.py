"""Operator 2: main text of a web page by tree scoring.

The page is parsed into a tree (tolerant: implied ends of the head, of paragraphs and list items, unclosed tags, truncated
pages).
Every text block gives points -- one, one per comma, one per hundred characters up to three -- to its parent, half of
them to its grandparent and a third, a quarter ... further up, to the 50th ancestor.  A container's score is discounted by its link density
(share of its characters inside links); tags and class / id words that name an article or its surroundings add or take
points.  The page itself can be the best container.  What stands beside the best one, and beside the containers around
it up to an ``article`` or ``main`` or the page, is kept if it scores at least a fifth of it, or if it is text by its
length and link density: paragraphs, lists, tables, bare text and the like with less than half their characters in links,
other containers with less than a quarter (none if short), headings if what follows them is kept.  Menus, headers, footers,
sidebars, notices, adverts, forms and reader comments are left out everywhere.

Result: blocks in page order joined by one newline; inside a block white space (Unicode's, no-break spaces included) is
one space; character references are decoded.  All steps take time in proportion to the page, however odd its nesting.  Null, empty and text-free pages give the empty text.  Text is never cut.  Repeated rows are
worked on each for itself; all other columns of a row travel in ``row``, so no name can clash.
"""
from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: never part of the text
DROP = frozenset("script style textarea title xmp iframe noembed noframes noscript template head nav footer aside form "
                 "button select option input label fieldset svg math canvas object embed video audio map dialog menu".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
                  "summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot legend".split())
#: an opening tag ends open tags of its list, up to a tag of the second
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: blocks of running text; "": text without one
FLOW = frozenset(["", *"p ul ol dl dir table pre blockquote figure figcaption caption center listing details summary hr address".split()])
#: what stands in a head; anything else ends an open one
IN_HEAD = frozenset("title meta link base style script noscript template head".split())
AWAY = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adv|banner\d*|sponsor\w*|promo\w*|comments?|commentlist|disqus|respond|replies|reply|"
                  r"footer|foot|header|masthead|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|widget\w*|aside|cookies?|consent|gdpr|notices?|"
                  r"alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|"
                  r"toolbar|pager|pagination|skip|hidden|legal|copyright|feedback|discussion|disclaimer|tags?)(?=$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content\w*|entry\w*|main\w*|post\w*|story\w*|text|blog\w*)(?=$|[\s_-])", re.I)
MARK = re.compile(r"<(?:(?P<c>!--)|(?P<d>[!?])|(?P<e>/)?(?P<t>[a-zA-Z][^\s/>]*))")
TAIL = re.compile(r">|=\s*([\"'])")
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"\s+")
#: ancestors that a block gives points to
LEVELS = 50

BASE = {"article": 25.0, "main": 15.0, "section": 4.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0,
        "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "dd": -3.0, "dt": -3.0, "h1": -5.0, "h2": -5.0, "h3": -5.0, "th": -5.0}


class Node:
    """away: 2 if its tag or attributes hide it, 1 if only its class, id or role speaks against it; talk: reader comments;
    block, cell: the nearest block and table cell from here up; art: inside an article; clear: no ancestor has away = 1."""

    __slots__ = ("tag", "kids", "up", "score", "chars", "linked", "away", "talk", "depth", "block", "cell", "art", "clear")

    def __init__(self, tag: str, up: Node | None, away: int = 0, score: float = 0.0):
        self.tag, self.up, self.kids, self.away, self.score, self.chars, self.linked = tag, up, [], away, score, 0, 0
        self.talk = self.clear = False
        self.depth = up.depth + 1 if up is not None else 0
        self.block = self if tag in BLOCK else up.block if up is not None else None
        self.cell = self if tag in ("td", "th") else up.cell if up is not None else None
        self.art = tag in ("article", "main") or up is not None and up.art


def _open(tag: str, attrs: str, up: Node) -> Node:
    score, away, names = BASE.get(tag, 0.0), 2 * (tag in DROP), ""
    if not away and attrs and "=" in attrs or "hidden" in attrs:
        got = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attrs)}
        names = got.get("class", "") + " " + got.get("id", "")
        role = got.get("role", "").lower()
        bad = bool(AWAY.search(names)) or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu")
        if tag in ("article", "main", "body", "html") or role in ("main", "article"):
            bad = bad and bool(re.search(r"comment|reply", names, re.I))
        elif bad and GOOD.search(names) and not re.search(r"(?:^|[\s_-])(?:ads?|advert\w*|comments?|sidebar|nav\w*|footer|menu)(?=$|[\s_-])", names, re.I):
            bad = False
        away = 1 if bad else 0
        away = 2 if "hidden" in got or got.get("aria-hidden", "") == "true" or bool(re.search(r"display\s*:\s*none", got.get("style", ""))) else away
        score += 25.0 * bool(GOOD.search(names)) + 25.0 * (role in ("main", "article"))
    node = Node(tag, up, away, score)
    node.talk = away == 1 and bool(re.search(r"(?:^|\s)(?:comment|repl|respon|disqus|discussion|ad)", names, re.I))
    return node


class _Path:
    """The open nodes, and those of each tag by depth: an end is found without climbing."""

    def __init__(self, root: Node):
        self.nodes, self.of = [root], {root.tag: [root]}

    def open(self, k: Node) -> None:
        self.nodes.append(k)
        self.of.setdefault(k.tag, []).append(k)

    def close(self, k: Node) -> None:
        """Ends ``k`` and all that is open in it; every node is closed once."""
        while self.nodes[-1].depth >= k.depth:
            self.of[self.nodes.pop().tag].pop()

    def last(self, tag: str) -> Node | None:
        nodes = self.of.get(tag)
        return nodes[-1] if nodes else None

    def first_below(self, tag: str, depth: int) -> Node | None:
        """The outermost open node of the tag that is deeper than ``depth``."""
        nodes = self.of.get(tag, [])
        i = bisect_right(nodes, depth, key=lambda k: k.depth)
        return nodes[i] if i < len(nodes) else None


def _tag_end(page: str, at: int, last: dict[str, int]) -> tuple[int, int]:
    """End of a tag's attributes, and the place behind its ``>``.  A quote counts only after ``=`` and if it is closed."""
    while m := TAIL.search(page, at):
        if m[1] is None:
            return m.start(), m.end()
        at = page.find(m[1], m.end()) + 1 if m.end() <= last[m[1]] else m.end()
    return len(page), len(page)


def _ended(path: _Path, tag: str) -> Node | None:
    """The open node that an end tag closes.  An inline end tag doesn't reach out of its block; a block's end tag doesn't
    leave a table cell."""
    node, k = path.nodes[-1], path.last(tag)
    if k is None:
        return None
    if tag not in BLOCK:
        return k if node.block is None or k.depth > node.block.depth else None
    if node.cell is not None and k.depth < node.cell.depth and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
        return None
    return k


def parse(page: str) -> Node:
    root = Node("html", None)
    path = _Path(root)
    at, n, seen = 0, len(page), 0
    last = {q: page.rfind(q) for q in "\"'"}
    while m := MARK.search(page, seen):
        start = m.start()
        tag = m["t"]
        if tag is None:
            end = page.find("-->" if m["c"] else ">", m.end())
            stop = end + (3 if m["c"] else 1) if end >= 0 else n
        else:
            attrs_end, stop = _tag_end(page, m.end(), last)
            attrs, tag = page[m.end():attrs_end], tag.lower()
        if start > at:
            if path.nodes[-1].tag == "head" and page[at:start].strip():
                path.close(path.nodes[-1])
            path.nodes[-1].kids.append(page[at:start])
        at = seen = stop
        if tag is None:
            continue
        if m["e"]:
            k = _ended(path, tag)
            if k is not None and k.up is not None:
                path.close(k)
            elif tag == "p" and k is None:
                path.nodes[-1].kids.append(Node("p", path.nodes[-1]))
            continue
        if tag == "body" or path.nodes[-1].tag == "head" and tag not in IN_HEAD and tag != "html":
            k = path.last("head")
            if k is not None:
                path.close(k)
        if tag in ("html", "body"):
            continue
        if tag in ("article", "main"):  # a wrapper named after what stands beside the article is no surrounding
            k = path.nodes[-1]
            while k is not None and not k.clear:
                k.away, k.clear = 0 if k.away == 1 else k.away, True
                k = k.up
        if tag in CLOSES_P and (k := path.nodes[-1].block) is not None and k.tag == "p":
            path.close(k)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            depth = max((k.depth for t in stops if (k := path.last(t)) is not None), default=-1)
            outer = min((k for t in ends if (k := path.first_below(t, depth)) is not None), key=lambda k: k.depth, default=None)
            if outer is not None:
                path.close(outer)
        up = path.nodes[-1]
        new = _open(tag, attrs, up)
        up.kids.append(new)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW and tag != "a":
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|$)", re.I).search(page, at)
            at = seen = end.end() if end else n
            continue
        path.open(new)
    if at < n:
        if path.nodes[-1].tag == "head" and page[at:].strip():
            path.close(path.nodes[-1])
        path.nodes[-1].kids.append(page[at:])
    return root


def _skipped(k: Node) -> bool:
    return k.away or k.tag == "header" and not k.art


def _blocks(top: Node) -> list[tuple[str, int, Node]]:
    """(text, characters of it inside links, holder) of every block below ``top`` in page order."""
    out: list[tuple[str, int, Node]] = []
    parts: list[str] = []
    linked = [0]

    def flush(holder: Node) -> None:
        if parts:
            t = SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
            if t:
                out.append((t, min(linked[0], len(t)), holder))
            parts.clear()
        linked[0] = 0

    # iterative walk: (node, next kid, inside link, holder)
    stack = [[top, 0, False, top]]
    while stack:
        f = stack[-1]
        node, i, link, holder = f
        if i == len(node.kids):
            stack.pop()
            if node.tag in BLOCK or node is top:
                flush(holder)
            continue
        f[1] += 1
        k = node.kids[i]
        if isinstance(k, str):
            parts.append(k)
            if link:
                linked[0] += len(k)
        elif k.tag == "br":
            parts.append(" ")
        elif _skipped(k):
            if k.tag in BLOCK:
                flush(holder)
        else:
            if k.tag in BLOCK:
                flush(holder)
                stack.append([k, 0, link, k])
            else:
                stack.append([k, 0, link or k.tag == "a", holder])
    return out


def _readmit(root: Node, share: float) -> None:
    """Takes containers that only their names speak against, and that hold more than ``share`` of the page's text, for
    wrappers of the article.  Reader comments stay out."""
    order, chars = [root], {}
    for k in order:
        order += [x for x in k.kids if isinstance(x, Node) and x.away < 2]
    for k in reversed(order):
        chars[id(k)] = sum(chars.get(id(x), 0) if isinstance(x, Node) else len(x.strip()) for x in k.kids)
    todo = [root]
    while todo:
        k = todo.pop()
        if k.away == 1:
            if chars[id(k)] <= share * chars[id(root)] or k.talk:
                continue
            k.away = 0
        todo += [x for x in k.kids if isinstance(x, Node) and x.away < 2]


def _readmit_names(root: Node) -> None:
    """Takes in the outermost containers that only their names speak against, layer by layer until there is text."""
    layer = [root]
    while layer:
        todo, found = layer, []
        while todo:
            for x in todo.pop().kids:
                if isinstance(x, Node) and x.away < 2:
                    (found if x.away else todo).append(x)
        for x in found:
            x.away = 0
        if any([_blocks(x) for x in found]):
            return
        layer = found


def _value(k: Node) -> float:
    return k.score * (1 - k.linked / max(1, k.chars))


def _keep_beside(up: Node, best: Node | None, score: float) -> None:
    """Takes the children of ``up`` that are no text of the article out of it; ``best``, of value ``score``, stays."""
    runs: list[Node] = []  # children; inline ones and bare text that follow each other are one
    for k in up.kids:
        if isinstance(k, Node) and (k is best or k.tag in BLOCK or _skipped(k) or k.chars):
            runs.append(k)
        elif runs and runs[-1].tag == "":
            runs[-1].kids.append(k)
        else:
            runs.append(Node("", up))
            runs[-1].kids.append(k)
    keep, heads = [], []
    for k in runs:
        if k is best:
            keep += [*heads, k]
            heads = []
            continue
        if k.tag != "" and _skipped(k):
            continue
        if k.tag == "":
            got = _blocks(k)
            k.chars, k.linked = sum(len(t) for t, _, _ in got), sum(n for _, n, _ in got)
        if not k.chars:
            continue
        if k.tag in HEADINGS:
            heads.append(k)
            continue
        density = k.linked / k.chars
        if density < 0.5 if k.tag in FLOW else density < 0.25 if k.chars > 80 else not density:
            stays = True
        else:
            stays = _value(k) >= max(10.0, score / 5)
        if stays:
            keep += [*heads, k]
        heads = []
    keep += heads
    up.kids = [x for k in keep for x in (k.kids if k.tag == "" else [k])]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _readmit(root, 0.6)
    blocks = _blocks(root)
    if not blocks:  # names alone don't empty a page
        _readmit_names(root)
        blocks = _blocks(root)
    touched: dict[int, Node] = {}
    for text, linked, holder in blocks:
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3)
        points *= 1 - linked / len(text)
        k, depth = (holder.up or holder) if holder.tag not in ("div", "td", "section", "article", "main", "html") else holder, 1
        holder.chars += len(text)
        holder.linked += linked
        if len(text) < 2:
            continue
        while k is not None and depth <= LEVELS:
            touched[id(k)] = k
            k.score += points / depth
            k, depth = k.up, depth + 1
    if not blocks:
        return ""
    order = [root]
    for k in order:
        order += [x for x in k.kids if isinstance(x, Node)]
    for k in reversed(order[1:]):  # children come behind their parents
        k.up.chars += k.chars
        k.up.linked += k.linked
    best = max(touched.values(), key=_value, default=root)
    top = best
    if best is root:
        _keep_beside(root, None, 0.0)
    while top.up is not None and top.tag not in ("article", "main"):
        _keep_beside(top.up, top, _value(best))
        top = top.up
    if top is best and top.up is not None:  # an article's own siblings, other articles among them
        _keep_beside(top.up, top, _value(best))
        top = top.up
    return "\n".join(t for t, _, _ in _blocks(top))


def _extract(batches):
    for b in batches:
        texts = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["row", "text", "n_chars"])


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``row`` (its other columns), text, n_chars (code points)."""
    from pyspark.sql import functions as F

    rest = [pages[c] for c in pages.columns if c != html_col]
    src = pages.select(F.struct(*rest).alias("row"), pages[html_col].alias("html"))
    return src.mapInArrow(_extract, f"row {src.schema['row'].dataType.simpleString()}, text string, n_chars long")
