"""Main text of web pages by tree scoring.

A page becomes a tree. Paragraphs pass points to their parent and, halved, to the grandparent: one
point, one per comma, one per hundred characters up to three; a container's score is discounted by
its link density. The best container, its content siblings and the article that holds it are kept.
Parts that are never main text (scripts, menus, footers, adverts, forms, comments, notices) are cut
by element, role and class name before scoring. Forms and parts cut by name stay where they hold most of
the points of a page without an article elsewhere, or of the article around them, or its only article;
comments do where nothing else is left.

A null or empty page gives the empty text; a page without any element is read as one block. Broken
markup is repaired like browsers do: a block closes an open paragraph, unknown end tags are ignored,
open elements end with the page. Pages are independent rows, so repeated rows repeat their result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul caption search".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend"}
SIBLING_CLOSE = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
DROPPED = frozenset(
    "script style noscript template iframe object embed svg math canvas audio video map head title nav aside "
    "footer button select textarea input label menu dialog search fieldset frame frameset applet".split()
)
DROPPED_ROLE = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
DROPPED_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|comment|comments|commentlist|"
    r"disqus|replies|respond|discussion|cookie\w*|consent|gdpr|notice\w*|popup\w*|modal\w*|newsletter\w*|"
    r"subscri\w*|sidebar\w*|side-?bar|widget\w*|menu\w*|nav|navbar\w*|navigation|breadcrumb\w*|footer\w*|"
    r"masthead|topbar|toolbar|pagination|pager|related\w*|recommend\w*|share|sharing|social\w*|login|signup|"
    r"outbrain|taboola|skip-?link|hidden)(?=$|[\s_-])",
    re.I,
)
STATE_NAME = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|not|with|without)[_-][\w-]*", re.I)
COMMENT_NAME = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|disqus|replies|respond|discussion)(?=$|[\s_-])", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


class Node:
    __slots__ = ("tag", "up", "kids", "score", "chars", "linked", "points", "doubt")

    def __init__(self, tag: str, up: "Node | None") -> None:
        self.tag, self.up, self.kids = tag, up, []
        self.score, self.chars, self.linked, self.points = 0.0, 0, 0, False
        self.doubt = ""  # "part" or "comments" where its name asks for it to be cut


def _unwanted(tag: str, attributes: str, inside_article: bool) -> str:
    """"cut", "part" or "comments" for what is to be cut, the latter two after a look at the whole page."""
    if tag in DROPPED or (tag == "header" and not inside_article):
        return "cut"
    doubt = "part" if tag == "form" else ""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return doubt
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            value = STATE_NAME.sub("", value)
            if COMMENT_NAME.search(value):
                doubt = "comments"
            elif DROPPED_NAME.search(value):
                doubt = doubt or "part"
        elif name == "role" and value.strip().lower() in DROPPED_ROLE:
            return "cut"
        elif name == "aria-hidden" and value.strip().lower() == "true":
            return "cut"
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return "cut"
    if re.search(r"(?:^|\s)hidden(?:\s|$|/)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        return "cut"
    return doubt


def parse(page: str) -> Node:
    """Tree of wanted elements; text is kept as strings among the children."""
    root = node = Node("#root", None)
    muted = None  # the open element whose content is cut
    doubts = False
    at, size = 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            if muted is None:
                node.kids.append(page[at:])
            break
        if found.start() > at and muted is None:
            node.kids.append(page[at : found.start()])
        at = found.end()
        tag = found.group(2) or found.group(5)
        if tag is None:
            if muted is None and found.group().startswith("<![CDATA["):
                node.kids.append(found.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        closing = found.group(1) or found.group(4)
        attributes = found.group(3) if found.group(2) else found.group(6)
        if closing:
            if tag == "br":
                node.kids.append(Node("br", node))
            open_node = node
            while open_node is not root and open_node.tag != tag:
                open_node = open_node.up
            if open_node is root or (tag not in BLOCK and _crosses(node, open_node)):
                continue
            if muted is not None and _holds(open_node, muted):
                muted = None
            node = open_node.up
            continue
        if tag in CLOSES_P:
            node, muted = _close(node, root, ("p",), ("button", "td", "th", "table"), muted)
        if tag in SIBLING_CLOSE:
            names, stops = SIBLING_CLOSE[tag]
            node, muted = _close(node, root, tuple(names.split()), stops, muted)
        if tag in HEADINGS:
            node, muted = _close(node, root, tuple(HEADINGS), tuple(BLOCK - HEADINGS), muted)
        if tag in VOID or (attributes.rstrip().endswith("/") and tag not in BLOCK and tag not in RAW):
            if muted is None and tag in ("br", "hr"):
                node.kids.append(Node(tag, node))
            continue
        child = Node(tag, node)
        if muted is None:
            unwanted = _unwanted(tag, attributes, _in_article(node))
            if unwanted == "cut":
                muted = child
            else:
                child.doubt, doubts = unwanted, doubts or bool(unwanted)
                node.kids.append(child)
        node = child
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            if muted is child:
                muted = None
            node = child.up
    if doubts:
        _settle(root)
    return root


def _settle(root: Node) -> None:
    """Cut the parts whose names ask for it, outermost first, but not those that are the page's main part."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in node.kids if type(k) is Node)
    _lengths(order)
    whole: dict[Node, float] = {}
    for node in reversed(order):
        # Letters count a little, so that pages without any paragraph are settled as well.
        text = 0 if node.tag == "a" else sum(len(k) for k in node.kids if type(k) is str and not k.isspace())
        plain = 1 - node.linked / node.chars if node.chars else 0
        whole[node] = _worth(node) * plain + text / 1e6 + sum(whole[k] for k in node.kids if type(k) is Node)
    while True:
        # What stays if all is cut, the articles in it, and the outermost doubtful parts with their article.
        rest: dict[Node, float] = {}
        articles: set[Node] = set()
        for node in reversed(order):
            kids = [k for k in node.kids if type(k) is Node]
            rest[node] = whole[node] - sum(whole[k] - (0 if k.doubt else rest[k]) for k in kids)
            if node.tag in ("article", "main") and whole[node] > 0 or any(k in articles for k in kids):
                articles.add(node)
        open_article, doubtful, stack = False, [], [(root, root)]
        while stack:
            node, scope = stack.pop()
            if node.doubt:
                doubtful.append((node, scope))
                continue
            if node.tag in ("article", "main"):
                scope, open_article = node, open_article or rest[node] > 0
            stack.extend((k, scope) for k in node.kids if type(k) is Node)
        if not doubtful:
            break
        gone = set()
        for node, scope in doubtful:
            most = 2 * whole[node] > whole[scope] and (node.doubt == "part" or rest[scope] < 0.5)
            if scope is root and open_article:
                most = False  # an advert longer than the article is still an advert
            if most or node in articles and scope is root and not open_article:
                node.doubt = ""
            else:
                gone.add(node)
        for up in {node.up for node in gone}:
            up.kids = [k for k in up.kids if type(k) is str or k not in gone]
        for node in gone:  # what went does not count any more
            up = node.up
            while up is not None:
                whole[up] -= whole[node]
                up = up.up
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(k for k in node.kids if type(k) is Node)
    for node in order:
        node.chars = node.linked = 0


def _in_article(node: Node) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.up
    return False


def _crosses(node: Node, target: Node) -> bool:
    """An inline end tag does not close blocks opened inside its element."""
    while node is not target:
        if node.tag in BLOCK:
            return True
        node = node.up
    return False


def _holds(outer: Node, inner: Node) -> bool:
    while inner is not None:
        if inner is outer:
            return True
        inner = inner.up
    return False


def _close(node: Node, root: Node, names, stops, muted):
    look = node
    while look is not root and look.tag not in stops:
        if look.tag in names:
            if muted is not None and _holds(look, muted):
                muted = None
            return look.up, muted
        look = look.up
    return node, muted


def _measure(root: Node) -> list[Node]:
    """Characters, linked characters and points of every element, without recursion."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in node.kids if type(k) is Node)
    scored = []
    _lengths(order)
    for node in order:
        points = _worth(node)
        if not points:
            continue
        up = node.up if node.tag in ("p", "pre", "td", "blockquote", "li") else node
        for share in (1.0, 0.5):
            while up is not None and up.tag not in BLOCK and up.tag != "#root":
                up = up.up
            if up is None:
                break
            if not up.points:
                up.points = True
                scored.append(up)
            up.score += points * share
            up = up.up
    return scored


def _lengths(order: list[Node]) -> None:
    for node in reversed(order):
        for kid in node.kids:
            if type(kid) is str:
                node.chars += len(kid) - kid.count("\n")
            else:
                node.chars += kid.chars
                node.linked += kid.linked
        if node.tag == "a":
            node.linked = node.chars


def _worth(node: Node) -> int:
    """Points of a paragraph, or of a container that holds text of its own."""
    own = any(type(k) is str and not k.isspace() for k in node.kids)
    if node.tag not in BLOCK and node.tag != "#root" or node.chars < 25:
        return 0
    if node.tag not in ("p", "pre", "td", "blockquote", "li") and not own:
        return 0
    return 1 + _commas(node) + min(node.chars // 100, 3)


def _commas(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        for kid in stack.pop().kids:
            if type(kid) is str:
                total += kid.count(",") + kid.count("،") + kid.count("、") + kid.count("，")
            elif kid.tag not in BLOCK:
                stack.append(kid)
    return total


def _final(node: Node) -> float:
    return node.score * (1 - node.linked / node.chars if node.chars else 0)


def main_nodes(root: Node) -> list[Node]:
    """The best container with its content siblings; the article around it where there is one."""
    scored = _measure(root)
    if not scored:
        return [root]
    best = max(scored, key=_final)
    top, look = None, best
    while look is not None:
        if look.tag in ("article", "main"):
            top = look if top is None or look.tag == "article" else top
        look = look.up
    if top is not None:
        return [top]
    if best.up is None:
        return [best]
    least = max(10.0, 0.2 * _final(best))
    kept = []
    for kid in best.up.kids:
        if type(kid) is str:
            continue
        linked = kid.linked / kid.chars if kid.chars else 1.0
        if (
            kid is best
            or _final(kid) >= least
            or (kid.tag == "p" and kid.chars > 80 and linked < 0.25)
            or (kid.tag in HEADINGS and kid.chars and linked < 0.25)
        ):
            kept.append(kid)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order: references decoded, white space made one space."""
    out, held = [], []

    def flush():
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append(text)

    for top in nodes:
        stack = [top]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif type(item) is str:
                held.append(item)
            elif item.tag in ("br", "hr"):
                if item.tag == "hr":
                    flush()
                else:
                    held.append(" ")
            elif item.tag in BLOCK or item.tag == "#root":
                flush()
                stack.append(None)
                stack.extend(reversed(item.kids))
            else:
                stack.extend(reversed(item.kids))
        flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(main_nodes(parse(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
