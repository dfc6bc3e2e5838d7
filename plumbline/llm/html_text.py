"""Main text of web pages by composite text density.

The page becomes a tree. Elements that never belong to an article (scripts,
menus, forms, adverts, comments, …) are taken out by name, role or class. Inside
an article, and for headings and sections, a word in a class or id is no proof:
ids are slugs of headings, so only a whole class token takes an element out (of
a section outside articles its whole id too), and a doubtful one only if most of
its text is links. The text of formulas stays, without their annotations. Every
node gets its link-adjusted characters per tag; the node with the largest
sum of its children's densities is the article. The least density on its path
to the body is the threshold: what is at least as dense elsewhere on the page
belongs to the article as well, unless the page marks its article as one element.

Defined results: NULL and empty html, and a page with no text left, give the
empty string. Broken markup is read as far as it goes: unknown end tags are
ignored, open elements end with their parent. Repeated rows are extracted
alike. Only the named columns are read.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import map_texts, schema_of, texts_of

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul head title caption".split()
)
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
NOISE = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video map form button select "
    "textarea input datalist fieldset nav menu aside footer dialog title noembed noframes xmp annotation annotation-xml".split()
)
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An opening tag that ends an open element of these names, up to a barrier.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

# Roles, and words of class or id, of parts that are no article.
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner banners cookie "
    "cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter "
    "subscribe subscription signup login sidebar sidebars aside rail menu menus nav navbar navigation breadcrumb "
    "breadcrumbs masthead topbar header footer comment comments disqus reply replies respond discussion share "
    "sharing social related recommend recommended recommendations widget widgets toolbar pagination pager "
    "searchbox hidden".split()
)

# Words of the above that take out paragraphs and inline elements of an article.
ADVERTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion".split()
)
# Words of the above that also name parts of an article.
DOUBTFUL = frozenset(
    "banner notice notices notification notifications alert aside rail menu menus header footer reply replies respond "
    "discussion".split()
)

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r"""[^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*>""")
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


class Node:
    __slots__ = ("name", "noise", "doubt", "parent", "parts", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, noise: bool = False, doubt: bool = False):
        """``doubt``: it is noise only if most of its text is links."""
        self.name, self.parent, self.noise, self.doubt = name, parent, noise, doubt
        self.parts: list[Node | str] = []


def _attributes(source: str) -> dict[str, str]:
    return {n.lower(): v.strip("\"'") for n, v in _ATTRIBUTE.findall(source)}


def _is_noise(name: str, attributes: dict[str, str], in_content: bool) -> tuple[bool, bool]:
    """Whether an element is taken out, by class only if it holds no article, and if that is in doubt."""
    if name in NOISE:
        return True, False
    if name == "header":
        return not in_content, False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True, False
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True, False
    if attributes.get("role", "").lower() in NOISE_ROLES:
        return True, False
    if name in CONTENT or name in ("html", "body"):
        return False, False
    classes, own_id = attributes.get("class", ""), attributes.get("id", "")
    strict = in_content or name in HEADINGS or name == "section"
    words = {w.lower() for w in _WORDS.findall(classes if strict else f"{classes} {own_id}")} & NOISE_WORDS
    if not strict:
        return bool(words), False
    whole = set(classes.lower().split()) & NOISE_WORDS
    if in_content and (name == "p" or name not in BLOCK):
        return bool(whole & ADVERTS), False
    if name in HEADINGS:
        return not in_content and bool(whole - DOUBTFUL), False
    if not in_content and own_id.lower() in NOISE_WORDS:
        whole.add(own_id.lower())
    return bool(words or whole), not whole - DOUBTFUL


def parse(page: str) -> Node:
    root = Node("html", None)
    here, in_content = root, 0
    at, size = 0, len(page)

    def close(node: Node) -> None:
        nonlocal here, in_content
        while here is not node:
            in_content -= here.name in CONTENT
            here = here.parent
        in_content -= node.name in CONTENT
        here = node.parent

    def find(names, barriers) -> Node | None:
        node = here
        while node is not root and node.name not in barriers:
            if node.name in names:
                return node
            node = node.parent
        return None

    while at < size:
        less = page.find("<", at)
        if less < 0:
            here.parts.append(page[at:])
            break
        if less > at:
            here.parts.append(page[at:less])
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), less):
            end = page.find(">", less)
            at = size if end < 0 else end + 1
            continue
        tag = _NAME.match(page, less + 1)
        if not tag:
            here.parts.append("<")
            at = less + 1
            continue
        name = tag[1].lower()
        stop = _TAG_END.match(page, tag.end())
        end = stop.end() if stop else page.find(">", tag.end()) + 1
        if not end:
            break
        at = end
        if page[less + 1] == "/":
            node = find({name}, ())
            if node is not None:
                close(node)
            elif name == "br":
                here.parts.append(Node("br", here))
            continue
        if name in BLOCK and (open_ := find({"p"}, {"td", "th", "button", "object", "table"})):
            close(open_)
        if name in ENDS and (open_ := find(*ENDS[name])):
            while open_:
                close(open_)
                open_ = find(*ENDS[name]) if name == "tr" else None
        if name in ("html", "body") and (name == "html" or find({"body"}, ())):
            continue
        attributes = _attributes(page[tag.end() : end - 1]) if end - 1 > tag.end() else {}
        node = Node(name, here, *_is_noise(name, attributes, in_content > 0))
        here.parts.append(node)
        if name in RAW:
            close_at = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if not close_at:
                at = size
            else:
                gone = page.find(">", close_at.start())
                at = size if gone < 0 else gone + 1
        elif name not in VOID:
            in_content += name in CONTENT
            here = node
    return root


def _nodes(root: Node) -> list[Node]:
    """Nodes in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    return out


def _prune(root: Node) -> list[Node]:
    """Take noise out; a noisy class does not take out an article."""
    every = _nodes(root)
    holds = {}
    for node in reversed(every):
        holds[node] = node.name in CONTENT or any(holds[p] for p in node.parts if isinstance(p, Node))
    if any(node.doubt for node in every):
        for node in reversed(every):
            _count(node)
            node.noise &= not node.doubt or 2 * node.link_chars > node.chars
    for node in every:
        node.parts = [
            p
            for p in node.parts
            if not (isinstance(p, Node) and p.noise and (p.name in NOISE or not holds[p]))
        ]
    return _nodes(root)


def _count(node: Node) -> None:
    """Characters and tags of a node whose parts were counted; raw text and other noise by name has none."""
    inside = [p for p in node.parts if isinstance(p, Node) and p.name not in NOISE]
    own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
    node.chars = own + sum(p.chars for p in inside)
    # A formula counts as one tag, or its marks would thin out the text around it.
    node.tags = sum(p.tags + 1 for p in inside) if node.name != "math" else 0
    if node.name == "a":
        node.link_chars, node.link_tags = node.chars, node.tags + 1
    else:
        node.link_chars = sum(p.link_chars for p in inside)
        node.link_tags = sum(p.link_tags for p in inside)


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        _count(node)
    body = next((n for n in nodes if n.name == "body"), nodes[0])
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        node.density = _density(node, share)
    for node in nodes:
        loose = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        blocks = [p for p in node.parts if isinstance(p, Node) and p.name in BLOCK]
        inline = sum(p.chars for p in node.parts if isinstance(p, Node) and p.name not in BLOCK)
        # Loose text beside blocks is a child of its own.
        node.total = sum(p.density for p in blocks) + (loose + inline if blocks else 0)


def _density(node: Node, body_share: float) -> float:
    chars, tags = node.chars, max(node.tags, 1)
    plain = chars / tags
    if not chars or not body_share:
        return plain
    links, link_tags = max(node.link_chars, 1), max(node.link_tags, 1)
    base = math.log(chars / max(chars - node.link_chars, 1) * node.link_chars + body_share * chars + math.e)
    inner = max(chars / links * tags / link_tags, 1.0)
    return plain * math.log(inner) / math.log(base) if base > 1 else plain


def _marked(nodes: list[Node]) -> set[Node]:
    """Nodes whose text is the article."""
    best = nodes[0]
    for node in nodes:
        if node.total >= best.total:
            best = node
    up, threshold = best, best.density
    article = None
    while up is not None:
        if up.name in CONTENT:
            article = up
        threshold = min(threshold, up.density)
        up = up.parent if up.name != "body" else None
    if article is not None:
        return {article}
    # Largest density sum below every node, from the leaves up.
    top: dict[Node, Node] = {}
    for node in reversed(nodes):
        top[node] = max([node, *(top[p] for p in node.parts if isinstance(p, Node))], key=lambda n: n.total)
    dense = {top[n] for n in nodes if n.name in BLOCK and n.chars and n.density >= threshold}
    return dense | {best}


def main_text(page: str) -> str:
    """Blocks of the main text, one per line."""
    if not page:
        return ""
    nodes = _prune(parse(page))
    _measure(nodes)
    if not nodes[0].chars:
        return ""
    marked = _marked(nodes)
    lines: list[str] = []
    line: list[str] = []

    def end_line() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            lines.append(text)
        line.clear()

    # Entering and leaving are both visited, so that depth costs no recursion.
    stack: list[tuple[Node | str, bool, bool]] = [(nodes[0], False, False)]
    while stack:
        part, leave, inside = stack.pop()
        if isinstance(part, str):
            if inside:
                line.append(part)
            continue
        block = part.name in BLOCK
        if block or leave:
            end_line()
        if leave:
            continue
        inside = inside or part in marked
        if part.name == "br":
            line.append(" ")
        if block:
            stack.append((part, True, inside))
        stack.extend((p, False, inside) for p in reversed(part.parts))
    end_line()
    return "\n".join(lines)


def extract(
    pages: DataFrame, *, keep: tuple[str, ...] = ("page_id", "url"), html_column: str = "html"
) -> DataFrame:
    """Columns ``keep`` with ``text`` and ``n_chars``, its code points."""
    schema = schema_of(pages, keep, text="string", n_chars="bigint")
    n = len(keep)

    def start():
        def work(batch: pa.RecordBatch):
            texts = [main_text(t.decode("utf-8", "replace")) for t in texts_of(batch.column(n))]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(n)),
                    pa.array(texts, pa.string()),
                    pa.array(list(map(len, texts)), pa.int64()),
                ],
                names=schema.names,
            )

        return work

    source = pages.select(*keep, pages[html_column].alias("_html"))
    return map_texts(source, source.columns, schema, start)
