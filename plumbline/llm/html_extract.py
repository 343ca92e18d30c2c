"""Operator 10: main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
NEVER = frozenset("script style noscript template iframe head title nav aside form button select textarea input svg canvas object embed audio video dialog menu map math".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
PARAGRAPH = frozenset("p pre td blockquote li dd".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ()}
#: Words of class, id and role that mark what is not the article, and those that mark the article.
NEGATIVE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|byline-share|comments?|respond|disqus|replies|reply|cookies?|consent|gdpr|notices?|alert|modal|popup|overlay|promo\w*|sponsor\w*|sidebar\w*|side|widget\w*|menu\w*|nav\w*|footer\w*|header|masthead|topbar|toolbar|pagination|pager|related\w*|recommend\w*|social|share\w*|sharing|subscribe|newsletter|login|signup|skip|tags?|meta|copyright|legal|outbrain|taboola|complementary|contentinfo|search)(?=$|[\s_-])",
    re.IGNORECASE,
)
POSITIVE = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|entry\w*|post\w*|body|text|story|page)(?=$|[\s_-])", re.IGNORECASE)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_SPACES = re.compile(r"\s+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}
#: Least length of a paragraph that passes points on, and what a container needs to join the best one.
MIN_PARAGRAPH = 25
SIBLING_SHARE = 0.2
LONG_SIBLING = 80


class Node:
    __slots__ = ("tag", "parent", "children", "marks", "score", "text_len", "link_len", "commas", "dropped")

    def __init__(self, tag: str, parent: Node | None, marks: str = ""):
        self.tag, self.parent, self.marks = tag, parent, marks
        self.children: list[Node | str] = []
        self.score, self.text_len, self.link_len, self.commas, self.dropped = 0.0, 0, 0, 0, False


def parse(page: str) -> Node:
    """A tree of the page's elements and raw text runs; unclosed and stray tags are borne as browsers bear them.

    Open elements are counted by tag, and inline ones by the block they are in, so a stray end tag costs no climb and the
    work is in proportion to the page.
    """
    root = at = Node("#root", None)
    #: open blocks, each with the counts of the inline elements open in it
    open_blocks: list[tuple[Node, dict[str, int]]] = [(root, {})]
    counts: dict[str, int] = {}
    pos, n = 0, len(page)

    def close(top: Node) -> Node:
        """Closes all that is open down to `top`."""
        node = at
        while True:
            if node.tag in BLOCK:
                counts[node.tag] -= 1
                open_blocks.pop()
            else:
                open_blocks[-1][1][node.tag] -= 1
            if node is top:
                return node.parent
            node = node.parent

    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            at.children.append(page[pos:])
            break
        if m.start() > pos:
            at.children.append(page[pos : m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, attributes = name.lower(), (m[3] if m[2] else m[6]) or ""
        if m[1] or m[4]:
            # an inline end tag doesn't end a block
            if (counts if tag in BLOCK else open_blocks[-1][1]).get(tag):
                top = at
                while top.tag != tag:
                    top = top.parent
                at = close(top)
            continue
        if tag in CLOSES_P or tag in SAME_CLOSES:
            top = open_blocks[-1][0]
            if top is not root and (top.tag == "p" and tag in CLOSES_P or top.tag == tag and tag in SAME_CLOSES or {top.tag, tag} <= {"dt", "dd"} or {top.tag, tag} <= {"td", "th"}):
                at = close(top)
        node = Node(tag, at, attributes)
        at.children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, pos)
            node.children.append(page[pos : end.start() if end else n])
            pos = end.end() if end else n
            continue
        at = node
        if tag in BLOCK:
            counts[tag] = counts.get(tag, 0) + 1
            open_blocks.append((node, {}))
        else:
            own = open_blocks[-1][1]
            own[tag] = own.get(tag, 0) + 1
    return root


def _mark(node: Node) -> bool:
    """Whether a node is outside any article by its element or by its class, id or role."""
    if node.tag in NEVER:
        return True
    if not node.marks or node.tag in ("html", "body", "article", "main"):
        return node.tag == "footer"
    words = []
    for m in _ATTRIBUTE.finditer(node.marks):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
        if key in ("class", "id", "role"):
            words.append(value)
    said = " ".join(words)
    return node.tag == "footer" or bool(NEGATIVE.search(said)) and not (POSITIVE.search(said) and not re.search(r"comment|sidebar|\bads?\b|advert|nav|menu", said, re.IGNORECASE))


def _walk(root: Node) -> list[Node]:
    """All nodes that are not dropped, parents first, without recursion; marks those to drop."""
    out, stack = [], [(root, False)]
    while stack:
        node, in_article = stack.pop()
        out.append(node)
        in_article = in_article or node.tag in ("article", "main")
        for child in reversed(node.children):
            if isinstance(child, Node):
                if _mark(child) or child.tag == "header" and not in_article:
                    child.dropped = True
                else:
                    stack.append((child, in_article))
    return out


def blocks(tops: list[Node]) -> list[str]:
    """The texts of the blocks below `tops` in page order, each with references decoded and white space made single."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            text = _SPACES.sub(" ", html.unescape("".join(run))).strip()
            run.clear()
            if text:
                out.append(text)

    for top in tops:
        end()
        stack: list[Node | str | None] = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                run.append(x)
            elif x.dropped:
                continue
            elif x.tag == "br":
                run.append(" ")
            else:
                if x.tag in BLOCK:
                    end()
                    stack.append(None)
                stack.extend(reversed(x.children))
    end()
    return out


def extract(page: str | None) -> str:
    """The main text of a page: the article's blocks joined by spaces, "" if there is none."""
    if not page:
        return ""
    root = parse(page)
    nodes = _walk(root)
    long_runs = set()
    for node in reversed(nodes):  # children first: lengths of text and of link text, and commas
        for child in node.children:
            if isinstance(child, str):
                run = _SPACES.sub(" ", html.unescape(child)).strip()
                node.text_len += len(run)
                node.commas += run.count(",")
                if len(run) >= MIN_PARAGRAPH:
                    long_runs.add(id(node))
            elif not child.dropped:
                node.text_len += child.text_len
                node.link_len += child.text_len if child.tag == "a" else child.link_len
                node.commas += child.commas
    for node in nodes:
        own = node.tag in PARAGRAPH or node.tag in ("div", "section", "article", "main", "body", "#root") and id(node) in long_runs
        if not own or node.text_len < MIN_PARAGRAPH:
            continue
        points = 1 + node.commas + min(node.text_len // 100, 3) + node.text_len / 1000
        if node.tag not in PARAGRAPH:
            node.score += points
        up, share = node.parent, 1.0
        while up is not None and share > 0.1:
            up.score += points * share
            up, share = up.parent, share * 0.5
    candidates = [x for x in nodes if x.score > 0]
    if not candidates:
        return " ".join(blocks([root]))

    def value(x: Node) -> float:
        bonus = 1.25 if x.tag in ("article", "main") else 1.0
        return bonus * x.score * (1 - x.link_len / max(1, x.text_len))

    best = max(candidates, key=value)
    up = best
    while up is not None:  # an article is whole
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    kept = [best]
    if best.parent is not None and best.tag not in ("article", "main"):
        least = max(10.0, SIBLING_SHARE * value(best))
        kept = []
        for s in best.parent.children:
            if not isinstance(s, Node) or s.dropped:
                continue
            links = s.link_len / max(1, s.text_len)
            if s is best or value(s) >= least or s.tag == "p" and s.text_len >= LONG_SIBLING and links < 0.25 or s.tag in HEADING and links < 0.5:
                kept.append(s)
    for node in kept:
        below = [node]
        for x in below:  # grows as it is read
            below += [c for c in x.children if isinstance(c, Node) and not c.dropped]
            if x is not best and x.tag in ("ul", "ol", "div", "section", "table") and x.text_len and x.link_len > 0.6 * x.text_len:
                x.dropped = True
    return " ".join(blocks(kept))


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages`.

    A null or empty page has the text ""; repeated rows stay; an empty table gives an empty one; null ids and urls stay;
    other columns are not read. A page without any paragraph gives what text is outside boilerplate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", column).mapInArrow(run, "page_id long, url string, text string, n_chars long")
