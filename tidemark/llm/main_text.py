"""Main text of web pages by composite text density.

The page becomes a tree (character references decoded, comments, scripts, styles and forms left out). For each node:
characters C and tags T below it, of these linked characters LC and link tags LT, and unlinked characters NLC = C - LC.
Its composite density is

    C / T * log( C * T / (LC * LT) ) / log( ln( C / NLC * LC  +  LCb / Cb * C  +  e ) )

with LCb, Cb of the body and zero counts taken as one. The density sum of a node is the sum over its children. The
threshold is the smallest density on the path from the node of maximal density sum to the body, both included. Of every
part at or above it the subtree of maximal density sum is kept, in page order, with headings right before it. An
innermost <article> or <main> at or above it is a boundary: it is kept as a whole. Parts whose tag or class names them as menus,
headers, footers, sidebars, notices, adverts or reader comments give no text.

A null or empty page gives an empty text. A page without any tag gives its text. Repeated rows give equal results;
other columns stay; a column named like the result is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, query, table

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas")
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the right closes an open element of the left.
CLOSED_BY = {
    "p": BLOCK - {"br"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "option": frozenset({"option", "optgroup"}),
}
#: An implied end stops at these.
SCOPE = frozenset("html body div section article main aside nav header footer form table ul ol dl blockquote td th figure details".split())
# What is not main text, by tag, role, and word of class or id.
LEFT_OUT = frozenset("head nav footer aside form button select input label dialog menu script style noscript template iframe svg math object canvas textarea".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAMES = re.compile(
    r"^(?:nav\w*|menu\w*|breadcrumbs?|footer|sidebar|side|widgets?|ads?|adverts?|advertisement|advertising|banner|promo\w*|sponsor\w*|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|comments?|disqus|reply|replies|"
    r"respond|related|recommended|share|sharing|social|toolbar|pagination|pager|skip|masthead|topbar|header|copyright)$"
)
TELLING = re.compile(r"^(?:nav|navbar|navigation|menu|sidebar|footer|ads?|adverts?|cookies?|comments|disqus|newsletter|promo)$")
KEEP_NAMES = re.compile(r"^(?:article|post|entry|main|content|story|body|text)\w*$")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*?(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


class Node:
    """An element; ``parts`` holds texts and child elements in page order."""

    __slots__ = ("tag", "parent", "parts", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False) -> None:
        self.tag, self.parent, self.noise = tag, parent, noise
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _names_noise(name: str) -> bool:
    """Whether one class or id names a part that is no main text: by its last word, or its first, or a telling one."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    if not words or words[0] in ("has", "with", "no", "is"):
        return False
    if NAMES.match(words[-1]) or any(TELLING.match(w) for w in words):
        return True
    return bool(NAMES.match(words[0])) and not KEEP_NAMES.match(words[-1])


def _is_noise(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in LEFT_OUT or (tag == "header" and not inside_article):
        return True
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    for name, *values in ATTRIBUTE.findall(attrs):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
        if name in ("class", "id") and not (tag in ("h1", "h2", "header") and inside_article):
            if any(_names_noise(one) for one in value.split()):
                return True
    return False


def parse(page: str) -> Node:
    """Tree of the page; unclosed and misplaced tags are closed as browsers do in the common cases."""
    root = Node("#page", None)
    here, done = root, 0
    for m in TOKEN.finditer(page):
        if m.start() > done:
            here.parts.append(page[done : m.start()])
        done = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            at = here
            while at.parent is not None and at.tag != tag:
                # An inline end tag does not close blocks around it.
                at = root if at.tag in SCOPE and tag not in BLOCK else at.parent
            if at.parent is not None:
                here = at.parent
            continue
        at = here
        while at.parent is not None and at.tag not in SCOPE:
            if tag in CLOSED_BY.get(at.tag, ()):
                here = at.parent
            at = at.parent
        if at.tag in CLOSED_BY and tag in CLOSED_BY[at.tag] and at.tag in ("td", "th"):
            here = at.parent
        within = here
        inside = False
        while within is not None and not inside:
            inside, within = within.tag in ("article", "main"), within.parent
        node = Node(tag, here, _is_noise(tag, m["attrs"] or "", inside))
        here.parts.append(node)
        if tag not in VOID and not (m["attrs"] or "").endswith("/"):
            here = node
    if done < len(page):
        rest = page[done:]
        cut = re.search(r"<[a-zA-Z/!][^<>]*\Z", rest)  # a tag that the end of the page cuts off
        here.parts.append(rest[: cut.start()] if cut else rest)
    return root


def _ordered(root: Node) -> list[Node]:
    """All elements, parents before children, without recursion."""
    out = [root]
    for node in out:
        out.extend(p for p in node.parts if isinstance(p, Node))
    return out


def _measure(root: Node) -> list[Node]:
    nodes = _ordered(root)
    for node in reversed(nodes):
        if node.noise:
            continue
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            elif not part.noise:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        if node.chars and not node.noise:
            c, t = node.chars, max(1, node.tags)
            lc, lt, free = max(1, node.link_chars), max(1, node.link_tags), max(1, node.chars - node.link_chars)
            base = math.log(c / free * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(max(c * t / (lc * lt), 1.0) + 1) / math.log(base + 1)
    for node in nodes:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node))
    return nodes


def _blocks(tops: list[Node]) -> list[str]:
    """Texts of the blocks below ``tops`` in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [x for top in reversed(tops) for x in (None, top)]
    while stack:
        part = stack.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            line.append(part)
        elif not part.noise:
            if part.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(part.parts))
    end()
    return out


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def main_parts(root: Node) -> list[Node]:
    """The subtrees of maximal density sum of all parts at or above the threshold, in page order."""
    measured = _measure(root)
    nodes = [n for n in measured if n.chars and not n.noise]
    if not nodes:
        return [root]
    body = next((n for n in nodes if n.tag == "body"), root)
    pool = {n for n in nodes if n.tag in SCOPE or n is root} or {root}
    best = max((n for n in nodes if n in pool), key=lambda n: n.total, default=root)
    threshold, at = best.density, best
    while at is not None:
        threshold = min(threshold, at.density)
        at = None if at is body else at.parent
    # Below each node: the largest density sum of parts at or above the threshold, and that of marked articles.
    most: dict[Node, float] = {}
    named: dict[Node, float] = {}
    for node in reversed(nodes):
        if node.parent is None or node.density < threshold and node not in most:
            continue
        own = node.density >= threshold
        sums = [most[node]] if node in most else []
        if own and node in pool:
            sums.append(node.total)
        if sums:
            most[node.parent] = max(*sums, most.get(node.parent, -1.0))
        marks = [named[node]] if node in named else []
        if own and node.tag in ("article", "main"):
            marks.append(node.total)
        if marks:
            named[node.parent] = max(*marks, named.get(node.parent, -1.0))
    out: list[Node] = []
    before: list[Node] = []  # headings with nothing but headings after them so far
    stack: list[Node | str] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            if not node.isspace():
                before.clear()
            continue
        if node.noise or not node.chars:
            continue
        kept = node.density >= threshold
        if kept and node.tag in ("article", "main"):
            kept = node not in named
        elif kept and node in pool:
            kept = most.get(node, -1.0) <= node.total and not (node in named and named[node] * 2 >= node.total)
        elif kept:
            kept = node.tag in BLOCK and node not in most
        if kept:
            out += [*before, node]
            before.clear()
        elif node.tag in HEADINGS:
            before.append(node)
        else:
            if not any(isinstance(p, Node) and p.chars for p in node.parts):
                before.clear()
            stack.extend(reversed(node.parts))
    return out or [best]


def main_text(page: str | None) -> str:
    """Blocks of the main parts, one a line."""
    if not page or page.isspace():
        return ""
    return "\n".join(_blocks(main_parts(parse(page))))


def extracted(page: Column | str) -> Column:
    def each(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(each, "string")(page)


def extract_main_text(pages: DataFrame, page: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page."""
    prepare(pages.sparkSession)
    return pages.withColumn(into, extracted(page))


@query("op1_main_text")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    pages = extract_main_text(table(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
