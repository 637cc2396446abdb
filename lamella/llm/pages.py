"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of styles. A node of it is a path of tags with their classes, ids and
roles from the root; siblings of one style are one node. Two entropies tell how important a node is for its host:

* of presentation: how evenly the node's pages spread over the different sequences of child styles,
* of content: how evenly they spread over the different texts that the node itself holds.

Each is the entropy to the base of the number of pages, so it lies between 0 (all pages alike: a template) and 1 (every
page its own). A node's importance is the largest of its own and its descendants'; with one page on the host it is
1. From each page, branches of low importance are removed, along with branches that by tag, role or
class are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments. Where a page has
an article (or else a main part), that is where its text lies. Inside it whole boxes of low importance go (a
notice, share bar or author's box that the host repeats), but no parts of them: headings, rows, items and words in a
sentence may well be alike on all pages of a host. A host that serves one article everywhere has nothing to
tell apart: where a removal leaves nothing, or less than a quarter of an article, only markup decides.
Pages of one content count once for their host, so that copies make no template.

Texts of blocks are joined by one newline in page order; a line break is white space. Character references are decoded
once. Nothing is cut off, and repeated paragraphs stay.

Null and empty pages give an empty text. A null url is a host of its own, and rows repeat as they are. Malformed markup
is read as far as it goes: open elements end with their parents, stray end tags are passed over. The tree is
aggregated by host and node, with partial sums in every task, so a host with very many pages does no harm, and
only nodes of low importance travel to the pages, as a list for each host. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import column, stored

# Names of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math xmp select".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}}
CLOSES |= {"td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCK_ENDS_P = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav"
    " ol p pre section table ul".split()
)
#: Elements of an article that the style tree may remove as a whole.
BOXES = set("address aside blockquote center details div dl fieldset figure ol p pre section table ul".split())
#: The share of an article that the style tree must leave.
LEFT = 0.25
#: Elements, roles and words of classes and ids that are never main text.
ASIDE_TAGS = set("nav header footer aside form button dialog head".split()) | RAW
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disclaimer footer gdpr header masthead menu nav navbar navigation newsletter notice notices pagination pager popup"
    " promo promoted promotion related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar"
    " widget".split()
)

TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|/\s*([a-zA-Z][^\s/>]*)[^>]*>"
    r"|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TELLING = ("class", "id", "role", "hidden")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")


@dataclass(frozen=True)
class Settings:
    importance: float = 0.2  # nodes below it are part of the host's template
    pages: int = 4  # pages a node must be on before it can be called one


class Node:
    """An element: its tag, style, children and texts in order; ``parts`` holds both."""

    __slots__ = ("tag", "style", "aside", "parts", "parent")

    def __init__(self, tag: str, style: str, aside: bool, parent: Node | None):
        self.tag, self.style, self.aside, self.parts, self.parent = tag, style, aside, [], parent


def _styled(tag: str, attributes: str) -> tuple[str, bool]:
    """The style of an element, and whether its markup says that it is no main text."""
    found = {}
    if any(k in attributes.lower() for k in TELLING):
        found = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    style = DIGITS.sub("0", ".".join([tag, *(found.get(k, "") for k in ("class", "id", "role"))]).rstrip("."))
    if tag in ("html", "body", "main"):  # their classes speak of what they hold
        return style, "hidden" in found
    words = set(named.split()) if tag == "article" else set(re.split(r"[^a-z]+", named))
    aside = tag in ASIDE_TAGS or "hidden" in found or found.get("role", "").lower() in ASIDE_ROLES
    return style, bool(aside or words & ASIDE_WORDS)


def parse(page: str) -> Node:
    """The tree of a whole page."""
    root = at = Node("", "", False, None)
    styles: dict[tuple[str, str], tuple[str, bool]] = {}
    end, position, size = 0, 0, len(page)
    while position < size:
        found = TAG.search(page, position)
        if not found:
            break
        if found.start() > end:
            at.parts.append(page[end : found.start()])
        position = end = found.end()
        closing, tag, attributes = found.groups()
        if closing:
            closing, up = closing.lower(), at
            while up is not None and up.tag != closing:
                up = up.parent
            if up is not None and up.parent is not None:
                at = up.parent
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK_ENDS_P:
            # An open paragraph ends here, and so do the inline elements left open in it.
            up = at
            while up.parent is not None and up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                at = up.parent
        if at.tag in CLOSES.get(tag, ()):
            at = at.parent
        key = (tag, attributes)
        if key not in styles:
            styles[key] = _styled(tag, attributes)
        node = Node(tag, *styles[key], at)
        at.parts.append(node)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, position)
            position = end = close.end() if close else size
            continue
        at = node
    if end < size:
        at.parts.append(page[end:])
    return root


def _short(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _named(parent: int, style: str) -> int:
    """The name of a node of the style tree: a digest of its path."""
    return _short(f"{parent}/{style}")


def _name_of(node: Node) -> int:
    styles, name = [], 0
    while node.parent is not None:
        styles.append(node.style)
        node = node.parent
    for style in reversed(styles):
        name = _named(name, style)
    return name


def features(page: str) -> Iterator[tuple[int, int, int, int]]:
    """For each style node of a page: name, parent's name, digests of its child styles and of its own texts."""
    found: dict[int, tuple[int, list, list]] = {}
    open_ = [(parse(page), 0)]
    while open_:
        node, name = open_.pop()
        for part in node.parts:
            if isinstance(part, str):
                if name and not part.isspace():
                    found[name][2].append(part)
            elif part.tag not in RAW and part.tag not in VOID:
                own = _named(name, part.style)
                found.setdefault(own, (name, [], []))
                if name:
                    found[name][1].append(part.style)
                open_.append((part, own))
    for name, (parent, styles, texts) in found.items():
        yield name, parent, _short("\n".join(styles)), _short("\n".join(texts))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [
            (host, _short(page), *x) for host, page in zip(batch["host"], batch["html"]) if page for x in features(page)
        ]
        if rows:
            yield pd.DataFrame(rows, columns=["host", "page", "node", "parent", "styles", "texts"])


def _mains(root: Node) -> list[Node]:
    """The articles of a page that are not part of an aside, or else its main parts."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    look = [root]
    while look:
        node = look.pop()
        if node.tag in found:
            found[node.tag].append(node)
        if node.tag != "article":
            look += [p for p in reversed(node.parts) if not isinstance(p, str) and not p.aside]
    return found["article"] or found["main"]


def main_text(page: str | None, template: frozenset = frozenset()) -> str:
    """The main text of a whole page; ``template`` names the style nodes that its host does not vary."""
    if not page:
        return ""
    root = parse(page)
    mains = _mains(root)
    if mains:
        marked = _blocks(mains, frozenset())
        varied = _blocks(mains, template, BOXES) if template else marked
        return varied if len(varied) >= LEFT * len(marked) else marked
    # Where a host serves the same page everywhere, its style tree has nothing to tell apart.
    return _blocks([root], template) or (_blocks([root], frozenset()) if template else "")


def _blocks(starts: list[Node], template: frozenset, removed: set | None = None) -> str:
    """Texts of the blocks below the starts, without asides and branches of the template (of ``removed`` tags, if given)."""
    blocks: list[str] = []
    current: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(current))).strip()
        current.clear()
        if text:
            blocks.append(text)

    for start in starts:
        work: list = [(start, _name_of(start), False)]
        while work:
            part, name, leaving = work.pop()
            if leaving:
                flush()
            elif isinstance(part, str):
                current.append(part)
            elif part.tag == "br":
                current.append(" ")
            elif part.tag in VOID:
                if part.tag == "hr":
                    flush()
            elif part is start or not (part.aside or name in template and (removed is None or part.tag in removed)):
                if part.tag not in INLINE:
                    flush()
                    work.append((part, name, True))
                work += [
                    (p, 0 if isinstance(p, str) or not template else _named(name, p.style), False) for p in reversed(part.parts)
                ]
        flush()
    return "\n".join(blocks)


def _texts(htmls: pd.Series, templates: pd.Series) -> pd.Series:
    return pd.Series([main_text(p, frozenset(() if t is None else t)) for p, t in zip(htmls, templates)], dtype="object")


def _entropy(nodes: DataFrame, digest: str) -> DataFrame:
    """Entropy of a digest over the pages of (host, node), to the base of their number."""
    counts = nodes.groupBy("host", "node", digest).agg(F.count("*").alias("n"))
    sums = counts.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log("pages"))).otherwise(1.0)
    return sums.select("host", "node", "pages", entropy.alias(digest))


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^/]*//([^/?#:]*)", 1))


def templates(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``host`` and the list of its template nodes, from ``host, html``."""
    nodes = stored(
        df.select("host", "html")
        .mapInPandas(_features, "host string, page long, node long, parent long, styles long, texts long")
        .distinct(),
        "style-tree",
    )
    own = _entropy(nodes, "styles").join(_entropy(nodes, "texts").drop("pages"), ["host", "node"])
    own = stored(own.select("host", "node", "pages", F.greatest("styles", "texts").alias("importance")), "importance")
    edges = stored(nodes.select("host", "node", "parent").distinct(), "style-edges")
    low = own.filter((F.col("importance") < s.importance) & (F.col("pages") >= s.pages))
    # A node keeps its branch alive: importance rises to all ancestors, a level at a time, as far as it changes anything.
    low, alive = stored(low.select("host", "node"), "low"), None
    while True:
        up = edges.join(low.select("host", F.col("node").alias("parent")), ["host", "parent"])
        up = up.join(low, ["host", "node"], "left_anti").select("host", F.col("parent").alias("node")).distinct()
        alive = stored(up, "alive")
        if alive.isEmpty():
            break
        low = stored(low.join(alive, ["host", "node"], "left_anti"), "low")
    # The top of a removed branch stands for all below it.
    inner = edges.join(low, ["host", "node"]).join(low.select("host", F.col("node").alias("parent")), ["host", "parent"])
    tops = low.join(inner.select("host", "node").distinct(), ["host", "node"], "left_anti")
    return tops.groupBy("host").agg(F.collect_list("node").alias("template"))


def extracted(df: DataFrame, page_id="page_id", url="url", page="html", s: Settings = Settings()) -> DataFrame:
    """One row per row of ``df``: the id, url, text, n_chars."""
    pages = df.select(
        column(page_id).alias("id"), column(url).alias("url"), host_of(column(url)).alias("host"), column(page).alias("html")
    )
    found = stored(templates(pages, s), "templates")
    texts = F.pandas_udf(_texts, "string")
    joined = pages.join(found, "host", "left").select("id", "url", texts("html", "template").alias("text"))
    return joined.select(F.col("id").alias(page_id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
