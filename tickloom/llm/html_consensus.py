"""HTML extraction by consensus host paths.

First pass: each page's containers are scored by their paragraph text, less links, with hints from tag and class
names; the best container votes, with its score's logarithm, for its generalised path (tags and first classes with digits
folded) on its host. Spark sums the votes and takes the winner of each host. Second pass: each page is extracted
again from its container at the host's winning path, or from its own best one where the page has none there, with
the siblings on the same path that hold more text than links. A name's hint counts for the containers around it, so an
inner container beats an outer one only where that adds no text outside links, or is no article where the inner one is.
The page itself stands for an article where no container is one by tag or name, or where most of its text lies in none of several containers. Of equal scores the
last in page order counts, of equal votes the last path in alphabetical order.

The text of a container leaves out menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
hidden parts and reader comments. A header within an article belongs to it; there a class word leaves an element out only
where the whole name says so. Class words do not drop an article or
main element, nor an element that holds most of the page's text and is named as content in another word, nor the
largest one that is not of comments where otherwise no text would be left. Character references are decoded, white space inside a block becomes one space, blocks
are joined by one newline in page order.

Defined results: a null html is the empty page, with an empty text; a null or odd url has no host, so the page goes
by its own best container; unclosed and misnested tags are mended as browsers do for paragraphs, list items and table cells; the end tag of a left-out element ends it whatever blocks are open in it;
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import functools
import html as html_lib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import sliced, store, strings

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "xmp", "noframes")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td".split())
#: Elements that are never main text.
DROPPED = frozenset("nav header footer aside form button select option input label fieldset dialog menu object audio video canvas map head".split())
#: Class, id or role words that mark what is not main text.
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?!comments?-(?:open|closed|off)(?:$|\s))(?:nav(?:bar|igation)?|menu|header|footer|side-?bar|aside|widget|breadcrumbs?|pagination|pager|toolbar|ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|comment-?\w+|disqus|respond|replies|reply|masthead|skip|search|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
#: Name parts that say nothing of what an element holds.
_PLAIN = re.compile(r"(?:area|articles?|bar|blocks?|bottom|box(?:es)?|btns?|buttons?|cards?|column|container|content|counts?|entr(?:y|ies)|feed|form|group|holder|icons?|inner|inline|inserts?|items?|left|links?|list|media|message|module|msg|outer|panel|posts?|right|row|section|slot|stories|story|text|thread|title|tools?|top|unit|wrap(?:per)?|zone|[0-9]+)", re.I)
_COMMENTS = re.compile(r"comment|disqus|respond|repl(?:y|ies)", re.I)
_HEADER = re.compile(r"header|masthead", re.I)
_GOOD = re.compile(r"article|content|main|post|entry|story|body|text", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Tags that end an open paragraph.
_ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary", "figcaption"}


#: Tags that an implied end tag does not reach across.
_FENCES = CONTAINERS | frozenset(("ul", "ol", "dl", "table", "tbody", "thead", "blockquote"))
#: Paths longer than this are named by a hash, so that deep nesting costs no more than its depth.
LONG_PATH = 400
#: Share of the page's text that lets an element named as content stay in spite of a class word.
MOST_TEXT = 0.6


class Node:
    """An element: its path, whether it is main text, and its place in the page's list of text pieces."""

    __slots__ = ("begin", "drop", "end", "good", "named", "path", "tag", "up")

    def __init__(self, tag: str, path: str, drop: bool, good: bool, begin: int) -> None:
        self.tag, self.path, self.drop, self.good, self.begin, self.end = tag, path, drop, good, begin, -1
        self.up: Node | None = None  # the container around a container
        self.named = ""  # class, id and role of an element that these drop


def parse(page: str) -> tuple[list[Node], list[tuple[str | None, bool, bool]]]:
    """Containers in page order, and the pieces of the page: text (None: a block edge), whether dropped, whether in a link."""
    containers, pieces, dropped = _parse(page, frozenset())
    if dropped:
        left = sum(len(t.strip()) for t, drop, link in pieces if t is not None and not drop and not link)
        sizes = [sum(len(t.strip()) for t, _, link in pieces[n.begin : n.end] if t is not None and not link) for n in dropped]
        k = max(range(len(dropped)), key=lambda i: (not _COMMENTS.search(dropped[i].named), sizes[i]))
        words = [w for w in dropped[k].named.split() if not _BOILERPLATE.search(w)]
        content = any(_GOOD.search(w) for w in words)
        if sizes[k] and not _COMMENTS.search(dropped[k].named) and (not left or (content and sizes[k] >= MOST_TEXT * (left + sum(sizes)))):
            containers, pieces, _ = _parse(page, frozenset((k,)))
    return containers, pieces


def _drops(name: str, names: str, in_article: bool) -> bool:
    """Whether class, id or role say that an element is no main text."""
    if name in ("html", "body", "article", "main") or not names.strip():
        return False
    if not in_article:
        return _BOILERPLATE.search(names) is not None
    # within an article a word counts only where the whole name says so: "related-posts", but not "related-work"
    whole = (w for w in names.split() if all(_BOILERPLATE.fullmatch(part) or _PLAIN.fullmatch(part) for part in re.split(r"[-_]+", w) if part))
    return any(not _HEADER.search(m.group(0)) for w in whole for m in _BOILERPLATE.finditer(w))


def _parse(page: str, kept: frozenset[int]) -> tuple[list[Node], list[tuple[str | None, bool, bool]], list[Node]]:
    """As `parse`, and the outermost elements that their names drop; those with the numbers in `kept` are not dropped."""
    pieces: list[tuple[str | None, bool, bool]] = []
    containers: list[Node] = []
    dropped: list[Node] = []
    root = Node("#", "", False, False, 0)
    stack = [root]
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    blocks, fences, around = [0], [0], [root]  # places of blocks and fences, and the open containers
    links = articles = found = 0
    at, size = 0, len(page)

    def close_from(k: int) -> None:
        nonlocal links, articles
        while len(stack) > k:
            node = stack.pop()
            node.end = len(pieces)
            opened[node.tag].pop()
            links -= node.tag == "a"
            articles -= node.tag in ("article", "main")
            if around[-1] is node:
                around.pop()
        while blocks[-1] >= k:
            blocks.pop()
        while fences[-1] >= k:
            fences.pop()

    def last(tag: str) -> int:
        places = opened.get(tag)
        return places[-1] if places else 0

    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            pieces.append((html_lib.unescape(text) if "&" in text else text, stack[-1].drop, links > 0))
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if not name:
            if m.group(0).startswith("<![CDATA["):
                pieces.append((m.group(0)[9:].removesuffix("]]>"), stack[-1].drop, links > 0))
            continue
        name = name.lower()
        if name in BLOCKS:
            pieces.append((None, False, False))
        elif name == "br":
            pieces.append((" ", stack[-1].drop, links > 0))
        if m.group(1):
            k = last(name)
            # an inline end tag does not close blocks, unless its element is where left-out text began
            if k and (name in BLOCKS or blocks[-1] < k or (stack[k].drop and not stack[k - 1].drop)):
                close_from(k)
            continue
        if name in RAW:
            end = _raw_end(name).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            continue
        enders = _CLOSED_BY.get(name, ())
        if enders or name in _ENDS_P:
            k = max(map(last, (*enders, "p") if name in _ENDS_P else enders))
            if k and k >= fences[-1]:
                close_from(k)
        attributes = {a.group(1).lower(): a.group(2) or a.group(3) or a.group(4) or "" for a in _ATTRIBUTE.finditer(m.group(3))} if m.group(3) else {}
        names = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}"
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        drop = stack[-1].drop or hidden or (name in DROPPED and not (name == "header" and articles))
        node = Node(name, "", drop, bool(_GOOD.search(names)), len(pieces))
        if not drop and _drops(name, names, articles > 0):
            node.drop = found not in kept
            node.named = names
            dropped.append(node)
            found += 1
        place = len(stack)
        links += name == "a"
        articles += name in ("article", "main")
        if name in CONTAINERS:
            first = attributes.get("class", "").split()
            step = f"{name}.{re.sub(r'[0-9]+', '0', first[0].lower())}" if first else name
            node.up = around[-1]
            node.path = f"{node.up.path}/{step}"
            if len(node.path) > LONG_PATH:
                node.path = f"~{xxhash.xxh3_64_hexdigest(node.path.encode('utf-8', 'replace'))}"
            containers.append(node)
            around.append(node)
        if name in BLOCKS:
            blocks.append(place)
        if name in _FENCES:
            fences.append(place)
        opened.setdefault(name, []).append(place)
        stack.append(node)
        if m.group(3).endswith("/") and name not in BLOCKS:
            close_from(place)
    close_from(1)
    root.end = len(pieces)
    if not any(c.tag == "body" for c in containers):
        containers.insert(0, root)
    return containers, pieces, dropped


@functools.cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def text_of(node: Node, pieces: list[tuple[str | None, bool, bool]]) -> str:
    blocks: list[str] = []
    run: list[str] = []
    for text, drop, _ in [*pieces[node.begin : node.end], (None, False, False)]:
        if text is None:
            if run and (block := " ".join("".join(run).split())):
                blocks.append(block)
            run = []
        elif not drop:
            run.append(text)
    return "\n".join(blocks)


def scores(containers: list[Node], pieces: list[tuple[str | None, bool, bool]]) -> list[float]:
    """Score of each container: characters of its text blocks outside links, with hints."""
    plain, linked = [0], [0]
    for text, drop, link in pieces:
        n = len(text.strip()) if text is not None and not drop else 0
        plain.append(plain[-1] + (0 if link else n))
        linked.append(linked[-1] + (n if link else 0))
    size = {c: plain[c.end] - plain[c.begin] for c in containers}
    inner: dict[Node, list[int]] = {}
    good = set()
    for c in reversed(containers):  # inner ones first
        if c.good and not c.drop and size[c]:
            good.add(c)
        if c.up:
            inner.setdefault(c.up, []).append(size[c])
            if c in good:
                good.add(c.up)
    named = any((c.tag in ("article", "main") or c.good) and not c.drop and size[c] and c.tag not in ("body", "#") for c in containers)
    out = []
    for c in containers:
        body, links = size[c], linked[c.end] - linked[c.begin]
        own = inner.get(c, [0])
        adds = body - sum(own)
        # the page as a whole stands for an article if no container is named as one; else only if it adds text to a
        # single container, or most lies directly in it
        alone = not adds and sum(own) == max(own)
        whole = c.tag in ("body", "#") and c in inner and (alone or (named and (not adds or (sum(own) != max(own) and adds <= max(own)))))
        if c.drop or whole or body + links == 0:
            out.append(0.0)
            continue
        score = body * (1 - links / (body + links))
        out.append(score * (1.3 if c.tag in ("article", "main") else 1.1 if c in good else 1.0))
    return out


def best(containers: list[Node], pieces: list[tuple[str | None, bool, bool]]) -> tuple[Node, float]:
    found = scores(containers, pieces)
    k = max(range(len(found)), key=lambda i: (found[i], i))
    return containers[k], found[k]


def article_at(node: Node, containers: list[Node], pieces: list[tuple[str | None, bool, bool]]) -> str:
    """Text of a container and of its siblings on the same path that hold more text than links, in page order."""
    texts = []
    for c in containers:
        if c is not node:
            if c.path != node.path or c.up is not node.up or c.drop:
                continue
            sizes = [0, 0]
            for text, drop, link in pieces[c.begin : c.end]:
                if text is not None and not drop:
                    sizes[link] += len(text.strip())
            if sizes[0] <= sizes[1]:
                continue
        if text := text_of(c, pieces):
            texts.append(text)
    return "\n".join(texts)


def main_text(page: str, path: str | None) -> str:
    """Text at the winning path; of several containers there, the one with the best score and its siblings."""
    if not page:
        return ""
    containers, pieces = parse(page)
    there = [k for k, c in enumerate(containers) if c.path == path and not c.drop] if path else []
    if there:
        found = scores(containers, pieces)
        k = max(there, key=lambda i: (found[i], i))
        if found[k] > 0:
            return article_at(containers[k], containers, pieces)
    return article_at(best(containers, pieces)[0], containers, pieces)


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case, without www; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", "")


def votes(pages: DataFrame) -> DataFrame:
    """host, path, vote of each page (page_id, url, html, host) that has a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            hosts, paths, weights = [], [], []
            for host, page in zip(batch.column("host").to_pylist(), strings(batch.column("html")), strict=True):
                if page:
                    node, score = best(*parse(page))
                    if score > 0 and node.path:
                        hosts.append(host)
                        paths.append(node.path)
                        weights.append(1.0 + math.log1p(score))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(weights, pa.float64())], ["host", "path", "vote"])

    return pages.select("host", "html").filter("host != ''").mapInArrow(run, "host string, path string, vote double")


def winners(pages: DataFrame) -> DataFrame:
    """host, path: the path with the most votes of each host. Votes fold before both shuffles."""
    summed = votes(pages).groupBy("host", "path").agg(F.sum("vote").alias("vote"))
    return summed.groupBy("host").agg(F.max(F.struct("vote", "path")).alias("top")).select("host", F.col("top.path").alias("path"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, host, path (the winning path of the host) of each page."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    pages = pages.withColumn("host", host_of(F.col("url")))
    won = store(winners(pages))  # its stored size decides whether it is broadcast
    known = pages.join(won, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [main_text(page, path) for page, path in zip(strings(batch.column("html")), batch.column("path").to_pylist(), strict=True)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("host"), batch.column("path")]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "host", "path"])

    return known.select("page_id", "url", "html", "host", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long, host string, path string")
