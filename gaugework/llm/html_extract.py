"""Main text of web pages by consensus host paths.

1. Every page's containers are scored by the words of the text blocks in them (links count against a block; a block
   gives its whole score to the nearest container, half of it to the next one out, and so on). The best one gives way to
   the article around it, else to the main element around it, else to its parent below the body while that has text
   of its own outside links, a sibling of the same path, or a fifth more words outside links.
2. A container's path is its chain of tags with generalised classes (lower case, digits as ``#``). Each page votes for
   the path of its best container, and Spark counts the votes per host.
3. Each page is read again: the host's paths are tried in the order of their votes, and the containers with the first
   path that the page has are its article. A page with none of them uses its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out
wherever they stand, by tag, by role or by a word of their class or id ("no-sidebar" names none; inside an article the whole
name has to say so, as "share-buttons" does and "share-price" does not). Words of class and id
leave nothing out that holds a main element, the article with the most unlinked words (if that is half of the main
element's at least), or most of the page's unlinked words (nine tenths for names of reader comments, which are often longer than the article).

Sizes: votes are one short row per page and combine in each task before the shuffle. The table of winning paths has
at most ``paths`` rows per host; Spark broadcasts it while it is small and else joins by host, splitting hot hosts.

Defined cases: a null or empty page has the empty text; pages with a null or unreadable url form one host; ties in
votes go to the path that comes first by code point; broken markup never fails: unclosed elements end with their
parent (a list of options with the next block; of scripts and styles nothing tells the end), a "<" that opens no tag is text; rows with equal ids get results of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.functions.columns import ref
from gaugework.llm.common import written

PATHS = 5
PATH_STEPS = 40  # deeper elements share the path of their ancestor at this depth
_DECAY = (1.0, 0.5, 0.25, 0.1)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript textarea title template iframe svg canvas audio video".split())
_TO_THE_END = frozenset("script style".split())  # without an end tag all that follows is code
_CONTROLS = frozenset("button datalist optgroup option select".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var math mi mn mo mrow ms mtext msup msub mfrac msqrt object".split()
)
_FLOWING = _INLINE | _CONTROLS
_CONTAINERS = frozenset("article body center div main section td".split())
_LEFT_OUT = frozenset("aside dialog fieldset footer form head header menu nav".split()) | _RAW
_LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted "
    "related reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# inside an article a class or id has to consist of left-out words and of these
_PLACES = frozenset(
    "area bar block bottom box button buttons container form icons inner item items left link links list main page panel post posts right "
    "section sections site story stories top wrap wrapper".split()
)
_COMMENT_WORDS = frozenset("comment comments disqus reply respond".split())
_WITHOUT = frozenset("has no not with without".split())  # "has-sidebar" says what stands elsewhere
_LEFT_OUT_ROLES = frozenset("banner complementary contentinfo navigation search form dialog".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:[\"'][^>]*)?)>?", re.S
)
_ATTRIBUTE = re.compile(r"""(?<![^\s/"'])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    path: str
    parent: Node | None
    out: bool
    container: Node | None  # the nearest container, itself included
    named: Node | None = None  # the nearest element with a left-out word as its name, itself included
    article: Node | None = None  # the nearest article or main without such a word, itself included
    remarks: bool = False  # named as reader comments
    unlinked: int = 0  # words outside links, of named elements and articles
    dropped: bool = False
    score: float = 0.0
    link: bool = False
    blocks: list[int] = field(default_factory=list)


@dataclass
class Block:
    text: str
    node: Node
    words: int
    linked: int


def _below(path: str, step: str) -> str:
    return f"{path}>{step}" if path.count(">") < PATH_STEPS else path


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text else {}


def _step(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({re.sub(r"[0-9]+", "#", c.lower()) for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


def _unwanted(tag: str, attributes: dict[str, str]) -> bool:
    return tag in _LEFT_OUT or "hidden" in attributes or attributes.get("role", "").lower() in _LEFT_OUT_ROLES


def _left_out_words(attributes: dict[str, str], inside: bool) -> set[str]:
    """Left-out words of class and id; ``inside`` an article, of names that say nothing else ("share-price" says more)."""
    found: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [p.lower() for p in _PART.split(name)]
        if parts[0] not in _WITHOUT and (not inside or _LEFT_OUT_WORDS.union(_PLACES).issuperset(filter(None, parts))):
            found |= _LEFT_OUT_WORDS.intersection(parts)
    return found


def _without_named(nodes: list[Node], containers: list[Node], blocks: list[Block]) -> tuple[list[Node], list[Block]]:
    """Leaves out the named elements, but for those that hold the article. ``nodes``: named elements and articles."""
    total = 0
    for b in blocks:
        free = max(0, b.words - b.linked)
        total += free
        for node in (b.node.named, b.node.article):
            if node is not None:
                node.unlinked += free
    for node in reversed(nodes):  # children come after their parents; a node is either named or an article
        up = node.parent.named if node.named is node else node.parent.article
        if up is not None:
            up.unlinked += node.unlinked
    articles = [n for n in nodes if n.article is n]
    mains = [n for n in articles if n.tag == "main"]
    best = max((n for n in articles if n.tag == "article"), key=lambda n: n.unlinked, default=None)
    if best is not None and 2 * best.unlinked > max((n.unlinked for n in mains), default=0):  # no teaser beside the text
        mains.append(best)
    held: set[int] = set()
    for node in mains:
        up = node.named
        while up is not None and id(up) not in held:
            held.add(id(up))
            up = up.parent.named
    for node in nodes:
        if node.named is node:
            most = node.unlinked > (0.9 if node.remarks else 0.5) * total
            above = node.parent.named
            node.dropped = not (most or id(node) in held) or (above is not None and above.dropped)
    stays = lambda n: n.named is None or not n.named.dropped
    return [n for n in containers if stays(n)], [b for b in blocks if stays(b.node)]


def read(html: str) -> tuple[list[Node], list[Block]]:
    """The containers and the text blocks of a page, in page order; left-out parts give no blocks."""
    root = Node("", "", None, False, None)
    root.container = root
    containers, blocks, stack = [root], [], [root]
    nodes: list[Node] = []  # named elements, articles and main elements
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = sum(len(unescape(p).split()) for p, in_link in parts if in_link)
                blocks.append(Block(text, stack[-1], len(text.split()), linked))
            parts.clear()

    opened: Counter[str] = Counter()

    def close(index: int) -> None:
        if any(n.tag not in _FLOWING for n in stack[index:]):
            flush()
        opened.subtract(n.tag for n in stack[index:])
        del stack[index:]

    at = 0
    while True:
        m = _TAG.search(html, at)
        text = html[at:m.start()] if m else html[at:]
        if text and not stack[-1].out:
            parts.append((text, stack[-1].link))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if opened[tag] > 0 else 0
            if i and (tag not in _INLINE or all(n.tag in _INLINE for n in stack[i:])):
                close(i)
            continue
        if tag in _VOID:
            if tag in ("br", "hr") and not stack[-1].out:
                parts.append((" ", False))
            continue
        if tag in _RAW:  # no markup inside: on to the end tag
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at) if not m[0].endswith("/>") else None
            at = end.end() if end else len(html) if tag in _TO_THE_END and not m[0].endswith("/>") else at
            parts.append((" ", False))
            continue
        if tag in _CONTROLS:  # left out, within the text around it; options need no end tag
            if tag in ("option", "optgroup") and stack[-1].tag == "option":
                close(len(stack) - 1)
            up = stack[-1]
            parts.append((" ", False))
            stack.append(Node(tag, up.path, up, True, up.container, up.named, up.article, link=up.link))
            opened[tag] += 1
            continue
        if tag not in _INLINE:
            # a list of options holds no blocks: it ends, whatever its end tag
            while stack[-1].tag in _CONTROLS and stack[-1].tag != "button":
                close(len(stack) - 1)
            # a new block ends an open paragraph, a new item or cell its open sibling
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ("p",))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag not in _INLINE and stack[i].tag != "p":
                    break
            flush()
        attributes = _attributes(m[3])
        up = stack[-1]
        if tag in _INLINE:
            node = Node(tag, up.path, up, up.out or (tag == "span" and (_unwanted(tag, attributes) or bool(_left_out_words(attributes, up.article is not None)))), up.container, up.named, up.article, link=up.link or tag == "a")
        else:
            node = Node(tag, _below(up.path, _step(tag, attributes)), up, up.out or _unwanted(tag, attributes), up.container, up.named, up.article, link=up.link)
            words = _left_out_words(attributes, up.article is not None) if attributes and not node.out else ()
            if tag in ("article", "main"):
                if not node.out and not words:
                    node.article = node
                    nodes.append(node)
            elif words and tag not in ("body", "html"):
                node.named, node.remarks = node, not _COMMENT_WORDS.isdisjoint(words)
                nodes.append(node)
            if tag in _CONTAINERS and not node.out:
                node.container = node
                containers.append(node)
        stack.append(node)
        opened[tag] += 1
    flush()
    return _without_named(nodes, containers, blocks)


def _climbed(best: Node, containers: list[Node], blocks: list[Block]) -> Node:
    """The container that holds the whole article of which ``best`` is a part."""
    around, node = {}, best
    while node is not None:
        around[node.tag] = node  # the outermost of each tag
        node = node.parent.container if node.parent is not None else None
    if "article" in around or "main" in around:
        return around.get("article") or around["main"]
    direct: Counter[int] = Counter()
    for b in blocks:
        direct[id(b.node.container)] += max(0, b.words - b.linked)
    inside = direct.copy()
    paths: Counter[tuple[int, str]] = Counter()
    for n in reversed(containers):  # children come after their parents
        up = n.parent.container if n.parent is not None else None
        if up is not None:
            inside[id(up)] += inside[id(n)]
            paths[id(up), n.path] += inside[id(n)] > 0
    below = best
    up = best.parent.container if best.parent is not None else None
    while up is not None and up.tag not in ("", "body"):
        more = inside[id(up)] - inside[id(best)]
        if more:
            if not direct[id(up)] and paths[id(up), below.path] < 2 and 5 * more < inside[id(best)]:
                break
            best = up
        below, up = up, up.parent.container
    return best


def _scored(containers: list[Node], blocks: list[Block]) -> Node:
    """The best container and what belongs to it; the first of equals."""
    for b in blocks:
        value = b.words * (1.0 - min(1.0, b.linked / b.words))
        node, level = b.node.container, 0
        while node is not None and level < len(_DECAY):
            node.score += value * _DECAY[level]
            node = node.parent.container if node.parent is not None else None
            level += 1
    return _climbed(max(containers, key=lambda n: n.score), containers, blocks)


def _inside(node: Node | None, chosen: set[int]) -> bool:
    """Whether a chosen container holds the node; only containers are looked at on the way up."""
    node = node.container if node is not None else None
    while node is not None:
        if id(node) in chosen:
            return True
        node = node.parent.container if node.parent is not None else None
    return False


def vote(html: str | None) -> str | None:
    """The path of the page's best container; None if the page has no text."""
    containers, blocks = read(html or "")
    return _scored(containers, blocks).path if blocks else None


def main_text(html: str | None, paths: list[str]) -> str:
    containers, blocks = read(html or "")
    if not blocks:
        return ""
    own = _scored(containers, blocks)
    chosen = [own]
    for path in paths:
        there = [n for n in containers if n.path == path]
        if there and any(_inside(b.node, {id(n) for n in there}) for b in blocks):
            chosen = there
            break
    marks = {id(n) for n in chosen}
    return " ".join(b.text for b in blocks if _inside(b.node, marks))


def host(url_column) -> F.Column:
    """The lower-case host of an address, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url_column.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url: str, html: str, paths: int) -> DataFrame:
    """(h, paths): per host its winning paths, most votes first."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [vote(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["h", "path"])

    cast = pages.select(host(ref(url)).alias("h"), ref(html).cast("string").alias("html")).mapInArrow(votes, "h string, path string")
    counted = cast.where("path IS NOT NULL").groupBy("h", "path").agg(F.count("*").alias("votes"))
    best = Window.partitionBy("h").orderBy(F.desc("votes"), "path")
    top = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= paths)
    return top.groupBy("h").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


@F.arrow_udf(T.StringType())
def _extract(pages: pa.Array, paths: pa.Array) -> pa.Array:
    return pa.array([main_text(h.as_py(), p.as_py() or []) for h, p in zip(pages, paths)], pa.string())


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", paths: int = PATHS) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    winners = written(host_paths(pages, url, html, paths), "host-paths").withColumnRenamed("h", "winner_host")
    rows = pages.select(ref(key).alias("page_id"), ref(url).alias("url"), ref(html).cast("string").alias("html"), host(ref(url)).alias("h"))
    joined = rows.join(winners, F.col("h") == F.col("winner_host"), "left")
    done = joined.select("page_id", "url", _extract("html", "paths").alias("text"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
