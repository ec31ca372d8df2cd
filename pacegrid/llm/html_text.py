"""Main text of web pages by site style trees.

Pages of a host are merged into one style tree.  Its nodes are element paths
(tag and class of every open container); for each node two things are counted
over the host's pages: which sequences of child containers it shows
(presentation), and which blocks of text stand in it (content).  Pages of a host
with the same blocks in the same places are one content and count once, and so are
pages whose articles have the same longest block, so that copies of a page, near
ones too, are no repetition.  With m contents that have the node,

    presentation importance = - sum of p * log_m(p) over its child sequences
    content importance      = 1 - average over blocks of log_m(contents with the block)

and the composite is ``(1 - g^l) * presentation + g^l * content`` for l child
sequences, g = ``DAMPING``.  A block that all contents repeat counts 0, one
that a single content has counts 1.  Nodes inside articles are judged, too; an
article or main element itself is not, nor what it stands in.

What an element says of itself is a prior: the importance of a branch is the
composite times ``PRIORS[...]``, and branches of less than ``LEAST`` go.  Menus,
adverts, forms, comments and the like have a prior that no composite lifts over
``LEAST``; names that articles use for their own parts (discussion, related, search,
side ...) halve the importance, so the tree decides.  A name counts as a
whole class, id or role, or if all parts of it are names or words of layout
(``cookie-banner``, ``comment-list``); headings and paragraphs are never named by
their id.  Where a host has less than ``PAGES`` contents with the node, the
composite is 1.

A page with an article keeps what is left of it alone, one without keeps what is
left of its main element, or of its body.

The parser is one linear scan with a stack of open containers; it closes what a page
leaves open when an outer element ends, and an article ends any open branch that
was to go.  Containers more than ``DEEPEST`` deep are judged with the container
above them.  A tag of more than ``LONGEST_TAG`` characters, or one whose quotes don't
close, ends at its first ``>``.  Defined results: null html, and pages without
text, give an empty text; null urls are one host; repeated rows give
equal texts; columns other than page_id, url and html are not used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.llm import _tables

DAMPING = 0.9
LEAST = 0.2
PAGES = 5
DEEPEST = 256
LONGEST_TAG = 1 << 16
#: Importance that an element's own words leave it: none, half of it, all.
PRIORS = (1.0, 0.5, 0.1)
PLAIN, DOUBTED, NAMED = 0, 1, 2
#: Removed branches of up to so many nodes go to every executor (8 bytes each), more are joined.
BROADCAST_NODES = 200_000
#: Rows of one host are dealt to so many tasks where they are joined.
SALTS = 16

_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", re.S)
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)
_TOKENS = re.compile(r"[^\s]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Fixed values of HTML: elements whose text is no text of the page, elements
#: without an end, and inline elements, which do not end a block.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEAD = {"head"}
#: Elements, roles and words of class or id that name boilerplate.
OUTSIDE = {"nav", "aside", "form", "footer", "menu", "dialog", "button", "select", "svg", "object", "canvas", "audio", "video", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsbox adslot adbox sponsor sponsored sponsors promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay paywall "
    "sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar masthead footer "
    "comment comments commentlist disqus respond sharing widget widgets login".split()
)
#: Names that parts of an article have as well.
DOUBTFUL = set("side share social related recommended recommendations replies reply discussion search skip note hidden".split())
#: Words of layout: they neither name anything nor keep a name from counting.
LAYOUT = set(
    "area bar bars block body bottom box buttons bg card cell col column container content el element fixed form global group head holder inner item items js left "
    "link links list main mobile outer page panel posts primary right row secondary section site slot sm lg md sticky text thread title top unit user wrap wrapper zone "
    "the reader readers".split()
)
#: A header is boilerplate outside an article; within, it holds the title.
HEADERS = {"header", "topbar", "siteheader"}
#: Their ids are slugs of their own text.
SLUGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}
ARTICLES = {"article": 2, "main": 1}
#: Starts that end an inline element that was left open.
STARTS = SLUGS | {"article", "main"}
#: Elements that another one of their kind ends.
ENDED = {"li", "dt", "dd", "tr", "td", "th", "option"}


def _attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for k, a, b, c in _ATTRIBUTE.findall(rest):
        found.setdefault(k.lower(), unescape(a or b or c))
    return found


def _word(token: str, inside: bool) -> int:
    """What a class or an id says of its element."""
    parts = [p.lower() for p in _PARTS.findall(token)]
    if not parts:
        return PLAIN
    names = NAMES if inside else NAMES | HEADERS
    whole = "".join(parts)
    if whole in names or (any(p in names for p in parts) and all(p in names or p in LAYOUT or p in DOUBTFUL or p.isdigit() for p in parts)):
        return NAMED
    if whole in DOUBTFUL or (any(p in DOUBTFUL for p in parts) and all(p in DOUBTFUL or p in LAYOUT or p.isdigit() for p in parts)):
        return DOUBTED
    return PLAIN


def _named(tag: str, at: dict[str, str], inside: bool) -> int:
    """What an element says of itself."""
    if tag in OUTSIDE or (tag == "header" and not inside):
        return NAMED
    if not at:
        return PLAIN
    if at.get("role", "").lower() in ROLES or at.get("aria-hidden", "").lower() == "true" or "hidden" in at or "display:none" in at.get("style", "").replace(" ", "").lower():
        return NAMED
    if tag in ARTICLES or at.get("role", "").lower() in ARTICLES:
        return PLAIN
    tokens = _TOKENS.findall(at.get("class", "")) + ([] if tag in SLUGS else _TOKENS.findall(at.get("id", "")))
    return max((_word(t, inside) for t in tokens), default=PLAIN)


class Block:
    """A block of text and where it stands."""

    __slots__ = ("text", "path", "article", "goes")

    #: path: its containers; article: 2 in an article, 1 in a main element, 0 outside both; goes: in a branch that names itself
    def __init__(self, text: str, path: tuple[int, ...], article: int, goes: bool):
        self.text, self.path, self.article, self.goes = text, path, article, goes


def _tags(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, tag, rest, kind) in page order; kind is "start", "end", "cdata" or "" behind the last tag.

    ``text`` stands before the tag.  Raw elements are left out with what they hold.
    """
    at, text, size = 0, 0, len(html)
    last = {q: html.rfind(q) for q in "\"'>"}
    while True:
        at = html.find("<", at)
        if at < 0 or at > last[">"]:
            yield html[text:], "", "", ""
            return
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            yield html[text:at], "", "", "comment"
            at = text = size if end < 0 else end + 3
            continue
        if html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            stop = size if end < 0 else end
            yield html[text:at] + html[at + 9 : stop].replace("&", "&amp;"), "", "", "comment"
            at = text = min(size, stop + 3)
            continue
        if html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            yield html[text:at], "", "", "comment"
            at = text = size if end < 0 else end + 1
            continue
        name = _NAME.match(html, at + 1, at + 1 + LONGEST_TAG)
        if name is None:
            at += 1
            continue
        rest = _REST.match(html, name.end(), min(size, name.end() + LONGEST_TAG)) if max(last['"'], last["'"]) > at else None
        end = rest.end() if rest else html.find(">", name.end()) + 1
        if not end:
            at += 1
            continue
        tag = name[0].lower()
        kind, tag = ("end", tag[1:]) if tag[0] == "/" else ("start", tag)
        yield html[text:at], tag, html[name.end() : end - 1], kind
        at = text = end
        if kind == "start" and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = text = close.end() if close else size


def parse(html: str | None) -> tuple[list[Block], dict[int, list[int]], dict[int, int]]:
    """Blocks in page order, child containers of every node seen, and what nodes say of themselves.

    A node is the hash of its path of tags and classes.
    """
    blocks: list[Block] = []
    children: dict[int, list[int]] = {}
    said: dict[int, int] = {}
    stack: list[tuple[str, int, bool, int]] = []  # tag, node, goes, in an article
    standing: Counter = Counter()
    text: list[str] = []
    muted: list[str] = []  # tags open since an inline element that goes
    node, goes, article = 0, False, 0

    def flush() -> None:
        if text:
            whole = " ".join(unescape("".join(text)).split())
            text.clear()
            if whole:
                blocks.append(Block(whole, tuple(dict.fromkeys(s[1] for s in stack[:DEEPEST])), article, goes))

    def enter(tag: str) -> None:
        stack.append((tag, node, goes, article))
        standing[tag] += 1

    def leave() -> None:
        nonlocal node, goes, article
        standing[stack.pop()[0]] -= 1
        _, node, goes, article = stack[-1] if stack else ("", 0, False, 0)

    for before, tag, rest, kind in _tags(html or ""):
        if before and not muted:
            text.append(before)
        if not tag:
            continue
        if muted:
            if kind == "start" and tag not in VOID and not rest.endswith("/"):
                if tag not in STARTS or not INLINE.issuperset(muted):
                    muted.append(tag)
                    continue
                muted.clear()
            elif kind == "end" and tag in muted:
                while muted.pop() != tag:
                    pass
                continue
            elif kind == "end" and (standing[tag] or tag == "p"):
                muted.clear()
            else:
                continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                text.append(" " if tag == "br" else "")
            elif kind == "start" and rest and not rest.endswith("/") and _named(tag, _attributes(rest), article > 0) == NAMED:
                # what is inside goes, and does not part the block
                muted.append(tag)
            continue
        flush()
        if stack and stack[-1][0] == "p":
            leave()
        if kind == "end":
            if standing[tag]:
                while stack[-1][0] != tag:
                    leave()
                leave()
            continue
        if tag == "body":
            while stack:
                leave()
        if tag in VOID or tag in RAW or rest.endswith("/") or tag in ("html", "body"):
            continue
        attributes = _attributes(rest) if rest else {}
        if tag == "p":
            if attributes and _named(tag, attributes, article > 0) == NAMED:
                goes = True
                enter(tag)
            continue
        if tag in ENDED and stack and stack[-1][0] == tag:
            leave()
        while tag in ARTICLES and not article and goes and _named(tag, attributes, True) != NAMED:
            leave()
        word = _named(tag, attributes, article > 0)
        if len(stack) < DEEPEST:
            below = xxhash.xxh3_64_intdigest(f"{tag}.{'.'.join(sorted(attributes.get('class', '').lower().split()))}", node & 0xFFFFFFFF)
            children.setdefault(node, []).append(below)
            node = below
            said[node] = max(said.get(node, PLAIN), word)
        goes = goes or tag in HEAD or PRIORS[word] < LEAST
        if not goes:
            article = max(article, ARTICLES.get(tag, 0), ARTICLES.get(attributes.get("role", "").lower(), 0))
        enter(tag)
    flush()
    return blocks, children, said


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _judged(blocks: list[Block]) -> list[Block]:
    """Blocks that may stay, with the containers that may go: those that hold no article."""
    kept = [b for b in blocks if not b.goes]
    holds: dict[int, int] = {}
    for b in kept:
        for n in b.path:
            holds[n] = min(holds.get(n, 2), b.article)
    # containers that a less inner block has, too, stand around the article; the next one is the article itself
    whole = set()
    for b in kept:
        if b.article:
            inner = [n for n in b.path if holds[n] == b.article]
            whole.update(b.path[: len(b.path) - len(inner) + 1])
    return [Block(b.text, tuple(n for n in b.path if n not in whole), b.article, False) for b in kept]


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_host, _content, _page, _features) of some pages' different contents."""
    feature = pa.struct([("node", pa.int64()), ("kind", pa.int64()), ("feature", pa.int64())])
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            seen: dict[tuple[str, int], tuple[int, list[dict[str, int]]]] = {}
            for host, html in zip(part.column("_host").to_pylist(), part.column("html").to_pylist(), strict=True):
                blocks, children, said = parse(html)
                blocks = _judged(blocks)
                longest = max((b.text for b in blocks if b.article), key=lambda t: (len(t), t), default=None)
                page = _signed(xxhash.xxh3_64_intdigest(repr([(b.path, b.text) for b in blocks])))
                content = page if longest is None else _signed(xxhash.xxh3_64_intdigest(longest))
                if (host, content) in seen and seen[host, content][0] <= page:
                    continue
                found = {(b.path[-1], 0, xxhash.xxh3_64_intdigest(b.text)) for b in blocks if b.path}
                judged = {n for b in blocks for n in b.path}
                found |= {(n, 1, xxhash.xxh3_64_intdigest(repr(children.get(n, [])))) for n in judged}
                found |= {(n, 2, said.get(n, PLAIN)) for n in judged}
                seen[host, content] = page, [{"node": _signed(n), "kind": kind, "feature": _signed(f)} for n, kind, f in sorted(found)]
            hosts, contents = zip(*seen) if seen else ((), ())
            pages, features = zip(*seen.values()) if seen else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(pages, pa.int64()), pa.array(list(features), pa.list_(feature))], ["_host", "_content", "_page", "_features"]
            )


def importance(pages: DataFrame) -> DataFrame:
    """(_host, node, contents, importance) of the nodes of the site style trees that can be judged."""
    seen = pages.mapInArrow(_contents, "_host string, _content long, _page long, _features array<struct<node: long, kind: long, feature: long>>")
    # copies that tasks do not see together have one vote, too
    once = seen.groupBy("_host", "_content").agg(F.min(F.struct("_page", "_features")).alias("_one"))
    counted = once.select("_host", F.explode("_one._features").alias("f")).select("_host", "f.*")
    features = counted.groupBy("_host", "node", "kind", "feature").agg(F.count(F.lit(1)).alias("pages"))
    shown, told = F.col("kind") == 1, F.col("kind") == 0
    prior = F.element_at(F.array(*map(F.lit, PRIORS)), F.max(F.when(F.col("kind") == 2, F.col("feature"))).cast("int") + 1)
    nodes = features.groupBy("_host", "node").agg(
        F.sum(F.when(shown, F.col("pages"))).alias("m"),
        F.sum(F.when(shown, F.col("pages") * F.log("pages"))).alias("shown_logs"),
        F.count(F.when(shown, 1)).alias("l"),
        F.count(F.when(told, 1)).alias("texts"),
        F.sum(F.when(told, F.log("pages"))).alias("told_logs"),
        prior.alias("prior"),
    ).where((F.col("m") >= PAGES) & (F.col("texts") > 0))
    # -sum p log p = log m - sum n log n / m, over log m
    presentation = 1 - F.col("shown_logs") / (F.col("m") * F.log("m"))
    content = 1 - F.col("told_logs") / (F.col("texts") * F.log("m"))
    fade = F.pow(F.lit(DAMPING), F.col("l"))
    return nodes.select("_host", "node", F.col("m").alias("contents"), (F.col("prior") * ((1 - fade) * presentation + fade * content)).alias("importance"))


def main_text(html: str | None, removed: set[int]) -> str:
    blocks = [b for b in _judged(parse(html)[0]) if not any(_signed(n) in removed for n in b.path)]
    top = max((b.article for b in blocks), default=0)
    return "\n\n".join(b.text for b in blocks if b.article == top)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    hosted = pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("_host"))
    # nodes are few for a host, whatever its pages: one row per host that has any to remove
    low = importance(hosted).where(F.col("importance") < LEAST).groupBy("_host").agg(F.collect_set("node").alias("_removed"))
    by_host = _tables.stored(low, "style-trees")
    if (by_host.agg(F.sum(F.size("_removed"))).first()[0] or 0) <= BROADCAST_NODES:
        ready = hosted.join(F.broadcast(by_host), "_host", "left")
    else:
        salted = by_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        ready = hosted.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = zip(part.column("html").to_pylist(), part.column("_removed").to_pylist(), strict=True)
                text = [main_text(html, set(removed or ())) for html, removed in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(np.fromiter(map(len, text), np.int64, len(text)))],
                    ["page_id", "url", "text", "n_chars"],
                )

    return ready.mapInArrow(run, "page_id long, url string, text string, n_chars long")
