"""Main text of web pages by tag-path ratios.

Method: a page is a sequence of text blocks, each under a root-to-leaf path of
tags. A block's path is that of its container: elements of running text
(paragraphs, headings, list items, table cells, ...) at its end make no path of
their own, and parts of one text (sections, articles, numbered names) count
together. Over all blocks of a path the text length and the punctuation are
added up: article paths hold long, punctuated text, menus and notices do not.
The two ratios (characters and punctuation marks a block) are smoothed over
neighbouring blocks, fused (geometric mean of the two, each relative to the
page's largest) and compared with a threshold; the paths above it are content
nodes, on every page alike. <article> and <main> only weigh more, and elements
whose class or id names an advert, a notice, a menu, ... weigh less: the ratio
decides about both. Headings come along with the content block they stand
before; blocks that are mostly links do not, unless they are sentences. What
HTML itself marks as something else (navigation, headers, footers, asides,
forms, scripts, comments, hidden elements) is never content.

Pages are independent: one pass over each whole page inside a task.

Edge cases: null and empty pages give an empty text; pages cut off in a tag, a
comment or an unclosed element are read as far as they go; an unclosed foreign
element (svg, math, ...) ends at the next block; a page without markup is one
block; rows that repeat a page_id are pages of their own.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                     r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+)(?:>|\Z)"
                     r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAMES = re.compile(r"[^a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section select summary
table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup or never shown.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video noframes xmp select button".split())
#: Without an end tag: those that hide the rest of the page, and those that end at the next block.
TO_THE_END = frozenset("script style textarea title xmp".split())
FOREIGN = frozenset("svg math noscript template iframe noframes".split())
#: Elements that are never content.
OTHER = frozenset("head nav header footer aside form menu dialog fieldset search".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that name something else than the article; the paths
#: below weigh this much if a name is made of such words alone, or of others too.
OTHER_WEIGHT, PARTLY_WEIGHT = 0.05, 0.4
OTHER_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie
cookies copyright disqus donate footer gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices
pager pagination paywall popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor
sponsored subscribe subscription teaser toolbar widget widgets""".split())
_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})\b", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends open elements of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Smoothing weights of a block and its neighbours, and the share of the
#: page's best fused ratio that makes a content path.
SMOOTH = (0.25, 0.5, 0.25)
THRESHOLD = 0.25
#: Elements of running text: they make no path of their own.
RUNNING = HEADINGS | frozenset("""address blockquote caption dd dl dt figcaption figure header hgroup li ol p pre table tbody td tfoot th
thead tr ul""".split())
#: Parts of a text: their names make no path of their own.
PARTS = frozenset("article main section".split())
_NUMBER = re.compile(r"[0-9]+")
#: Weight of the paths under an <article> or <main>.
PRIOR = 2.0
#: More than this share of a block's characters in links: a menu, if it does not end like a sentence.
MOSTLY_LINKS = 0.6
_SENTENCE = re.compile(r"\w\W+\w.*[.!?。！？…]['\"”’»)\]]*$", re.S)


class Node:
    """A place in the tree of a page's paths: equal paths are one node."""

    __slots__ = ("article", "below", "counted", "label", "named", "parent", "parts", "tag")

    def __init__(self, parent: Node | None, tag: str = "", label: str = "", named: float = 1.0):
        self.parent, self.tag, self.label, self.below, self.parts = parent, tag, label, {}, {}
        self.named = min(named, parent.named) if parent else named  # what the names on the path leave of its weight
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        # where blocks count: parts of one text together, and running text in what holds it
        if parent is None:
            self.counted: Node | None = None
        elif tag in RUNNING:
            self.counted = parent.container()
        else:
            self.counted = None

    def child(self, tag: str, label: str, named: float) -> Node:
        found = self.below.get((label, named))
        if found is None:
            found = self.below[label, named] = Node(self, tag, label, named)
        return found

    def container(self) -> Node:
        """The node that this node's blocks count under."""
        if self.counted is None:
            self.counted = self.shape()
        return self.counted

    def shape(self) -> Node:
        """One node for all paths of the same parts."""
        if self.parent is None:
            return self
        at = self
        up: list[Node] = []
        while at.parent is not None and "shape" not in at.parts:
            up.append(at)
            at = at.parent
        got = at.parts.get("shape", at)
        for node in reversed(up):
            key = _part(node.label), node.named
            same = got.parts.get(key)
            if same is None:
                same = got.parts[key] = node
            node.parts["shape"] = got = same
        return got

    def path(self) -> tuple[str, ...]:
        out, at = [], self
        while at.parent is not None:
            out.append(at.label)
            at = at.parent
        return tuple(reversed(out))


class Block:
    __slots__ = ("links", "node", "other", "text")

    def __init__(self, node: Node, text: str, links: float, other: bool):
        self.node, self.text, self.links, self.other = node, text, links, other

    @property
    def path(self) -> tuple[str, ...]:
        return self.node.path()


def _attributes(raw: str) -> tuple[list[str], float, bool]:
    """(names of class and id, what they leave of the element's weight,
    whether it is marked off or hidden)."""
    names, named, other = [], 1.0, False
    for m in _ATTRIBUTE.finditer(raw):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind in ("class", "id"):
            words = [w for w in _NAMES.split(value) if w]
            names += words
            for token in value.split():
                some = [w for w in _NAMES.split(token) if w]
                if some and OTHER_NAMES.issuperset(some):
                    named = OTHER_WEIGHT
                elif not OTHER_NAMES.isdisjoint(some):
                    named = min(named, PARTLY_WEIGHT)
        elif kind == "role":
            other = other or value in OTHER_ROLES
        elif kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and "display:none" in value.replace(" ", ""):
            other = True
    return names, named, other


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    top = Node(None)
    stack: list[tuple[str, Node, bool]] = []  # (tag, node, other)
    opened: Counter = Counter()
    parts: list[str] = []
    linked: list[str] = []
    in_link = False

    def flush():
        nonlocal in_link
        text = " ".join("".join(parts).split())
        if text:
            link = len(" ".join("".join(linked).split()))
            out.append(Block(stack[-1][1] if stack else top, text, link / len(text), bool(stack) and stack[-1][2]))
        parts.clear()
        linked.clear()
        in_link = False

    def add(raw: str):
        t = html.unescape(raw) if "&" in raw else raw
        parts.append(t)
        if in_link:
            linked.append(t)

    def pop_to(k: int):
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        close, tag, raw = m[1] or m[4], tag.lower(), m[3] or m[6] or ""
        if close:
            if tag == "a":
                in_link = False
            elif tag in BLOCK and opened[tag] > 0:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
            continue
        if tag in ("br", "hr"):
            add(" ")
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at) if not raw.endswith("/") else None
            if end:
                at = end.end()
            elif tag in TO_THE_END:
                at = n
            elif not raw.endswith("/") and tag in FOREIGN:
                after = _NEXT_BLOCK.search(page, at)
                at = after.start() if after else n
            continue
        if tag == "a":
            in_link = True
            continue
        if tag not in BLOCK or tag in VOID:
            continue
        flush()
        ends = ENDS.get(tag, ())
        for k in range(len(stack) - 1, -1, -1):
            open_tag = stack[k][0]
            if open_tag == "p" or open_tag in ends or (tag in HEADINGS and open_tag in HEADINGS):
                pop_to(k)
            elif open_tag in ("table", "ul", "ol", "dl") or not (ends and open_tag in ("div", "section")):
                break
        names, named, other = _attributes(raw) if raw else ([], 1.0, False)
        inside, node = (stack[-1][2], stack[-1][1]) if stack else (False, top)
        if tag in ("html", "body", "article", "main"):
            named, other = 1.0, False
        elif tag in OTHER and not (tag == "header" and node.article):
            other = True
        stack.append((tag, node.child(tag, ".".join([tag, *sorted(set(names))]) if names else tag, named), inside or other))
        opened[tag] += 1
    flush()
    return out


def _part(label: str) -> str:
    """The label without what tells the parts of one text apart."""
    tag, *names = label.split(".")
    return ".".join([tag, *sorted({_NUMBER.sub("", n) for n in names} - {""})]) if names and tag not in PARTS else tag


def containers(found: list[Block]) -> list[Node]:
    """The node that each block counts under."""
    return [b.node.container() for b in found]


def path_ratios(found: list[Block]) -> list[float]:
    """Fused ratio of each block's path, relative to the page's best (0 to 1)."""
    size = [float(len(b.text)) for b in found]
    marks = [float(len(_PUNCTUATION.findall(b.text))) for b in found]
    paths = containers(found)

    def smooth(x: list[float]) -> list[float]:
        before, here, after = SMOOTH
        return [(x[i - 1] if i else x[i]) * before + x[i] * here + (x[i + 1] if i + 1 < len(x) else x[i]) * after for i in range(len(x))]

    total: dict[Node, list[float]] = {}
    for b, path, s, p in zip(found, paths, smooth(size), smooth(marks), strict=True):
        t = total.setdefault(path, [0.0, 0.0, 0.0, 0.0])
        t[0] += s
        t[1] += p
        t[2] += 1
        t[3] += len(b.text) * (1 - b.links)
    # characters and marks a block; the square root of the plain text keeps one long notice from beating an article
    weight = {k: sqrt(t[3]) / t[2] * (PRIOR if k.article else 1.0) * k.named for k, t in total.items()}
    text = {k: t[0] * weight[k] for k, t in total.items()}
    mark = {k: t[1] * weight[k] for k, t in total.items()}
    most_text, most_mark = max(text.values(), default=0) or 1.0, max(mark.values(), default=0)
    if most_mark:
        fused = {k: sqrt(text[k] / most_text * max(mark[k] / most_mark, 1e-3)) for k in total}
    else:  # a page without punctuation: the text alone speaks
        fused = {k: text[k] / most_text for k in total}
    best = max(fused.values(), default=0) or 1.0
    return [fused[k] / best for k in paths]


def content(found: list[Block]) -> list[Block]:
    """The content blocks of a page in order."""
    plain = [b for b in found if not b.other]
    ratios = path_ratios(plain)
    out: list[Block] = []
    heads = False  # the next block in order that is no heading is content
    for b, ratio in zip(reversed(plain), reversed(ratios), strict=True):
        heading = b.node.tag in HEADINGS
        linked = b.links > MOSTLY_LINKS and not _SENTENCE.search(b.text)
        kept = not linked and (ratio >= THRESHOLD or heading and heads)
        if kept:
            out.append(b)
        if not heading:
            heads = kept
    return out[::-1]


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in content(blocks(page))) if page else ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                text = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    return (pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
            .mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long"))


def page_blocks(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """Every block with its path, fused ratio and verdict: page_id, block,
    path, text, ratio (null for marked-off elements), kept."""

    def run(batches):
        for b in batches:
            rows = []
            for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = blocks(h or "")
                ratios = iter(path_ratios([x for x in found if not x.other]))
                kept = {id(x) for x in content(found)}
                rows += [(i, k, "/".join(x.path), x.text, None if x.other else next(ratios), id(x) in kept) for k, x in enumerate(found)]
            if rows:
                i, k, p, t, r, v = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, b.column(0).type), pa.array(k, pa.int32()), pa.array(p), pa.array(t), pa.array(r, pa.float64()), pa.array(v)],
                                                 names=["page_id", "block", "path", "text", "ratio", "kept"])

    kind = pages.schema[key].dataType.simpleString()
    return (pages.select(F.col(key).alias("page_id"), F.col(page).alias("html"))
            .mapInArrow(run, f"page_id {kind}, block int, path string, text string, ratio double, kept boolean"))
