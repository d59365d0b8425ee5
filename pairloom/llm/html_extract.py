"""HTML extraction by wrapper inference.

The pages of a host come from few templates.  Their token streams are aligned
into a wrapper, a regular expression without unions: adjacent groups of equal
shape fold into a repeated group, what only some pages have becomes optional, and
text that differs becomes a slot.  A wrapper grows with the shapes of a host's
pages, not with their number or length.

Every page takes part.  Each task folds the pages it reads into one wrapper per
host; those are aligned in as many levels as there are powers of ``BLOCK`` tasks, so
that a host with a third of all pages is many small tasks.

The wrapper then says where the article is.  From its root it goes down to the one
part of the page that holds most of the running text, as long as there is such a
part: text that differs between pages and is not mostly links; names of articles
count double, so they break ties.  That container's slots are the article.  Inside
and outside of it, text that three or more pages of a host have in common is
template, unless there is more of it than of text that differs.  A page that lacks
the container falls back on elements named as articles, and then on its running
text.  Menus, headers, footers, sidebars, notices, adverts, forms, comments of
readers, scripts and styles are left out wherever they stand.  Then each page is
read again along its host's wrapper.

The slots of a host are joined to its pages; Spark broadcasts that table where its
size on disk allows it, and otherwise joins by host, hot hosts split.

Defined results: NULL and empty pages give an empty text.  A NULL URL, or one
without a host, belongs to the host with the empty name.  Unclosed tags end with
what holds them, stray end tags are ignored, an unclosed script or comment takes
the rest of the page.  Elements nested more than ``MAX_DEPTH`` deep are breaks in the
last one above them; no text is lost.  Pages of any length are read whole, in time
that grows with their length.  Repeated rows are extracted alike; other columns
stay, whatever their names.
"""

from __future__ import annotations

import html
import json
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import filled, materialize
from pairloom.llm.url_filter import host_of

# Tags and names by their part in a page.
SKIPPED = "script style noscript template svg iframe textarea select object canvas annotation annotation-xml".split()
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr math mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts"
    " mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset("br hr".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav"
    " ol p pre section table ul".split()
)
SIBLINGS = {t: frozenset(g.split()) for g in ("li", "dt dd", "tr", "td th", "option", "thead tbody tfoot") for t in g.split()}
DROPPED_TAGS = frozenset("head title nav footer aside form button dialog menu fieldset".split())
DROPPED_NAMES = frozenset(
    "ad ads advert alert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " complementary contentinfo disclaimer disqus footer gdpr hidden login menu modal nav navbar navigation newsletter"
    " notice notification pager pagination popup promo promoted promotion reactions recommended related replies reply"
    " search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
# What may stand around dropped names in a compound: "main-nav", "sidebar-left"; not "has-sidebar", "overflow-hidden".
BEFORE = "article bottom entry footer global header left main mobile page post primary right secondary site sticky top".split()
BEHIND = (
    "area article articles bar block body bottom box button buttons container content form header inner item items label left"
    " link links list message overlay panel post posts right row section slot stories thread title top unit wrap wrapper"
).split()
_NAMES = "|".join(sorted(DROPPED_NAMES - {"hidden"}))
COMPOUND = re.compile(rf"(?:(?:{'|'.join(BEFORE)})-)*(?:{_NAMES})(?:-(?:{_NAMES}))*(?:-(?:{'|'.join(BEHIND)}|\d+(?:x\d+)?))*")
# Elements of these names hold articles of their own beside that of the page: comments, teasers, adverts.
COMPANIONS = frozenset(
    "ad ads advert advertisement advertising comment comments disqus promo promoted promotion reactions recommended related"
    " replies reply sponsor sponsored".split()
)
CONTAINER_NAMES = frozenset("article articlebody content main post entry story maincontent bodytext".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(SKIPPED)})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMING = ("class", "id", "role", "itemprop")

OPEN, CLOSE, TEXT, BREAK, LEFT_OUT = range(5)
# A wrapper node: name, pages seen in, optional, repeated, slot (None while constant), its text's checksum, characters, characters in links, children.
NAME, SEEN, OPTIONAL, REPEATED, VARIES, SUM, CHARS, LINKED, KIDS = range(9)
NAMED = ("article", "main", "content")
KINDS = ("container", *NAMED, "text")
MAX_DEPTH = 100
# Elements that hold text, not parts of a page.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table caption address".split())
TITLES = frozenset("h1 h2".split())
BOXES = frozenset("div section td center".split())
HOLDS = "+"
# Pages that must have the same text for it to be template, and aligned pairs that are compared one by one.
TEMPLATE_PAGES = 3
ALIGNED_PAIRS = 1 << 18
BLOCK = 64


def attributes_of(attributes: str) -> dict[str, str]:
    """The attributes by name, in lower case; of equal names the first counts."""
    out: dict[str, str] = {}
    if attributes and ("=" in attributes or "hidden" in attributes.lower()):
        for name, *values in ATTRIBUTE.findall(attributes):
            out.setdefault(name.lower(), "".join(values).lower())
    return out


@lru_cache(maxsize=20_000)
def dropped_names(attributes: str) -> frozenset[str]:
    """Words for which an element is left out: whole classes or ids, listed compounds, and ``hidden``."""
    values = attributes_of(attributes)
    found = {"hidden"} if "hidden" in values or values.get("aria-hidden", "").strip() == "true" else set()
    for key in NAMING:
        for name in values.get(key, "").split():
            name = re.sub(r"[_\-]+", "-", name).strip("-")
            if name in DROPPED_NAMES:
                found.add(name)
            elif COMPOUND.fullmatch(name):
                found.update(DROPPED_NAMES.intersection(name.split("-")))
    return frozenset(found)


@lru_cache(maxsize=20_000)
def role_of(tag: str, attributes: str) -> tuple[str, bool, str]:
    """Name of an element in wrappers, whether it is left out, and what kind of container it is."""
    values = attributes_of(attributes)
    named = [values[key] for key in values if key in NAMING and values[key]]
    words = {w for value in named for w in re.split(r"[\s_\-]+", value)}
    # An id is a name of its own on each page, unless it is a word that says something.
    telling = [v for key in values if key in NAMING and (v := values[key].strip()) and (key != "id" or v in CONTAINER_NAMES or v in DROPPED_NAMES)]
    label = "".join("." + re.sub(r"\d+", "#", value) for value in telling)
    names = dropped_names(attributes)
    dropped = tag in DROPPED_TAGS or bool(names)
    if tag in ("article", "main"):
        dropped = not names.isdisjoint(("comment", "comments", "hidden"))
    elif tag in ("body", "html"):
        dropped = False
    kind = tag if tag in ("article", "main") else "content" if words & CONTAINER_NAMES else ""
    return tag + label, dropped, kind


def events(page: str) -> Iterator[tuple[int, str, bool]]:
    """The token stream: opened and closed elements, text with whether it is in a link, and breaks."""
    stack: list[str] = []
    beyond: dict[str, int] = {}  # open elements deeper than the limit; what they hold counts to the last one above it
    links = at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield TEXT, page[at : m.start()], links > 0
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[2], m[4]) if m[3] else (m[5], m[7])
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif beyond.get(tag):
                beyond[tag] -= 1
                yield BREAK, tag, False
            elif tag in stack:
                while (last := stack.pop()) != tag:
                    yield CLOSE, last, False
                yield CLOSE, tag, False
            elif tag == "p":
                yield BREAK, tag, False
            continue
        if tag == "a":
            links += 1
        if tag in VOID:
            if tag in BREAKS:
                yield BREAK, tag, False
            continue
        if tag in INLINE and not role_of(tag, attributes)[1]:
            continue
        if stack and (stack[-1] == "p" and tag in CLOSES_P or stack[-1] in SIBLINGS.get(tag, ())):
            yield CLOSE, stack.pop(), False
        if attributes.endswith("/") and tag not in CLOSES_P:
            continue
        if len(stack) >= MAX_DEPTH:
            beyond[tag] = beyond.get(tag, 0) + 1
            yield BREAK, tag, False
            continue
        stack.append(tag)
        yield OPEN, f"{tag} {attributes}" if attributes else tag, False
    if at < len(page):
        yield TEXT, page[at:], links > 0
    while stack:
        yield CLOSE, stack.pop(), False


def enclosing(stream: list[tuple[int, str, bool]]) -> set[int]:
    """Places in the token stream of elements that would be left out, but hold the article container.

    That is a ``main`` element, an article body, or every ``article`` of the page; the
    latter not where elements hold other articles by their nature.
    """
    kept: set[int] = set()
    open_: list[tuple[str, int, bool]] = []  # tag, place if left out, or -1, and whether it holds articles beside the page's
    common: list[int] | None = None
    for place, (what, value, _) in enumerate(stream):
        if what == CLOSE:
            open_.pop()
        if what != OPEN:
            continue
        tag, _, attributes = value.partition(" ")
        dropped = role_of(tag, attributes)[1]
        around = [] if dropped else [o for o in open_ if o[1] >= 0]
        values = attributes_of(attributes) if around else {}
        if around and (tag == "main" or values.get("role") == "main" or "articlebody" in values.get("itemprop", "").split()):
            kept.update(at for _, at, _ in around)
        elif tag == "article" and not dropped and all(o[0] != "article" for o in open_):
            places = [] if any(beside for *_, beside in around) else [at for _, at, _ in around]
            common = places if common is None else [at for at in common if at in places]
        beside = dropped and (tag in DROPPED_TAGS - {"form", "fieldset"} or not dropped_names(attributes).isdisjoint(COMPANIONS))
        open_.append((tag, place if dropped else -1, beside))
    return kept.union(common or ())


def visible(page: str) -> Iterator[tuple[int, str, bool]]:
    """The token stream without what left-out elements hold; of those themselves, ``LEFT_OUT``."""
    stream = list(events(page))
    kept, hidden = None, 0
    for place, (what, value, in_link) in enumerate(stream):
        if hidden:
            hidden += (what == OPEN) - (what == CLOSE)
            continue
        if what == OPEN:
            tag, _, attributes = value.partition(" ")
            if role_of(tag, attributes)[1]:
                kept = enclosing(stream) if kept is None else kept
                if place not in kept:
                    hidden = 1
                    yield LEFT_OUT, value, in_link
                    continue
        yield what, value, in_link


def named(page: str) -> list[tuple[int, str, bool]]:
    """The visible token stream with the names of elements in wrappers.

    A box that holds elements has another name than one that holds text alone: they are not of one shape.
    """
    stream = list(visible(page))
    filled_boxes: set[int] = set()
    open_: list[int] = []
    for place, (what, _, _) in enumerate(stream):
        if what == OPEN:
            if open_:
                filled_boxes.add(open_[-1])
            open_.append(place)
        elif what == CLOSE:
            open_.pop()
    out = []
    for place, (what, value, in_link) in enumerate(stream):
        if what in (OPEN, LEFT_OUT):
            tag, _, attributes = value.partition(" ")
            value = role_of(tag, attributes)[0] + (HOLDS if tag in BOXES and place in filled_boxes else "")
        out.append((what, value, in_link))
    return out


def shape(page: str) -> list:
    """The page as a wrapper of its own, parts that are left out without what they hold."""
    root = ["", 1, 0, 0, 0, 0, 0, 0, []]
    stack = [root]
    for what, value, in_link in named(page):
        if what in (OPEN, LEFT_OUT):
            node = [value, 1, 0, 0, 0, 0, 0, 0, []]
            stack[-1][KIDS].append(node)
            if what == OPEN:
                stack.append(node)
        elif what == CLOSE:
            node = stack.pop()
            node[KIDS] = fold(node[KIDS])
        elif what == TEXT and (size := len(value.strip())):
            node = stack[-1]
            node[SUM] = crc32(value.strip().encode("utf-8", "replace"), node[SUM])
            node[CHARS] += size
            node[LINKED] += size if in_link else 0
    root[KIDS] = fold(root[KIDS])
    return root


def fold(nodes: list) -> list:
    """Adjacent groups of one to three elements of equal names become one repeated group."""
    out: list = []
    for node in nodes:
        out.append(node)
        for width in (1, 2, 3):
            if len(out) >= 2 * width and [n[NAME] for n in out[-width:]] == [n[NAME] for n in out[-2 * width : -width]]:
                again = out[-width:]
                del out[-width:]
                for mine, other in zip(out[-width:], again):
                    merge(mine, other, same_page=True)
                    mine[REPEATED] = 1
                break
    return out


def merge(mine: list, other: list, same_page: bool = False) -> None:
    """Align ``other`` into ``mine``: unequal text is a slot, unmatched elements are optional."""
    mine[VARIES] |= other[VARIES] | (mine[SUM] != other[SUM])
    mine[SEEN] = max(mine[SEEN], other[SEEN]) if same_page else mine[SEEN] + other[SEEN]
    mine[CHARS] += other[CHARS]
    mine[LINKED] += other[LINKED]
    mine[OPTIONAL] |= other[OPTIONAL]
    mine[REPEATED] |= other[REPEATED]
    a, b = mine[KIDS], other[KIDS]
    if [n[NAME] for n in a] == [n[NAME] for n in b]:
        for x, y in zip(a, b):
            merge(x, y, same_page)
        return
    out: list = []
    for x, y in align(a, b):
        if x is not None and y is not None:
            merge(x, y, same_page)
        else:
            (x or y)[OPTIONAL] = 1
        out.append(x or y)
    mine[KIDS] = fold(out)


def align(a: list, b: list) -> list[tuple]:
    """Two sequences of elements matched by name, in order, with the rest between.

    Equal starts and ends are matched first, then the names that occur once in
    either; what lies between two of those is matched by its longest common
    subsequence, or in one pass where it is too long for that.
    """
    x, y = [n[NAME] for n in a], [n[NAME] for n in b]
    first, last = 0, 0
    short = min(len(a), len(b))
    while first < short and x[first] == y[first]:
        first += 1
    while last < short - first and x[-1 - last] == y[-1 - last]:
        last += 1
    out, i, j = list(zip(a[:first], b[:first])), first, first
    ends = len(a) - last, len(b) - last
    for p, q in [*_anchors(x, y, first, *ends), ends]:
        out += _gap(a[i:p], b[j:q])
        if (p, q) != ends:
            out.append((a[p], b[q]))
        i, j = p + 1, q + 1
    return out + list(zip(a[ends[0] :], b[ends[1] :]))


def _anchors(x: list[str], y: list[str], first: int, end_x: int, end_y: int) -> list[tuple[int, int]]:
    """Places of names that occur once in either sequence, as many as can be had in order."""
    if (end_x - first) * (end_y - first) <= ALIGNED_PAIRS:
        return []
    once_x, once_y = (
        {name: at for at, name in enumerate(seq[first:end], first) if counts[name] == 1}
        for seq, end in ((x, end_x), (y, end_y))
        for counts in [Counter(seq[first:end])]
    )
    pairs = sorted((at, once_y[name]) for name, at in once_x.items() if name in once_y)
    tails: list[int] = []  # place in ``pairs`` of the smallest end of an ascending run of each length
    values: list[int] = []
    back: list[int] = []
    for n, (_, q) in enumerate(pairs):
        k = bisect_left(values, q)
        back.append(tails[k - 1] if k else -1)
        tails[k : k + 1], values[k : k + 1] = [n], [q]
    out, n = [], tails[-1] if tails else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _gap(a: list, b: list) -> list[tuple]:
    if not a or not b:
        return [(x, None) for x in a] + [(None, y) for y in b]
    if len(a) * len(b) > ALIGNED_PAIRS:
        return _one_pass(a, b)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][NAME] == b[j][NAME] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i][NAME] == b[j][NAME]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out + [(x, None) for x in a[i:]] + [(None, y) for y in b[j:]]


def _one_pass(a: list, b: list) -> list[tuple]:
    """Each element of ``a`` with the next one of its name in ``b``."""
    places: dict[str, list[int]] = {}
    for at, node in enumerate(b):
        places.setdefault(node[NAME], []).append(at)
    out, j = [], 0
    for node in a:
        own = places.get(node[NAME], [])
        k = bisect_left(own, j)
        # A match far ahead would leave what lies between it unmatched.
        if k < len(own) and own[k] - j <= 1000:
            out += [(None, y) for y in b[j : own[k]]]
            out.append((node, b[own[k]]))
            j = own[k] + 1
        else:
            out.append((node, None))
    return out + [(None, y) for y in b[j:]]


class Part:
    """A wrapper node on its path, with what counts of the text below it."""

    def __init__(self, node: list, path: str, kind: str, in_header: bool):
        self.node, self.path = node, path
        name = node[NAME].removesuffix(HOLDS)
        self.tag = name.partition(".")[0]
        own = role_of(self.tag, f'class="{name.partition(".")[2].replace(".", " ")}"')[2] if name else ""
        self.named = bool(own)
        self.kind = own if own and (not kind or NAMED.index(own) < NAMED.index(kind)) else kind
        self.in_header = in_header or (self.tag == "header" and self.kind not in ("article", "main"))
        self.kids = [Part(k, f"{path}/{k[NAME]}", self.kind, self.in_header) for k in node[KIDS]]
        self.links = node[LINKED] * 2 > node[CHARS]
        self.constant = node[SEEN] >= TEMPLATE_PAGES and not node[VARIES]

    def running(self, template: bool) -> int:
        """Characters of running text of the element itself."""
        return 0 if self.in_header or self.links or (template and self.constant) else self.node[CHARS]

    def weigh(self, template: bool) -> int:
        self.weight = self.running(template) + sum(k.weigh(template) for k in self.kids)
        self.titled = (self.tag in TITLES and self.weight > 0) or any(k.titled for k in self.kids)
        return self.weight

    def every(self) -> Iterator[Part]:
        yield self
        for k in self.kids:
            yield from k.every()


def container(root: Part, template: bool) -> Part:
    """The one part of the page that holds most of the running text, as far down as there is one."""
    at = root
    while at.kids and at.kind not in ("article", "main") and not at.running(template):
        best = max(at.kids, key=lambda k: k.weight * (2 if k.named else 1))
        rest = [k for k in at.kids if k is not best and k.weight]
        direct = any(k.tag in TEXT_BLOCKS or k.titled for k in rest)
        most = best.weight * (4 if best.named else 2) > at.weight
        if best.tag in TEXT_BLOCKS or best.node[REPEATED] or not most or (direct and not best.named):
            break
        at = best
    return at


def slots(wrapper: list) -> dict[str, str]:
    """The article's slots: path of each, and what makes it one."""
    root = Part(wrapper, "", "", False)
    texts = [p for p in root.every() if p.running(False)]
    constant = sum(p.node[CHARS] for p in texts if p.constant)
    template = sum(p.node[CHARS] for p in texts if not p.constant) > constant
    root.weigh(template)
    chosen = container(root, template)
    bare = chosen.tag in ("", "html", "body")
    found: dict[str, str] = {}
    inside = {id(p) for p in chosen.every()}
    for p in root.every():
        if not p.node[CHARS] or p.in_header or (template and p.constant):
            continue
        if id(p) in inside and not bare:
            found[p.path] = "container"
        elif p.kind:
            found[p.path] = p.kind
        elif not p.links:
            found[p.path] = "text"
    return found


def extract(page: str, article: dict[str, str]) -> str:
    """Text of the slots of the best kind of container that the page has."""
    parts: dict[str, list[str]] = {}
    stack = [""]
    for what, value, _ in named(page):
        if what == TEXT:
            if kind := article.get(stack[-1]):
                parts.setdefault(kind, []).append(html.unescape(value))
            continue
        if what == OPEN:
            stack.append(f"{stack[-1]}/{value}")
        elif what == CLOSE:
            stack.pop()
        for texts in parts.values():
            texts.append("\n")
    for kind in KINDS:
        if kind in parts and (text := " ".join("".join(parts[kind]).split())):
            return text
    return ""


# --- over the whole table ---------------------------------------------------------------------------------------------

MAX_HOSTS = 20_000  # wrappers a task holds before it hands them on


def _merged(rows: pd.DataFrame) -> str:
    first, *rest = map(json.loads, rows["wrapper"])
    for other in rest:
        merge(first, other)
    return json.dumps(first)


def infer_wrappers(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """``host, wrapper``: the wrapper of each host as JSON, from all its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def hand_on(known: dict[str, list]) -> pa.RecordBatch:
            values = [json.dumps(w) for w in known.values()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(known), pa.string()), pa.array([part // BLOCK] * len(known), pa.int64()), pa.array(values, pa.string())],
                names=["host", "block", "wrapper"],
            )

        known: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = shape(page)
                if host in known:
                    merge(known[host], own)
                else:
                    known[host] = own
            if len(known) >= MAX_HOSTS:
                yield hand_on(known)
                known = {}
        yield hand_on(known)

    def join_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "block": [key[1] // BLOCK], "wrapper": [_merged(rows.sort_values("wrapper"))]})

    parts = pages.select(host_col, html_col).mapInArrow(run, "host string, block long, wrapper string")
    blocks = math.ceil(pages.rdd.getNumPartitions() / BLOCK)
    while blocks > 1:
        parts = parts.groupBy("host", "block").applyInPandas(join_block, "host string, block long, wrapper string")
        blocks = math.ceil(blocks / BLOCK)
    parts = parts.groupBy("host", "block").applyInPandas(join_block, "host string, block long, wrapper string")
    return parts.groupBy("host").applyInPandas(lambda key, rows: join_block((key[0], 0), rows)[["host", "wrapper"]], "host string, wrapper string")


@lru_cache(maxsize=4096)
def _slots(wrapper: str) -> dict[str, str]:
    return json.loads(wrapper)


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", into: str = "text") -> DataFrame:
    """The pages without their HTML, with the main text."""
    passed = [c for c in pages.columns if c not in (html_col, into)]
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in passed]).alias("d"), host_of(filled(pages[url_col])).alias("host"), filled(pages[html_col]).alias("html")
    )

    @F.pandas_udf("string")
    def slots_of(wrappers: pd.Series) -> pd.Series:
        return wrappers.map(lambda w: json.dumps(slots(json.loads(w))))

    article = materialize(infer_wrappers(rows).select(F.col("host").alias("of"), slots_of("wrapper").alias("slots")), "wrappers")

    @F.pandas_udf("string")
    def read(htmls: pd.Series, wrappers: pd.Series) -> pd.Series:
        return pd.Series([extract(h, _slots(w)) for h, w in zip(htmls, wrappers)], dtype=object)

    met = rows.join(article, rows["host"] == article["of"])
    return met.select("d", read("html", "slots").alias("main")).select("d.*", F.col("main").alias(into))


# --- the query --------------------------------------------------------------------------------------------------------


def digest(pages: DataFrame) -> DataFrame:
    return main_text(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )
