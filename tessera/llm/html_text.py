r"""Main text of web pages as a maximum-scoring subsequence.

A page is read once, left to right, into tags and blocks of words. Words score positive and tags
negative; the contiguous run with the greatest sum is the content, found by a linear scan. The
weights are learned from pages whose content is labelled, that is from pages with exactly one
``article`` element (or one ``main``): a tag weighs the log of how much more often it stands
outside the content than inside, and the words of a block by what encloses them. Only the bounded
sample of pages that the fit reads is bounded; every whole page is extracted.

The run then grows to the element that holds it, see :func:`_grown`: to the whole article, or to the
innermost element around all of the run, so that lists and tables at its ends are not lost. Within
that, what is no article text by its element or its class is left out: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments. Character references are
decoded, white space inside a block becomes one space, blocks are joined by \n. Table cells and list
items are blocks. A page is read in time linear in its length, however deep or broken its markup.

A class or id names such a part by the whole of one of its words, or by that word's first or last
portion (``site-header``); what follows ``has``, ``no``, ``with`` and the like names a state of the
page. Names are weaker evidence than elements: one around the only article or around most of the
content is that of a layout and drops nothing, see :func:`_lift`.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.batches import bound_batches

# HTML's elements by their part in a page, and usual names of what is no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
NO_TEXT = frozenset("head title nav header footer aside form button select option input dialog menu".split())
NO_TEXT_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice alert popup modal overlay breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe subscription signup login comment comments "
    "disqus discussion replies respond form search widget toolbar pagination pager copyright".split()
)
#: of these, parts that may hold more running text than the article: their size is no sign of a layout
OWN_TEXT_NAMES = frozenset("comment comments disqus discussion replies respond related recommended cookie cookies consent gdpr notice popup modal overlay".split())
STATES = frozenset("has have no non not with without hide show".split())
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CONTENT = ("article", "main")
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: elements that stand directly in the page's body and may be text of an article without an element of its own
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
#: parts of a text that are never all of it
IN_A_TEXT = TEXT_TAGS | INLINE | frozenset("ul ol dl table thead tbody tfoot tr figure".split())
#: an open one of these is closed by the next, unless an element of the second group opens in between
ENDED_BY_NEXT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_SCOPE = frozenset("ul ol dl table select body".split())
_MARKUP = re.compile(r"<(?:!--|!|\?|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTES = re.compile(r"""(?:[^>=]++|=(?!\s*+["'])|=\s*+"[^"]*+"|=\s*+'[^']*+')*+>""")
_ALONE = re.compile(r"""(?:^|[\s"'])/\s*$""")  # not the end of an unquoted value
_MOST_BROKEN = 16  # tags whose quotes never close, after which quotes are no longer looked at
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")

# Before any page is seen: counts (inside, outside) that stand for common knowledge of page building.
PRIOR = {"p": (8, 1), "h1": (2, 1), "h2": (2, 1), "h3": (2, 1), "blockquote": (2, 1), "pre": (2, 1), "a": (1, 6), "li": (1, 4), "ul": (1, 3), "nav": (0.1, 9), "footer": (0.1, 9), "header": (0.2, 6), "aside": (0.1, 9), "form": (0.1, 9), "div": (1, 3), "body": (1, 1)}
LEAST_WORD, LEAST_TAG = 0.1, -0.1


class _Name:
    """An element whose class, id or role says that it is no article text; ``strength`` as in :func:`_named_part`."""

    __slots__ = ("strength", "outer", "lifted", "away", "words")

    def __init__(self, strength: int, outer: _Name | None):
        self.strength, self.outer, self.lifted, self.away, self.words = strength, outer, False, False, 0


class _Open:
    """An open element, with what holds for all that stands in it."""

    __slots__ = ("tag", "feature", "dropped", "inside", "link", "name", "number", "p_at", "near")

    def __init__(self, tag, feature, dropped, inside, link, name, number, p_at, near):
        self.tag, self.feature, self.dropped, self.inside, self.link, self.name, self.number, self.p_at, self.near = tag, feature, dropped, inside, link, name, number, p_at, near


class _Event(NamedTuple):
    """``kind`` is ``tag``, ``text`` or ``break``; ``feature`` is a tag's name with its first class, for a text that of the block around it.

    ``dropped``: no article text by an element around it; ``inside``: in an ``article`` or ``main``;
    ``name``: the innermost element around it that is none by its name; ``node`` and ``depth``: the
    element around it.
    """

    kind: str
    feature: str
    text: str = ""
    dropped: bool = False
    inside: bool = False
    name: _Name | None = None
    link: bool = False
    node: int = -1
    depth: int = 0


class Page:
    """Events of a page in order, its elements as ``(tag, parent, first event, last event)``, and its named parts, outer ones first."""

    def __init__(self, html_text: str):
        self.events: list[_Event] = []
        self.elements: list[list] = []
        self.names: list[_Name] = []
        self._stack: list[_Open] = []
        self._count: Counter[str] = Counter()  # open elements by tag
        self._read(html_text)
        while self._stack:
            self._pop()

    def _pop(self) -> _Open:
        gone = self._stack.pop()
        self._count[gone.tag] -= 1
        self.elements[gone.number][3] = len(self.events)
        return gone

    def _put(self, kind: str, feature: str, text: str = "", within: bool = False) -> None:
        top = self._stack[-1] if self._stack else None
        if top is None:
            self.events.append(_Event(kind, feature, text, inside=within))
        else:
            self.events.append(_Event(kind, feature, text, top.dropped, top.inside or within, top.name, top.link, top.number, len(self._stack)))

    def _read(self, page: str) -> None:
        at, n, last = 0, len(page), page.rfind(">")
        broken = 0
        while at < n:
            m = _MARKUP.search(page, at)
            if m is None or (m.start() > last and not m[0].startswith("<!--")):
                self._text(page[at:])
                return
            start = m.start()
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                end = n if end < 0 else end + 3
            elif m[2] is None:
                end = page.find(">", m.end()) + 1
            else:
                close = _ATTRIBUTES.match(page, m.end()) if broken < _MOST_BROKEN else None
                broken += close is None
                end = close.end() if close else page.find(">", m.end()) + 1
            self._text(page[at:start])
            at = end
            if m[2] is not None:
                at = self._tag(page, m[2].lower(), bool(m[1]), page[m.end() : end - 1], end)

    def _text(self, raw: str) -> None:
        if raw:
            self._put("text", self._stack[-1].feature if self._stack else "", raw)

    def _tag(self, page: str, tag: str, closing: bool, rest: str, at: int) -> int:
        stack = self._stack
        alone = _ALONE.search(rest[-64:]) is not None
        if tag in RAW and not closing:
            if alone:
                return at
            end = _END_OF[tag].search(page, at)
            self._put("tag", tag)
            return end.end() if end else len(page)
        if tag not in INLINE:
            self._put("break", "")
        if closing:
            if self._count[tag]:
                while (gone := self._pop()).tag != tag:
                    pass
                self._put("tag", "/" + (gone.feature if tag not in INLINE else tag))
            return at
        if tag in CLOSES_P and stack and stack[-1].p_at >= 0:
            self._cut(stack[-1].p_at)
        if tag in ENDED_BY_NEXT and stack:
            open_ = [stack[-1].near[t] for t in ENDED_BY_NEXT[tag] if t in stack[-1].near]
            if open_:
                self._cut(max(open_))
        named = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTR.findall(rest)} if rest else {}
        names = named.get("class", "").split()
        feature = f"{tag}.{names[0]}" if names else tag
        top = stack[-1] if stack else _TOP
        name = top.name
        strength = _named_part(tag, named)
        if strength:
            name = _Name(strength, name)
            self.names.append(name)
        if tag in VOID or alone:
            self._put("tag", feature)
            return at
        if tag in ENDS_SCOPE:
            near = {}
        else:
            near = {**top.near, tag: len(stack)} if tag in ENDED_BY_NEXT else top.near
        p_at = len(stack) if tag == "p" else top.p_at if tag in INLINE else -1
        block = feature if tag not in INLINE else top.feature  # of the text inside
        stack.append(_Open(tag, block, top.dropped or _no_text(tag, top.inside), top.inside or tag in CONTENT, top.link or tag == "a", name, len(self.elements), p_at, near))
        self.elements.append([tag, top.number, len(self.events), 0])
        self._count[tag] += 1
        self._put("tag", feature)
        return at

    def _cut(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._pop()
        self._put("break", "")


_TOP = _Open("", "", False, False, False, None, -1, -1, {})
_END_OF = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def _no_text(tag: str, inside: bool) -> bool:
    return tag in NO_TEXT and not (tag == "header" and inside)  # an article's own header holds its heading


def _named_part(tag: str, named: dict[str, str]) -> int:
    """0: no name of a part that is no article text; 1: a name made with one; 2: such a name or role itself; 3: one of OWN_TEXT_NAMES."""
    if not named or tag in ("html", "body", "main", "article", "h1", "h2", "h3"):
        return 0
    found = 2 if named.get("role", "") in NO_TEXT_ROLES else 0
    for word in (w for k in ("class", "id") for w in named.get(k, "").split()):
        parts = [x for x in _PARTS.split(word) if x]
        said = parts[: next((i for i, x in enumerate(parts) if x in STATES), len(parts))]
        roles = NO_TEXT_NAMES.intersection((*said[:1], *said[-1:]))
        if roles:
            found = max(found, 3 if roles & OWN_TEXT_NAMES else 2 if len(parts) == 1 else 1)
    return found


class PageWeights:
    """Weights of tags and of the words inside them."""

    def __init__(self, inside: Counter, outside: Counter):
        self.inside, self.outside = Counter(inside), Counter(outside)
        for k, (a, b) in PRIOR.items():
            self.inside[k] += a
            self.outside[k] += b
        self.word: dict[str, float] = {}
        self.tag: dict[str, float] = {}

    def _odds(self, feature: str) -> float:
        """Log odds of standing inside the content; a class never seen counts as its bare tag."""
        name = feature.removeprefix("/")
        if name not in self.inside and name not in self.outside:
            name = name.partition(".")[0]
        return math.log((self.inside[name] + 0.5) / (self.outside[name] + 0.5))

    def of_word(self, feature: str) -> float:
        if feature not in self.word:
            self.word[feature] = max(LEAST_WORD, min(8.0, self._odds(feature)))
        return self.word[feature]

    def of_tag(self, feature: str) -> float:
        if feature not in self.tag:
            self.tag[feature] = min(LEAST_TAG, self._odds(feature))
        return self.tag[feature]


def extract(page: str | None, weights: PageWeights) -> str:
    """The main text of one page; empty for a null or empty page and for one without words."""
    found = Page(page or "")
    _lift(found, weights)
    text = _content(found, weights)
    if not text and _lift_most(found, weights, 3):
        text = _content(found, weights)
    return text


def _lift(page: Page, weights: PageWeights) -> None:
    """Names that are those of a layout drop nothing from now on.

    They are the names around the only ``article``, or else the only ``main``, unless it stands in a
    part with a text of its own (a reader's comment may be an ``article``), names made with that of
    a part (``sidebar-layout``) around more than half of the content, and names of a part around
    more than nine tenths of it.
    """
    for content in CONTENT:
        opened = [e for e in page.elements if e[0] == content]
        if len(opened) != 1:
            continue
        around, name = [], page.events[opened[0][2]].name
        while name is not None:
            around.append(name)
            name = name.outer
        if all(name.strength < 3 for name in around):
            for name in around:
                name.lifted = True
            break
    _lift_most(page, weights, 1)
    _lift_most(page, weights, 2, 0.9)


def _lift_most(page: Page, weights: PageWeights, strength: int, share: float = 0.5) -> bool:
    """Lifts names up to ``strength`` that hold more than that share of the words of the best run read without such names."""
    if not any(x.strength <= strength and not x.lifted for x in page.names):
        return False
    first, last, _ = _best_run(page, weights, strength)
    for x in page.names:
        x.words = 0
    total = 0
    for e in page.events[first : last + 1]:
        if e.kind == "text" and not e.dropped and not (e.name is not None and e.name.away):
            n = len(e.text.split())
            total += n
            if e.name is not None:
                e.name.words += n
    for x in reversed(page.names):
        if x.outer is not None:
            x.outer.words += x.words
    most = [x for x in page.names if not x.lifted and x.words > share * total]
    for x in most:
        x.lifted = True
    return bool(most)


def _best_run(page: Page, weights: PageWeights, strength: int = 0) -> tuple[int, int, list[tuple[int, list[_Event]]]]:
    """First and last event of the run with the greatest sum, and the page's blocks; names up to ``strength`` drop nothing."""
    for x in page.names:  # outer ones first
        x.away = (x.outer is not None and x.outer.away) or (not x.lifted and x.strength > strength)
    blocks: list[tuple[int, list[_Event]]] = []  # (number of the first event, texts)
    best = total = 0.0
    start = best_start = best_end = 0
    fresh = True
    for i, e in enumerate(page.events):
        if e.kind == "break":
            fresh = True
            continue
        if e.kind == "tag":
            score = weights.of_tag(e.feature)
        elif e.dropped or (e.name is not None and e.name.away):
            continue
        else:
            n = len(e.text.split())
            score = n * weights.of_word(e.feature)
            if fresh or not blocks:
                blocks.append((i, [e]))
                fresh = False
            else:
                blocks[-1][1].append(e)
                if total <= 0 and n:
                    start = blocks[-1][0]
        if total <= 0:
            total, start = 0.0, (blocks[-1][0] if e.kind == "text" else i)
        total += score
        if total > best:
            best, best_start, best_end = total, start, i
    return best_start, best_end, blocks


def _grown(page: Page, first: int, last: int, blocks: list) -> list:
    """The blocks of the run and those that belong to the same element.

    That element is the ``article`` or ``main`` around the run's texts, which is taken whole, or else
    the innermost element around all of them, of which blocks that are mostly links (menus without a
    name) stay out. Where that is the page's body, only blocks of running text come in.
    """
    run = [b for b in blocks if first <= b[0] <= last and any(not e.text.isspace() for e in b[1])]
    if not run:
        return []
    _, node = min((e.depth, e.node) for e in page.events[run[0][0] : run[-1][0] + 1])  # this element stays open all along
    while node >= 0 and page.elements[node][0] in IN_A_TEXT:
        node = page.elements[node][1]
    at, content = node, -1
    while at >= 0:
        if page.elements[at][0] in CONTENT:
            content = at
            break
        at = page.elements[at][1]
    body = content < 0 and (node < 0 or page.elements[node][0] in ("body", "html"))
    begin, end = (0, len(page.events)) if node < 0 else page.elements[content if content >= 0 else node][2:4]

    def belongs(block) -> bool:
        if first <= block[0] <= last:
            return True
        if not begin <= block[0] < end:
            return False
        if content >= 0:
            return True
        words, linked = (sum(len(e.text.split()) for e in block[1] if e.link >= k) for k in (0, 1))
        return 2 * linked < words and (not body or block[1][0].feature.partition(".")[0] in TEXT_TAGS)

    return [b for b in blocks if belongs(b)]


def _content(page: Page, weights: PageWeights) -> str:
    out = []
    for _, texts in _grown(page, *_best_run(page, weights)):
        text = " ".join(html.unescape("".join(e.text for e in texts)).split())
        if text:
            out.append(text)
    return "\n".join(out)


def fit_page_weights(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample_rows: int = 1000) -> PageWeights:
    """Weights from the ``sample_rows`` pages with the least identifier hashes, as far as they are labelled.

    Pages without one ``article`` or ``main`` say nothing; with none at all the prior counts alone
    make the weights.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))
    labelled = rows.where(F.regexp_like("html", F.lit("(?i)<(article|main)[\\s>]")) & F.col("page_id").isNotNull())
    taken = labelled.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_rows).distinct()
    some = labelled.join(F.broadcast(taken), "page_id", "left_semi").select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                opened = len(re.findall(r"(?i)<article[\s>]", page)) or len(re.findall(r"(?i)<main[\s>]", page))
                if opened != 1:
                    continue
                for e in Page(page).events:
                    if e.kind != "break" and e.feature and not e.feature.startswith("/"):
                        (inside if e.inside else outside)[e.feature] += 1
        keys = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], ["feature", "inside", "outside"])

    rows = some.mapInArrow(count, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
    rows = rows.where(F.col("a") + F.col("b") >= 2).collect()  # as many rows as distinct tags in the sample
    return PageWeights(Counter({r.feature: r.a for r in rows}), Counter({r.feature: r.b for r in rows}))


def extract_pages(pages: DataFrame, weights: PageWeights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points of the text).

    A null or empty page, and one without words, has an empty text. Each row is read for itself,
    also one that repeats another's identifier; an empty table gives no rows, and further columns,
    whatever their names, are not read.
    """
    bound_batches(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = T.StructType([source.schema["page_id"], source.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(p, weights) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return source.mapInArrow(run, schema)
