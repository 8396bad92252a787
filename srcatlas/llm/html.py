"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page becomes a sequence of words and tags. Words score positive and tags
negative; class and id names of the elements around words raise or lower their
score. One linear scan finds the contiguous region with the highest total, and
the blocks of text within it whose own words score positive are the main text.
Elements whose tag or role says that they never hold an article (nav, aside,
footer, form, hidden ones, ...) have no words at all.

Weights are learned from labelled pages: pages whose <article> or <main> element
marks the content, at most about SAMPLE of them. A kind of word or tag weighs the
log ratio of its rates inside and outside, shrunk to the prior of its kind and
held within its sign's limits; so does each part of a name. A name weighs the mean
of its parts (so that "layout-sidebar-right" says less than "sidebar"), an element
the sum of its names. Names lower no words of an element that holds a headline
(h1), an article or a main element: that is a wrapper, whatever it is called.
Every page is read whole.

null or empty html: an empty text. A page without words: an empty text. Ties
go to the earlier, longer region. Rows repeat as they come; null ids and urls stay.
Pages of any length, depth and attribute length take linear time. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, prepared, typed

#: Most labelled pages, on average, that weights are learned from; how many counts the prior is worth.
SAMPLE, TRUST = 2000, 500.0
#: Limits and priors of weights.
WORD, LINKED, TAG = (1.0, 3.0, 1.5), (-2.0, -0.5, -1.0), (-0.6, -0.05, -0.1)
OUTSIDE_MAIN, APART = -3.0, -0.1
#: Limits and priors of parts of names that speak for content, against it, and of all others; limits of all names together.
CONTENT, NOISE, OTHER, NAMES = (0.5, 3.0, 1.5), (-4.0, -2.0, -3.0), (-1.5, 1.0, 0.0), (-5.0, 1.5)
#: Least words for which a part of a name that no prior knows gets a weight.
SUPPORT = 200

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video audio canvas".split()
)
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg canvas audio video head select datalist".split())
_NEVER = frozenset("nav aside footer form dialog menu button search fieldset label annotation annotation-xml".split())
_INLINE = frozenset("a b i em strong span img u code input sup sub small".split())
_ENDS_P = _BLOCK - {"br", "button", "iframe", "noscript", "object", "select", "textarea", "video", "audio", "canvas", "option", "template"}
_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
#: Parts of class names and ids with a prior of their own.
_FOR = frozenset("article content body post entry story main text".split())
_AGAINST = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social comment comments commentlist reply replies disqus discussion respond sidebar sidebars widget widgets related recommended recommendations menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar pagination pager login paywall teaser byline header topbar".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_SKIP_BEFORE = frozenset("has with no without is".split())
# a quoted value (after =) ends at its closing quote, however far; a quote that nothing closes, or elsewhere, is stray
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)(?:>|\Z)|[^<]+|<", re.S)
_RAW_END = {t: re.compile(f"</{t}(?![^\\s/>])", re.I | re.A) for t in _RAW}
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def name_parts(attrs: list[tuple[str, str]]) -> list[tuple[str, ...]]:
    """The names of an element's class and id, each as its parts; names such as has-x and no-x say nothing of the element."""
    out = []
    for name, value in attrs:
        if name in ("class", "id"):
            for word in value.split():
                parts = tuple(p.lower() for p in _CAMEL.split(word) if p)
                if parts and parts[0] not in _SKIP_BEFORE:
                    out.append(parts)
    return out


def never(tag: str, attrs: list[tuple[str, str]], in_main: bool) -> bool:
    """Whether an element's tag, role or style says that it never holds a part of the article."""
    if tag in ("html", "body", "article", "main"):
        return False
    if tag in _NEVER or (tag == "header" and not in_main):
        return True
    for name, value in attrs:
        if (name == "role" and value.lower() in _ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
    return False


class Page:
    """events, the texts of blocks, named elements, and whether the page marks its content.

    An event is (kind, number of words, block, named element): kind "t:name" for a tag, "w:tag" and "l:tag" for words
    without and within a link in a block of that tag, with "+" before it inside the marked content, "-" outside. A named
    element is [number of the named element around it or -1, its names, whether it holds a headline or the content]."""

    def __init__(self, page: str):
        self.events: list[tuple[str, int, int, int]] = []
        self.blocks: list[str] = []
        self.named: list[list] = []
        self.marked = False
        self._read(page)

    def _read(self, page: str) -> None:
        events, blocks = self.events, self.blocks
        # open elements: (tag, never, and what held before it: block tag, place of the open p, named element)
        stack: list[tuple[str, bool, str, int, int]] = []
        opened: Counter = Counter()
        bad = main = link = 0
        parts, runs = [], []
        block_tag, open_p, here = "body", -1, -1

        def leave(k: int) -> None:
            nonlocal bad, main, link, block_tag, open_p, here
            while len(stack) > k:
                tag, is_bad, block_tag, open_p, here = stack.pop()
                opened[tag] -= 1
                bad -= is_bad
                main -= tag in ("article", "main")
                link -= tag == "a"

        def flush() -> None:
            nonlocal parts, runs
            if parts:
                text = "".join(parts)
                text = " ".join((unescape(text) if "&" in text else text).split())
                if text:
                    events.extend((kind, words, len(blocks), at_name) for kind, words, at_name in runs)
                    blocks.append(text)
            parts, runs = [], []

        at, size = 0, len(page)
        while at < size:
            m = _TOKEN.match(page, at)
            at = m.end()
            tag = m[2]
            if tag is None:
                text = m[0]
                if (text[0] == "<" and len(text) > 1) or bad:
                    continue
                parts.append(text)
                words = len(text.split())
                if words:
                    runs.append((("+" if main else "-") + ("l:" if link else "w:") + block_tag, words, here))
                continue
            tag = tag.lower()
            closing, alone = m[1] == "/", m[3].endswith("/")
            if tag in _RAW and not closing:
                flush()
                if tag != "head" and not alone:
                    end = _RAW_END[tag].search(page, at)
                    at = end.start() if end else size
                    events.append(("t:raw", 1, -1, -1))
                continue
            if tag in _BLOCK:
                flush()
            events.append(("t:" + (tag if tag in _BLOCK or tag in _INLINE else "other"), 1, -1, -1))
            if closing:
                if opened[tag] > 0:
                    leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
                continue
            if tag in ("h1", "article", "main") and not bad:
                k = here
                while k >= 0 and not self.named[k][2]:
                    self.named[k][2] = True
                    k = self.named[k][0]
            if tag in _VOID or alone:
                continue
            if tag in _ENDS_P and open_p >= 0:
                leave(open_p)
            for other in _SELF.get(tag, ()):
                if stack and stack[-1][0] == other:
                    leave(len(stack) - 1)
            attrs = [(a[1].lower(), a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])] if m[3] and not m[3].isspace() else []
            is_bad = never(tag, attrs, main > 0)
            stack.append((tag, is_bad, block_tag, open_p, here))
            opened[tag] += 1
            bad += is_bad
            link += tag == "a"
            if tag in ("article", "main"):
                main += 1
                self.marked = True
            if tag in _BLOCK:
                block_tag, open_p = tag, len(stack) - 1 if tag == "p" else -1
            names = name_parts(attrs) if attrs and tag not in ("html", "body") else []
            if names:
                self.named.append([here, names, tag in ("article", "main", "h1")])
                here = len(self.named) - 1
        flush()


def parsed(page: str) -> Page:
    return Page(page)


def prior(kind: str) -> tuple[float, float, float]:
    if kind[0] == "n":
        return CONTENT if kind[2:] in _FOR else NOISE if kind[2:] in _AGAINST else OTHER
    return TAG if kind[0] == "t" else LINKED if kind[0] == "l" else WORD


class Weights:
    """Weight of each kind of word and tag, from counts (kind, inside, outside)."""

    def __init__(self, counts: list[tuple[str, float, float]]):
        inside, outside = (max(sum(r[k] for r in counts if r[0][0] in "wl"), 1.0) for k in (1, 2))
        self.of = {}
        for kind, a, b in counts:
            low, high, mid = prior(kind)
            # pseudo-counts in the ratio that the prior weight stands for
            pa_, pb = TRUST * math.exp(mid) / (1 + math.exp(mid)), TRUST / (1 + math.exp(mid))
            seen = math.log((a + pa_) / (b + pb)) - math.log((inside + TRUST) / (outside + TRUST)) * min(1.0, (a + b) / TRUST)
            self.of[kind] = min(high, max(low, seen))

    def __getitem__(self, kind: str) -> float:
        return self.of.get(kind) if kind in self.of else prior(kind)[2]


    def names(self, page: Page) -> list[float]:
        """What the names of each named element and of those around it add to a word."""
        out: list[float] = []
        for around, names, wrapper in page.named:
            own = sum(sum(self["n:" + p] for p in parts) / len(parts) for parts in names)
            out.append((out[around] if around >= 0 else 0.0) + (max(own, 0.0) if wrapper else own))
        return [min(NAMES[1], max(NAMES[0], x)) for x in out]


def values(page: Page, weights: Weights) -> list[float]:
    """The score of each event."""
    names = weights.names(page)
    out = []
    for kind, n, _, named in page.events:
        if kind[0] == "t":
            out.append(weights[kind])
        elif page.marked and kind[0] == "-":
            out.append(OUTSIDE_MAIN * n)
        else:
            own = weights[kind[1:]]
            # what names make negative is left out of the text, so it parts what is around it no more than tags do
            out.append(max(own + names[named], min(own, APART)) * n if named >= 0 else own * n)
    return out


def region(events: list[tuple], scores: list[float]) -> tuple[int, int]:
    """First and last block of the best contiguous region; (0, -1) if there is none."""
    best, total, start, found = 0.0, 0.0, None, (0, -1)
    for (_, _, block, *_), value in zip(events, scores):
        total += value
        if total < 0:
            total, start = 0.0, None
        elif block >= 0:
            if start is None:
                start = block
            if total > best:
                best, found = total, (start, block)
    return found


def main_text(html: str | None, weights: Weights) -> str:
    if not html:
        return ""
    page = parsed(html)
    scores = values(page, weights)
    a, b = region(page.events, scores)
    own = [0.0] * len(page.blocks)
    names = weights.names(page)
    for (kind, n, block, named), score in zip(page.events, scores):
        if block >= 0:
            # links lower a region, but a block of them within it is text like any other
            inside = not page.marked or kind[0] == "+"
            own[block] += (score if not inside else (WORD[2] + (names[named] if named >= 0 else 0.0)) * n)
    return "\n".join(t for k, t in enumerate(page.blocks[a : b + 1], a) if own[k] > 0)


def learn(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE) -> Weights:
    """Counts of kinds inside and outside marked content, summed in Spark; a row per kind reaches the driver."""
    prepared(pages.sparkSession)
    total = max(1, pages.count())
    share = int(min(1.0, sample / total) * (1 << 30))
    # by key and content, so that rows of one key (or of none) are not all in or all out
    chosen = pages.where(F.pmod(F.xxhash64(key, html), F.lit(1 << 30)) < share) if share < 1 << 30 else pages

    def run(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for html in batch.column(0).to_pylist():
                page = parsed(html or "")
                events = page.events
                first = next((k for k, e in enumerate(events) if e[0][0] == "+"), None)
                if not page.marked or first is None:
                    continue
                last = next(k for k in range(len(events) - 1, -1, -1) if events[k][0][0] == "+")
                for k, (kind, n, _, named) in enumerate(events):
                    side = kind[0] == "-" if kind[0] != "t" else not first <= k <= last
                    counts.setdefault(kind.lstrip("+-"), [0, 0])[side] += n
                    seen: set[str] = set()
                    while named >= 0:
                        around, names, wrapper = page.named[named]
                        if not wrapper:
                            seen.update(p for parts in names for p in parts)
                        named = around
                    for p in seen:
                        counts.setdefault("n:" + p, [0, 0])[side] += n
            if counts:
                yield pa.RecordBatch.from_pydict({"kind": list(counts), "inside": pa.array([c[0] for c in counts.values()], pa.int64()), "outside": pa.array([c[1] for c in counts.values()], pa.int64())})

    rows = mapped(chosen.select(html), run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
    rows = rows.where(~F.col("kind").startswith("n:") | (F.col("a") + F.col("b") >= SUPPORT)).orderBy("kind").collect()
    return Weights([(r.kind, float(r.a), float(r.b)) for r in rows])


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sample: int = SAMPLE) -> DataFrame:
    """keep's columns with text and n_chars (code points) of every page. Columns beyond these, whatever their names, play no part."""
    spark = pages.sparkSession
    prepared(spark)
    shared = spark.sparkContext.broadcast(learn(pages, key, html, sample))

    def run(batches):
        weights = shared.value
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return mapped(pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html)), run, typed(pages, keep, "text string, n_chars long"))
