"""Main text of web pages as a maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score positive and tags negative: the weight of a word
depends on the block that it stands in, the weight of a tag on its name, and both are log odds from
labelled pages (pages that mark their article themselves with article, main, role=main or
itemprop=articleBody: what is inside is content, the marking tags themselves are not), smoothed towards fixed
prior odds. One linear scan finds the contiguous region of the greatest sum; marks decide nothing else, so
pages with and without them are read alike. Of the region come all blocks that it touches, whole, but those
inside menus, page headers, footers, asides, notices, adverts, forms, comments and hidden or raw elements.

The weights are fitted on a bounded sample (`sample` pages by a hash of page_id) for the `names` most frequent
features; others keep their prior. Null and empty html and html without text give empty text; of regions with
equal sums the first and shortest is taken. Repeated pages are rows each, an empty table gives an empty result.
Long and deeply nested pages are scanned whole; other columns are not touched.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their part in a page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("head script style noscript template svg math iframe object embed canvas audio video select option datalist button textarea input form nav aside footer menu dialog title map applet frameset noframes".split())
MARKED = ("article", "main")
#: A block that closes when one of these opens.
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Parts of class, id, role or aria-label values that mark what isn't the article.
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar toolbar "
    "footer foot copyright legal sidebar aside widget widgets related recommended recommendations trending popular share sharing social comment comments commentlist disqus respond reply replies discussion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin search searchbox pagination pager paywall skip hidden complementary contentinfo".split()
)
PAGE_HEADER = frozenset("header site-header page-header".split())
PRIOR_WORD = {"p": 0.9, "h1": 0.9, "h2": 0.5, "h3": 0.5, "pre": 0.7, "blockquote": 0.8, "td": 0.1, "li": 0.1, "a": -0.6, "boiler": -2.5, "div": 0.3, "figcaption": 0.3, "dd": 0.3}
PRIOR_TAG = {"p": 0.55, "h1": 0.55, "h2": 0.55, "h3": 0.55, "h4": 0.55, "blockquote": 0.55, "pre": 0.55, "br": 0.5, "b": 0.5, "i": 0.5, "em": 0.5, "a": 0.4, "li": 0.4, "div": 0.35, "ul": 0.35}
PRIOR_COUNT = 200.0

#: Ordinary tags are matched here, with bounds on what is tried; the rest that begins like one goes to `TagEnds`.
TOKEN = re.compile(r"<!--|<!\[CDATA\[|<(/?)([a-zA-Z][^\s/>]{0,99})(?=[\s/>])((?:[^>\"']|\"[^\"]{0,4096}\"|'[^']{0,4096}'){0,256})>|[^<]+|<")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
EVENT = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def is_boiler(name: str, given: dict[str, str], in_marked: bool) -> bool:
    if name in NEVER:
        return True
    if name == "header" and not in_marked:
        return True
    if not given:
        return False
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I):
        return True
    if name in ("body", "html", "article", "main"):
        return False
    if given.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"):
        return True
    for key in ("class", "id"):
        for value in given.get(key, "").split():
            parts = [p.lower() for p in PARTS.split(value) if p]
            if any(p in BOILER for p in parts) or value.lower() in PAGE_HEADER and not in_marked:
                return True
    return False


class TagEnds:
    """Where tags end, in time linear in the page for all its tags.

    A tag ends at the first > outside of quotes, or, if a quote stays open or no such > follows, at the first > of all. Scans
    that reach a quote, outside of quotes, from which an earlier scan found no end have none either.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.events: list[int] | None = None
        self.hopeless: set[int] = set()

    def first(self, at: int) -> int:
        """The first > from `at` on, or -1."""
        return -1 if at > self.last else self.source.find(">", at)

    def of(self, at: int) -> int:
        """The end of the tag whose attributes begin at `at`, or -1."""
        if at > self.last:
            return -1
        if self.events is None:
            self.events = [m.start() for m in EVENT.finditer(self.source)]
        source, k, seen = self.source, bisect.bisect_left(self.events, at), []
        while k < len(self.events) and (place := self.events[k]) not in self.hopeless:
            if source[place] == ">":
                return place
            seen.append(place)
            end = source.find(source[place], place + 1)
            if end < 0:
                break
            k = bisect.bisect_right(self.events, end, k)
        self.hopeless.update(seen)
        return self.first(at)


class Page:
    """Tokens of a page: (tag name or None, number of words, feature of the words, block or None)."""

    def __init__(self, source: str):
        self.blocks: list[list[str]] = [[]]
        self.kept: list[bool] = [True]
        self.tokens: list[tuple[str | None, int, str, int]] = []
        self.marked: list[list[int]] = []  # [first token, end token] of the articles that the page marks
        # name, boiler, feature, marked article or -1, whether in one, index of the innermost block
        stack: list[tuple[str, bool, str, int, bool, int]] = []
        self.opened: Counter[str] = Counter()
        pos, n, ends = 0, len(source), TagEnds(source)
        while pos < n:
            m = TOKEN.match(source, pos)
            start, text, pos = pos, m[0], m.end()
            if text == "<!--":
                end = source.find("-->", pos)
                pos = n if end < 0 else end + 3
                continue
            if text == "<![CDATA[":
                end = source.find("]]>", pos)
                end = n if end < 0 else end
                self._words(source[pos:end], stack, decode=False)
                pos = min(n, end + 3)
                continue
            closes, name, rest = m[1], m[2], m[3]
            if text == "<":
                if source.startswith(("<!", "<?"), start):
                    if (end := ends.first(pos)) >= 0:
                        pos = end + 1
                        continue
                elif (tag := TAG.match(source, start)) and (end := ends.of(tag.end())) >= 0:
                    closes, name, rest, pos = tag[1], tag[2], source[tag.end() : end], end + 1
            if not name:
                self._words(text, stack)
                continue
            name = name.lower()
            if closes:
                self._close(name, stack)
                continue
            self._open(name, attributes(rest), stack)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, pos)
                pos = n if end is None else end.start()
        for own in self.marked:
            own[1] = own[1] if own[1] >= 0 else len(self.tokens)

    def _break(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])
            self.kept.append(True)

    def _open(self, name: str, given: dict[str, str], stack: list) -> None:
        while stack and name in CLOSES.get(self._block(stack), ()):
            self._pop(self._depth(stack), stack, len(self.tokens))
        if name not in INLINE:
            self._break()
        self.tokens.append((name, 0, "", -1))
        if name in VOID:
            return
        boiler = stack[-1][1] if stack else False
        inside = bool(stack) and stack[-1][4]
        boiler = boiler or is_boiler(name, given, inside)
        own = -1
        if not boiler and not inside and (name in MARKED or given.get("role", "").lower() in ("main", "article") or "articlebody" in given.get("itemprop", "").lower()):
            own = len(self.marked)
            self.marked.append([len(self.tokens), -1])
        feature = "boiler" if boiler else "a" if name == "a" or (stack and stack[-1][2] == "a") else name if name not in INLINE else stack[-1][2] if stack else "body"
        stack.append((name, boiler, feature, own, inside or own >= 0, self._depth(stack) if name in INLINE else len(stack)))
        self.opened[name] += 1

    @staticmethod
    def _depth(stack: list) -> int:
        """Index of the innermost open element that is a block."""
        return stack[-1][5] if stack else 0

    def _block(self, stack: list) -> str:
        return stack[self._depth(stack)][0]

    def _pop(self, depth: int, stack: list, end: int) -> None:
        for name, _, _, own, _, _ in stack[depth:]:
            self.opened[name] -= 1
            if own >= 0:
                self.marked[own][1] = end
        del stack[depth:]

    def _close(self, name: str, stack: list) -> None:
        if name not in INLINE:
            self._break()
        self.tokens.append((f"/{name}", 0, "", -1))
        if not self.opened[name]:
            return
        # an inline element does not close past the block that it stands in
        first = self._depth(stack) if name in INLINE else 0
        at = next((k for k in range(len(stack) - 1, first - 1, -1) if stack[k][0] == name), -1)
        if at >= 0:
            self._pop(at, stack, len(self.tokens) - 1)

    def _words(self, text: str, stack: list, decode: bool = True) -> None:
        text = html.unescape(text) if decode else text
        if any(x[0] in RAW for x in stack[-1:]) or not text:
            return
        boiler, feature = stack[-1][1:3] if stack else (False, "body")
        kept = not boiler
        if self.blocks[-1] and self.kept[-1] != kept:
            self._break()
        self.kept[-1] = kept
        self.blocks[-1].append(text)
        n = len(text.split())
        if n:
            self.tokens.append((None, n, feature, len(self.blocks) - 1))


def odds(inside: float, outside: float, prior: float) -> float:
    """Log odds of content with PRIOR_COUNT pseudo-observations at the prior share."""
    return math.log((inside + PRIOR_COUNT * prior) / (outside + PRIOR_COUNT * (1 - prior)))


class Weights:
    def __init__(self, words: dict[str, tuple[float, float]], tags: dict[str, tuple[float, float]]):
        share = lambda x: 1 / (1 + math.exp(-x))
        self.word, self.tag = {}, {}
        for name in {*words, *PRIOR_WORD, "body"}:
            a, b = words.get(name, (0, 0))
            self.word[name] = max(-3.0, min(2.0, odds(a, b, share(PRIOR_WORD.get(name, 0.2)))))
        # left out of the text anyway: enough that a region does not begin or end there
        self.word["boiler"] = max(-0.1, min(-0.01, 0.05 * self.word["boiler"]))
        for name in {*tags, *PRIOR_TAG}:
            a, b = tags.get(name, (0, 0))
            # tags never score positive; those that articles hold cost least
            self.tag[name] = min(-0.05, max(-2.0, odds(a, b, PRIOR_TAG.get(name.lstrip("/"), 0.3)) - 0.5))

    def score(self, token: tuple[str | None, int, str, int]) -> float:
        name, n, feature, _ = token
        return n * self.word.get(feature, 0.2) if name is None else self.tag.get(name, -0.8)


def counted(page: Page) -> tuple[Counter, Counter] | None:
    """Words by feature and tags by name, inside and outside of the page's one marked article."""
    if len(page.marked) != 1:
        return None
    lo, hi = page.marked[0]
    words, tags = Counter(), Counter()
    for k, (name, n, feature, _) in enumerate(page.tokens):
        side = lo <= k < hi
        if name is None:
            words[feature, side] += n
        else:
            tags[name, side] += 1
    return words, tags


def region(page: Page, weights: Weights) -> tuple[int, int]:
    """Token range of the maximum-scoring contiguous subsequence."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for k, token in enumerate(page.tokens):
        if total <= 0:
            total, start = 0.0, k
        total += weights.score(token)
        if total > best:
            best, found = total, (start, k + 1)
    return found


def main_text(source: str | None, weights: Weights) -> str:
    if not source:
        return ""
    page = Page(source)
    lo, hi = region(page, weights)
    if hi <= lo:
        return ""
    blocks = dict.fromkeys(b for name, _, _, b in page.tokens[lo:hi] if name is None and page.kept[b])
    return " ".join(" ".join("".join(page.blocks[b]).split()) for b in blocks)


def fit(pages: DataFrame, sample: int = 2000, names: int = 500) -> Weights:
    n = pages.count()
    scale = 1 << 30
    rows = pages.where(F.pmod(F.xxhash64("page_id", F.lit(5)), F.lit(scale)) < min(scale, sample * scale // max(n, 1) + 1)).select("html")

    def run(batches):
        words, tags = Counter(), Counter()
        for b in batches:
            for source in b.column(0).to_pylist():
                got = counted(Page(source)) if source else None
                if got:
                    words.update(got[0])
                    tags.update(got[1])
        rows = [("w", *k, float(v)) for k, v in words.items()] + [("t", *k, float(v)) for k, v in tags.items()]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.float64())], names=["kind", "name", "inside", "n"])

    # names of tags are the pages' own: the most frequent ones are learned
    out = rows.mapInArrow(run, "kind string, name string, inside boolean, n double").groupBy("kind", "name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0.0)).alias("a"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0.0)).alias("b"))
    got = out.orderBy(F.desc(F.col("a") + F.col("b")), "kind", "name").limit(names).collect()
    return Weights({r.name: (r.a, r.b) for r in got if r.kind == "w"}, {r.name: (r.a, r.b) for r in got if r.kind == "t"})


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(weights or fit(pages))

    def run(batches):
        for b in batches:
            texts = [main_text(x, shared.value) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
