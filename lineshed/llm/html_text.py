"""Main text of web pages by the maximum-scoring run of words and tags.

A page is read once into blocks: the words between block-level tags, with the tags before them. Words
score above 0 and tags below 0; the contiguous run of blocks with the largest sum is the content, found in
one scan. The weights come from labelled pages, those that mark their content with an `article` or `main`
element; the mark is the label only: what is scored is the same on marked and unmarked pages. A word's
weight depends on whether it is in a link. A tag's depends on its name and on whether it opens or closes: the share of its uses that aren't
between two blocks of content, times what crossing a stretch of other words should cost.

Before scoring, what is never content is left out with all that it holds, on every page: scripts, styles,
forms, menus and the like by their element's name, role or class.

Edge cases: a null, empty or word-less page gives an empty text; stray tags are forgiven; an unclosed
comment, script or style reaches to the end, and so does a tag without `>`; the first of equal runs wins;
without labelled pages words weigh 1 and tags -0.5; equal pages give equal texts, repeated or not; an
empty table gives no rows; the time is linear in the page, however long it is and however its tags nest.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineshed.llm.textops import byte_batches, map_texts
from lineshed.session import materialize

_TOKEN = re.compile(
    r"(?P<text>[^<]+)|<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>|(?P<stray><)",
    re.S,
)
_TAG = re.compile("</?[a-zA-Z]")
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMES = re.compile(r"[^a-z0-9]+")
RAW = frozenset("script style noscript template textarea title iframe svg object canvas audio video select xmp noembed noframes".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt mstyle msub msubsup msup mtext nobr picture q ruby rb rt rp s samp small source span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset("head nav aside footer form button dialog menu fieldset datalist output progress meter search".split())
NEVER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist tooltip status".split())
NEVER_CLASS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription "
    "signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist respond disqus replies reply related recommended "
    "recommendations share sharing social popup modal overlay widget widgets toolbar pagination pager copyright disclaimer login skip toc".split()
)
KEPT = frozenset("html body main article".split())
NOT_NAMES = frozenset("has with without no".split())
WORD, LINK, OUT = "#word", "#link", "#out"
SHARE = 1e-5
MOST_NAMES = 50_000
FAR, LEAST_APART = 3.0, 20.0


@dataclass
class Block:
    """Words between block-level tags, and the tags passed since the block before."""

    text: str
    words: int
    linked: int
    marked: bool
    tags: Counter = field(default_factory=Counter)  # names; of end tags with a slash in front


def left_out(name: str, attrs: str, in_marked: bool) -> bool:
    """Whether an element is never content. in_marked: a header there is the article's own."""
    if name in NEVER or name == "header" and not in_marked:
        return True
    if name in KEPT and name != "article":
        return False
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key == "role" and value in NEVER_ROLE:
            return True
        if key in ("class", "id"):
            for one in value.split():
                words = [w for w in _NAMES.split(one) if w]
                if any(w in NEVER_CLASS and (k == 0 or words[k - 1] not in NOT_NAMES) for k, w in enumerate(words)) or "header" in words and not in_marked:
                    return True
    return False


class _Open:
    """The open elements. Where the topmost of a name stands is known, so no tag walks over them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool]] = []  # name, and whether it began something left out
        self.places: dict[str, list[int]] = {}
        self.other: list[int] = []  # places of elements that aren't inline
        self.gone = self.marked = self.links = 0

    def push(self, name: str, began: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.other.append(len(self.stack))
        self.stack.append((name, began))
        self.gone += began
        self.marked += name in ("article", "main")
        self.links += name == "a"

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            name, began = self.stack.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.other.pop()
            self.gone -= began
            self.marked -= name in ("article", "main")
            self.links -= name == "a"

    def top(self, name: str) -> int:
        held = self.places.get(name)
        return held[-1] if held else -1

    def close(self, name: str) -> None:
        """An end tag; that of an inline element doesn't reach out of a block."""
        place = self.top(name)
        if place >= 0 and (name not in INLINE or not self.other or place > self.other[-1]):
            self.pop_to(place)

    def close_implied(self, name: str, stops: tuple[str, ...]) -> None:
        place = self.top(name)
        if place >= 0 and all(self.top(s) < place for s in stops):
            self.pop_to(place)


_P_STOPS = ("div", "article", "main", "section", "td", "th", "li", "body", "blockquote", "aside", "nav", "footer", "form", "header")


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, without what is never content."""
    out: list[Block] = []
    held = _Open()
    pieces: list[str] = []
    linked = 0
    tags: Counter = Counter()
    page = page or ""

    def flush() -> None:
        nonlocal pieces, linked, tags
        if pieces:
            words = "".join(pieces).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), held.marked > 0, tags))
                tags = Counter()
            pieces, linked = [], 0

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        if at > last and _TAG.match(page, at):
            break  # a tag that never ends
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"] or m["data"] or m["stray"]
        if text is not None:
            if not held.gone:
                text = html.unescape(text)
                pieces.append(text)
                if held.links:
                    linked += len(text.split())
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        inline = name in INLINE
        if not inline and not held.gone:
            flush()
        if m["close"] or m["close2"]:
            gone = held.gone
            held.close(name)
            if not gone and not inline:
                tags["/" + name] += 1
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            done = _RAW_END[name].search(page, at)
            at = done.end() if done else end
            continue
        if not inline and name not in VOID:
            if name == "li":
                held.close_implied("li", ("ul", "ol"))
            elif name in ("dt", "dd", "tr", "td", "th", "option"):
                held.close_implied(name, ("table", "dl"))
            held.close_implied("p", _P_STOPS)
        if name in VOID or attrs.rstrip().endswith("/") and name not in ("a", "p", "div"):
            if not held.gone:
                tags[name] += 1
            continue
        began = left_out(name, attrs, held.marked > 0)
        if not held.gone and not began:
            tags[name] += 1
        held.push(name, began)
    if held.gone:
        held.pop_to(0)
    flush()
    return out


@dataclass
class Weights:
    """Scores of words (above 0) and of tags (below 0)."""

    word: float = 1.0
    link: float = 0.5
    tag: dict[str, float] = field(default_factory=dict)
    other_tag: float = -0.5

    @classmethod
    def of_counts(cls, counts: dict[tuple[str, bool], int]) -> Weights:
        """From how often words and tags stand inside and outside the content of labelled pages."""
        if not counts:
            return cls()

        def odds(name: str) -> float:
            return math.log((counts.get((name, True), 0) + 1) / (counts.get((name, False), 0) + 1))

        def n(name: str) -> int:
            return counts.get((name, False), 0)

        word = min(max(odds(WORD), 0.5), 3.0)
        apart = word * max(LEAST_APART, FAR * (n(WORD) + n(LINK)) / max(n(OUT), 1))  # some stretches of other words
        names = {name for name, _ in counts if name[0] != "#"}
        tag = {t: -0.05 - apart * (n(t) + 0.001) / (n(t) + counts.get((t, True), 0) + 1) for t in names}
        return cls(word, min(max(odds(LINK), 0.1), word), tag)

    def scores(self, found: list[Block]) -> list[tuple[float, float]]:
        """For each block the sum of the tags before it and the sum of its words."""
        return [(sum(n * self.tag.get(t, self.other_tag) for t, n in b.tags.items()), self.word * (b.words - b.linked) + self.link * b.linked) for b in found]


def counted(found: list[Block]) -> Counter:
    """What a labelled page tells: words by block, other blocks, and tags by whether content is on both sides."""
    counts: Counter = Counter()
    before = False
    for b in found:
        counts[WORD, b.marked] += b.words - b.linked
        counts[LINK, b.marked] += b.linked
        counts[OUT, b.marked] += 1
        for t, n in b.tags.items():
            counts[t, before and b.marked] += n
        before = b.marked
    return counts


def best_run(scores: list[tuple[float, float]]) -> tuple[int, int]:
    """First and last + 1 of the run of blocks with the largest sum; the tags before a run don't count."""
    best, best_run_, run, start = 0.0, (0, 0), 0.0, 0
    for k, (tags, words) in enumerate(scores):
        if run + tags <= 0:
            run, start = 0.0, k
        else:
            run += tags
        run += words
        if run > best:
            best, best_run_ = run, (start, k + 1)
    return best_run_


def main_text(page: str | None, weights: Weights) -> str:
    found = blocks(page)
    first, last = best_run(weights.scores(found))
    return " ".join(b.text for b in found[first:last])


def fit(pages: DataFrame, column: str = "html") -> Weights:
    """Weights from all pages that mark their content. Names of `SHARE` of all tags or more are learned."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in byte_batches(frames, "h"):
            for page in pdf["h"]:
                found = blocks(page)
                if any(b.marked for b in found):
                    counts += counted(found)
            if len(counts) > MOST_NAMES:  # names may be many: send what there is
                yield _rows(counts)
                counts = Counter()
        yield _rows(counts)

    held = pages.select(F.col(column).alias("h")).mapInPandas(run, "t string, inside boolean, n long").groupBy("t").agg(
        F.sum(F.when(F.col("inside"), F.col("n"))).alias("inside"), F.sum(F.when(~F.col("inside"), F.col("n"))).alias("outside"), F.sum("n").alias("n")
    )
    held = materialize(held, "tags")
    least = F.lit(SHARE * (held.filter("t not like '#%'").agg(F.sum("n")).first()[0] or 0))
    rows = held.filter(F.col("t").startswith("#") | (F.col("n") >= least)).collect()  # at most 1 / SHARE names
    counts = {(r["t"], True): r["inside"] or 0 for r in rows} | {(r["t"], False): r["outside"] or 0 for r in rows}
    return Weights.of_counts({k: n for k, n in counts.items() if n})


def _rows(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame([(t, inside, n) for (t, inside), n in counts.items()], columns=["t", "inside", "n"]).astype({"n": "int64", "inside": "bool"})


def extract(pages: DataFrame, weights: Weights, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep`, text and n_chars for every page."""

    def run(found: list) -> list:
        texts = [main_text(page, weights) for page in found]
        return [texts, [len(t) for t in texts]]

    return map_texts(pages, column, keep, "text string, n_chars long", run)
