"""Main text of web pages by two-pass block rules.

Pass one classifies blocks of text by stop-word density, length and link density: good, bad, or undecided. Long blocks
of few links are good in an article; on a page without one they are good if they hold stop words or if no such block
does (another language). Long blocks that are all link, runs of linked blocks, and linked or short copyright lines outside an
article, are bad. Short blocks, paragraphs of an article with links in them, and long blocks of few stop words are undecided. Pass two lets undecided blocks
inherit the label of the nearest decided block of their part of the page. A part with nothing decided is kept.

Elements that hold no article text (navigation, footers, buttons) make their blocks bad. Class and id names, and forms,
only weigh. A name made of nothing but words of such parts ("ad", "share-buttons") marks an element: it is left out unless it
holds most of a page's good text and no article stands outside it (never so for reader comments), or unless nothing good would
be left without it. A name that holds such a word beside others ("share-price", "notice-of-death"), or a header in an article,
leaves the element in doubt: its blocks are good from twice the length and with stop words only, bad if short and linked, else
undecided, so that pass two decides. Names of headings say nothing.

Everything is linear in a page's length, however deep its elements stand in each other. Of equally near neighbours the one
before counts.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    """the of and a to in is it that was for on are as with be by this from or an at which not have has but they you we
    de la le les et des en un une du que est pour qui dans par sur au pas plus ne se il elle avec sont ce
    der die das und ist von den mit zu im ein eine auf für nicht sich dem als auch des es an werden aus er sie wie
    el los las y del se por con una su para es al lo como más o pero sus fue son""".split()
)
# Elements that hold no article text, elements whose content is no markup, and block elements.
OUTSIDE = frozenset("nav header footer aside button select textarea label fieldset dialog menu iframe object svg canvas template noscript video audio head title".split())
RAW = "script|style|textarea|title|noscript|template|iframe|svg"
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class and id names of parts that are not the article.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb
    breadcrumbs header footer sidebar aside widget comment comments reply replies respond disqus cookie cookies consent
    notice notices alert popup modal overlay share sharing social related recommended newsletter subscribe signup login
    search form copyright legal disclaimer skip pagination pager tags hidden""".split()
)
# Words that say where or how such a part is shown, not what it holds.
PLACES = frozenset(
    """area article bar block bottom box btn button buttons card cell center col column container content cta desktop entry fixed
    foot google group head holder icon icons image inner item items label left line link links list main message mini mobile module
    outer panel pane post posts primary rail region right row secondary section site slot small space sticky strip text thread title
    toolbar top unit view wrap wrapper zone""".split()
)
# Words of parts written by readers.
READERS = frozenset("comment comments reply replies respond disqus".split())
# Whole lines, and a phrase of lines, at the foot of a page.
FOOT_LINES = frozenset(("about us", "back to top", "contact us", "cookie policy", "privacy policy", "sitemap", "terms and conditions", "terms of service", "terms of use"))
FOOT_PHRASE = "all rights reserved"
# With these in its name, a class or id speaks of the page around such a part.
AROUND = frozenset("with without has no free layout page body".split())

_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:"[^"]*"|'[^']*'|[^>"'])*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"<]*"|'[^'<]*'|[^>"'])*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)""", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden\b|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^a-z]+")


@dataclass(frozen=True)
class Rules:
    """Bounds of the block rules."""

    short: int = 70
    stop_words: float = 0.2
    link_density: float = 0.33
    all_links: float = 0.8
    link_run: int = 3
    most: float = 0.7
    doubt: int = 2  # times the length


@dataclass(eq=False)
class Mark:
    """An element whose name says that it isn't the article, or may not be; `outer` is the next such element around it."""

    outer: Mark | None
    kind: str  # "aside", "readers" or "doubt"
    held: int = 0  # characters of long and plain blocks inside
    own: int = 0  # those that stand in no inner mark that can be left out
    own_article: int = 0  # those of an article
    left_out: bool = False

    def __post_init__(self):
        self.doubt: bool = self.kind == "doubt" or bool(self.outer and self.outer.doubt)
        #: The innermost mark, from this one outwards, that can be left out.
        self.anchor: Mark | None = self if self.kind != "doubt" else self.outer and self.outer.anchor


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    part: int  # which article (or the page itself) it stands in
    outside: bool  # in an element that holds no article text
    mark: Mark | None = None  # the innermost element around it whose name weighs
    label: str = ""


def _kind(tag: str, attrs: str, part: int) -> str:
    """What an element's names say of it: "readers", "aside", "doubt", or nothing."""
    found = {"aside"} if tag == "form" else set()
    if tag in ("html", "body", "h1", "h2", "h3", "h4", "h5", "h6"):
        return ""
    for m in _NAMES.finditer(attrs):
        for name in m[1].strip("\"'").lower().split():
            words = {w for w in _SPLIT.split(name) if len(w) > 1}
            marks = words & MARKS
            if not marks or words & AROUND:
                continue
            if words - MARKS - PLACES or marks == {"header"} and (part or words & {"article", "entry", "post"}):
                found.add("doubt")
            else:
                found.add("readers" if marks & READERS else "aside")
    return next((k for k in ("readers", "aside", "doubt") if k in found), "")


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order. Unclosed parts end where an article begins or an outer element closes."""
    out: list[Block] = []
    text: list[str] = []
    state = {"linked": 0, "parts": 0, "link": False}
    opened: dict[str, int] = defaultdict(int)
    stack: list[tuple[str, bool, int, Mark | None]] = [("", False, 0, None)]  # open elements that are not inline: outside or not, part, mark

    def flush() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append(Block(joined, state["linked"], stack[-1][2], stack[-1][1], stack[-1][3]))
        text.clear()
        state["linked"] = 0

    def add(piece: str) -> None:
        text.append(piece)
        if state["link"]:
            state["linked"] += len(" ".join(html.unescape(piece).split()))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag, close, attrs = m["tag"].lower(), bool(m["close"]), m["attrs"] or ""
        if tag == "a":
            state["link"] = not close
        elif tag in INLINE:
            if tag == "img":
                text.append(" ")
        elif tag == "br":
            text.append(" ")
        else:
            flush()
            state["link"] = False
            if tag in VOID or attrs.endswith("/"):
                continue
            _, outside, part, mark = stack[-1]
            if close:
                while opened[tag]:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
                continue
            kind = _kind(tag, attrs, part)
            if kind:
                mark = Mark(mark, kind)
            if tag in ("article", "main"):
                # One in a marked or outer element of an article belongs to it; else what is open outside was never closed.
                if not (part and (outside or mark and mark.anchor)):
                    state["parts"] += 1
                    outside, part = False, state["parts"]
                stack.append((tag, outside, part, mark))
                opened[tag] += 1
            elif tag != "p" or mark is not stack[-1][3] or _HIDDEN.search(attrs):
                outer = tag in OUTSIDE and not (tag == "header" and part) or bool(_HIDDEN.search(attrs))
                stack.append((tag, outside or outer, part, mark))
                opened[tag] += 1
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _long_and_plain(b: Block, rules: Rules) -> bool:
    return not b.outside and len(b.text) >= rules.short and b.linked <= rules.link_density * len(b.text)


def _leave_out(blocks: list[Block], rules: Rules) -> None:
    """Sets which marks are left out: see the module's text."""
    marks: dict[Mark, None] = {}  # outer ones first
    total = bare = article = 0  # characters of long and plain blocks: of all, of those that are not left out, in articles of these
    for b in blocks:
        chain, m = [], b.mark
        while m is not None and m not in marks:
            chain.append(m)
            m = m.outer
        marks.update(dict.fromkeys(reversed(chain)))
        if _long_and_plain(b, rules):
            n = len(b.text)
            total += n
            anchor = b.mark and b.mark.anchor
            if anchor is None:
                bare, article = bare + n, article + n * (b.part > 0)
            else:
                anchor.own += n
                anchor.own_article += n * (b.part > 0)
    for m in reversed(marks):
        m.held += m.own
        if m.outer is not None:
            m.outer.held += m.held
    for m in marks:
        if m.outer is not None and m.outer.left_out:
            m.left_out = True
        elif m.kind != "doubt":
            most = m.kind != "readers" and m.held > rules.most * total and not article
            m.left_out = not (m.held and (not bare or most))
            if not m.left_out:
                bare, article = bare + m.own, article + m.own_article


def _foot(text: str) -> bool:
    low = text.lower()
    return "\N{COPYRIGHT SIGN}" in text or FOOT_PHRASE in low or low.strip(" .!>") in FOOT_LINES


def classify(blocks: list[Block], rules: Rules = Rules()) -> None:
    """Pass one: sets the labels "good" and "bad"; undecided blocks keep ""."""
    _leave_out(blocks, rules)
    away = [b.outside or b.mark is not None and b.mark.left_out for b in blocks]
    articles = any(b.part and not out for b, out in zip(blocks, away, strict=True))
    unknown, run = [], []  # long blocks of few stop words on a page without an article; linked blocks in a row
    for b, out in zip(blocks, away, strict=True):
        short, linked = len(b.text) < rules.short, b.linked > rules.link_density * len(b.text)
        doubt = b.mark is not None and b.mark.doubt
        if not out and b.linked > rules.all_links * len(b.text):
            run.append(b)
        else:
            run = []
        if out or articles and not b.part or short and (linked and (doubt or not b.part) or not b.part and _foot(b.text)):
            b.label = "bad"
        elif len(run) >= rules.link_run or run and not (short and b.part):
            for x in run if len(run) == rules.link_run else [b]:
                x.label = "bad"
        elif not short and not linked:
            words = [] if b.part and not doubt else _WORD.findall(b.text.lower())
            known = bool(words) and sum(w in STOP_WORDS for w in words) >= rules.stop_words * len(words)
            if known and (not doubt or len(b.text) >= rules.doubt * rules.short) or b.part and not doubt:
                b.label = "good"
            else:
                unknown.append(b)
    if not any(b.label == "good" for b in blocks):
        for b in unknown:
            b.label = "good"


def inherit(blocks: list[Block]) -> list[Block]:
    """Pass two: the blocks that are good, or undecided and nearest to a good one of their part (before wins over after)."""
    ahead, behind = _decided(blocks, 1), _decided(blocks, -1)
    kept = []
    for i, b in enumerate(blocks):
        near = [(abs(j - i), j > i, blocks[j].label) for j in (ahead[i], behind[i]) if j is not None]
        if b.label == "good" or not b.label and (not near or min(near)[2] == "good"):
            kept.append(b)
    return kept


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The article's text, blocks joined by one space; empty if there is none."""
    blocks = blocks_of(page or "")
    classify(blocks, rules)
    return " ".join(b.text for b in inherit(blocks))


def _decided(blocks: list[Block], step: int) -> list[int | None]:
    """For each block the last decided block of its part that comes before it (step 1) or after it (step -1).

    What stands in an element without article text says nothing about its neighbours.
    """
    last: dict[int, int] = {}
    out: list[int | None] = [None] * len(blocks)
    for i in range(len(blocks))[::step]:
        b = blocks[i]
        out[i] = last.get(b.part)
        if b.label and not b.outside and not (b.label == "bad" and b.mark is not None):
            last[b.part] = i
    return out


def _extract(batches, rules: Rules):
    for batch in batches:
        pages = batch.column(batch.num_columns - 1).to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([main_text(p, rules) for p in pages], pa.string())], ["page_id", "url", "text"])


def extract_html(pages: DataFrame, rules: Rules = Rules(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row for each row. Null and empty pages, and pages without text, give "".

    Pages without an article or main element are classified as a whole. Pages may have any length. Broken markup (unclosed elements, a page
    that ends inside a tag) loses the broken tag only. Ids and urls pass through, null or repeated as they are.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(partial(_extract, rules=rules), "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_html(read_table(spark, sf_dir, "pages"))
