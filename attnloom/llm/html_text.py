"""Main text of web pages by line-block distribution.

Markup is stripped into blocks, one line each, with the length of their text
outside links. Blocks in menus, headers, footers, sidebars, notices, adverts,
forms and comments are asides: they weigh nothing and are never kept. A name
alone does not make an aside of a wrapper: one that holds WRAPPED of the page's
weight, and nearly all that of marked articles, is none, unless it is named for
comments, adverts, consent, newsletters, related pages or sharing. Lengths
are summed over windows of WINDOW lines: the text starts at the surge, the first
line whose window ahead is heavy, and ends at the dive, the last line whose
window behind is. Markup is a weight: a line inside an article counts as heavy
by itself, however short, and the windows of other lines are heavy if they reach
HEAVY characters (on short pages a quarter of the longest window) and half the
longest window inside articles. Surge and dive move outwards over lines with
text of their own that follow without a gap, so that short lines at either end
stay. All blocks between the two that are no asides are kept whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

WINDOW, HEAVY = 3, 60
WRAPPED, BESIDE = 0.75, 0.1

#: Elements without text of the page; those of RAW_TAGS run to the end of the page when no end tag follows, as in browsers.
DROPPED_TAGS = frozenset("script style noscript template svg iframe object textarea select button title canvas audio video".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-z][a-z0-9-]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-z!?/][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in DROPPED_TAGS}
#: A slash after a space, a quoted value or the name closes an element that script and style never close so.
_SELF_CLOSED = re.compile(r"""(?:^|["'\s])/\s*\Z""")
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose names tell asides; headings, paragraphs, list items and inline elements never do.
CONTAINER_TAGS = frozenset("div section ul ol dl table header figure details".split())
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
_CLASS = re.compile(r"(?<![\w-])(?:class|role)" + _VALUE, re.I)
_ANY_NAME = re.compile(r"(?<![\w-])(?:class|id|role|aria-label)" + _VALUE, re.I)
#: Boxes that are content of an article.
_CONTENT_BOX = re.compile(r"(?:^|[_-])(?:notices?|alert)(?=$|[_-])", re.I)
_ASIDE_NAME = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav\w*|menus?|breadcrumbs?|side-?bar|widgets?|footer|site-?header|masthead|topbar|toolbar|related|recommend\w*|share|sharing|social|"
    r"comments?|commentlist|disqus|respond|replies|pagination|pager|complementary|contentinfo|search)(?:$|[_-])",
    re.I,
)
#: Names that say what a box stands beside or was built with, such as `with-sidebar`.
_STATE_NAME = re.compile(r"(?:^|[_-])(?:with|without|has|no|elementor)[_-]", re.I)
#: Asides whatever they hold.
_FIRM_NAME = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adbox|sponsor\w*|cookies?|consent|newsletter|subscribe|promo\w*|"
    r"related|recommend\w*|share|sharing|social|breadcrumbs?|pagination|comments?|commentlist|disqus|respond|replies)(?:$|[_-])",
    re.I,
)
#: Whole ids and classes of reader comments, which count in articles and on sections too.
_COMMENTS = re.compile(
    r"(?:(?:post|reader|readers|user|article)[_-])?(?:comments?|comment-?list|respond|replies|disqus|disqus_thread)(?:[_-](?:section|area|list|box|block|wrap|wrapper|container|form))?", re.I
)
#: Whole classes of a paragraph, list item or article that is an advert, or a reader's comment.
_ADVERT = re.compile(r"ads?|advert|advertisement|sponsored", re.I)
#: Asides that hold articles of their own: comments and cards of other pages.
_LISTING = re.compile(r"(?:^|[_-])(?:related|recommend\w*|comments?|commentlist|replies)(?:$|[_-])", re.I)
LISTING, FIRM, NAMED = 3, 2, 1


def _aside_kind(tag: str, attributes: str, in_article: bool) -> int:
    """LISTING or FIRM for asides by tag or firm name, NAMED for other names of containers, else 0.

    Class and role count on containers; ids and labels outside articles, but not
    those of sections; ids and classes of reader comments everywhere.
    """
    if tag in ASIDE_TAGS or (tag == "header" and not in_article):
        return FIRM
    if not attributes or not (tag in CONTAINER_TAGS or tag in ("p", "li", "article")):
        return 0
    any_names = [name for m in _ANY_NAME.finditer(attributes) for name in next(filter(None, m.groups()), "").split()]
    classes = [name for m in _CLASS.finditer(attributes) for name in next(filter(None, m.groups()), "").split()]
    if tag not in CONTAINER_TAGS:
        whole = _ADVERT if tag != "article" else _COMMENTS
        return LISTING if any(whole.fullmatch(name) for name in classes) else 0
    if any(_COMMENTS.fullmatch(name) for name in any_names):
        return LISTING
    kind = 0
    for name in classes if in_article or tag == "section" else any_names:
        name = _CONTENT_BOX.sub("", name) if in_article else name
        if not _STATE_NAME.search(name) and _ASIDE_NAME.search(name):
            kind = max(kind, LISTING if _LISTING.search(name) else FIRM if _FIRM_NAME.search(name) else NAMED)
    return kind


def _dropped_end(page: str, tag: str, attributes: str, at: int, open_ended: set[str]) -> int:
    """Where the dropped element ends whose start tag ends at `at`; tags in `open_ended` have no end tag further on."""
    if tag not in ("script", "style", "title") and _SELF_CLOSED.search(attributes):
        return at
    end = None if tag in open_ended else _END[tag].search(page, at)
    if end:
        return end.end()
    open_ended.add(tag)
    return len(page) if tag in RAW_TAGS else at


class _Asides:
    """Open asides while a page is read, and all of them for the weighing after."""

    def __init__(self) -> None:
        self.parents: list[int] = []
        self.kinds: list[int] = []
        self.open: list[tuple[int, str, int]] = []  # number, tag, level of the tag
        self.levels: dict[str, int] = {}
        self.places: dict[tuple[str, int], int] = {}  # where in `open` the aside of a tag's level is
        self.listings = 0  # open ones in which articles are none

    def innermost(self) -> int:
        return self.open[-1][0] if self.open else -1

    def opened(self, tag: str, kind: int) -> None:
        level = self.levels[tag] = self.levels.get(tag, 0) + 1
        if kind:
            self.places[tag, level] = len(self.open)
            self.parents.append(self.innermost())
            self.kinds.append(kind)
            self.open.append((len(self.kinds) - 1, tag, level))
            self.listings += kind == LISTING

    def closed(self, tag: str) -> None:
        level = self.levels.get(tag, 0)
        self.levels[tag] = max(0, level - 1)
        self.cut(self.places.get((tag, level), len(self.open)))

    def cut(self, size: int = 0) -> None:
        while len(self.open) > size:
            number, tag, level = self.open.pop()
            del self.places[tag, level]
            self.listings -= self.kinds[number] == LISTING

    def paragraph_ends(self) -> None:
        """A paragraph or list item that is an aside ends where the next block starts or ends."""
        if self.open and self.open[-1][1] in ("p", "li"):
            self.cut(len(self.open) - 1)

    def judged(self, lines: list[tuple[str, int, bool, int]]) -> list[bool]:
        """Per aside whether it stays one: wrappers that hold nearly all weight do not."""
        firm, inside, marked = [], [0] * len(self.kinds), [0] * len(self.kinds)
        for parent, kind in zip(self.parents, self.kinds, strict=True):
            firm.append(kind >= FIRM or (parent >= 0 and firm[parent]))
        free = [(w, m, n) for _, w, m, n in lines if n < 0 or not firm[n]]
        total, articles = sum(w for w, _, _ in free), sum(w for w, m, _ in free if m)
        for w, m, n in free:
            if n >= 0:
                inside[n] += w
                marked[n] += w if m else 0
        for n in range(len(self.kinds) - 1, -1, -1):
            if (parent := self.parents[n]) >= 0 and not firm[n]:
                inside[parent] += inside[n]
                marked[parent] += marked[n]
        out: list[bool] = []
        for n, parent in enumerate(self.parents):
            wraps = not firm[n] and inside[n] >= max(1, WRAPPED * total) and articles - marked[n] <= BESIDE * articles
            out.append(not wraps or (parent >= 0 and out[parent]))
        return out


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters outside links, inside an article, in an aside) of the blocks of a page."""
    lines: list[tuple[str, int, bool, int]] = []
    words: list[str] = []
    linked = articles = links = 0
    asides = _Asides()

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            lines.append((text, max(0, len(text) - linked), articles > 0, asides.innermost()))
        words.clear()
        linked = 0

    at = 0
    open_ended: set[str] = set()
    while m := TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            words.append(piece)
            linked += len(" ".join(html.unescape(piece).split())) if links else 0
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        closing = bool(m["close"])
        if tag in DROPPED_TAGS:
            at = at if closing else _dropped_end(page, tag, m["attributes"], at, open_ended)
            continue
        if tag == "br":
            words.append(" ")
        elif tag == "a":
            links = max(0, links - 1) if closing else 1
        if tag not in BLOCK_TAGS:
            continue
        flush()
        links = 0
        asides.paragraph_ends()
        if tag in VOID_TAGS:
            continue
        kind = 0 if closing else _aside_kind(tag, m["attributes"], articles > 0)
        if tag in ("article", "main") and not kind and not asides.listings:
            articles = max(0, articles + (-1 if closing else 1))
            asides.cut()  # an aside that was never closed ends with the article, or before one opens
        if closing:
            asides.closed(tag)
        else:
            asides.opened(tag, kind)
    words.append(page[at:])
    flush()
    stays = asides.judged(lines)
    return [(text, weight, inside, n >= 0 and stays[n]) for text, weight, inside, n in lines]


def _windows(weights: list[int]) -> list[int]:
    """Sums over each line and the next ones of its window."""
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights))]


def main_text(page: str | None) -> str:
    """The blocks from surge to dive, joined by an empty line; empty where no line is heavy."""
    lines = blocks(page or "")
    marked = [inside and not aside for _, _, inside, aside in lines]
    weights = [0 if aside else w for _, w, _, aside in lines]
    plain = [0 if m else w for w, m in zip(weights, marked, strict=True)]
    ahead, behind = _windows(plain), _windows(plain[::-1])[::-1]
    most_marked = max(_windows([w if m else 0 for w, m in zip(weights, marked, strict=True)]), default=0)
    heavy = max(min(HEAVY, max(_windows(weights), default=0) / 4), most_marked / 2)
    surges = [i for i, m in enumerate(marked) if m or (plain[i] and ahead[i] >= heavy)]
    dives = [i for i, m in enumerate(marked) if m or (plain[i] and behind[i] >= heavy)]
    if not surges or not dives:
        return ""
    surge, dive = surges[0], dives[-1]
    while surge and plain[surge] and plain[surge - 1]:
        surge -= 1
    while dive + 1 < len(lines) and plain[dive] and plain[dive + 1]:
        dive += 1
    return "\n\n".join(text for text, _, _, aside in lines[surge : dive + 1] if not aside)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html", 4 << 20):
            found = pa.array([main_text(h) for h in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), found], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html), repeated rows included.

    Null and empty pages give an empty text. Other columns are ignored; an empty
    table gives no rows.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    found = pages.mapInArrow(_extract, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
