"""Main text of web pages by the maximum-scoring contiguous region.

A page is a sequence of words and tags. Words score positive and tags negative, with weights from labelled pages; a
linear scan finds the region of the highest sum. Words outside the article of a page that has one score negative. What
lies inside elements that are never content (navigation, adverts, forms and the like) scores nothing, so that a region
may go on behind it, and is left out of the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.workers import lean, slices

#: Labelled pages that weights are fitted on, in expectation.
FIT_PAGES = 2000
#: Least size of a weight, and weights used where no page is labelled.
LEAST, WORD_DEFAULT, TAG_DEFAULT, OUTSIDE_WORD = 0.05, 1.0, -2.0, -3.0

# Fixed values of HTML: elements by role. Elements of other names count as one class, "other".
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video select option datalist textarea title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
ASIDE = frozenset("nav footer aside form menu dialog button fieldset label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("a abbr acronym b bdi bdo big caption cite code colgroup data del dfn em font i ins kbd mark map meter optgroup output picture progress q rp rt ruby s samp search slot small span strike strong sub sup time tt u var".split())
KNOWN = HIDDEN | ASIDE | VOID | BLOCK | INLINE
#: Elements that hold blocks; class words by halves of a name count for these only.
CONTAINER = frozenset("div section article main ul ol dl table td aside details figure center header".split())
#: Words of class, id and role that mark parts that are not content: readers' comments, adverts and their like, and others.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted cookie cookies consent newsletter subscribe popup".split())
OTHER_WORDS = frozenset("banner breadcrumb breadcrumbs contentinfo footer header menu nav navbar navigation notice recommended related share sharing sidebar social toolbar widget complementary search".split())
#: Words of names that wrap content, and what before a word says that it is only about it.
WRAP_WORDS = frozenset("content main article post entry story page wrapper layout container body".split())
ABOUT = frozenset("no not non without with has have hide show".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s=>/]+(?:\s*=\s*(?:"[^"]*"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[^\s>]*))?|=)*+)>?""", re.S)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def mark(name: str, attributes: str, in_article: bool) -> str:
    """``comment``, ``advert``, ``other`` or ``part`` if the class, id or role of an element says so, else nothing.

    A whole name that is such a word counts for any element but headings; a part of one (related-links) only for containers, and
    inside an article as ``part``, which is settled by what the element holds. Ids inside an article count for comments only. A
    container that is also named as a wrapper of content stays content unless it is named as comments or adverts.
    """
    if name[:1] == "h" and name[1:].isdigit():
        return ""
    found, wraps = "", False
    for m in _NAMES.findall(attributes):
        for token in "".join(m[1:]).lower().split():
            parts = [p for p in _PARTS.split(token) if p]
            if not parts or parts[0] in ABOUT:
                continue
            words = set(parts if name in CONTAINER else parts[:1] if len(parts) == 1 else ())
            if words & COMMENT_WORDS:
                return "comment"
            if m[0].lower() == "id" and (in_article or name not in CONTAINER):
                continue
            if words & ADVERT_WORDS:
                found = "advert"
            elif words & OTHER_WORDS and name in CONTAINER:
                found = found or ("part" if in_article and len(parts) > 1 else "other")
            else:
                wraps = wraps or bool(words & WRAP_WORDS)
    return found if found == "advert" or not wraps else ""


@dataclass
class _Open:
    """An open element, and whether it is an aside (or, in it, readers' comments), an article, a main element; held: the number of an element that may be an aside."""

    name: str
    aside: bool
    comment: bool
    article: bool
    main: bool
    held: int = -1


@dataclass(frozen=True, slots=True)
class Token:
    """kind: text, space or tag (``/name`` when closing). aside: in an element that is never content. article, main: in such an element."""

    kind: str
    value: str
    aside: bool
    article: bool
    main: bool


@dataclass(slots=True)
class _Held:
    """What an element that its name alone makes an aside holds: words, and those of them in links."""

    kind: str
    words: int = 0
    linked: int = 0

    def is_aside(self, total: int) -> bool:
        """Whether it is one on a page of ``total`` words: not if it holds most of them; by a part of its name in an article, if it is short or mostly links."""
        if 2 * self.words > total:
            return False
        return self.kind == "other" or 2 * self.linked >= self.words or 10 * self.words < total


def tokens(html: str) -> list[Token]:
    """The tokens of a page in order. Elements that only their names make asides are settled at the end, by what share of the page they hold."""
    held: list[_Held] = []
    drawn = list(_drawn(html, held))
    total = 0
    for t, within, linked in drawn:
        if t.kind == "text" and not t.aside:
            n = len(t.value.split())
            total += n
            for k in within:
                held[k].words += n
                held[k].linked += n * linked
    out = [h.is_aside(total) for h in held]
    return [replace(t, aside=True) if any(out[k] for k in within) and not t.aside else t for t, within, _ in drawn]


def _drawn(html: str, held: list[_Held]) -> Iterator[tuple[Token, tuple[int, ...], bool]]:
    """The tokens of a page in order, each with the numbers in ``held`` of the elements around it, and whether it lies in a link. Hidden elements give their tags only.

    A missing end tag of an aside element ends with its parent, and with the first article of the page unless that lies
    within it; an end tag that was never opened is nothing but a tag. Readers' comments are no articles.
    """
    stack: list[_Open] = []
    at, end, begun = 0, len(html), False

    where: tuple[bool, bool, bool] = (False, False, False)
    within: tuple[int, ...] = ()
    linked = False

    def seen() -> tuple[tuple[bool, bool, bool], tuple[int, ...], bool]:
        flags = any(x.aside for x in stack), any(x.article for x in stack), any(x.main for x in stack)
        return flags, tuple(x.held for x in stack if x.held >= 0), any(x.name in ("a", "button") for x in stack)

    while at < end:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else end]
        if text:
            yield Token("space" if text.isspace() else "text", text, *where), within, linked
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if depth is not None:
                del stack[depth:]
                where, within, linked = seen()
            yield Token("tag", "/" + name, *where), within, linked
            continue
        yield Token("tag", name, *where), within, linked
        if name in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = close.end() if close else end
            yield Token("tag", "/" + name, *where), within, linked
        elif name not in VOID and not m[3].endswith("/"):
            inside = where[1]
            said = mark(name, m[3], inside)
            label = name in ("article", "main") and said != "comment" and not any(x.comment for x in stack)
            aside = said == "comment" or name in HIDDEN or name in ASIDE or (name == "header" and not inside and not where[2])  # a page header is none of an article's own
            named = bool(said) and name not in ("html", "body") and not label
            aside = aside or (named and said == "advert")
            if label and not begun:
                begun = True
                for x in stack:
                    x.aside = x.aside and x.name in ASIDE and _around(html, at, x.name, name)
            number = -1
            if named and said in ("other", "part"):
                number = len(held)
                held.append(_Held(said))
            stack.append(_Open(name, aside, said == "comment", label and name == "article", label and name == "main", number))
            where, within, linked = seen()


def _around(html: str, at: int, outer: str, inner: str) -> bool:
    """Whether the ``inner`` element that begins at a place ends before ``outer`` does."""
    ends = [re.compile(rf"</{n}\b", re.I).search(html, at) for n in (inner, outer)]
    return bool(ends[0] and ends[1] and ends[0].start() < ends[1].start())


def labelled(page: list[Token]) -> list[bool]:
    """Which tokens lie in the article of a page, or where it has none with words, in its main element; none else."""
    for of in ("article", "main"):
        got = [getattr(t, of) for t in page]
        if any(t.kind == "text" and not t.aside and g for t, g in zip(page, got)):
            return got
    return [False] * len(page)


def _class(t: Token) -> str:
    bare = t.value.lstrip("/")
    return t.value if bare in KNOWN else "/other" if t.value[0] == "/" else "other"


def class_counts(html: str) -> Counter:
    """Words and tags by class, inside and outside the labelled region of a page; what asides hold is left out."""
    page = tokens(html)
    out: Counter = Counter()
    for t, inside in zip(page, labelled(page)):
        if t.kind == "tag":
            out[_class(t), inside] += not t.aside
        elif t.kind == "text" and not t.aside:
            out["word", inside] += len(t.value.split())
    return out


def fit_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weight of each class: the log of how much likelier it is inside labelled regions than outside.

    Labelled pages are those with an article or main element; FIT_PAGES of them in expectation are counted, by hash of
    the page. There are no more classes than elements in KNOWN, twice, and four. Words are held above zero, tags and words
    outside an article below.
    """
    known = pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.col(html_col).alias("html"))
    n = known.count()
    if not n:
        return {}
    sample = known.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < F.lit(int(min(1.0, FIT_PAGES / n) * (1 << 30))))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            total = sum((class_counts(t.as_py()) for t in b.column("html")), Counter())
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], ["class", "inside", "n"])

    rows = sample.mapInArrow(lean(count), "class string, inside boolean, n bigint").groupBy("class", "inside").agg(F.sum("n").alias("n")).collect()
    inside, outside = ({r["class"]: r["n"] for r in rows if r["inside"] is x} for x in (True, False))
    a, b = sum(inside.values()) + 1, sum(outside.values()) + 1
    ratio = {k: log((inside.get(k, 0) + 0.5) / a) - log((outside.get(k, 0) + 0.5) / b) for k in {*inside, *outside}}
    weights = {k: max(LEAST, v) if k == "word" else min(-LEAST, v) for k, v in ratio.items()}
    weights["outside word"] = min(OUTSIDE_WORD, log(0.5 / a) - log((outside.get("word", 0) + 0.5) / b))
    return weights


def scores(page: list[Token], weights: dict[str, float]) -> list[float]:
    """Score of each token. Spaces, and what asides hold, score nothing; the tags around an aside score as any."""
    word, outside = weights.get("word", WORD_DEFAULT), weights.get("outside word", OUTSIDE_WORD)
    inside = labelled(page)
    known = any(inside)
    out = []
    for t, own in zip(page, inside):
        if t.kind == "space" or t.aside:
            out.append(0.0)
        elif t.kind == "tag":
            out.append(weights.get(_class(t), TAG_DEFAULT))
        else:
            out.append(len(t.value.split()) * (word if own or not known else outside))
    return out


def best_region(values: list[float]) -> tuple[int, int]:
    """Bounds (first, past the last) of the contiguous run with the highest sum, by one linear scan; the first of equal ones.

    Empty, (0, 0), where no run is above zero.
    """
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, best_from, best_to = total, start, i + 1
    return best_from, best_to


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best region, joined by an empty line; references decoded, white space within a block made one space."""
    page = tokens(html or "")
    own = labelled(page)
    known = any(own)
    first, past = best_region(scores(page, weights))
    blocks: list[str] = []
    open_: list[str] = []
    for t, inside in zip(page[first:past], own[first:past]):
        if t.kind == "tag":
            name = t.value.lstrip("/")
            if name in BLOCK:
                blocks.append("".join(open_))
                open_ = []
            elif name == "br":
                open_.append(" ")
        elif not t.aside and (inside or not known):  # words between two articles are of neither
            open_.append(t.value)
    blocks.append("".join(open_))
    texts = (" ".join(unescape(b).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """``pages`` with ``text`` in place of the html column (and of any column named text).

    Null and empty pages, and pages without words, have the empty text. Repeated rows stay; other columns are carried
    along. Nothing but the named parts is dropped, whatever a page's length. An empty table gives no rows.
    """
    found = fit_weights(pages, html_col) if weights is None else weights
    kept = [c for c in pages.columns if c not in (html_col, "text")]

    @F.arrow_udf("string")
    def text(html: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py(), found) for h in html], pa.string())

    return pages.select(*kept, text(F.col(html_col)).alias("text"))


def extraction_report(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
