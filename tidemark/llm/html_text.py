"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score positive and tags negative;
the contiguous region of the highest sum, found in one linear scan, is the main
content (Pasternack and Roth 2009). The weights are log-odds learnt from
labelled pages: how often a tag, or a word inside such a tag, lies inside the
content of a page rather than outside; that a page names its article enters as
such a feature, and nothing replaces the region. Elements that are never content,
by their name or by words of their class, id or role, are cut from the region;
such a word cuts no element that may be a wrapper of the content.

Scale. One pass over the pages, no shuffle, linear in each page; the labelled
sample is bounded by ``LABELLED`` pages and only counts of features leave it, one
for each known element.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

LABELLED = 2000

#: Element names of HTML by their role.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary"
    " table tbody td tfoot th thead title tr ul".split()
)
CUT = frozenset("nav footer aside button select menu dialog head object audio video canvas".split()) | RAW
#: Elements that hold controls or a page's head, or wrap the content.
MAYBE = frozenset("form header".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label legend map mark meter nobr output progress"
    " q rp rt ruby s samp slot small span strike strong sub sup time tt u var".split()
)
#: Words of class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments cookie"
    " cookies consent disqus footer header masthead menu menus modal nav navbar navigation newsletter notice notices"
    " pagination popup promo promos promoted recommend recommended related replies reply respond share sharing sidebar"
    " sidebars signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Those that mark adverts, those of the head of a page or article, those that tell an article's head.
ADS = frozenset("ad ads advert adverts advertisement advertising promo promos promoted sponsor sponsored".split())
HEADS = frozenset("header masthead banner".split())
#: Those of readers' comments, and words beside them that make a wrapper.
THREAD = frozenset("comment comments disqus replies reply respond".split())
WITH = frozenset("and has no with without".split())
OWN = frozenset("article blog content entry headline news page post story title".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text, which marks other than those of adverts do not cut.
PROSE = frozenset("p li blockquote td th dd dt figcaption caption pre em strong span a b i".split())
#: The largest share of a page's words that a mark alone may cut, and that a form may;
#: the least share that must be left outside of marked elements where comments are cut whatever their length.
SHARE, FORM_SHARE, LEFT = 0.25, 0.5, 0.02
#: Elements that name the article itself.
MAIN = frozenset("article main".split())

START = re.compile(r"<!--|<[!?]|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)")
#: The rest of a tag. A quote counts after an equals sign if it is closed; only the last quote of a page can be open, so no text is read twice.
REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+")
ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I | re.S)
SPACE = re.compile(r"\s+")
#: References to numbers beyond any character.
LONG = re.compile(r"&#0*+[0-9]{8,}+;?")

Token = tuple[str, str, bool]  # kind, name or text, inside something that is cut


def _words(value: str) -> list[str]:
    return [w.lower() for w in re.split(r"[^A-Za-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value)) if w]


def _mark(name: str, attrs: str) -> str:
    """What class, id or role say: "noise", "thread" (comments), "head" (of a page or an article), "own" (head of an article) or nothing.

    Ids of sections must be made of marks and headings have none, since ids are
    often made from titles; running text is marked by adverts only.
    """
    if name in HEADING:
        return ""
    for m in ATTR.finditer(attrs):
        words = _words(m[2] or m[3] or m[4] or "")
        some = {w for w in words if w in (ADS if name in PROSE else MARKS)}
        if some and not (name == "section" and m[1].lower() == "id" and not all(w in MARKS for w in words)):
            if some <= HEADS:
                return "own" if any(w in OWN for w in words) else "head"
            return "thread" if some & THREAD and not any(w in WITH for w in words) else "noise"
    return ""


class _Element:
    """One that may be cut: its tokens, the one around it, what speaks for it."""

    __slots__ = ("kind", "first", "end", "around")

    def __init__(self, kind: str, first: int, around: int) -> None:
        self.kind, self.first, self.end, self.around = kind, first, first + 1, around


def tokens(page: str) -> Iterator[Token]:
    """("open" | "close" | "text", name or raw text, cut) of a page, comments and declarations left out.

    An end tag closes the innermost open element of its name; without one it is
    ignored. Elements left open close with the one around them. Every character
    is read once and every open element is left once, so the time is linear.

    A marked element is cut if it holds at most ``SHARE`` of the page's words
    and no article element, or if it lies beside the article elements. One that
    holds article elements is cut only if it is that small and there are
    others outside of marked elements. So no wrapper of the content is cut.
    Forms and headers are such elements by their name; a form may hold up to
    ``FORM_SHARE`` of the words, and the head of an article, with its title, stays.
    Comments are cut whatever their length if ``LEFT`` of the words are outside of
    marked elements; a comment may be an article element.
    """
    # kind, value, cut by name, number of the innermost element around that may be cut
    found: list[tuple[str, str, bool, int]] = []
    may: list[_Element] = []
    # name, cut, element that may be cut, place of the innermost paragraph or block
    stack: list[tuple[str, bool, int, int]] = []
    open_: Counter[str] = Counter()
    at, n = 0, len(page)

    def close(where: int) -> None:
        around = stack[where - 1][2] if where else -1
        k = stack[-1][2]
        while k != around:
            may[k].end = len(found)
            k = may[k].around
        for name, *_ in stack[where:]:
            open_[name] -= 1
        del stack[where:]

    while at < n:
        m = START.search(page, at)
        cut, mine = stack[-1][1:3] if stack else (False, -1)
        if m is None:
            found.append(("text", page[at:], cut, mine))
            break
        if m.start() > at:
            found.append(("text", page[at : m.start()], cut, mine))
        if not m["name"]:
            mark = "-->" if m[0] == "<!--" else ">"
            # "<!-->" and "<!--->" are whole comments
            end = page.find(mark, m.start() + 2 if m[0] == "<!--" else m.end())
            at = end + len(mark) if end >= 0 else n
            continue
        at = REST.match(page, m.end()).end()
        attrs = page[m.end() : at]
        at += 1
        name = m["name"].lower()
        if m["close"]:
            if open_[name]:
                where = len(stack) - 1
                while stack[where][0] != name:
                    where -= 1
                close(where)
            found.append(("close", name, *(stack[-1][1:3] if stack else (False, -1))))
            continue
        if name == "p" and stack and (k := stack[-1][3]) >= 0 and stack[k][0] == "p":
            # a paragraph ends where the next begins
            close(k)
            cut, mine = stack[-1][1:3] if stack else (False, -1)
        around = mine
        kind = name if name in MAYBE else "" if name in CUT or name in ("body", "html") else _mark(name, attrs)
        if name in MAIN and kind != "thread":
            kind = ""
        if kind:
            mine = len(may)
            may.append(_Element(kind, len(found), around))
        found.append(("open", name, cut or name in CUT, mine))
        if name in VOID or attrs.endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            found.append(("close", name, cut, around))
            continue
        block = len(stack) if name in BLOCK else stack[-1][3] if stack else -1
        stack.append((name, cut or name in CUT, mine, block))
        open_[name] += 1
    if stack:
        close(0)
    gone = _gone(found, may) if may else []
    for k, e in enumerate(may):
        # elements come after those around them
        gone[k] = gone[k] or (e.around >= 0 and gone[e.around])
    for kind, value, cut, k in found:
        yield kind, value, cut or (k >= 0 and gone[k])


def _gone(found: list[tuple[str, str, bool, int]], may: list[_Element]) -> list[bool]:
    """For each element that may be cut whether it is, for itself."""
    depths = _depths([(kind, value, cut) for kind, value, cut, _ in found])
    words, mains, titles, menus = [0], [0], [0], [0]
    free, left = False, 0
    for (kind, value, cut, k), depth in zip(found, depths):
        words.append(words[-1] + (len(value.split()) if kind == "text" and not cut else 0))
        mains.append(mains[-1] + (kind == "open" and value in MAIN and not cut))
        titles.append(titles[-1] + (kind == "open" and value in HEADING and not cut))
        menus.append(menus[-1] + (kind == "open" and value in ("nav", "menu")))
        free = free or (kind == "text" and depth > 0 and not cut and k < 0 and not value.isspace())
        left += words[-1] - words[-2] if k < 0 else 0
    out = []
    for e in may:
        share = words[e.end] - words[e.first]
        small = share <= (FORM_SHARE if e.kind == "form" else SHARE) * words[-1]
        titled = titles[e.end] > titles[e.first] and menus[e.end] == menus[e.first]
        if e.kind == "thread" and left >= max(1, LEFT * words[-1]):
            out.append(True)
        elif mains[e.end] > mains[e.first]:
            out.append(free and small)
        elif titled and (e.kind == "own" or (e.kind in ("head", "header") and depths[e.first] > 0)):
            out.append(False)
        else:
            out.append(small or (free and depths[e.first] == 0))
    return out


def _depths(found: list[Token]) -> list[int]:
    """For each token how many uncut article elements are around it, their own tags within."""
    out: list[int] = []
    open_: list[str] = []
    names: Counter[str] = Counter()
    for kind, value, cut in found:
        if kind == "open" and value in MAIN and not cut:
            open_.append(value)
            names[value] += 1
        out.append(len(open_))
        if kind == "close" and names[value]:
            while True:
                name = open_.pop()
                names[name] -= 1
                if name == value:
                    break
    return out


class _Blocks:
    """The innermost open block while tokens pass."""

    def __init__(self) -> None:
        self.open: list[str] = ["#page"]
        self.names: Counter[str] = Counter()

    def pass_(self, kind: str, value: str) -> str:
        if kind == "open" and value in BLOCK and value not in VOID:
            self.open.append(value)
            self.names[value] += 1
        elif kind == "close" and self.names[value]:
            while True:
                name = self.open.pop()
                self.names[name] -= 1
                if name == value:
                    break
        return self.open[-1]


#: Elements with a feature of their own; all others share one, so the number of features has a bound.
KNOWN = BLOCK | VOID | RAW | CUT | MAYBE | INLINE


def _plain(kind: str, value: str, block: str) -> str:
    return f"word in {block}" if kind == "text" else f"tag {value if value in KNOWN else 'other'}"


def _scored(page: str) -> list[tuple[str, str, bool, str, int]]:
    """Tokens with their feature and how many words they hold; words stand in a run of their element.

    Where article elements hold half of the words or more, being in one or
    beside them is the feature; where they hold less they may be teasers, and
    the features are those of a page without them.
    """
    found = list(tokens(page))
    depths = _depths(found)
    words = [len(value.split()) if kind == "text" else 1 for kind, value, _ in found]
    within = [n * (d > 0) for (kind, _, cut), n, d in zip(found, words, depths) if kind == "text" and not cut]
    every = sum(n for (kind, _, cut), n in zip(found, words) if kind == "text" and not cut)
    named = 0 < every <= 2 * sum(within)
    out, blocks = [], _Blocks()
    for (kind, value, cut), n, depth in zip(found, words, depths):
        block = blocks.pass_(kind, value)
        if cut and named and depth:
            feature = "cut in article"
        elif kind == "text" and cut:
            feature = "word in cut"
        elif named:
            feature = f"{'word' if kind == 'text' else 'tag'} {'in' if depth else 'beside'} article"
        else:
            feature = _plain(kind, value, block)
        out.append((kind, value, cut, feature, n))
    return out


def _label(page: str) -> list[tuple[str, int, bool]] | None:
    """(feature, count, inside) of each token of a page that marks its article, None for other pages.

    A token counts for its feature and, where that tells of the article, also
    for the one it has on pages without articles.
    """
    found = list(tokens(page))
    depths = _depths(found)
    if not any(depths):
        return None
    out, blocks = [], _Blocks()
    for (kind, value, cut, feature, n), depth in zip(_scored(page), depths):
        inside = depth > 0 and not cut
        block = blocks.pass_(kind, value)
        out.append((feature, n, inside))
        if feature.endswith(" article"):
            out.append(("word in cut" if cut and kind == "text" else _plain(kind, value, block), n, inside))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            for feature, n, own in _label(t or "") or ():
                (inside if own else outside)[feature] += n
    names = list(inside.keys() | outside.keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), *[pa.array([c[k] for k in names], pa.int64()) for c in (inside, outside)]],
        ["feature", "inside", "outside"],
    )


#: Before any page is seen: words speak for content, tags against it, cut words strongly.
PRIOR = {
    "word": 1.0, "tag": -0.8, "word in cut": -6.0,
    "word in article": 2.0, "tag in article": 0.0, "cut in article": 0.0, "word beside article": -2.0, "tag beside article": -0.8,
}
#: What is cut leaves the text wherever the region ends, so inside an article it says nothing.
FIXED = ("word in cut", "cut in article")


def learn(pages: DataFrame, html_col: str = "html", most: int = LABELLED) -> dict[str, float]:
    """Weights from labelled pages, those that mark their article; of more than ``most`` the ones of smallest hash.

    A feature's weight is its smoothed log-odds of lying inside, moved to the
    sign of its kind: words in content are positive, tags negative.
    """
    scratch = Scratch(pages.sparkSession, "html")
    sample = pages.select(F.col(html_col).cast("string").alias("html")).where(F.col("html").isNotNull())
    sample = sample.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    count = sample.count()
    if count > most:
        # hashes alone are sorted, those below a share of all that leaves enough; equal pages count once
        hash_ = F.pmod(F.xxhash64("html"), F.lit(1 << 40))
        low = sample.select(hash_.alias("h")).where(F.col("h") < F.lit(int((2.0 * most / count) * (1 << 40)))).distinct()
        cut = low.orderBy("h").limit(most).agg(F.max("h")).first()[0]
        sample = sample.where(hash_ <= F.lit(cut if cut is not None else -1)).dropDuplicates(["html"])
    counts = sample.mapInArrow(_count, "feature string, inside long, outside long").groupBy("feature").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside")
    )
    rows = scratch.save(counts, "counts").collect()
    scratch.clear()
    weights = dict(PRIOR)
    for r in rows:
        odds = math.log((r.inside + 1) / (r.outside + 1))
        if r.feature in FIXED:
            continue
        if r.feature == "tag in article":
            weights[r.feature] = max(-4.0, min(0.0, odds))
        elif r.feature.startswith("word"):
            weights[r.feature] = max(-4.0, min(2.0, odds))
        elif r.feature.startswith("tag"):
            weights[r.feature] = max(-4.0, min(-0.05, odds - 1.0))
    return weights


def region(scored: list[tuple[str, str, bool, str, int]], weights: dict[str, float]) -> tuple[int, int]:
    """(first, end) of the tokens whose sum of scores is highest, the first such; (0, 0) if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, _, _, feature, n) in enumerate(scored):
        w = weights.get(feature)
        if w is None:
            w = weights["word" if kind == "text" else "tag"]
        if total <= 0:
            total, start = 0.0, i
        total += w * n
        if total > best:
            best, at = total, (start, i + 1)
    return at


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text: blocks joined by an empty line, white space inside a block as one space."""
    scored = _scored(page or "")
    first, end = region(scored, weights)
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = SPACE.sub(" ", html.unescape(LONG.sub("\ufffd", "".join(run)))).strip()
        if text:
            blocks.append(text)
        run.clear()

    for kind, value, cut, _, _ in scored[first:end]:
        if kind == "text":
            if not cut:
                run.append(value)
        elif value in BLOCK:
            close()
    close()
    return "\n\n".join(blocks)


def main_text(
    pages: DataFrame,
    weights: dict[str, float],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(page_id, url, text, n_chars): one row per input row.

    Null and empty pages, and pages without words outside what is cut, have an
    empty text. Ids and urls are passed on as they are, nulls too; repeated rows
    each get their row; extra columns of any name are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [extract(t.as_py(), weights) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    Scratch(pages.sparkSession, "html")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
