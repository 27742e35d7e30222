"""Main text of web pages by the maximum-scoring contiguous region.

A page is read as a row of scored tokens, pieces of text and tags, and one linear scan finds the contiguous run with the
highest sum; nothing else chooses the place or the bounds of the text.

A piece of text scores its letters (characters that aren't white space, so that scripts without blanks count like all
others) times the worth of the element that it stands in, from 1 to -1, and a tag scores minus its weight.  Both come
from labelled pages, those with exactly one ``article`` or ``main`` (below): the worth of an element is the letters
directly in it inside the content less those outside, as a share; the weight of a tag is the mean run of letters outside
the content times the surplus of its uses outside, as a share.  An element never seen is worth 1, a link 0.

What is known of names comes first: text in an element that by its name, role, class or id is a menu, footer, form,
advert, reader comment or the like scores minus its letters, whatever it is worth.  A class or id counts only as a whole
name (or if it is made of such names, as ``cookie-banner``).  As pages also give such names to what holds everything,
the number of class names around a text matters only beyond those around the content: around the only ``article`` or
``main``, else none, or if no region is then worth more than a mean run of letters outside content, as few as give one.

A page with exactly one outermost ``article`` or ``main`` that holds text (of several, only those with the fewest class
names around them are looked at) is labelled itself: letters outside score minus 1, inside 1, and tags and boilerplate
inside score nothing, so that no advert or list can end the region.  On pages with several, as cards, they are elements
like all others.

The run is widened to whole blocks of text.  Of what lies between its first and last text that scores above 0,
boilerplate is left out, and so is a block of which nothing scores 0 or more: an advert in the middle of the article.

Defined results: a null or empty page has the empty text and 0 characters; white space is what HTML calls so (space,
tab, line feed, form feed, return) and the vertical tab; rows are independent, so repeated ids, nulls and extra
columns, whatever their names, change nothing; of regions with the same score the first is taken; an empty table gives
an empty result, and without labelled pages all weights are those of elements never seen.  Pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of elements in the HTML standard, by their part in a page, and usual class and role names.
SILENT = frozenset("head svg canvas object audio video map math".split())
ASIDE = frozenset("nav header footer aside form button select option dialog menu".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
MARKED = frozenset(("article", "main"))
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup login paywall sidebar sidenav menu nav navbar navigation navigator breadcrumb breadcrumbs footer topbar toolbar masthead comment comments commentlist discussion disqus replies respond share sharing social related recommended recommendations popup popover modal overlay widget widgets pagination pager skip hidden".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An open element of the first kind ends where one of the second begins.
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "html", "head", "body", "title"}

#: Weight of a tag at least; uses and letters of an unseen element that stand for what is not known yet; run of letters
#: without labelled pages; names whose counts reach the driver (pages may make up names without end).
LEAST, FEW_TAGS, FEW_LETTERS, UNSEEN_RUN, MOST_NAMES = 0.1, 20, 500, 25.0, 10_000
TEXT_IN, RUN, ALL_LETTERS, ALL_RUNS = "text in ", "mean run", "all letters", "all runs"

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_HINT_ATTR = re.compile(r"""\b(class|id|role|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?<![-\w])(hidden)(?![-\w=])""", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WHITE = re.compile(r"[ \t\n\r\f\v]+")
_NAME_PART = re.compile(r"[a-z]+")


def _hinted(value: str) -> bool:
    """Whether one of the names in a class or id consists of hints only."""
    return any((parts := _NAME_PART.findall(x)) and HINTS.issuperset(parts) for x in value.split())


def _boilerplate(name: str, attrs: str, marked: bool) -> str:
    """Empty, or what makes the element's words negative: 'element' (name, role, hidden) or 'class'."""
    if name in ASIDE:
        return "" if marked and name == "header" else "element"
    if not attrs or name in ("html", "body") or name in MARKED and "comment" not in attrs:
        return ""
    by_class = name in MARKED
    for key, value, bare in _HINT_ATTR.findall(attrs):
        value = value.strip("\"'").lower()
        if bare or key.lower() == "aria-hidden" and value == "true" or key.lower() == "role" and value in ROLES:
            return "element"
        by_class = by_class or key.lower() in ("class", "id") and _hinted(value)
    return "class" if by_class else ""


@dataclass(frozen=True)
class Token:
    """A tag or a piece of text; ``name``: of the tag, or of the element, with its classes, that the text stands in (``a`` in a link).

    ``aside``: in an element that is boilerplate by its name or role; ``level``: class names of boilerplate around it;
    ``mark``: number of the outermost ``article`` or ``main`` around it, or -1.
    """

    tag: bool
    name: str
    text: str
    aside: bool
    level: int
    mark: int
    letters: int = 0


def _letters(text: str) -> int:
    return len("".join((html.unescape(text) if "&" in text else text).split()))


def tokens(page: str) -> list[Token]:
    return list(_read(page))


def _read(page: str) -> Iterator[Token]:
    stack: list[tuple[str, bool, bool, bool, bool, str]] = []  # name, silent, aside, class name of boilerplate, outermost mark, name with classes
    silent = aside = level = at = marks = links = 0
    mark = -1

    def pop() -> None:
        nonlocal silent, aside, level, mark, links
        name, s, a, c, m, _ = stack.pop()
        silent -= s
        aside -= a
        level -= c
        links -= name == "a"
        if m:
            mark = -1

    while at < len(page):
        found = _TOKEN.search(page, at)
        text = page[at:found.start()] if found else page[at:]
        if text and not silent:
            yield Token(False, "a" if links else stack[-1][5] if stack else "body", text, aside > 0, level, mark, _letters(text))
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name == "br":
                yield Token(True, name, "", aside > 0, level, mark)
            elif any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    pop()
                inside = aside > 0, level, mark
                was = silent
                pop()
                if not was:
                    yield Token(True, name, "", *inside)
            continue
        attrs = found[3]
        if name in CLOSES_P and any(x[0] == "p" for x in stack):
            while stack and (last := stack[-1][0]) != "p" and last not in BLOCK:
                pop()
            if stack and stack[-1][0] == "p":
                pop()
        for end in IMPLIED_END.get(name, ()):
            if stack and stack[-1][0] == end:
                pop()
        if name in MARKED:  # content never stands inside a menu or footer: an unclosed one ends here
            while aside and any(x[2] and x[0] in ("nav", "header", "footer") for x in stack):
                pop()
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in VOID:
            if not silent:
                yield Token(True, name, "", aside > 0, level, mark)
            continue
        if attrs.endswith("/") and name not in BLOCK:
            continue
        why = _boilerplate(name, attrs, mark >= 0)
        first = name in MARKED and why == "" and mark < 0 and not aside and not silent
        classes = _CLASS.search(attrs) if "class" in attrs else None
        full = " ".join([name, *sorted(set(classes[1].strip("\"'").lower().split()))])[:80] if classes else name
        stack.append((name, name in SILENT, why == "element", why == "class", first, full))
        silent += stack[-1][1]
        aside += stack[-1][2]
        level += stack[-1][3]
        links += name == "a"
        if first:
            mark, marks = marks, marks + 1
        if not silent:
            yield Token(True, name, "", aside > 0, level, mark)


def only_mark(row: list[Token]) -> tuple[int, int]:
    """(number, class names around it) of the one article or main that labels the page, or (-1, 0)."""
    held: dict[int, int] = {}
    for x in row:
        if x.mark >= 0 and not x.tag and not x.aside and x.letters:
            held[x.mark] = min(held.get(x.mark, x.level), x.level)
    fewest = min(held.values(), default=0)
    best = [m for m, level in held.items() if level == fewest]
    return (best[0], fewest) if len(best) == 1 else (-1, 0)


def count_page(page: str) -> Counter | None:
    """Of a labelled page: (what, inside the content) to letters, uses and runs; None if it isn't labelled.

    What is known by its names to be boilerplate teaches what text in its elements is worth, but nothing of tags and links:
    a menu says nothing against other lists.
    """
    row = tokens(page)
    mark, level = only_mark(row)
    if mark < 0:
        return None
    out: Counter = Counter()
    for x in row:
        inside, known = x.mark == mark, x.aside or x.level > level
        if not x.tag and not inside and (n := x.letters):
            out[ALL_LETTERS, False] += n
            out[ALL_RUNS, False] += 1
        if x.name.split(" ")[0] in MARKED or known and (x.tag or x.name == "a"):
            continue
        out[(x.name if x.tag else TEXT_IN + x.name), inside and not known] += 1 if x.tag else x.letters
    return out


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Weights of tags, ``text in`` elements their worth, and the mean run of letters outside content."""
    if not counts:
        return {}
    run = counts.get((ALL_LETTERS, False), 0) / max(1, counts.get((ALL_RUNS, False), 0))
    out = {RUN: run}
    for name in {name for name, _ in counts} - {ALL_LETTERS, ALL_RUNS}:
        inside, outside = counts.get((name, True), 0), counts.get((name, False), 0)
        if name.startswith(TEXT_IN):
            prior = 0 if name == TEXT_IN + "a" else 1
            out[name] = (inside - outside + FEW_LETTERS * prior) / (inside + outside + FEW_LETTERS)
        else:
            out[name] = max(LEAST, run * (outside - inside) / (outside + inside + FEW_TAGS))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for page in batch.column(0):
            total.update(count_page(page.as_py()) or {})
        if total:
            columns = [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.bool_()), pa.array(list(total.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "inside", "n"])


def fit_weights(pages: DataFrame, html_col: str = "html", sample: int = 400) -> dict[str, float]:
    """Weights from at most ``sample`` different pages with a mark, those with the lowest hash of their html; counted by tasks."""
    labelled = pages.select(pages[html_col].cast("string").alias("html")).where(F.lower("html").rlike(r"<(article|main)[\s>]")).withColumn("h", F.xxhash64("html"))
    # hashes first: no page comes to the driver, whatever its length
    chosen = [r["h"] for r in labelled.select("h").distinct().orderBy("h").limit(sample).collect()]
    if not chosen:
        return {}
    rows = labelled.where(F.col("h") <= chosen[-1]).dropDuplicates(["h"]).select("html").mapInArrow(_counted, "name string, inside boolean, n long")
    counts = rows.groupBy("name", "inside").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(MOST_NAMES)
    return weights_of({(r["name"], r["inside"]): r["n"] for r in counts.collect()})


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and one past the last of the contiguous run with the highest sum; the first such run; (0, 0) if none is above 0."""
    best, at = 0.0, (0, 0)
    total, begin = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, at = total, (begin, i + 1)
    return at


def token_scores(row: list[Token], weights: dict[str, float], mark: int, level: int) -> list[float]:
    """What each token adds to a region that holds it, where ``mark`` labels the page (or -1) and ``level`` class names don't count."""
    out = []
    for x in row:
        low = x.aside or x.level > level
        if x.tag:
            out.append(0.0 if 0 <= mark == x.mark else -weights.get(x.name, 1.0 if x.name in BLOCK else LEAST))
        elif mark >= 0:
            out.append(-float(x.letters) if x.mark != mark else 0.0 if low else float(x.letters))
        else:
            out.append(-float(x.letters) if low else x.letters * weights.get(TEXT_IN + x.name, 0.0 if x.name == "a" else 1.0))
    return out


def region(row: list[Token], weights: dict[str, float]) -> tuple[int, int, int, list[float]]:
    """(begin, end, class names that don't count, scores) of the best region of a page."""
    mark, level = only_mark(row)
    if mark >= 0:
        scores = token_scores(row, weights, mark, level)
        return *best_region(scores), level, scores
    held = None
    for level in sorted({x.level for x in row} | {0}):
        scores = token_scores(row, weights, -1, level)
        begin, end = best_region(scores)
        if begin < end and held is None or sum(scores[begin:end]) > weights.get(RUN, UNSEEN_RUN):
            held = begin, end, level, scores
            if sum(scores[begin:end]) > weights.get(RUN, UNSEEN_RUN):
                break
    return held or (0, 0, 0, scores)


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page: blocks joined by line feeds."""
    row = tokens(page or "")
    begin, end, level, scores = region(row, weights)
    low = [not x.tag and (x.aside or x.level > level) for x in row]
    wall = lambda i: row[i].name in BLOCK if row[i].tag else low[i] or scores[i] < 0
    while 0 < begin < end and not wall(begin - 1):
        begin -= 1
    while begin < end < len(row) and not wall(end):
        end += 1
    good = [i for i in range(begin, end) if not row[i].tag and scores[i] > 0]
    blocks, now, worth = [], [], False
    for i in range(begin, end + 1):
        if i < end and not row[i].tag:
            inner = good[0] < i < good[-1]
            if not (low[i] and inner):
                now.append(html.unescape(row[i].text))
                worth = worth or scores[i] >= 0 and row[i].letters > 0 or not inner
        elif i == end or row[i].name in BLOCK:
            if worth and (line := _WHITE.sub(" ", "".join(now)).strip(" ")):
                blocks.append(line)
            now, worth = [], False
    return "\n".join(blocks)


def _run(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = fit_weights(pages, html_col) if weights is None else weights
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(_run(weights), "page_id long, url string, text string, n_chars long")
