"""Main text of HTML pages by line-block distribution.

Markup is stripped so that each block element gives a line, in page order. Lines in menus, headers,
footers, sidebars, notices, adverts, forms and comments weigh nothing, as do lines that are mostly links.
The text lengths are summed over sliding windows of lines; a surge point is where the sums rise from
nothing, a dive point where they return to it. The run between the surge and the dive with the most
text finds the main text, short paragraphs in between included: the runs of the same container (the
nearest common box, and boxes beside it that are named alike) are joined with it, with the lists of links
between them. Where a page marks articles, the lines of the heaviest one alone have weight (of an element
"main" where its articles hold less than half of it), and the text is what lies between the first surge and
the last dive in it, so that lists of links at its ends go and all between stays.

Tags are read in one pass by the rules of the HTML standard, except that a tag which meets another "<" before
its end, outside quotes, is text; so is a "<" that begins none. Form controls count as forms.

Null or empty html, and pages without text that has weight, give an empty text. Pages of any length are read whole,
in time in proportion to their length. Rows are independent: repeated rows and ties give repeated results, nulls in
other columns stay, an empty table gives none, extra columns are ignored whatever their names, nothing is shuffled.
"""

from __future__ import annotations

import html as entities
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window.
WINDOW = 3
#: Characters that a window must hold for a surge, where no article is marked and some window holds as many.
SURGE = 80
#: Share of link text from which a line weighs nothing.
LINKS = 0.6

_WS = r"[ \t\n\f\r]"
#: A tag: its slash, name and attributes. Quantifiers are possessive, so that a failing match ends where it fails.
_TAG = regex.compile(
    rf"<(/?)([a-zA-Z][^ \t\n\f\r/><]*+)"
    rf"((?:[ \t\n\f\r/]++|[^ \t\n\f\r/>=<\"'][^ \t\n\f\r/>=<]*+(?:{_WS}*+={_WS}*+(?:\"[^\"]*+\"|'[^']*+'|[^ \t\n\f\r\"'<>][^ \t\n\f\r<>]*+|(?=[ \t\n\f\r>])))?+|[\"'=])*+)>"
)
#: Elements whose content is no text of the page.
_RAW = {name: regex.compile(rf"</{name}(?=[ \t\n\f\r/>])[^>]*+>?+", regex.I) for name in "script style template textarea svg select".split()}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """The page's tokens: ("text", text, ""), ("data", text, ""), ("raw", "", ""), ("open" or "close", name, attributes)."""
    at, text, size = 0, 0, len(page)
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        if after == "!" or after == "?" or (after == "/" and not page[at + 2 : at + 3].isalpha()):
            if page.startswith("<!--", at):
                ends = [k for k in (page.find("-->", at + 2), page.find("--!>", at + 4)) if k >= 0]
                end = page.index(">", min(ends)) + 1 if ends else size
                found = None
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                found = ("data", page[at + 9 : end if end >= 0 else size], "")
                end = end + 3 if end >= 0 else size
            else:
                end, found = page.find(">", at) + 1 or size, None
        else:
            tag = _TAG.match(page, at)
            if not tag:
                at += 1
                continue
            end, name = tag.end(), tag[2].lower()
            found = ("close" if tag[1] else "open", name, tag[3])
            if not tag[1] and name in _RAW:
                closed = _RAW[name].search(page, end)
                end, found = closed.end() if closed else size, ("raw", "", "")
        if at > text:
            yield "text", page[text:at], ""
        if found:
            yield found
        at = text = end
    if text < size:
        yield "text", page[text:], ""


_NAMES = regex.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", regex.I)
_HIDDEN = regex.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", regex.I)
_DROPPED_NAMES = regex.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|"
    r"footer|masthead|topbar|notice|notices|cookie|cookies|consent|popup|modal|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|"
    r"comment|comments|commentlist|disqus|reply|replies|respond|toolbar|pagination|pager|contentinfo|complementary|alert|gdpr|skip)(?=$|[\s_-]|s\b)",
    regex.I,
)
_ARTICLE_NAMES = regex.compile(r"(?:^|\s)(?:main|articlebody|article-body|post-content|entry-content)(?=$|\s)", regex.I)
_DROPPED = frozenset("nav footer aside form head title button dialog menu fieldset label option datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead title tr ul caption head".split()
)
#: Elements that set parts of a page apart; others, such as lists and sections, are parts of a text.
_BOXES = frozenset("body div html td".split())
#: Elements that hold text itself: their names must say in one word that they are dropped.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption em strong b i".split())
_PARTS = regex.compile("[-_]")
_DIGITS = regex.compile("[0-9]+")
#: Elements whose start ends an open one of the same kind.
_ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}


#: Open elements that an end tag may close.
DEPTH = 500
#: Level (article 2, main 1, none 0) of the mark a line is under, the outermost mark around it, and its own.
_UNMARKED = (0, 0, 0)


def _named_away(name: str, names: str) -> bool:
    """Whether an element's names say that it is no part of a text."""
    if not _DROPPED_NAMES.search(names):
        return False
    return name not in _TEXT or any(not _PARTS.search(x) and _DROPPED_NAMES.search(x) for x in names.split())


class _Line:
    __slots__ = ("box", "dropped", "links", "marked", "text")

    def __init__(self, text: str, links: int, dropped: bool, marked: tuple[int, int, int], box: int) -> None:
        self.text, self.links, self.dropped, self.marked, self.box = text, links, dropped, marked, box

    @property
    def weight(self) -> int:
        return 0 if self.dropped or self.links > LINKS * len(self.text) else len(self.text)


def lines(page: str) -> tuple[list[_Line], list[tuple[int, str, str]]]:
    """A line for each run of text between the borders of blocks, and the boxes they are in: each one's
    outer box, name, and class and id without digits. The first box is the page."""
    out: list[_Line] = []
    boxes = [(0, "", "")]
    stack: list[tuple[str, bool, tuple[int, int, int], int]] = []  # name, dropped, mark, box
    outside = (False, _UNMARKED, 0)
    marks = 0
    parts: list[str] = []
    links = 0
    linked = 0  # open links

    def flush() -> None:
        nonlocal links
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(_Line(text, links, *(stack[-1][1:] if stack else outside)))
        links = 0

    def take(text: str) -> None:
        nonlocal links
        parts.append(text)
        if linked:
            links += len(text.strip())

    for kind, name, attrs in tokens(page):
        if kind == "text":
            take(name)
            continue
        if kind == "data":
            take(name.replace("&", "&amp;"))
            continue
        if kind == "raw":
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            linked = 0 if kind == "close" else 1
            continue
        if name == "hr":
            flush()
        if name in _VOID:
            continue
        dropped, marked, box = stack[-1][1:] if stack else outside
        if kind == "close":
            if name in _BLOCK:
                flush()
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
                if stack[k][0] == name:
                    if any(s[1] for s in stack[k:]) and name not in _BLOCK:
                        flush()
                    del stack[k:]
                    break
            continue
        if attrs.endswith("/") and name not in _BLOCK:
            continue
        names = " ".join(x.strip("\"'") for x in _NAMES.findall(attrs)) if attrs else ""
        # A page's header is dropped, an article's holds its heading.
        drop = dropped or name in _DROPPED or (name == "header" and not marked[0]) or bool(names and name not in ("html", "body", "article", "main") and _named_away(name, names)) or bool(attrs and _HIDDEN.search(attrs))
        if name in _BLOCK or drop != dropped:
            flush()
        if name in _BLOCK:
            while stack and stack[-1][0] in _ENDS.get(name, ()) or (stack and stack[-1][0] not in _BLOCK and not stack[-1][1]):
                stack.pop()
            dropped, marked, box = stack[-1][1:] if stack else outside
            drop = drop and (dropped or name in _DROPPED or name == "header" or bool(names or attrs))
        if name in _BLOCK or drop != dropped:
            if name in _BOXES:
                boxes.append((box, name, _DIGITS.sub("", names)))
                box = len(boxes) - 1
            level = 2 if name == "article" else 1 if name == "main" or (names and _ARTICLE_NAMES.search(names)) else 0
            if level > marked[0]:
                marks += 1
                marked = (level, marked[1] if marked[0] else marks, marks)
            stack.append((name, drop, marked, box))
    flush()
    return out, boxes


def _container(found: list[_Line], weight: list[int], boxes: list[tuple[int, str, str]], start: int, end: int) -> tuple[int, list[bool]]:
    """The box that holds the lines from start to end, or boxes like it, and for each box whether it is in it."""
    way = [next(x.box for x, w in zip(found[start:end], weight[start:end], strict=True) if w)]
    while way[-1]:
        way.append(boxes[way[-1]][0])
    meets = {b: k for k, b in enumerate(way)}  # for each box, how far up the way it meets it
    at = 0
    for x, w in zip(found[start:end], weight[start:end], strict=True):
        b, passed = x.box, []
        while w and b not in meets:
            passed.append(b)
            b = boxes[b][0]
        meets.update((c, meets[b]) for c in passed)
        at = max(at, meets[b]) if w else at
    held = [0] * len(boxes)
    for x, w in zip(found, weight, strict=True):
        held[x.box] += w
    for b in range(len(boxes) - 1, 0, -1):  # an outer box comes before those in it
        held[boxes[b][0]] += held[b]
    alike = Counter(boxes[b] for b in range(1, len(boxes)) if held[b] >= SURGE)
    while way[at] and alike[boxes[way[at]]] > 1:
        at += 1
    inside = [b == way[at] for b in range(len(boxes))]
    for b in range(1, len(boxes)):
        inside[b] = inside[b] or inside[boxes[b][0]]
    return way[at], inside


def _article(found: list[_Line]) -> list[_Line]:
    """The lines of the marked article, those at its ends that no window reaches left out; none if nothing is marked."""
    weight: Counter[int] = Counter()
    for x in found:
        if x.marked[0] and not x.dropped:
            for mark in {x.marked[1], x.marked[2]}:
                weight[mark] += len(x.text)
    if not weight:
        return []
    outer = max(sorted(weight), key=weight.__getitem__)
    inner = {x.marked[2] for x in found if x.marked[0] == 2 and not x.dropped}
    best = max(sorted(inner), key=weight.__getitem__, default=outer)
    mark = best if 2 * weight[best] >= weight[outer] else outer
    held = [x for x in found if mark in x.marked[1:] and not x.dropped]
    sums = [sum(x.weight for x in held[k : k + WINDOW]) for k in range(len(held))]
    surging = [k for k, total in enumerate(sums) if total]
    if not surging:
        return held
    end = surging[-1] + 1
    return held[surging[0] : len(held) if len(held) - end < WINDOW else end]


def main_text(page: str | None) -> str:
    """The text between the surge and the dive point of the heaviest run of lines."""
    found, boxes = lines(page or "")
    own = _article(found)
    if own:
        return "\n\n".join(x.text for x in own)
    weight = [x.weight for x in found]
    sums = [sum(weight[k : k + WINDOW]) for k in range(len(weight))]
    need = SURGE if max(sums, default=0) >= SURGE else 1  # a page of short lines may surge lower
    best, best_sum, k = (0, 0), 0, 0
    runs = []
    while k < len(sums):
        if sums[k] < need:
            k += 1
            continue
        surge = k
        while k < len(sums) and sums[k] > 0:
            k += 1
        dive = k
        runs.append((surge, dive))
        if sum(weight[surge:dive]) > best_sum:
            best, best_sum = (surge, dive), sum(weight[surge:dive])
    start, end = best
    if not best_sum:
        return ""
    box, inside = _container(found, weight, boxes, start, end)
    if boxes[box][1] == "div":  # a part of the page: all of it
        joined = [k for k, x in enumerate(found) if weight[k] and inside[x.box]]
    else:  # the page: what surges
        joined = [k for surge, dive in runs for k in range(surge, dive) if weight[k] and inside[found[k].box]]
    start, end = min(start, joined[0]), max(end, joined[-1] + 1)
    while start > 0 and weight[start - 1]:  # short lines just before the surge
        start -= 1
    kept = [k for k in range(start, end) if weight[k]]
    return "\n\n".join(x.text for x in found[kept[0] : kept[-1] + 1] if not x.dropped)


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of df (page_id, url, html)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 500):
                some = part.slice(at, 500)
                texts = [main_text(h) for h in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return df.select(F.col("page_id"), F.col("url"), F.col("html")).mapInArrow(batches, "page_id long, url string, text string, n_chars long")
