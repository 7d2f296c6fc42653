"""Main text of web pages by line-block distribution.

Markup is stripped to lines: a block element ends a line, character references are decoded,
white space becomes one space. Lines in elements that the page itself names as menu, header,
footer, sidebar, notice, advert, form or comments go with the markup. Over the lines that are
left runs a window of a few lines; the curve of their summed weights surges where an article
begins and dives where it ends, and all text between surge and dive is kept, a page's other
text is not. A line weighs as many characters as it has outside links; where a page marks an
article element, a line outside it weighs nothing, but only the curve sets the borders.

Each page is one row of a map over the table: no shuffle, memory bounded by the page.

Defined cases: null or blank html gives the empty text; unclosed and stray tags are
read as browsers do for blocks; on a page too short for a surge the lines with weight are the
text; repeated rows are extracted alike; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines of one window.
BLOCK_LINES = 3
#: Summed characters at which the curve surges.
SURGE = 60

#: Elements that end a line of text where they begin and where they end.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template iframe svg math canvas object audio video head textarea select".split())
#: Elements that hold an article's sentences and items: their links are part of it.
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
#: Elements that hold what isn't the article.
ASIDE = frozenset("nav footer aside form menu dialog button header".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role values that name boilerplate, and words that may stand beside them.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header "
    "login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promos promotion related replies respond share "
    "sharing sidebar signup social sponsor sponsored sponsors subscribe toolbar widget complementary contentinfo search".split()
)
FILLERS = frozenset(
    "area articles bar block bottom box button buttons container content desktop form global google group inner item items left links list main "
    "mobile nav navi outer page panel posts primary reader right row secondary section site slot text top unit user wrap wrapper".split()
)
#: Names that an article's own parts may have.
OWN = frozenset("header search".split())
_PARTS = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)(\s*/?>)?", re.S)
#: An attribute as HTML reads it: a bare value may hold quotes.
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*|(?=>)))?)?)?""")
_RAW = {t: re.compile(f"</{t}", re.I | re.A) for t in ("script", "style", "textarea", "noscript", "iframe", "template")}
_WHITE = re.compile(r"\s+")


def _named(value: str, inside: bool) -> bool:
    """Whether one of the names in a class, id or role value says boilerplate: all its words are
    names or fillers, so ``site-footer`` does and ``related-work`` doesn't."""
    for token in _CAMEL.sub("-", value).lower().split():
        words = [w for w in _PARTS.findall(token) if not w.isdigit()]
        if any(w in NAMES and not (inside and w in OWN) for w in words) and all(w in NAMES or w in FILLERS for w in words):
            return True
    return False


def _boilerplate(tag: str, attributes: list[tuple[str, str]], inside: bool) -> bool:
    if tag in ASIDE:
        return not (inside and tag == "header")
    if tag in ("body", "html", "main", "article"):
        return False
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            return True
        if name in ("class", "id", "role") and _named(value, inside):
            return True
    return False


def _attributes(html: str, at: int) -> tuple[int, list[tuple[str, str]], bool]:
    """(place after the tag's end, or -1 if it has none; attributes; whether it closes itself)."""
    found: list[tuple[str, str]] = []
    while True:
        m = _ATTRIBUTE.match(html, at)
        if m[1] is None:
            at = m.end()
            return (at + 1, found, html[at - 1] == "/") if html.startswith(">", at) else (-1, found, False)
        found.append((m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")))
        if m.end() == at:
            return -1, found, False
        at = m.end()


class _Open:
    """Open elements: each block with the inline elements open in it. An end tag closes what is
    open above its element, but one of an inline element nothing outside its block. What
    is open is counted by name, so that a stray end tag costs nothing."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, bool, list[tuple[str, bool]], dict[str, int]]] = [("", False, [], {})]
        self.names: dict[str, int] = {}
        self.dropped = self.articles = self.anchors = 0

    def _count(self, tag: str, drop: bool, by: int) -> None:
        self.dropped += drop * by
        self.articles += (tag in ("article", "main")) * by
        self.anchors += (tag == "a") * by

    def open(self, tag: str, drop: bool, block: bool) -> None:
        self._count(tag, drop, 1)
        if block:
            self.blocks.append((tag, drop, [], {}))
            self.names[tag] = self.names.get(tag, 0) + 1
        else:
            self.blocks[-1][2].append((tag, drop))
            self.blocks[-1][3][tag] = self.blocks[-1][3].get(tag, 0) + 1

    def _close_inline(self, until: str | None) -> None:
        _, _, inline, counts = self.blocks[-1]
        while inline:
            tag, drop = inline.pop()
            counts[tag] -= 1
            self._count(tag, drop, -1)
            if tag == until:
                return

    def close(self, tag: str, block: bool) -> None:
        if not block:
            if self.blocks[-1][3].get(tag):
                self._close_inline(tag)
        elif self.names.get(tag):
            found = None
            while found != tag:
                self._close_inline(None)
                found, drop, _, _ = self.blocks.pop()
                self.names[found] -= 1
                self._count(found, drop, -1)


def lines_of(html: str) -> list[tuple[str, int, bool, bool]]:
    """(text, weight, in an article element, dropped) of each line of the page. Time grows with
    the page's length, whatever is on it."""
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked = at = 0
    open_ = _Open()
    strict = True  # until a quote that never ends: then a tag ends at the next >

    def end_line() -> None:
        nonlocal linked
        text = _WHITE.sub(" ", unescape("".join(parts))).strip()
        if text:
            links = 0 if open_.articles and open_.blocks[-1][0] in PROSE else linked
            out.append((text, 0 if open_.dropped else max(0, len(text) - links), open_.articles > 0, open_.dropped > 0))
        parts.clear()
        linked = 0

    while True:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else len(html)
        if stop > at:
            parts.append(html[at:stop])
            if open_.anchors:
                linked += stop - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), []
        alone = m[3] is not None and "/" in m[3]
        if m[3] is None:
            end = -1
            if strict:
                end, attributes, alone = _attributes(html, at)
                strict = end >= 0
            if end < 0:
                end = html.find(">", at) + 1
                if not end:  # no tag ends any more: the rest is text
                    parts.append(html[stop:])
                    break
            at = end
        block = tag in BLOCKS or tag in HIDDEN
        if tag in HIDDEN and not closing and not alone and tag in _RAW:  # raw text up to its end tag
            end_tag = _RAW[tag].search(html, at)
            at = end_tag.start() if end_tag else len(html)
            if tag in ("script", "style"):
                continue
        if block:
            end_line()
        if closing:
            open_.close(tag, block)
        elif tag not in VOID and not alone:
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and open_.blocks[-1][0] == tag:
                open_.close(tag, True)
            if tag == "a":
                open_.close(tag, False)
            open_.open(tag, tag in HIDDEN or _boilerplate(tag, attributes, open_.articles > 0), block)
    end_line()
    return out


def passages(weights: list[int], block_lines: int = BLOCK_LINES, surge: int = SURGE) -> list[tuple[int, int]]:
    """Runs [begin, end) of lines in which the curve, the summed weights of the window that a
    line begins, rises from nothing to a surge, up to the dive where a whole window has none."""
    n = len(weights)
    curve = [sum(weights[k : k + block_lines]) for k in range(n)]
    runs: list[tuple[int, int]] = []
    k = 0
    while k < n:
        if not weights[k]:
            k += 1
            continue
        begin = k
        while k < n and curve[k] > 0:
            k += 1
        end = k
        while not weights[end - 1]:
            end -= 1
        if max(curve[begin:end]) >= surge:
            runs.append((begin, end))
    return runs


def main_text(html: str | None, block_lines: int = BLOCK_LINES, surge: int = SURGE) -> str:
    lines = [(text, weight, inside) for text, weight, inside, dropped in lines_of(html or "") if not dropped]
    marked = any(inside for _, _, inside in lines)
    weights = [weight if inside or not marked else 0 for _, weight, inside in lines]
    runs = passages(weights, block_lines, 1 if marked else surge)
    if not runs:  # a page of a few words has no surge: its weighty lines are its text
        return "\n".join(text for (text, _, _), w in zip(lines, weights, strict=True) if w)
    return "\n".join(text for begin, end in runs for text, _, _ in lines[begin:end])


def extract_text(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """(keys, text, n_chars) of every page."""
    d = pages.select(*keys, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(len(keys)).to_pylist()]
            cols = [*b.columns[: len(keys)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "text", "n_chars"])

    kinds = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys)
    return d.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
