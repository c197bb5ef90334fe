"""HTML read by structure: tags with quoted attributes, comments, scripts, nested elements.

Tags are found one after the other, so that signs within quotes, comments and scripts are no tags; an element ends at the
tag that closes it, not at the first of its name. An element of the hidden kinds that is never closed hides nothing
but its tag; a script or style that isn't hides the rest. Rows go to Python a hundred at a time: an Arrow batch has
10,000 rows, whole pages here, which Arrow, pandas and the result would hold at once in each task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Elements that are never text, elements outside the main part, elements whose content has no tags.
UNSEEN = frozenset(["script", "style", "noscript", "svg", "iframe"])
ASIDE = UNSEEN | {"nav", "footer", "header", "aside", "form"}
RAW = frozenset(["script", "style"])
#: Elements that start a line.
BLOCKS = frozenset(["p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "ul", "ol", "br"])
#: Where the main part of a page is, the first kind that there is.
ROOTS = ("main", "article", "body")

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
ATTRIBUTE = re.compile(rf"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE})?+)?+")
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+)*+[\s/]*+)>|<[!?/][^>]*+>", re.S)


class Tag(NamedTuple):
    name: str  # "" for comments and declarations
    closes: bool
    start: int
    end: int
    rest: str


def tags(markup: str) -> Iterator[Tag]:
    """The tags and comments in order. A script or style is one tag, with its content."""
    at, last = 0, markup.rfind(">")  # past the last > no tag ends, but a comment may begin
    while found := MARKUP.search(markup, at) if at <= last else re.compile(r"<!--.*", re.S).search(markup, at):
        name, closes, rest = (found["name"] or "", found["close"], found["rest"]) if found.re is MARKUP else ("", "", "")
        name, end = name.lower(), found.end()
        if name in RAW and not closes:
            close = re.compile(rf"</{name}\s*>", re.I).search(markup, end)
            end = close.end() if close else len(markup)
        yield Tag(name, bool(closes), found.start(), end, rest or "")
        at = max(end, found.start() + 1)


def elements(listed: list[Tag], names: frozenset[str]) -> list[tuple[int, int]]:
    """(start, end) of the elements of these names that are closed, outermost only, in order."""
    still: dict[str, list[int]] = {}
    spans = []
    for tag in listed:
        if tag.name in RAW and tag.name in names and not tag.closes:
            spans.append((tag.start, tag.end))
        elif tag.name in names:
            if not tag.closes:
                still.setdefault(tag.name, []).append(tag.start)
            elif still.get(tag.name):
                spans.append((still[tag.name].pop(), tag.end))
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def outside(listed: list[Tag], spans: list[tuple[int, int]]) -> list[Tag]:
    """The tags that lie in none of the spans."""
    out, k = [], 0
    for tag in listed:
        while k < len(spans) and spans[k][1] <= tag.start:
            k += 1
        if k == len(spans) or tag.start < spans[k][0]:
            out.append(tag)
    return out


def kept(markup: str, spans: list[tuple[int, int]], start: int = 0, end: int | None = None) -> str:
    """markup from start to end without the spans; a space stands for each."""
    end = len(markup) if end is None else end
    parts, at = [], start
    for lo, hi in spans:
        if hi > start and lo < end:
            parts += [markup[at : max(lo, at)], " "]
            at = max(at, hi)
    return "".join(parts) + markup[at:end] if at < end else "".join(parts)


def main_markup(markup: str) -> str:
    """The inside of the first main element (else article, else body, else all) without what lies aside."""
    listed = list(tags(markup))
    spans = elements(listed, ASIDE)
    seen = outside(listed, spans)
    for root in ROOTS:
        own = [t for t in seen if t.name == root]
        first = next((i for i, t in enumerate(own) if not t.closes), None)
        if first is None:
            continue
        depth, end = 0, len(markup)
        for tag in own[first:]:
            depth += -1 if tag.closes else 1
            if depth == 0:
                end = tag.start
                break
        return kept(markup, spans, own[first].end, end)
    return kept(markup, spans)


def plain(markup: str | None) -> str:
    """The text of a fragment, with a line for each block and a dash for each item; its lines are cleaned later."""
    markup = markup or ""
    if "&lt;" in markup:
        markup = html.unescape(markup)
    if "<" not in markup:
        return html.unescape(markup)
    listed = list(tags(markup))
    spans = elements(listed, UNSEEN)
    parts, at = [], 0
    hidden = iter(spans)
    span = next(hidden, None)
    for tag in listed:
        if tag.start < at:
            continue  # within an element that is not seen
        parts.append(html.unescape(markup[at : tag.start]))
        at = tag.end
        if span and tag.start == span[0]:
            at, span = span[1], next(hidden, None)
        elif tag.name in BLOCKS:
            parts.append("\n- " if tag.name == "li" and not tag.closes else "\n")
    parts.append(html.unescape(markup[at:]))
    return "".join(parts)


def addresses(markup: str | None) -> list[str]:
    """The href of each anchor, in order."""
    out = []
    for tag in tags(markup or ""):
        if tag.name == "a" and not tag.closes:
            for found in ATTRIBUTE.finditer(tag.rest):
                if found[1].lower() == "href":
                    value = found[2] or ""
                    out.append(html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
                    break
    return out


@F.udf(StringType(), useArrow=False)
def _plain(markup: str | None) -> str:
    return plain(markup)


@F.udf(ArrayType(StringType()), useArrow=False)
def _plain_each(markup: list[str | None] | None) -> list[str] | None:
    return None if markup is None else [plain(x) for x in markup]


@F.udf(StringType(), useArrow=False)
def _main(markup: str | None) -> str:
    return plain(main_markup(markup or ""))


@F.udf(ArrayType(StringType()), useArrow=False)
def _addresses(markup: str | None) -> list[str]:
    return addresses(markup)


def lines(c: Column) -> Column:
    """The text of an HTML fragment, its lines not yet cleaned; null gives ''."""
    return _plain(c)


def lines_each(c: Column) -> Column:
    """`lines` of each element of an array."""
    return _plain_each(c)


def main_lines(c: Column) -> Column:
    """The text of the main part of a page, its lines not yet cleaned."""
    return _main(c)


def hrefs(c: Column) -> Column:
    """The addresses of a page's anchors, in order."""
    return _addresses(c)
