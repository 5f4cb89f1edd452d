"""Main text of raw web pages by the distribution of text over line blocks.

Markup is stripped first: scripts, styles, comments, menus and headers go, and
every block-level tag ends a line.  So do elements whose class or id names
boilerplate, forms and reader comments, unless they are the layout around the
article.  The lengths of the remaining lines are summed over a sliding window;
the text starts at the surge and ends at the dive of that curve.  Lines that
the page marks as its article weigh more, so that short lines inside it stay.

One scan reads a page from left to right and looks at each character a bounded
number of times, so broken pages of any length take time in proportion to it.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.words import text_batches

#: Lines of a window, and the summed length at which a surge begins.
WINDOW, SURGE = 3, 80
#: Fixed: elements whose content is no markup, that start or end a line, that hold no article text, that mark the
#: article, and without an end tag.
_RAW = frozenset("script style noscript template textarea title iframe object svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol "
    "option p pre section select summary table tbody td tfoot th thead tr ul".split())
_DROPPED = frozenset("nav footer aside head header menu select button dialog fieldset noscript".split())
_ARTICLE = frozenset(["article", "main"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_COMMENTS = r"comments?|disqus|replies"
_MARKED = re.compile(
    r"(?:^|[\s_-])(?P<word>ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|footer|"
    r"header|masthead|sidebar|widgets?|related|share|sharing|social|cookies?|consent|gdpr|notices?|popup|modal|"
    rf"newsletter|subscribe|signup|login|{_COMMENTS}|pagination|pager|toolbar|skip)(?=$|[\s_-])", re.I)
#: Class names that tell a state of the element instead of its kind.
_STATE = re.compile(r"(?:^|[_-])(?:has|with|without|no|hide|show|is)[_-]|[_-](?:open|opened|closed|enabled|disabled|on|off)$", re.I)
_TALK = re.compile(rf"(?:{_COMMENTS})\Z", re.I)
_LEGAL = re.compile(r"©|\bcopyright\b|\ball rights reserved\b|\bcookies?\b|\bprivacy policy\b|\bterms of (?:use|service)\b", re.I)


@dataclass
class Line:
    text: str
    links: int
    article: bool
    mark: int = -1      # the innermost element around it that may be boilerplate


@dataclass
class Mark:
    """An element that may be boilerplate: the mark around it, its lines, and what is known of it."""
    parent: int
    first: int
    talk: bool          # reader comments
    end: int            # where its end tag begins
    last: int = 0       # its lines are first .. last - 1
    wraps: bool = False     # an article with text is inside, in no comments of their own


@dataclass
class _Tag:
    start: int
    end: int
    name: str
    closing: bool
    attributes: str


def _tags(page: str):
    """Tags from left to right, and stretches without text (comments, scripts) as tags without a name."""
    at, size = 0, len(page)
    last = {c: page.rfind(c) for c in ">\"'"}
    quotes = True
    while True:
        at = page.find("<", at)
        if at < 0:
            return
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            close = "-->" if page[at + 2] == "-" else "]]>"
            found = page.find(close, at + 4 if close == "-->" else at + 9)
            end = found + 3 if found >= 0 else size
            yield _Tag(at, end, "", False, "")
            at = end
            continue
        head = _TAG.match(page, at)
        if head is None:
            if page[at + 1:at + 2] in ("!", "?", "/"):
                found = page.find(">", at) if at < last[">"] else -1
                end = found + 1 if found >= 0 else size
                yield _Tag(at, end, "", False, "")
                at = end
            else:
                at += 1     # a plain character
            continue
        end = -1
        if at < last[">"]:
            k = head.end()
            while quotes:
                stop = _STOP.search(page, k)
                if stop is None:
                    quotes = False  # a quote that never ends: from here on quotes are plain characters
                elif stop.group() == ">":
                    end = stop.end()
                    break
                elif stop.start() < last[stop.group()]:
                    k = page.find(stop.group(), stop.end()) + 1
                else:
                    k = stop.end()
            if end < 0:
                end = page.find(">", head.end()) + 1
        if end <= 0:    # the page breaks off inside this tag
            found = page.find("<", head.end())
            end = found if found >= 0 else size
            yield _Tag(at, end, "", False, "")
            at = end
            continue
        name, closing, attributes = head[2].lower(), bool(head[1]), page[head.end():end - 1]
        if name in _RAW and not closing and not attributes.endswith("/"):
            shut = re.compile(rf"</{name}\s*+>", re.I).search(page, end)
            end = shut.end() if shut else size
            name = ""
        yield _Tag(at, end, name, closing, attributes)
        at = end


def _partners(tags: list[_Tag]) -> list[int]:
    """For each tag the place of the one that closes or opens it, -1 for none; elements of one name nest."""
    out, waiting = [-1] * len(tags), {}
    for k, tag in enumerate(tags):
        if not tag.name or tag.name in _VOID:
            continue
        if not tag.closing:
            waiting.setdefault(tag.name, []).append(k)
        elif waiting.get(tag.name):
            out[k] = waiting[tag.name].pop()
            out[out[k]] = k
    return out


def _kind(tag: _Tag, in_article: bool) -> str:
    """``drop``, ``talk`` (reader comments), ``mark`` (boilerplate unless it is layout) or nothing."""
    if tag.name in _DROPPED:
        return "" if tag.name == "header" and in_article else "drop"
    if tag.name in ("body", "html"):
        return ""
    kind = "mark" if tag.name == "form" else ""
    if not tag.attributes.strip():
        return kind
    if tag.name not in _ARTICLE and "hidden" in tag.attributes.lower().split():
        return "drop"
    for name, *values in _ATTRIBUTE.findall(tag.attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if tag.name not in _ARTICLE and (name == "role" and value.lower() in _ROLES
                                         or name == "aria-hidden" and value.lower() == "true"):
            return "drop"
        if name not in ("class", "id"):
            continue
        for token in value.split():
            if _STATE.search(token):
                continue
            for found in _MARKED.finditer(token):
                word = found["word"].lower()
                if _TALK.match(word):
                    return "talk"
                if tag.name not in _ARTICLE and not (in_article and word in ("header", "masthead")):
                    kind = "mark"
    return kind


def lines_of(page: str) -> list[Line]:
    """The lines that are left of a page, references decoded and white space reduced.

    An element reaches from its start tag to the end tag that closes it; one that is never closed neither drops nor
    marks anything, except an article, which then goes on to the end of the page.
    """
    tags = list(_tags(page))
    partner = _partners(tags)
    lines: list[Line] = []
    marks: list[Mark] = []
    stack: list[int] = []
    opened: list[tuple[int, int, int]] = []     # articles: where they end, their first line, the mark around them
    parts: list[str] = []
    linked = at = k = 0
    link_until = article_until = -1
    article = False

    def flush() -> None:
        nonlocal linked, article
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                lines.append(Line(text, linked, article, stack[-1] if stack else -1))
            parts.clear()
        linked, article = 0, False

    def piece(start: int, end: int) -> None:
        nonlocal linked, article
        if end > start:
            parts.append(page[start:end])
            linked += (end - start) * (start < link_until)
            article |= start < article_until

    def leave(position: int) -> None:
        while opened and opened[-1][0] <= position:
            flush()
            _, first, mark = opened.pop()
            marks[mark].wraps |= len(lines) > first
        while stack and marks[stack[-1]].end <= position:
            flush()
            marks[stack.pop()].last = len(lines)

    while k < len(tags):
        tag, other = tags[k], partner[k]
        piece(at, tag.start)
        at = tag.end
        k += 1
        leave(tag.start)
        if tag.name in _BLOCK:
            flush()
        if not tag.name or tag.closing or tag.name in _VOID:
            continue
        kind = _kind(tag, tag.start < article_until)
        if kind:
            flush()
        if kind == "drop":
            if other >= 0:
                at, k = tags[other].end, other + 1
            continue
        if kind and other >= 0:
            outer = marks[stack[-1]].end if stack else len(page)
            marks.append(Mark(stack[-1] if stack else -1, len(lines), kind == "talk", min(outer, tags[other].start)))
            stack.append(len(marks) - 1)
        end = tags[other].start if other >= 0 else len(page)
        if tag.name in _ARTICLE and kind != "talk":
            article_until = max(article_until, end)
            if stack:
                opened.append((min(end, opened[-1][0]) if opened else end, len(lines), stack[-1]))
        if tag.name == "a" and other >= 0:
            link_until = max(link_until, end)
    piece(at, len(page))
    flush()
    leave(len(page))
    return _without_marked(lines, marks)


def _plain(line: Line) -> int:
    return max(0, len(line.text) - 2 * line.links)


def _sums(values: list[int]) -> list[int]:
    return [0, *accumulate(values)]


def _surge_at(weight: list[int]) -> list[int]:
    """For each line the first line at or after it whose full window surges, the number of lines where none does."""
    total = _sums(weight)
    out = [len(weight)] * (len(weight) + 1)
    for k in range(len(weight) - 1, -1, -1):
        full = k + WINDOW <= len(weight) and total[k + WINDOW] - total[k] >= SURGE
        out[k] = k if full else out[k + 1]
    return out


def _without_marked(lines: list[Line], marks: list[Mark]) -> list[Line]:
    """Lines outside the marked elements, except those that are the layout around the main text.

    Comments are layout only if an article is inside and the rest of the page has neither an article nor a surge.
    Other marks are if an article is inside, or if they surge, hold most of the text, and are more than four times
    the best the rest of the page offers: its articles together, or one stretch without marks that surges.
    """
    if not marks:
        return lines
    talk, gone = [False] * len(marks), [False] * len(marks)
    for k, m in enumerate(marks):
        talk[k] = m.talk or m.parent >= 0 and talk[m.parent]
    for m in reversed(marks):
        if m.wraps and not m.talk and m.parent >= 0:
            marks[m.parent].wraps = True
    weight = [0 if line.mark >= 0 and talk[line.mark] else _plain(line) for line in lines]
    total, article = _sums(weight), _sums([w * line.article for w, line in zip(weight, lines)])
    surge = _surge_at(weight)
    free, bare = 0, [_plain(line) * (line.mark < 0) for line in lines]
    for inside, run in groupby(range(len(lines)), key=lambda k: lines[k].mark < 0):
        own = [bare[k] for k in run]
        if inside and (_surge_at(own)[0] < len(own) or len(own) < WINDOW and sum(own) >= SURGE):
            free = max(free, sum(own))
    for k, m in enumerate(marks):
        size = total[m.last] - total[m.first]
        rest = max(free, article[-1] - article[m.last] + article[m.first])
        surges = surge[m.first] + WINDOW <= m.last or m.last - m.first < WINDOW and size >= SURGE
        layout = m.wraps and rest == 0 if m.talk else m.wraps or surges and 2 * size > total[-1] and size > 4 * rest
        gone[k] = not layout or m.parent >= 0 and gone[m.parent]
    return [line for line in lines if line.mark < 0 or not gone[line.mark]]


def main_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[Line]:
    """Lines between the surges and dives of the main text.

    A window's weight is the text outside links over ``window`` lines; lines of
    a marked article weigh ``surge`` more, so they always stand above the rest.
    Unmarked lines at the edges of a marked stretch stay only where they surge
    themselves.  If the stretch with the most text is marked, all marked
    stretches stay.  Otherwise all unmarked ones do, since only links stand
    between them; of these, legal notices of less than a quarter of it do not.
    """
    plain = [_plain(line) for line in lines]
    weight = [w + surge * line.article for w, line in zip(plain, lines)]
    total = _sums(weight)
    sums = [total[min(k + window, len(lines))] - total[k] for k in range(len(lines))]
    found, k = [], 0
    while k < len(lines):
        if sums[k] >= surge and weight[k] > 0:
            end = k
            while end < len(lines) and sums[end] > 0:
                end += 1
            found.append((k, end))
            k = end
        k += 1
    if not found:   # nothing surges: the page is short, all its unlinked lines are its text
        return [line for line, w in zip(lines, weight) if w > 0]

    def marked(a: int, b: int) -> list[int]:
        return [k for k in range(a, b) if lines[k].article]

    def surges(a: int, b: int) -> bool:
        return any(sum(plain[k:min(b, k + window)]) >= surge for k in range(a, b))

    size = {f: total[f[1]] - total[f[0]] for f in found}
    best = max(found, key=lambda f: (size[f], -f[0]))

    def legal(f: tuple[int, int]) -> bool:
        return 4 * size[f] < size[best] and any(_LEGAL.search(lines[k].text) for k in range(*f))

    picked = ([f for f in found if marked(*f)] if marked(*best) else
              [f for f in found if f == best or not marked(*f) and not legal(f)])
    out: list[Line] = []
    for first, end in picked:
        inside = marked(first, end)
        if inside and not surges(first, inside[0]):
            first = inside[0]
        if inside and not surges(inside[-1] + 1, end):
            end = inside[-1] + 1
        while end > first and not weight[end - 1]:
            end -= 1
        out += lines[first:end]
    return out


def main_text(page: str | None) -> str:
    return " ".join(line.text for line in main_lines(lines_of(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text, blocks joined by one space) and n_chars (its code points) of every page.

    A null or empty page gives an empty text; null ids and urls and repeated
    rows pass through; other input columns are dropped.  Very long and broken
    pages take time in proportion to their length; an empty table gives no rows.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch, sources in text_batches(batches, "html", 4 << 20):
            texts = [main_text(page) for page in sources]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
