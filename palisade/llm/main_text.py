"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks.  Each block is tied to two terminals, content and
boilerplate, with capacities from its tags, class names, length and links; neighbours in
page order and blocks below one parent are tied to each other.  The cheapest cut that parts
the terminals labels all blocks at once: what stays with the content terminal is the text.

Names speak for boilerplate only where they do not hold the page's content: the marks of
elements around the ``article`` or ``main`` with most text, and of those holding half of
the text in it (in the page, if there is none), do not count, except for comment lists.

Defined cases: null or empty html gives an empty text; a page cut off anywhere is read as
far as it goes, a torn tag at its end is dropped; stray end tags and unclosed elements are
tolerated; an unclosed button, ``svg`` or the like ends at the next block; formulas are text,
without their annotations; a ``<`` that opens no tag is text; repeated pages are read alike; a null
``page_id`` or ``url`` stays null.  White space is Unicode's, so a no-break space counts.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape

from pyspark.sql import DataFrame

from palisade.llm.common import in_arrow

#: Elements that start and end blocks.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page, up to their end tag.
RAW = frozenset("script style title textarea noscript template iframe svg object select button xmp noembed noframes annotation annotation-xml".split())
#: Those of them that run to the page's end if their end tag is missing, and those that hold elements of their own name.
ENDLESS, NESTED = frozenset(("script", "style")), frozenset(("svg", "object", "template"))
#: A start tag of the key closes an open element of these, if one is open within the nearest block container.
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
#: Elements that speak for boilerplate, and those that speak for content.
ASIDE = frozenset("nav footer header aside form menu dialog fieldset head".split())
CONTENT = frozenset("article main".split())
#: Words of class names and ids that speak for boilerplate.
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion footer "
    "form header login menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted recommended related "
    "replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

#: Words that make a name a state of its element, as in ``has-sidebar`` and ``comments-open``.
STATE_WORDS = frozenset("has no with without open opened closed enabled disabled".split())
#: Whole names of comment lists, which may well hold most of a page.
COMMENTS = frozenset(("comment", "comments", "respond"))
#: Evidence for boilerplate of an element, of its name, and of the name of an element that speaks for content.
TAG_COST, NAME_COST, CONTENT_NAME_COST = 60, 50, 10
#: Marks around a block that are weighed one by one; those further in always count.
MAX_MARKS = 64

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS - {'option'}, key=len, reverse=True))})(?=[\s/>])", re.I)


class _Open:
    """An open element; ``marks`` and ``holders`` are the marked and the content elements around its text, itself included."""

    __slots__ = ("holders", "marks", "name", "number", "side")

    def __init__(self, name: str, number: int, side: int, marks: tuple[int, ...], holders: tuple[int, ...]):
        self.name, self.number, self.side, self.marks, self.holders = name, number, side, marks, holders


def _ends(html: str, name: str) -> dict[int, int]:
    """Where each element of a name of RAW ends, by its start; unclosed ones are left out."""
    ends: dict[int, int] = {}
    starts: list[int] = []
    for m in re.finditer(rf"<(/?){name}(?=[\s/>]|\Z)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", html, re.I):
        if not m[1]:
            if name not in NESTED:
                starts.clear()
            if name != "svg" or not m[2].endswith("/"):
                starts.append(m.start())
        elif starts:
            ends[starts.pop()] = m.end()
    return ends


def _mark(attributes: str) -> tuple[bool, bool]:
    """Whether an element's names speak for boilerplate, and whether one is that of a comment list."""
    found = firm = False
    for m in _NAMES.finditer(attributes):
        for name in _CAMEL.sub("-", m[1] or m[2] or m[3] or "").lower().split():
            words = _SPLIT.split(name)
            if not ASIDE_WORDS.isdisjoint(words) and STATE_WORDS.isdisjoint(words):
                found, firm = True, firm or name in COMMENTS
    return found, firm


def _bearing(out: list[tuple], firm: set[int], around: dict[int, _Open], marks: dict[int, tuple[int, ...]]) -> set[int]:
    """Marked elements that hold the page's content.  ``around`` has what each content element lies in, ``marks`` the holders of each mark."""
    size: Counter = Counter()
    for text, linked, _, side, _, _, own, holders in out:
        if side < TAG_COST:
            for x in (0, *own, *holders):
                size[x] += len(text) - linked
    scope, bearing = 0, set()
    for _ in range(8):
        inner = [(size[h] >> len(set(x.marks) - bearing), -h) for h, x in around.items() if size[h] > 0 and (not scope or scope in x.holders)]
        if not inner or not max(inner)[0]:
            break
        scope = -max(inner)[1]
        bearing.update(around[scope].marks)
    within = (x for x, holders in marks.items() if x not in firm and (not scope or scope in holders))
    return bearing.union(x for x in within if 0 < size[scope] <= 2 * size[x])


def blocks(html: str) -> list[tuple]:
    """``(text, linked characters, parent, side, in content, tag)`` of each block; ``side`` is evidence for boilerplate."""
    out: list[tuple] = []
    stack = [_Open("", 0, 0, (), ())]
    text: list[str] = []
    costs: dict[int, int] = {}
    firm: set[int] = set()
    around: dict[int, _Open] = {}
    within: dict[int, tuple[int, ...]] = {}
    ends: dict[str, dict[int, int]] = {}
    state = {"linked": 0, "links": 0, "seen": 0}

    def flush() -> None:
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                top = next(x for x in reversed(stack) if x.name in BLOCKS or not x.name)
                parent = stack[max(0, stack.index(top) - 1)].number
                last = stack[-1]
                out.append((joined, state["linked"], parent, last.side, bool(last.holders), top.name, last.marks, last.holders))
            text.clear()
        state["linked"] = 0

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if state["links"]:
                state["linked"] += len(piece)

    def close(at: int) -> None:
        for x in stack[at:]:
            if x.name == "a":
                state["links"] -= 1
        del stack[at:]

    place, size = 0, len(html)
    for m in iter(lambda: _TAG.search(html, place), None):
        add(html[place : m.start()])
        place = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, end, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            flush()
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
                if name not in BLOCKS and stack[k].name in BLOCKS:
                    break
            continue
        if attributes.endswith("/") and name not in VOID and (name in ("svg", "math") or any(x.name == "math" for x in stack)):
            continue
        if name in ENDLESS:
            over = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, place)
            place = over.end() if over else size
            continue
        if name in RAW:
            if name not in ends:
                ends[name] = _ends(html, name)
            over = ends[name].get(m.start())
            if over is None:
                after = _BLOCK.search(html, place)
                over = after.start() if after else size
            place = over
            continue
        if name in VOID:
            continue
        closed = ("p",) if name in CLOSES_P else ()
        closed += {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ())
        if closed:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in closed:
                    close(k)
                    break
                if stack[k].name in BLOCKS:
                    break
        above = stack[-1]
        state["seen"] += 1
        number, side, marks, holders = state["seen"], above.side, above.marks, above.holders
        cost = TAG_COST if name in ASIDE else 0
        if attributes and name not in ("body", "html"):
            found, comments = _mark(attributes)
            if found and name in CONTENT:
                side += CONTENT_NAME_COST
            elif found:
                cost += NAME_COST
                if comments:
                    firm.add(number)
        if cost and (name == "form" or name not in ASIDE) and len(marks) < MAX_MARKS:
            costs[number], within[number], marks = cost, holders, (*marks, number)
        else:
            side += cost
        if name in CONTENT:
            around[number] = above
            holders = (*holders, number)[-MAX_MARKS:]
        if name == "a":
            state["links"] += 1
        stack.append(_Open(name, number, side, marks, holders))
    add(html[place:])
    flush()
    spared = _bearing(out, firm, around, within) if costs else set()
    return [(*b[:3], b[3] + sum(costs[x] for x in b[6] if x not in spared), *b[4:6]) for b in out]


def capacities(block: tuple) -> tuple[int, int]:
    """Cost of calling a block boilerplate, and of calling it content."""
    text, linked, _, side, content, tag = block
    words = text.count(" ") + 1
    good = 2 + min(8, words // 5) + 2 * (text[-1] in ".!?…:\"'”»")
    bad = 3 + side
    if content:
        good += 14
    if tag in ("p", "blockquote", "pre"):
        good += 2
    if 2 * linked > len(text):
        bad += 9
    return good, bad


def cut(good: list[int], bad: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node stays with the content terminal in a minimum cut: augmenting paths, shortest first."""
    n = len(good)
    excess = [g - b for g, b in zip(good, bad, strict=True)]  # what flows straight through is gone
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    while True:
        came = {i: i for i in range(n) if excess[i] > 0}
        queue, end = deque(came), None
        while queue and end is None:
            i = queue.popleft()
            for j, room in near[i].items():
                if room > 0 and j not in came:
                    came[j] = i
                    if excess[j] < 0:
                        end = j
                        break
                    queue.append(j)
        if end is None:
            return [i in came for i in range(n)]
        path = [end]
        while came[path[-1]] != path[-1]:
            path.append(came[path[-1]])
        flow = min(excess[path[-1]], -excess[end], *(near[b][a] for a, b in zip(path, path[1:], strict=False)))
        excess[path[-1]] -= flow
        excess[end] += flow
        for a, b in zip(path, path[1:], strict=False):
            near[b][a] -= flow
            near[a][b] += flow


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    costs = [capacities(b) for b in found]
    edges, last = [], {}
    for i, block in enumerate(found):
        if i:
            edges.append((i - 1, i, 1))
        if block[2] in last:
            edges.append((last[block[2]], i, 3))
        last[block[2]] = i
    kept = cut([g for g, _ in costs], [b for _, b in costs], edges)
    return "\n".join(b[0] for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""

    def run(rows):
        for row in rows:
            text = main_text(row["html"])
            yield {"page_id": row["page_id"], "url": row["url"], "text": text, "n_chars": len(text)}

    return in_arrow(pages.select("page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
