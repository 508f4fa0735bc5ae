"""Main text of web pages by tree scoring.

A page becomes a tree of its elements. Each paragraph-like block passes points for its length and commas to its
parent and, halved with each step, to the ancestors above; an element's points are discounted by the share of its
text that stands in links. The best container is kept, or the article it stands in, and from there upwards what stands
beside it and holds unlinked text; blocks that belong to menus, forms, adverts and the like never count. All steps take
time in proportion to the page, whatever is in it: elements are visited once downwards and once upwards, and a tag that
never ends is looked for once. Figures and their captions belong to the article; dialog and menu elements count as notices
and menus, and what stands in noscript, canvas, object, video and audio for readers who can't see these is left out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of HTML by their part in a page.
DROPPED = frozenset("script style noscript template iframe object embed svg math canvas head title nav header footer aside button select textarea input option dialog menu video audio map".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a start tag of the key closes, as their end tags may be left out.
ENDS = {k: frozenset(v.split()) for k, v in {"p": "p", "li": "p li", "dt": "p dt dd", "dd": "p dt dd", "tr": "p tr td th", "td": "p td th", "th": "p td th", "option": "option"}.items()}
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Names in class, id and role that mark what is not the article.
AWAY = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu nav navbar navigation newsletter notice pagination pager popup promo promoted related reply replies respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget modal search complementary contentinfo alert dialog".split())
#: Those of them that mark what readers wrote, however much of a page it is.
READERS = frozenset("comment comments disqus reply replies respond".split())
#: Words that make a name a remark on its element (has-sidebar, comments-open), not what the element is.
REMARKS = frozenset("has with without no not hide show is are open closed enabled disabled".split())
CONTAINERS = frozenset("article main body div section".split())
KEEP = frozenset("article main content entry post story body text".split())
SCORED = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body".split())

_TAG = re.compile(r"<(?:(!--)|(!\[CDATA\[)|(/?)([A-Za-z][^\s/>]*)|[!?/])")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: Points of ancestors: the parent takes all, its parent half, those above a share that falls with the distance.
LEVELS = 5
#: Share of a page's text that an element set aside by its name must exceed to be kept, if what is outside of all such is less than the second.
MOST, LEAST = 0.5, 0.1
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Element:
    __slots__ = ("away", "chars", "children", "gone", "held", "linked", "name", "parent", "points", "title", "whole")

    def __init__(self, name: str, parent: "_Element | None", away: str, title: bool):
        """away: why the element isn't the article: "never" for what it is, "readers" or "name" for how it is named, or "".
        title: whether it is the header of an article, of which only headings count."""
        self.name, self.parent, self.away, self.title = name, parent, away, title
        self.children: list[_Element] = []
        self.points, self.chars, self.linked, self.whole = 0.0, 0, 0, 0
        self.gone = self.held = False


def _attributes(text: str) -> tuple[list[frozenset[str]], bool]:
    """The words of each name in class, id and role; whether the element is hidden."""
    names, hidden = [], False
    for m in _ATTR.finditer(text):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            names += [frozenset(w.lower() for w in _WORD.findall(name)) for name in value.split()]
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return names, hidden


def _away(name: str, names: list[frozenset[str]]) -> bool:
    """Names mark what is not the article; in containers, a name that marks the article outweighs those that only mention such."""
    marks = [n for n in names if n & AWAY and not n & REMARKS]
    if not marks or name == "body":
        return False
    if name in ("article", "main") and any(n & KEEP for n in names):
        return False
    return not (name in CONTAINERS and any(n & KEEP and not n & AWAY for n in names) and not any(n <= AWAY for n in marks))


class _Tags:
    """Where tags end: at the first > outside quotes. A quote that isn't closed is a character like others; where all > left
    stand in quotes, quotes mean nothing from there on."""

    def __init__(self, page: str):
        self.page, self.quoted, self.closed = page, True, {'"': True, "'": True}

    def end(self, at: int) -> int:
        """Place of the > that ends the tag, -1 if there is none."""
        where = at
        while self.quoted:
            m = _STOP.search(self.page, where)
            if m is None:
                self.quoted = False
            elif m[0] == ">":
                return m.start()
            else:
                where = m.end()
                to = self.page.find(m[0], where) if self.closed[m[0]] else -1
                if to < 0:
                    self.closed[m[0]] = False
                else:
                    where = to + 1
        return self.page.find(">", at)


def _tree(page: str) -> tuple[list[_Element], list[tuple[str, _Element]]]:
    """All elements, parents first, and the page's blocks (text, element) in page order."""
    root = here = _Element("html", None, "", False)
    elements, blocks = [root], []
    parts: list[str] = []
    links = linked = 0
    tags, endless = _Tags(page), set()
    opened = {"html": 1}  # how many elements of a name are open

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append((text, here, min(linked, len(text))))
        linked = 0

    def close() -> None:
        nonlocal here
        opened[here.name] -= 1
        here = here.parent

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and here.away != "never":
            parts.append(page[at:stop])
            if links:
                linked += len(" ".join(page[at:stop].split()))
        if not m:
            break
        if m[1] or m[2]:
            to = page.find("-->" if m[1] else "]]>", m.end())
            at = end if to < 0 else to + 3
            continue
        to = tags.end(m.end())
        if m[4] is None:
            at = end if to < 0 else to + 1
            continue
        if to < 0:  # no tag ends any more: all that is left is text
            if here.away != "never":
                parts.append(page[stop:])
            break
        name, closing, rest = m[4].lower(), bool(m[3]), page[m.end() : to]
        at = to + 1
        if name in ("b", "i", "em", "strong", "span", "u", "small", "font"):
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif closing:
            if opened.get(name) and (name != "html" or opened[name] > 1):
                flush()
                while here.name != name:
                    close()
                if here.parent is not None:
                    close()
        elif name in RAW:
            e = None if name in endless else _RAW_END[name].search(page, at)
            if e is not None:
                at = e.end()
            else:
                endless.add(name)
                if not rest.rstrip().endswith("/"):
                    at = end
        elif name not in VOID and (name in BLOCKS or name in DROPPED):
            flush()
            shut = ENDS.get(name) or (ENDS["p"] if name in CLOSES_P else frozenset())
            while here.name in shut and here.parent is not None:
                close()
            links = 0
            if name in ("html", "body") and here.parent is None:
                continue
            inside = bool(opened.get("article") or opened.get("main"))
            away, title = "never" if here.away == "never" or name in DROPPED and not (name == "header" and inside) else "", name == "header"
            if not away:
                names, hidden = _attributes(rest) if rest else ([], False)
                marks = frozenset().union(*(n & AWAY for n in names if not n & REMARKS))
                title = title or bool(marks) and marks <= {"header"} and (inside or any(n & KEEP for n in names))
                if hidden:
                    away = "never"
                elif not title and (name == "form" or _away(name, names)):
                    away = "readers" if marks & READERS else "name"
            here = _Element(name, here, away, title and not away)
            elements.append(here)
            here.parent.children.append(here)
            opened[name] = opened.get(name, 0) + 1
        elif name == "hr":
            flush()
    flush()
    return elements, _present(elements, blocks)


def _present(elements: list[_Element], blocks: list[tuple[str, _Element, int]]) -> list[tuple[str, _Element]]:
    """The blocks outside of what is set aside, with the characters of all elements counted from them.

    An element that its name sets aside but that holds most of the page's text, with next to nothing outside, is the page.
    """
    for text, node, _ in blocks:
        node.whole += len(text)
    total = outside = sum(len(text) for text, _, _ in blocks)
    for e in elements:
        e.gone = bool(e.away) or e.parent is not None and e.parent.gone
        outside -= e.whole if e.gone else 0
    for e in reversed(elements[1:]):
        e.parent.whole += e.whole
    for e in elements:
        spared = e.away == "name" and outside < LEAST * total and e.whole > MOST * total
        e.gone = bool(e.away) and not spared or e.parent is not None and e.parent.gone
        e.title = e.title or e.parent is not None and e.parent.title
    left = [(text, node, links) for text, node, links in blocks if not node.gone and (not node.title or node.name in HEADINGS)]
    for text, node, links in left:
        node.chars += len(text)
        node.linked += links
    for e in reversed(elements[1:]):
        e.parent.chars += e.chars
        e.parent.linked += e.linked
    return [(text, node) for text, node, _ in left]


def _points(text: str) -> float:
    return 0.0 if len(text) < 25 else 1 + text.count(",") + text.count("、") + min(len(text) // 100, 3)


def main_text(page: str | None) -> str:
    """Main text of a page, blocks joined by a line end; empty for null, empty or blank pages."""
    if not page:
        return ""
    elements, blocks = _tree(page)
    if not blocks:
        return ""
    scored: list[_Element] = []
    for text, node in blocks:
        points = _points(text)
        if not points or node.name not in SCORED:
            continue
        up = node.parent if node.name in ("p", "pre", "blockquote", "li", "dd", "td", "h1", "h2", "h3", "h4", "h5", "h6") and node.parent else node
        for level in range(LEVELS):
            if not up.points:
                scored.append(up)
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            if up.parent is None:
                break
            up = up.parent
    worth = lambda e: e.points * (1 - e.linked / max(e.chars, 1))
    best = max(scored, key=worth, default=elements[0])
    limit = max(10.0, 0.2 * worth(best))

    def prose(e: _Element) -> bool:
        scored_itself = e.points > 0 or e.name in ("p", "pre", "blockquote") and e.chars >= 25
        return scored_itself and (e.linked < 0.25 * e.chars or worth(e) >= limit)

    top = best
    while top is not None and top.name not in ("article", "main"):
        top = top.parent
    top = top or best
    top.held = True
    while top.parent is not None:
        beside = [e for e in top.parent.children if e is not top and not e.gone]
        text = [e for e in beside if prose(e)]
        for e in beside:
            e.held = e.held or bool(e.chars) and not e.linked and e.name in HEADINGS
        for e in text:
            e.held = True
        if text and top.parent.parent is not None:  # a part of the page, not all of it
            top.parent.held = True
        elif not text and top.parent.chars > top.chars:
            break
        top = top.parent
    # (whether an element is held, whether one of many links is), by what is nearest above
    kept: dict[int, tuple[bool, bool]] = {}
    for e in elements:
        above = kept[id(e.parent)] if e.parent is not None else (False, False)
        kept[id(e)] = (True, True) if e.held else (above[0], above[1] and not (e.chars and e.linked / e.chars > 0.6))
    dense = ("ul", "ol", "div", "table", "section")
    return "\n".join(text for text, node in blocks if kept[id(node)][node.name in dense])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Null and empty pages give an empty text; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kind = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(run, f"page_id {kind[id_col]}, url {kind[url_col]}, text string, n_chars long")
