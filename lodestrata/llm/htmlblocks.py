"""Leaf blocks of an HTML page: runs of text between block-level tags, with their ancestors.

One pass by an index that only moves forward: what has been looked through for the end of a
tag without success is never looked through again, open elements are counted by name, and an
element knows its parent instead of carrying a copy of all that is around it. So time and
memory are linear in the page, broken or deeply nested ones included.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Elements of HTML, by what they mean for blocks (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp".split())
UNSEEN = frozenset("iframe noembed noframes noscript template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow ms mtext nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element on the left ends where one of those on the right begins.
ENDS_AT = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select".split())

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTE_OR_END = re.compile("[\"'>]")
_RAW_END = {tag: re.compile(f"</{tag}(?![a-zA-Z0-9:-])", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")
_SPACE = re.compile(r"\s+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none")


class Frame:
    """An open block element: its tag, its own features, its parent, and its score once known."""

    __slots__ = ("tag", "features", "parent", "unseen", "ender", "score")

    def __init__(self, tag: str, features: list[str], parent: Frame | None, unseen: bool = False, ender: int = 0):
        self.tag, self.features, self.parent, self.unseen, self.ender = tag, features, parent, unseen, ender
        self.score: float | None = None

    def around(self) -> list[str]:
        """The features of it and of all around it."""
        out, at = [], self
        while at is not None:
            out += at.features
            at = at.parent
        return out


@dataclass(slots=True)
class Block:
    frame: Frame
    text: str
    link_chars: int


def _features(tag: str, attributes: str) -> list[str]:
    out = [f"in:{tag}"]
    if attributes and not attributes.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role", "itemprop"):
                out += sorted({f"name:{p.lower().rstrip('s')}" for p in _PART.findall(value)})
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _NOT_SHOWN.search(value)):
                out.append("hidden")
    return out


class _Tags:
    """Finds where tags end; each part of the page is looked through a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.quotes = True  # false once a search for an unquoted end has reached the end of the page

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends at ``at``; -1 if there is none."""
        page, last = self.page, self.last
        if at > last[">"]:
            return -1
        here = at
        while self.quotes:
            hit = _QUOTE_OR_END.search(page, here)
            if hit is None or here > last[">"]:
                self.quotes = False
                break
            c = hit[0]
            if c == ">":
                return hit.start()
            here = hit.end()
            if here > last[c]:  # a quote that is never closed
                break
            here = page.index(c, here) + 1
        return page.index(">", at)


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order. Unclosed and crossed tags are accepted; a null page has none.

    A tag that the page ends in is dropped. A script, style, title or text area that is never
    closed reaches to the end; what is never seen (frames, templates, vector graphics) ends with
    the element around it.
    """
    if not page:
        return []
    out: list[Block] = []
    stack, still_open = [Frame("", [], None)], Counter()
    parts: list[str] = []
    linked, in_link, at, size, tags = 0, 0, 0, len(page), _Tags(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(stack[-1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if stack[-1].unseen:
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    def close_from(i: int) -> None:
        for frame in stack[i:]:
            still_open[frame.tag] -= 1
        del stack[i:]

    while at < size:
        start = at
        while True:  # a < that begins no tag is text
            start = page.find("<", start)
            if start < 0 or page[start + 1 : start + 2] in ("!", "?"):
                break
            name = _NAME.match(page, start + 1)
            if name:
                break
            start += 1
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        if page[start + 1] in "!?":
            stop = page.find("-->", start + 4) if page.startswith("<!--", start) else page.find(">", start)
            if stop < 0:
                break
            at = stop + (3 if page.startswith("<!--", start) else 1)
            continue
        stop = tags.end(name.end())
        if stop < 0:
            break
        closing, tag, attributes, at = bool(name[1]), name[2].lower(), page[name.end() : stop], stop + 1
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = page.find(">", end.end()) + 1 if end else 0
                if not at:
                    break
            continue
        if tag in INLINE:
            if tag == "br":
                say(" ")
            elif tag == "a":
                in_link = 0 if closing else 1
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if still_open[tag] > 0:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close_from(i)
            continue
        if stack[-1].tag == "p":
            close_from(len(stack) - 1)
        i = stack[-1].ender
        while i:
            if tag in ENDS_AT.get(stack[i].tag, ()):
                close_from(i)
                break
            if stack[i].tag in SCOPES:
                break
            i = stack[i - 1].ender
        if attributes.endswith("/") and tag not in ("p", "div", "li"):
            continue
        top = stack[-1]
        ender = len(stack) if tag in ENDS_AT or tag in SCOPES else top.ender
        stack.append(Frame(tag, _features(tag, attributes), top, top.unseen or tag in UNSEEN, ender))
        still_open[tag] += 1
    flush()
    return out
