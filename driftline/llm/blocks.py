"""Pages as sequences of leaf blocks: runs of text between the borders of block elements, with their ancestors."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math meter nobr output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: Elements whose text is never shown as text of the page.
SKIPPED = frozenset("script style noscript template textarea title svg iframe select option button object canvas audio video map datalist noframes xmp head".split())
#: Of these, those that reach to their end tag whatever stands between, and those that stand within a line of text.
RAW = frozenset("script style textarea title iframe xmp noframes".split())
APART = frozenset("noscript template svg select button object canvas audio video".split())
#: Elements that a later one of the second kind closes, if nothing of the third kind lies between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
}
BLOCK_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split()
)
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style|data-main)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
MARK = "data-main"


class Element:
    """An open element: its description, and the element around it. Elements are shared by the blocks in them, so a page
    takes room in proportion to its length, however deep it is nested. ``told`` is what a model knows of it."""

    __slots__ = ("around", "description", "told")

    def __init__(self, around: Element | None, description: str) -> None:
        self.around, self.description, self.told = around, description, None


@dataclass
class Block:
    text: str
    inside: Element | None
    linked: int
    main: str | None = None

    @property
    def path(self) -> tuple[str, ...]:
        """The descriptions of the elements around the block, the outermost first."""
        found, at = [], self.inside
        while at is not None:
            found.append(at.description)
            at = at.around
        return tuple(found[::-1])


def _describe(tag: str, attributes: str) -> tuple[str, str | None]:
    """An element as its tag and the tokens of its attributes, and its mark, if it has one."""
    if not attributes or attributes.isspace():
        return tag, None
    tokens, mark = [], None
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == MARK:
            mark = value
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            tokens.append("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            tokens += [t.lower() for t in TOKEN.findall(value)]
    return " ".join([tag, *sorted(set(tokens))]), mark


def leaf_blocks(html: str) -> list[Block]:
    """The blocks of a page in order, those without text left out.

    Character references are decoded, white space within a block becomes one space. Missing end tags are
    supplied as far as HTML allows them to be left out; end tags that close nothing are ignored. Elements that are not
    text of the page end with an element around them, and do not cut the line they stand in.
    """
    stack: list[tuple[str, Element, str | None]] = []  # tag, element, innermost mark
    open_tags: Counter[str] = Counter()
    outer_skips: list[int] = []  # the places of elements that are skipped
    found: list[Block] = []
    parts: list[str] = []
    described: dict[tuple[str, str], tuple[str, str | None]] = {}
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked, in_link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = outer_skips[0] if outer_skips else len(stack)  # nothing is added within skipped elements
                _, inside, mark = stack[n - 1] if n else ("", None, None)
                found.append(Block(text, inside, min(linked, len(text)), mark))
            parts.clear()
        linked, in_link = 0, False

    def close(tag: str, until: tuple[str, ...] = ()) -> None:
        if not open_tags[tag]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                if not outer_skips or i < outer_skips[0] or i == outer_skips[0] and tag not in APART:
                    flush()
                open_tags.subtract(t for t, _, _ in stack[i:])
                del stack[i:]
                while outer_skips and outer_skips[-1] >= i:
                    outer_skips.pop()
                return
            if stack[i][0] in until:
                return

    def add(text: str) -> None:
        nonlocal linked
        if text and not outer_skips:
            if "&" in text:
                text = unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    at = 0
    while True:
        m = _MARKUP.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, ends = name.lower(), bool(m[1] or m[4])
        attributes = (m[3] if m[2] else m[6]) or ""
        if attributes.endswith("/"):
            if not ends and (tag == "svg" or open_tags["svg"]):
                continue
            attributes = attributes[:-1]
        if tag in RAW:
            if not ends:
                end = _END[tag].search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in INLINE:
            if tag == "a" and (ends or not outer_skips):
                in_link = not ends
            continue
        if tag in ("br", "wbr"):
            if not outer_skips and tag == "br":
                parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr" and not outer_skips:
                flush()
            continue
        if ends:
            if tag == "p" and not outer_skips and not open_tags["p"]:
                flush()
            close(tag, ("table",) if tag in ("p", "div", "li") else ())
            continue
        if tag in BLOCK_CLOSES_P and stack and stack[-1][0] == "p":
            close("p")
        if tag in CLOSES:
            for other in CLOSES[tag][0]:
                close(other, CLOSES[tag][1])
        if tag == "body":
            close("head")
        if tag in ("button", "select"):
            close(tag)
        if not outer_skips and tag not in APART:
            flush()
        key = (tag, attributes)
        if (known := described.get(key)) is None:
            known = described[key] = _describe(tag, attributes)
        if tag in SKIPPED:
            outer_skips.append(len(stack))
        outer, mark = (stack[-1][1], stack[-1][2]) if stack else (None, None)
        stack.append((tag, Element(outer, known[0]), mark if known[1] is None else known[1]))
        open_tags[tag] += 1
    flush()
    return found
