"""HTML as a sequence of leaf blocks: text with the path of its open elements.

A forgiving pass over tags. Scripts, styles, titles, comments, templates, frames,
drawings, media with their fallbacks, and the document head are no text; formulas
are. Without an end tag, raw text (``RAW``) runs to the end of the page, as in
browsers; any other silent element is only its tag then, and a head that
``body`` or a block starts in before it ends is that too. Block-level elements end a block; ``br`` and inline
elements do not (``br`` counts as white space). Character references are
decoded in each piece of text between tags, so no tag can lie inside one.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections import Counter
from typing import NamedTuple

#: Elements that separate blocks, never have content, whose content is no text (raw up to their end tag, or with elements), or in which "/" ends an element.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title iframe".split())
SILENT = frozenset("noscript template svg object canvas audio video".split())
FOREIGN = frozenset("svg math".split())
#: An element of the key ends an open element of the value.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = BLOCK - {"button", "option", "optgroup", "select", "textarea", "legend", "caption", "tr", "td", "th", "tbody", "thead", "tfoot"}

#: Names that mark boilerplate or main text in sectioning elements, classes and ids.
APART = frozenset("nav aside footer header form ad ads advert advertisement banner sponsored promo cookie consent notice popup modal overlay newsletter subscribe sidebar widget related recommended share social comment comments reply discussion menu breadcrumb breadcrumbs pagination login search navbar topbar masthead toolbar".split())
MAIN = frozenset(("article", "main"))
#: Names of a path are hashed to so many bits.
PATH_BITS = 10

_START = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*)", re.S)
_STOP = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")


_HASHES: dict[tuple[str, int], int] = {}


def slot(word: str, bits: int) -> int:
    """A word's hash of ``bits`` bits."""
    key = (word, bits)
    found = _HASHES.get(key)
    if found is None:
        if len(_HASHES) > 200_000:
            _HASHES.clear()
        found = _HASHES[key] = (zlib.crc32(word.encode("utf-8", "surrogatepass")) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)
    return found


class Path:
    """What is told of a block's open elements: the hashed names of all, the last name, and whether one is set apart or main.

    An element knows its parent, and shares its parent's set if its names occur
    above it already, so paths take memory by their different names, however
    deep they are. ``path[k]`` is the k-th of all names, found by going up.
    """

    __slots__ = ("slots", "last", "apart", "main", "parent", "own")

    def __init__(self, slots: frozenset[int], last: str, apart: bool, main: bool, parent: Path | None = None, own: tuple[str, ...] = ()):
        self.slots, self.last, self.apart, self.main, self.parent, self.own = slots, last, apart, main, parent, own

    @staticmethod
    def of(names: tuple[str, ...]) -> Path:
        """The path of elements without names of their own."""
        out = ROOT
        for name in names:
            out = out.below(name, ())
        return out

    def names(self) -> list[str]:
        """The names of all open elements, outermost first."""
        out, at = [], self
        while at is not None:
            out += reversed(at.own)
            at = at.parent
        return out[::-1]

    def __getitem__(self, k: int) -> str:
        return self.names()[k]

    def below(self, tag: str, names: tuple[str, ...]) -> Path:
        own = {slot(x, PATH_BITS) for x in (tag, *names)}
        slots = self.slots if own <= self.slots else self.slots | own
        every = {tag, *names}
        return Path(slots, names[-1] if names else tag, self.apart or not APART.isdisjoint(every), self.main or not MAIN.isdisjoint(every), self, (tag, *names))


ROOT = Path(frozenset(), "", False, False)


class Block(NamedTuple):
    text: str
    path: Path
    link_share: float


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = []
    for m in _NAMES.finditer(attributes):
        found += _PART.findall((m[1] or m[2] or m[3] or "").lower())
    return tuple(found)


class Token(NamedTuple):
    start: int
    end: int
    name: str  # empty where nothing but the place counts
    closing: bool
    attributes: str


def _tag_end(page: str, at: int, no_tag_inside: bool, unpaired: set[str]) -> tuple[int, int]:
    """Where a tag's attributes end and where the tag does, from the end of its name.

    A ``>`` in quotes does not end it. A quote that is never closed, or that
    would take in a ``<`` where ``no_tag_inside``, is an ordinary character; a
    tag without ``>`` runs to the end of the page. All that is looked at belongs
    to the tag, but for the search of a missing quote, which ``unpaired`` allows once.
    """
    while m := _STOP.search(page, at):
        c, at = m[0], m.end()
        if c == ">":
            return m.start(), at
        if c in unpaired:
            continue
        end = page.find(c, at)
        if end < 0:
            unpaired.add(c)
        elif not (no_tag_inside and page.find("<", at, end) >= 0):
            at = end + 1
    return len(page), len(page)


def _tokens(page: str) -> list[Token]:
    """Tags, comments and declarations; a raw-text element is one nameless token. One pass, whatever the page."""
    out, at, foreign = [], 0, 0
    unpaired: set[str] = set()
    while m := _START.search(page, at):
        at = m.end()
        if m[2] is None:
            out.append(Token(m.start(), at, "", False, ""))
            continue
        name, closing = m[2].lower(), bool(m[1])
        stop, end = _tag_end(page, at, not closing and (name in RAW or name in SILENT), unpaired)
        attributes, at = page[at:stop], end
        if name in FOREIGN:
            if closing:
                foreign = max(0, foreign - 1)
            elif not attributes.endswith("/"):
                foreign += 1
        elif name in RAW and not closing:
            if not (foreign and attributes.endswith("/")):
                found = _RAW_END[name].search(page, at)
                at = found.end() if found else len(page)
            name = ""
        out.append(Token(m.start(), at, name, closing, attributes))
    return out


def _silent_spans(tokens: list[Token]) -> dict[int, int]:
    """From the start tags of silent elements to their end tags, as places in ``tokens``."""
    spans: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for k, t in enumerate(tokens):
        if t.name in SILENT:
            held = opened.setdefault(t.name, [])
            if not t.closing:
                if not (t.name in FOREIGN and t.attributes.endswith("/")):
                    held.append(k)
            elif held:
                spans[held.pop()] = k
    head, k = None, 0
    while k < len(tokens):
        t = tokens[k]
        if t.name == "head":
            if t.closing and head is not None:
                spans[head] = k
            head = None if t.closing else k
        elif not t.closing and (t.name == "body" or t.name in BLOCK):
            head = None
        k = spans.get(k, k) + 1
    return spans


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page with text, in page order."""
    blocks: list[Block] = []
    if not page:
        return blocks
    stack: list[tuple[str, Path]] = []
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    linked, in_link, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            blocks.append(Block(text, stack[-1][1] if stack else ROOT, min(1.0, linked / len(text))))
        pieces.clear()
        linked = 0

    def pop() -> str:
        tag, _ = stack.pop()
        open_tags[tag] -= 1
        return tag

    tokens = _tokens(page)
    spans, silent_to = _silent_spans(tokens), -1
    for k_token, t in enumerate(tokens):
        if k_token <= silent_to:
            at = t.end
            continue
        if t.start > at:
            piece = _html.unescape(page[at : t.start])
            pieces.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = t.end
        name = t.name
        silent_to = spans.get(k_token, -1)
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = 0 if t.closing else 1
        elif name in BLOCK:
            close()
            if t.closing:
                if open_tags[name]:
                    while pop() != name:
                        pass
                    in_link = 0
            else:
                if name in _ENDS_P and stack and stack[-1][0] == "p":
                    pop()
                ends = ENDS.get(name)
                while ends and stack and stack[-1][0] in ends:
                    pop()
                if name != "hr" and not t.attributes.endswith("/"):
                    stack.append((name, (stack[-1][1] if stack else ROOT).below(name, _names(t.attributes))))
                    open_tags[name] += 1
    if at < len(page):
        pieces.append(_html.unescape(page[at:]))
    close()
    return blocks
