"""Blocks of HTML pages: runs of text between block-level tags, with the path of tags above them."""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import defaultdict
from dataclasses import dataclass

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"[\s ]+")
_PART = re.compile(r"[a-z]+|[A-Z]+[a-z]*|\d+")
#: Elements whose content isn't markup or isn't shown, and lists to choose from in forms.
RAW = frozenset("script style template textarea select iframe noframes noembed canvas audio video annotation annotation-xml desc metadata".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
#: Elements that don't end a block: HTML's, formulas' and drawings'.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics "
    "svg circle clippath defs ellipse g line path polygon polyline rect symbol text textpath tspan use".split()
)
#: A start tag ends open elements of these kinds, up to the nearest of the others.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    """An open element: its tag, the parts of its class, id and role, the element around it, how many are, the innermost
    block-level tag, and what names and block-level tags it has that none around it has."""

    __slots__ = ("tag", "names", "parent", "depth", "inner", "new", "vector")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None, new: list[str]):
        self.tag, self.names, self.parent, self.new, self.vector = tag, names, parent, new, None
        self.depth = parent.depth + 1 if parent else 0
        self.inner = parent.inner if parent and tag in INLINE else tag


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    linked: int  # code points inside links

    @property
    def path(self) -> list[tuple[str, tuple[str, ...]]]:
        """(tag, names) of the elements around it, from the root down."""
        out, node = [], self.node
        while node.parent:
            out.append((node.tag, node.names))
            node = node.parent
        return out[::-1]


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        out += [p.lower() for p in _PART.findall(m[2] or m[3] or m[4] or "")]
    return tuple(out)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order. White space is one blank, character references are decoded; blocks without visible
    characters aren't there. Comments, declarations and the content of RAW elements are left out; an unclosed RAW
    element ends with the page. A paragraph ends where another block-level element starts, list items, cells and terms
    where the next does, and an end tag that opens nothing means nothing. Text after a `<` that begins no tag is text. Elements
    of any depth count."""
    out: list[Block] = []
    stack: list[tuple[str, Node]] = []  # all open elements
    root = node = Node("", (), None, [])
    around: defaultdict[str, int] = defaultdict(int)  # open elements by name and block-level tag
    places: defaultdict[str, list[int]] = defaultdict(list)  # in the stack, by tag
    outer: list[int] = []  # places of block-level elements
    pieces: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            text = _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
            if text:
                out.append(Block(text, node, min(linked, len(text))))
        linked = 0

    def close(k: int) -> None:
        """Ends the open elements from number k on."""
        nonlocal links, node
        if outer and outer[-1] >= k:
            flush()
        while len(stack) > k:
            t, gone = stack.pop()
            places[t].pop()
            links -= t == "a"
            if t not in INLINE:
                outer.pop()
            for x in gone.new:
                around[x] -= 1
            node = gone.parent or root

    at = 0
    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            pieces.append(page[at:end])
            if links > 0:
                linked += end - at
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, attributes = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            if places[tag]:
                close(places[tag][-1])
            elif tag in ("p", "br"):
                flush() if tag == "p" else pieces.append(" ")
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                stop = _RAW_END[tag].search(page, at)
                at = n if not stop else (page.find(">", stop.start()) + 1 or n)
            continue
        if tag in VOID:
            if tag in INLINE:
                pieces.append(" ") if tag == "br" else None
            else:
                flush()
            continue
        if tag not in INLINE:
            flush()
            kinds, walls = _ENDS.get(tag, ((), ()))
            if kinds:
                wall = max((places[t][-1] for t in walls if places[t]), default=-1)
                ended = [places[t][i] for t in (*kinds, "p") if (i := bisect(places[t], wall)) < len(places[t])]
                if ended:
                    close(min(ended))
            elif outer and stack[outer[-1]][0] == "p":
                close(outer[-1])
        elif tag == "a":
            links += 1
        if not attributes.endswith("/") or tag not in INLINE:
            inline, names = tag in INLINE, _names(attributes)
            new = []
            for x in names if inline else (f"<{tag}", *names):
                if not around[x]:
                    around[x] += 1
                    new.append(x)
            node = Node(tag, names, node, new)
            if not inline:
                outer.append(len(stack))
            places[tag].append(len(stack))
            stack.append((tag, node))
        elif tag == "a":
            links -= 1
    flush()
    return out
