"""Leaf blocks of a page: runs of text between block-level tags, with the elements around them.

One pass over the page: every character is looked at a bounded number of times, whatever the nesting. Elements are linked
to their parents, and counts of what is open answer what an end tag may close, so no step walks a deep stack in vain.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

NAME = re.compile(r"[^\s/>]+")
#: The next attribute of a tag, or its end. A quote opens a value only right after the equals sign.
ATTRIBUTE = re.compile(
    r"""[\s/]*+(?:(?P<end>>)|(?P<name>=?[^\s/>=]*+)(?:\s*+=\s*+(?:"(?P<double>[^"]*+)(?P<dq>")?|'(?P<single>[^']*+)(?P<sq>')?|(?P<plain>[^\s>"'][^\s>]*+)?))?+)"""
)
KEPT = frozenset("class id role aria-label hidden".split())
PIECE = re.compile(r"[A-Za-z]{2,}")
#: A class with one of these words tells how a page looks, not what the element is (has-sidebar, share-enabled).
STATES = frozenset("has with without no not is are enabled disabled active inactive show shown hide open closed layout col cols grid row js".split())
COMMENT_ENDS = re.compile("--!?>")
#: The content of these is raw up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Form controls: what they say is no text of the article, wherever they stand.
CONTROLS = frozenset("button label input select textarea datalist output meter progress".split())
UNSEEN = RAW | CONTROLS | frozenset("head template noscript svg object canvas audio video annotation annotation-xml".split())
INLINE = CONTROLS | frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr picture source svg math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mstyle "
    "mspace mpadded mphantom menclose merror semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of the value, up to the next table, list or section.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("table ul ol dl div section article main aside nav header footer body form blockquote".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())


#: Hidden elements that an unclosed tag leaves open; they end where a block begins before their own end tag comes.
UNCLOSED = UNSEEN - RAW - {"head", "svg", "annotation", "annotation-xml", "input"}


class Element:
    """A block-level element: token ("tag word word", of its class, id, role), parent, the characters of text and of links below it.

    ``new`` are the features that no ancestor has. Those of an element that holds most of the page's text are features of their own: all
    that a page has stands in its wrappers, whatever they are called.
    """

    __slots__ = ("token", "parent", "new", "size", "linked")

    def __init__(self, token: str, parent: Element | None):
        self.token, self.parent, self.new, self.size, self.linked = token, parent, [], 0, 0


class Block:
    """Text, the innermost element around it, and the number of its characters inside links."""

    __slots__ = ("text", "within", "linked")

    def __init__(self, text: str, within: Element | None, linked: int):
        self.text, self.within, self.linked = text, within, linked

    def around(self):
        """The elements around it, from the innermost to the root."""
        element = self.within
        while element:
            yield element
            element = element.parent

    @property
    def path(self) -> tuple[str, ...]:
        return tuple(e.token for e in self.around())[::-1]


def element_features(token: str, wide: bool) -> list[str]:
    tag, *names = token.split(" ")
    lead = "wide " if wide else ""
    return [f"{lead}in {tag}", *(f"{lead}named {n}" for n in names)]


#: Share of the page's text from which on an element is wide.
WIDE = 0.5


def measure(made: list[Block], elements: list[Element]) -> None:
    """Sizes of the elements, in the order of their start tags, and their features."""
    for block in made:
        if block.within:
            block.within.size += len(block.text)
            block.within.linked += min(block.linked, len(block.text))
    for e in reversed(elements):
        if e.parent:
            e.parent.size += e.size
            e.parent.linked += e.linked
    total = sum(len(block.text) for block in made)
    path: list[tuple[Element, list[str]]] = []
    features: Counter[str] = Counter()
    for e in elements:
        while path and path[-1][0] is not e.parent:
            features.subtract(path.pop()[1])
        own = element_features(e.token, e.size >= WIDE * total)
        e.new = [f for f in own if not features[f]]
        features.update(own)
        path.append((e, own))


def _tag(page: str, at: int, kept: list[tuple[str, str]]) -> int:
    """The place behind the tag whose attributes start at ``at``, or the end of the page if it is cut off there.

    A value whose quote is never closed ends with the tag, at the next ``>``.
    """
    while True:
        found = ATTRIBUTE.match(page, at)
        if found["end"]:
            return found.end()
        double, single = found["double"], found["single"]
        if (double is not None and not found["dq"]) or (single is not None and not found["sq"]):
            end = page.find(">", found.start("double" if double is not None else "single"))
            return end + 1 or len(page)
        if found.end() == len(page) or found.end() == at:
            return len(page)
        name = found["name"].lower()
        if name in KEPT:
            kept.append((name, double or single or found["plain"] or ""))
        at = found.end()


def _token(name: str, kept: list[tuple[str, str]]) -> str:
    words = [name]
    for key, value in kept:
        named = [[w.lower() for w in PIECE.findall(x)] for x in value.split()]
        words += ["hidden"] if key == "hidden" else [w for part in named if STATES.isdisjoint(part) for w in part]
    return " ".join(dict.fromkeys(words))


class _Reader:
    """The open elements and the text of the block that is being read."""

    def __init__(self, page: str = ""):
        self.page, self.at = page, 0  # the place behind the tag that is read
        self.places: dict[str, tuple[list[int], list[int]]] = {}
        self.made: list[Block] = []
        self.all: list[Element] = []
        self.names: list[str] = []  # of the open elements
        self.elements: list[Element | None] = []  # None for inline ones
        self.open: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]  # elements opened since each open element of SCOPE
        self.lines: list[Counter[str]] = [Counter()]  # inline elements opened since each open block-level element
        self.within: Element | None = None
        self.pending: list[str] = []
        self.linked = self.unseen = 0

    def flush(self) -> None:
        if self.pending:
            text = " ".join("".join(self.pending).split())
            if text:
                self.made.append(Block(text, self.within, self.linked))
            self.pending.clear()
        self.linked = 0

    def text(self, part: str) -> None:
        if not part:
            return
        if self.names and self.names[-1] == "head" and not part.isspace():
            self.leave()
        if not self.unseen:
            part = html.unescape(part)  # by itself: a reference does not go on behind a tag
            self.pending.append(part)
            if self.open["a"]:
                self.linked += len(part)

    def enter(self, name: str, token: str) -> None:
        self.scopes[-1][name] += 1
        if name in SCOPE:
            self.scopes.append(Counter())
        self.open[name] += 1
        self.unseen += name in UNSEEN
        self.names.append(name)
        if name in INLINE:
            self.lines[-1][name] += 1
            self.elements.append(None)
            return
        self.flush()
        self.lines.append(Counter())
        self.within = Element(token, self.within)
        self.all.append(self.within)
        self.elements.append(self.within)

    def leave(self) -> None:
        """Close the innermost element."""
        name, element = self.names.pop(), self.elements.pop()
        if name in SCOPE:
            self.scopes.pop()
        self.scopes[-1][name] -= 1
        if element is None:
            self.lines[-1][name] -= 1
        else:
            self.flush()
            self.lines.pop()
            self.within = element.parent
        self.open[name] -= 1
        self.unseen -= name in UNSEEN

    def leave_to(self, names: set[str]) -> None:
        """Close elements up to the innermost of the names, which is open."""
        while self.names[-1] not in names:
            self.leave()
        self.leave()

    def is_closed(self, name: str) -> bool:
        """Whether the open element's end tag comes, and before another start tag of its name."""
        if name not in self.places:
            both = [[m.start() for m in re.finditer(rf"<{lead}{re.escape(name)}(?=[\s/>])", self.page, re.I)] for lead in ("", "/")]
            self.places[name] = both[0], both[1]
        starts, ends = self.places[name]
        start, end = bisect_left(starts, self.at), bisect_left(ends, self.at)
        return end < len(ends) and (start == len(starts) or ends[end] < starts[start])

    def start(self, name: str, kept: list[tuple[str, str]], closed: bool) -> None:
        if self.names and self.names[-1] == "head" and name not in IN_HEAD:
            self.leave()
        if name in CONTROLS and not self.unseen:
            self.pending.append(" ")
        if self.unseen and name in ENDS_P:
            for hidden in UNCLOSED:
                while self.open[hidden] and not self.is_closed(hidden):
                    self.leave_to({hidden})
        if name in ENDS_P and self.open["svg"] and not self.open["foreignobject"]:
            self.leave_to({"svg"})  # a drawing that was never closed ends where text goes on
        if name in VOID:
            if name == "br":
                self.text(" ")
            elif name not in INLINE:
                self.flush()
            return
        if name not in INLINE:
            self.flush()
            closes = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
            while any(self.scopes[-1][c] for c in closes):
                self.leave_to(closes)
        if closed and (name in ("svg", "math") or self.open["svg"] or self.open["math"]):
            return
        self.enter(name, _token(name, kept) if kept else name)

    def end(self, name: str) -> None:
        if name == "br":
            self.text(" ")
        elif name in INLINE:
            if self.lines[-1][name]:
                self.leave_to({name})
        elif self.open[name]:
            self.leave_to({name})
        else:
            self.flush()


def blocks(page: str) -> list[Block]:
    """As ``read``, the blocks alone."""
    return read(page)[0]


def read(page: str) -> tuple[list[Block], list[Element]]:
    """The leaf blocks of a page, in order, white space made single, character references decoded, without empty ones.

    Unclosed and misnested tags are closed as browsers do in the common cases; a tag cut off by the end of the page is dropped.
    The elements come in the order of their start tags.
    """
    reader, at = _Reader(page), 0
    while at < len(page):
        tag = page.find("<", at)
        if tag < 0:
            reader.text(page[at:])
            break
        after = page[tag + 1 : tag + 3]
        begin = tag + 1 + after.startswith("/")
        if after[:1] in ("!", "?") or (after[:1] == "/" and after[1:] and not (after[1].isascii() and after[1].isalpha())):
            reader.text(page[at:tag])
            if page.startswith("<!--", tag):
                short = page.startswith((">", "->"), tag + 4)
                ends = None if short else COMMENT_ENDS.search(page, tag + 4)
                at = page.find(">", tag) + 1 if short else ends.end() if ends else len(page)
            else:
                at = page.find(">", tag) + 1 or len(page)
            continue
        if not (page[begin : begin + 1].isascii() and page[begin : begin + 1].isalpha()):
            reader.text(page[at : tag + 1])
            at = tag + 1
            continue
        reader.text(page[at:tag])
        named = NAME.match(page, begin)
        name, kept, at = named[0].lower(), [], named.end()
        at = at + 1 if page.startswith(">", at) else _tag(page, at, kept)
        if at == len(page) and page[-1] != ">":
            break
        if begin > tag + 1:
            reader.end(name)
            continue
        reader.at = at
        reader.start(name, kept, page[at - 2] == "/")
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    while reader.names:
        reader.leave()
    reader.flush()
    return reader.made, reader.all
