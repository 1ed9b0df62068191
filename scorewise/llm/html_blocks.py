"""Leaf blocks of an HTML page: runs of text not broken by a block-level tag, with the tags they stand in."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

SPACES = re.compile(r"[\x20\x09-\x0D]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video head title".split())
# an opening tag ends an open element of its group, as HTML lets authors leave the end tag out
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table select body html".split())
# all that may stand in a head; any other opening tag ends a head that was left open
HEAD = frozenset("base basefont bgsound link meta title noscript noframes script style template head html".split())


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]  # ancestors, outermost first
    names: tuple[str, ...]  # class, id and role values of each ancestor, lower case
    linked: int  # characters inside links
    hidden: bool


@dataclass
class _Open:
    tag: str
    names: str
    hidden: bool = False


@dataclass
class _State:
    text: list[str] = field(default_factory=list)
    linked: int = 0


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.blocks: list[Block] = []
        self.title: list[str] = []
        self.now = _State()
        self.links = self.silent = 0

    def flush(self):
        text = SPACES.sub(" ", "".join(self.now.text)).strip(" ")
        if text:
            self.blocks.append(Block(
                text, tuple(o.tag for o in self.open), tuple(o.names for o in self.open), self.now.linked,
                any(o.hidden for o in self.open),
            ))
        self.now = _State()

    def pop(self, upto: int):
        for o in self.open[upto:]:
            self.links -= o.tag == "a"
            self.silent -= o.tag in SILENT
        del self.open[upto:]

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            # not one inside an element of the head that is silent itself, such as a noscript
            silent = [i for i, o in enumerate(self.open) if o.tag in SILENT]
            if silent and self.open[silent[-1]].tag == "head":
                self.flush()
                self.pop(silent[-1])
        if tag == "br":
            self.now.text.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if tag not in SILENT and "p" in (o.tag for o in self.open):  # a paragraph ends where a block starts
                self.pop(max(i for i, o in enumerate(self.open) if o.tag == "p"))
            if tag in ENDS:
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i].tag in ENDS[tag]:
                        self.pop(i)
                        break
                    if self.open[i].tag in FENCES:
                        break
        if tag in VOID:
            return
        values = dict(attrs)
        names = " ".join(values.get(k) or "" for k in ("class", "id", "role")).lower()
        style = (values.get("style") or "").replace(" ", "").lower()
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in style
        self.links += tag == "a"
        self.silent += tag in SILENT
        self.open.append(_Open(tag, names, hidden))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # in HTML a slash does not end an element

    def handle_endtag(self, tag):
        if tag not in INLINE and tag != "br":
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self.pop(i)
                break
            if tag in INLINE and self.open[i].tag not in INLINE:
                break

    def handle_data(self, data):
        if self.open and self.open[-1].tag == "head" and data.strip("\x20\t\n\x0b\f\r"):
            self.pop(len(self.open) - 1)  # words end an open head as well
        if self.open and self.open[-1].tag == "title":
            self.title.append(data)
        if not self.silent:
            self.now.text.append(data)
            if self.links:
                self.now.linked += len(data)


def blocks_of(html: str | None) -> tuple[list[Block], str]:
    """All leaf blocks with text, in page order, and the title."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks, SPACES.sub(" ", "".join(reader.title)).strip(" ")
