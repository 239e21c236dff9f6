"""A small element tree over the standard library's HTML parser: enough to find elements and read their text."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A tag in the first set ends an open element of the second, up to the container in the third.
_ENDS = {
    "p": ({"p"}, {"td", "th", "div", "li"}), "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}


def squeezed(text: str | None) -> str:
    return " ".join((text or "").split())


class Node:
    """An element. Elements and strings are kept in the order of the page in two lists that all of a page's nodes share, so what is inside a node is a slice of each."""

    __slots__ = ("tag", "attrs", "_nodes", "_strings", "_from", "_to", "_text")

    def __init__(self, tag: str, attrs: dict[str, str], nodes: list[Node], strings: list[str]):
        self.tag, self.attrs, self._nodes, self._strings, self._text = tag, attrs, nodes, strings, None
        nodes.append(self)
        self._from = self._to = (len(nodes), len(strings))

    def close(self) -> None:
        self._to = (len(self._nodes), len(self._strings))

    def walk(self) -> list[Node]:
        """All elements below, in the order of the page."""
        return self._nodes[self._from[0] : self._to[0]]

    def strings(self) -> list[str]:
        return self._strings[self._from[1] : self._to[1]]

    @property
    def text(self) -> str:
        """The strings inside, each stripped, joined by one space."""
        if self._text is None:
            self._text = squeezed(" ".join(self.strings()))
        return self._text

    def all(self, *tags: str, where: Callable[[Node], bool] | None = None) -> list[Node]:
        return [n for n in self.walk() if (not tags or n.tag in tags) and (where is None or where(n))]

    def first(self, *tags: str, where: Callable[[Node], bool] | None = None) -> Node | None:
        return next((n for n in self.walk() if (not tags or n.tag in tags) and (where is None or where(n))), None)

    def has(self, name: str) -> bool:
        """Whether ``name`` is one of the element's classes."""
        given = self.attrs.get("class")
        return given is not None and name in given and name in given.split()

    def links(self, part: str) -> list[Node]:
        """Anchors whose target holds ``part``."""
        return self.all("a", where=lambda n: part in n.attrs.get("href", ""))


#: Tags as most pages have them: lower case, quoted values without references. The standard parser takes all others, and elements whose content is no markup.
_PLAIN = re.compile(r"""<([a-z][a-z0-9]*)((?:\x20[a-z][a-z-]*=(?:"[^"<>&]*"|'[^'<>&]*'))*)>""")
_VALUE = re.compile(r"""([a-z][a-z-]*)=(?:"([^"]*)"|'([^']*)')""")
_PLAIN_END = re.compile("</([a-z][a-z0-9]*)>")
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())


class _Builder(HTMLParser):
    def updatepos(self, i, j):  # lines aren't counted
        return j

    def parse_starttag(self, i):
        found = _PLAIN.match(self.rawdata, i)
        if not found or found[1] in _RAW:
            return super().parse_starttag(i)
        self.lasttag = found[1]
        self.handle_starttag(found[1], [(m[1], m[2] or m[3]) for m in _VALUE.finditer(found[2])] if found[2] else ())
        return found.end()

    def parse_endtag(self, i):
        found = self.cdata_elem is None and _PLAIN_END.match(self.rawdata, i)
        if not found or found[1] in _RAW:
            return super().parse_endtag(i)
        self.handle_endtag(found[1])
        return found.end()

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.strings = [], []
        self.open = [Node("", {}, self.nodes, self.strings)]

    def end(self, at: int) -> None:
        """The open elements from ``at`` on hold no more."""
        for node in self.open[at:]:
            node.close()
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS:
            ended, container = _ENDS[tag]
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag in container:
                    break
                if self.open[at].tag in ended:
                    self.end(at)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.nodes, self.strings)
        if tag not in _EMPTY:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self.end(at)
                return

    def handle_data(self, data):
        self.strings.append(data)


def parsed(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    page = builder.open[0]
    builder.end(0)
    return page
