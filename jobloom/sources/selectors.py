"""Elements of a page as rows, and selectors over them.

A selector is a list of steps: a tag (or *), then any of .class, #id, [attr], [attr=value], [attr*=part], [attr^=start] and
[attr$=end]; steps stand inside one another ("div .card a") or right under one another ("ul > li"); commas part alternatives. Classes and tags
are whole names. The steps are matched from the element upwards, which needs no look at the page besides the element's ancestors.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "wbr"}
#: Open tags that a tag ends where pages leave the end tag out, unless one of BOXES was opened between.
ENDS = {"li": {"li"}, "option": {"option"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOXES = {"ul", "ol", "select", "table", "dl", "div", "section", "article"}
WORD = re.compile(r">|(?:\[[^\]]*\]|[^\s>\[])+")
PART = re.compile(r"""\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$]?=)\s*(?P<q>["']?)(?P<value>[^\]"']*)(?P=q)\s*)?\]""", re.X)


@dataclass
class Element:
    no: int
    parent: Element | None
    tag: str
    attrs: dict[str, str]
    text_from: int
    source_from: int
    text_to: int = 0
    source_to: int = 0
    last: int = 0
    classes: set[str] = field(default_factory=set)


class Page(HTMLParser):
    """Elements in document order; an element's text and markup are ranges of the page's pieces of text and of its source."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.elements, self.open, self.pieces = html, [], [], []
        self.depth: Counter[str] = Counter()  # open elements by tag
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()
        self.shut(0, len(html))

    def here(self) -> int:
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if any(self.depth[x] for x in ENDS.get(tag, ())):
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at].tag in BOXES:
                    break
                if self.open[at].tag in ENDS[tag]:
                    self.shut(at, self.here())
                    break
        values = {k: v or "" for k, v in reversed(attrs)}
        e = Element(len(self.elements), self.open[-1] if self.open else None, tag, values, len(self.pieces), self.here() + len(self.get_starttag_text() or ""), classes=set(values.get("class", "").split()))
        e.text_to, e.source_to, e.last = e.text_from, e.source_from, e.no
        self.elements.append(e)
        if tag not in VOID:
            self.open.append(e)
            self.depth[tag] += 1

    def handle_endtag(self, tag):
        for at in () if not self.depth[tag] else range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                self.shut(at, self.here())
                return

    def shut(self, at: int, source_to: int) -> None:
        """Ends the open elements from a depth on."""
        for e in self.open[at:]:
            e.text_to, e.source_to, e.last = len(self.pieces), source_to, len(self.elements) - 1
            self.depth[e.tag] -= 1
        del self.open[at:]

    def handle_data(self, data):
        if self.open and self.open[-1].tag not in ("script", "style"):
            self.pieces.append(data)

    def text(self, e: Element) -> str:
        return " ".join(" ".join(self.pieces[e.text_from : e.text_to]).split())

    def markup(self, e: Element) -> str:
        return self.html[e.source_from : e.source_to]

    def inside(self, e: Element) -> list[Element]:
        return self.elements[e.no + 1 : e.last + 1]

    def find(self, selector: str | list, within: Element | None = None) -> list[Element]:
        """Elements that a selector matches, in document order."""
        alternatives = parse(selector) if isinstance(selector, str) else selector
        return [e for e in (self.inside(within) if within else self.elements) if any(fits(e, steps) for steps in alternatives)]

    def outermost(self, selector: str) -> list[Element]:
        """Matches that do not stand inside another match."""
        out: list[Element] = []
        for e in self.find(selector):
            if not out or e.no > out[-1].last:
                out.append(e)
        return out


def parse(selector: str) -> list[list[tuple[str, str, list[tuple]]]]:
    """Alternatives, each a list of (combinator before it, tag, tests); the combinator is " " or ">"."""
    out = []
    for one in re.split(r",(?![^\[]*\])", selector):
        steps, combinator = [], " "
        if WORD.sub("", one).strip():
            raise ValueError(f"selector: {selector!r}")
        for word in WORD.findall(one):
            if word == ">":
                combinator = ">"
                continue
            tag = re.match(r"[\w-]+|\*", word)
            tests, at = [], tag.end() if tag else 0
            while at < len(word):
                m = PART.match(word, at)
                if not m:
                    raise ValueError(f"selector: {word!r} in {selector!r}")
                tests.append((m["cls"], m["id"], m["attr"], m["op"], m["value"]))
                at = m.end()
            steps.append((combinator, tag.group().lower() if tag else "*", tests))
            combinator = " "
        if not steps or combinator == ">":
            raise ValueError(f"selector: {selector!r}")
        out.append(steps)
    return out


def _is(e: Element, tag: str, tests: list[tuple]) -> bool:
    if tag not in ("*", e.tag):
        return False
    for cls, id_, attr, op, value in tests:
        if cls is not None and cls not in e.classes or id_ is not None and e.attrs.get("id") != id_:
            return False
        if attr is not None:
            has = e.attrs.get(attr.lower())
            if has is None or not {None: True, "=": has == value, "*=": bool(value) and value in has, "^=": bool(value) and has.startswith(value or " "), "$=": bool(value) and has.endswith(value or " ")}[op]:
                return False
    return True


def fits(e: Element, steps: list[tuple[str, str, list[tuple]]]) -> bool:
    """Whether an element ends the steps: for each step from the last, the ancestors at which it may stand."""
    if not _is(e, *steps[-1][1:]):
        return False
    at = [e]
    for k in range(len(steps) - 1, 0, -1):
        above: dict[int, Element] = {}
        for x in at:
            p = x.parent
            while p is not None and p.no not in above:
                if _is(p, *steps[k - 1][1:]):
                    above[p.no] = p
                if steps[k][0] == ">":
                    break
                p = p.parent
        at = list(above.values())
        if not at:
            return False
    return True
