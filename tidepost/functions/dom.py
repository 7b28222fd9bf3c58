"""A small element tree of one page, and selectors over it. Pure functions; one page at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements without an end tag; those whose text nobody sees; what a new element closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(("script", "style", "template"))
CLOSES = {"li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          **{tag: {"p"} for tag in "p div ul ol table section article header footer nav h1 h2 h3 h4 h5 h6 pre".split()}}


@dataclass(eq=False)
class Node:
    tag: str
    attributes: dict[str, str]
    parent: Node | None = None
    children: list = field(default_factory=list)

    def descendants(self) -> Iterator[Node]:
        """Elements below, in page order."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, Node):
                yield child
                stack.append(iter(child.children))

    def pieces(self) -> Iterator[str]:
        """Pieces of text in page order, without scripts and styles."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                yield child
            elif child.tag not in UNSEEN:
                stack.append(iter(child.children))

    def text(self, separator: str = " ") -> str:
        """The whole text of the element; white space inside a piece is one space."""
        return separator.join(x for x in (" ".join(piece.split()) for piece in self.pieces()) if x)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.now.tag in CLOSES.get(tag, ()):
            self.now = self.now.parent or self.root
        node = Node(tag, {name: value or "" for name, value in reversed(attrs)}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.now
        while node is not self.root and node.tag != tag:
            node = node.parent or self.root
        if node is not self.root:
            self.now = node.parent or self.root

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def parse(page: str | None) -> Node:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


@dataclass(frozen=True)
class Select:
    """Which elements, and what of them.

    ``css`` names one class or several (all are needed), ``within`` an element around it (the first found),
    ``holding`` an attribute and a part of its value, ``nth`` the place among all children of the parent,
    ``contains`` words of its text. The value is its text, or the attribute ``take``; with ``part`` (separator,
    number) one piece of the text.
    """

    tag: str | None = None
    css: str | None = None
    dom_id: str | None = None
    within: Select | None = None
    holding: tuple[str, str] | None = None
    nth: int | None = None
    contains: str | None = None
    take: str | None = None
    part: tuple[str, int] | None = None

    def _fits(self, node: Node) -> bool:
        if self.tag is not None and node.tag != self.tag:
            return False
        if self.css is not None and not set(self.css.split()) <= set(node.attributes.get("class", "").split()):
            return False
        if self.dom_id is not None and node.attributes.get("id") != self.dom_id:
            return False
        if self.holding is not None and self.holding[1] not in node.attributes.get(self.holding[0], ""):
            return False
        if self.nth is not None:
            siblings = [c for c in node.parent.children if isinstance(c, Node)] if node.parent else []
            if len(siblings) < self.nth or siblings[self.nth - 1] is not node:
                return False
        return self.contains is None or self.contains in node.text()

    def all(self, root: Node) -> Iterator[Node]:
        if self.within is not None:
            around = next(self.within.all(root), None)
            return iter(()) if around is None else (n for n in around.descendants() if self._fits(n))
        return (n for n in root.descendants() if self._fits(n))

    def value(self, root: Node) -> str | None:
        """The value of the first element that has one that is not empty."""
        node = next(self.all(root), None)
        if node is None:
            return None
        if self.take is not None:
            found = node.attributes.get(self.take, "").strip()
        elif self.part is not None:
            pieces = "".join(f"{x}{self.part[0]}" for x in node.pieces()).split(self.part[0])
            found = pieces[self.part[1] - 1].strip() if len(pieces) - 1 >= self.part[1] else ""
        else:
            found = node.text()
        return found or None


def first_value(root: Node, selects: tuple[Select, ...]) -> str | None:
    return next((v for v in (s.value(root) for s in selects) if v is not None), None)
