"""The labelled tree of a page: elements, comments and texts, numbered in document order."""

from __future__ import annotations

from collections.abc import Iterator


class Comment(str):
    __slots__ = ()


class Element:
    """``pre`` and ``last`` are the interval of document order, ``nth`` the place among siblings of the same tag, ``texts`` the interval of the page's texts."""

    __slots__ = ("attrs", "children", "depth", "last", "nth", "order", "parent", "pre", "tag", "texts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str | Comment] = []
        self.pre = self.last = self.depth = 0
        self.nth = 1
        self.texts = (0, 0)
        self.order: Order | None = None  # of numbered trees: all elements and texts of the page

    def elements(self) -> list[Element] | Iterator[Element]:
        """This element and those below it, in document order."""
        if self.order is not None:
            return self.order.elements[self.pre : self.last + 1]
        return self._walk()

    def _walk(self) -> Iterator[Element]:
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]

    def above(self) -> Iterator[Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    def kids(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def classes(self) -> list[str]:
        return self.attrs["class"].split() if "class" in self.attrs else []

    def __contains__(self, other: Element) -> bool:
        return self.pre <= other.pre <= self.last


class Order:
    """All elements and texts of a page in document order, so that what is below an element is a slice of them."""

    __slots__ = ("elements", "sizes", "texts")

    def __init__(self) -> None:
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self.sizes: list[int] | None = None  # prefix sums of the texts' lengths, white space collapsed


def number(root: Element) -> Element:
    """Give each element its place in document order, its last descendant's place, its depth, its place among its like and its texts."""
    order = Order()
    elements, texts = order.elements, order.texts
    todo: list = [root]
    while todo:
        x = todo.pop()
        if type(x) is str:
            texts.append(x)
        elif isinstance(x, Element):
            x.pre = len(elements)
            x.order = order
            x.depth = x.parent.depth + 1 if x.parent else 0
            x.texts = (len(texts), 0)
            elements.append(x)
            todo.append((x,))
            kids = x.children
            if len(kids) == 1:
                if isinstance(kids[0], Element):
                    kids[0].nth = 1
                todo.append(kids[0])
            elif kids:
                seen: dict[str, int] = {}
                for c in kids:
                    if isinstance(c, Element):
                        c.nth = seen[c.tag] = seen.get(c.tag, 0) + 1
                todo += reversed(kids)
        elif type(x) is tuple:
            (e,) = x
            e.last = len(elements) - 1
            e.texts = (e.texts[0], len(texts))
    return root
