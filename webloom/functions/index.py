"""What is known of a page after one walk: counts for unique selectors, sums over document order.

Counts by id, tag, tag and class, and tag and set of classes prove most selectors unique by a lookup; the rest
is proved by intersecting the postings of their classes. Lengths of texts and links are prefix sums, so what an
element holds is the difference of two of them, whatever its size.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from functools import cached_property
from itertools import accumulate

from webloom.functions.dom import Element, squeeze
from webloom.functions.selectors import SelectorError, select
from webloom.functions.urls import resolve

SAFE = re.compile(r"(?:-?[A-Za-z_]|-(?=[A-Za-z_]))[A-Za-z0-9_-]*\Z")


class Page:
    """A numbered tree with its URL, and what is found out about it once."""

    def __init__(self, root: Element, url: str = ""):
        self.root, self.url = root, url
        self.elements = root.elements()

    @cached_property
    def base(self) -> str:
        """What addresses are resolved against: the first ``base``, which may be relative itself."""
        found = next((e for e in self.elements if e.tag == "base" and "href" in e.attrs), None)
        return (resolve(self.url, found.get("href")) if found else "") or self.url

    # sums over document order -----------------------------------------------------------------------------

    @cached_property
    def _chars(self) -> list[int]:
        """Before each text: characters of the texts so far, white space collapsed and one space behind each."""
        return [0, *accumulate(len(t) + 1 if (t := squeeze(x)) else 0 for x in self.root.order.texts)]

    def chars(self, e: Element) -> int:
        """The length of an element's collapsed text."""
        a, b = e.texts
        return max(0, self._chars[b] - self._chars[a] - 1)

    def sums(self, weight) -> list[int]:
        """Before each element: the weights of the elements so far."""
        return [0, *accumulate(map(weight, self.elements))]

    @cached_property
    def _linked(self) -> list[int]:
        return self.sums(lambda e: self.chars(e) if e.tag == "a" else 0)

    def linked(self, e: Element) -> int:
        """Characters in links at or below an element."""
        return self._linked[e.last + 1] - self._linked[e.pre]

    @cached_property
    def _links(self) -> list[int]:
        return self.sums(lambda e: e.tag == "a")

    def links(self, e: Element) -> int:
        return self._links[e.last + 1] - self._links[e.pre]

    # unique selectors -------------------------------------------------------------------------------------

    @cached_property
    def ids(self) -> Counter:
        return Counter(e.attrs["id"] for e in self.elements if e.attrs.get("id"))

    @cached_property
    def tags(self) -> Counter:
        return Counter(e.tag for e in self.elements)

    @cached_property
    def postings(self) -> dict[tuple[str, str], list[int]]:
        """By tag and class, the elements that have both, in document order."""
        out: dict[tuple[str, str], list[int]] = defaultdict(list)
        for e in self.elements:
            for c in set(e.classes()):
                out[e.tag, c].append(e.pre)
        return out

    @cached_property
    def signatures(self) -> Counter:
        return Counter((e.tag, frozenset(e.classes())) for e in self.elements if "class" in e.attrs)

    @cached_property
    def _supersets(self) -> dict[tuple[str, frozenset], int]:
        return {}

    def matching(self, tag: str, classes: frozenset | set) -> list[int]:
        """Places of the elements of a tag with all of some classes: the rarest class's, as far as they are the others' too."""
        lists = sorted((self.postings.get((tag, c), []) for c in classes), key=len)
        if not lists:
            return [e.pre for e in self.elements if e.tag == tag]
        return [p for p in lists[0] if classes <= set(self.elements[p].classes())]

    @cached_property
    def _by_tag(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = defaultdict(list)
        for e in self.elements:
            out[e.tag].append(e.pre)
        return out

    @cached_property
    def _by_attribute(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = defaultdict(list)
        for e in self.elements:
            for name in e.attrs:
                out[name].append(e.pre)
        return out

    def _places(self, tag: str, classes: list[str], attribute: str) -> list[int]:
        """Places of the elements that have an attribute, or a tag and the rarest of some classes."""
        if attribute:
            return self._by_attribute.get(attribute, [])
        return min((self.postings.get((tag, c), []) for c in classes), key=len) if classes else self._by_tag.get(tag, [])

    def between(self, a: int, b: int, tag: str, classes: list[str], attribute: str = "") -> int:
        """How many elements from one place to another may have an attribute, or a tag and all of some classes."""
        places = self._places(tag, classes, attribute)
        return bisect_right(places, b) - bisect_left(places, a)

    def first_in(self, top: Element, tag: str, classes: list[str], attribute: str = "") -> Element | None:
        """The first element at or below one that has an attribute, or a tag and all of some classes."""
        places, wanted = self._places(tag, classes, attribute), set(classes)
        for at in range(bisect_left(places, top.pre), len(places)):
            if places[at] > top.last:
                break
            e = self.elements[places[at]]
            if len(wanted) < 2 or wanted <= set(e.classes()):
                return e
        return None

    def named(self, e: Element) -> tuple[str, bool]:
        """(selector by tag and classes, whether it finds this element only)."""
        classes = e.classes()
        css = e.tag + "".join("." + c for c in classes)
        if not SAFE.match(e.tag) or not all(map(SAFE.match, classes)):
            return css, self.finds(css, e)
        if not classes:
            return css, self.tags[e.tag] == 1
        own = frozenset(classes)
        if any(len(self.postings[e.tag, c]) == 1 for c in own):
            return css, True
        if self.signatures[e.tag, own] > 1:
            return css, False
        key = (e.tag, own)
        if key not in self._supersets:
            self._supersets[key] = len(self.matching(e.tag, own))
        return css, self._supersets[key] == 1

    def finds(self, css: str, e: Element) -> bool:
        """Whether a selector can be read and finds just this element; looks at the whole page."""
        try:
            return select(self.root, css) == [e]
        except SelectorError:
            return False

    def selector(self, e: Element) -> str:
        """A selector of just this element: its id, its tag and classes, or its path from an element with a unique id."""
        raw, ident = e.get("id"), e.get("id").strip()
        if ident:
            if raw == ident and SAFE.match(ident):
                if self.ids[ident] == 1:
                    return "#" + ident
            elif self.finds("#" + ident, e):
                return "#" + ident
        css, alone = self.named(e)
        return css if alone else self.path(e)

    def path(self, e: Element) -> str:
        parts: list[str] = []
        x: Element | None = e
        while x is not None:
            if x is not e and SAFE.match(x.get("id")) and self.ids[x.get("id")] == 1:
                parts.append("#" + x.get("id"))
                break
            parts.append(f"{x.tag}:nth-of-type({x.nth})")
            x = x.parent
        return " > ".join(reversed(parts))
