"""Declarative shadow trees: a host shows its template's content, with its own children in the slots they name."""

from __future__ import annotations

from webloom.functions.parsing import MOST_DEPTH
from webloom.functions.tree import Element

#: Nodes that composing may make of a page: slots of one name repeat what they are given, and hosts within them repeat that again.
MOST_NODES = 1_000_000


def _template(host: Element) -> Element | None:
    return next((k for k in host.kids() if k.tag == "template" and ("shadowrootmode" in k.attrs or "shadowroot" in k.attrs)), None)


def composed(root: Element) -> Element:
    """The tree as it is shown, in place: inner hosts first, so that what is put into a slot is composed already.

    A slot takes all of the host's children that name it (the default slot those that name none, texts too), each further slot of a name a copy of
    them, and else shows what it holds itself. Other templates stay as they are. Once a page has MOST_NODES nodes such further slots stay empty.
    """
    order = list(root._walk())
    left = MOST_NODES - len(order)
    taken: set[str] = set()

    def copy(node, parent: Element):
        """A node below a new parent, without slots."""
        nonlocal left
        if not isinstance(node, Element):
            return node
        left -= 1
        twin = Element(node.tag, dict(node.attrs), parent)
        twin.children = [copy(c, twin) for c in node.children] if left > 0 else []
        return twin

    def shown(node, parent: Element, light: dict[str, list]) -> list:
        """What a node of the template becomes."""
        nonlocal left
        if not isinstance(node, Element):
            return [node]
        if node.tag == "slot":
            name = node.get("name")
            given = light.get(name)
            if given and name not in taken:
                taken.add(name)
                for c in given:
                    if isinstance(c, Element):
                        c.parent = parent
                return given
            if given:
                return [copy(c, parent) for c in given] if left > 0 else []
            return [x for c in node.children for x in shown(c, parent, light)]
        left -= 1
        twin = Element(node.tag, dict(node.attrs), parent)
        twin.children = [x for c in node.children for x in shown(c, twin, light)]
        return [twin]

    for host in reversed(order):
        inside = _template(host)
        if inside is None:
            continue
        light: dict[str, list] = {}
        taken = set()
        for c in host.children:
            if c is not inside:
                light.setdefault(c.get("slot") if isinstance(c, Element) else "", []).append(c)
        host.children = [x for c in inside.children for x in shown(c, host, light)]
    return level(root)


def level(root: Element) -> Element:
    """No element deeper than MOST_DEPTH: what would be comes beside its parent."""
    todo = [(root, 0)]
    while todo:
        e, depth = todo.pop()
        if depth == MOST_DEPTH - 1:
            flat: list = []
            rest = list(reversed(e.children))
            while rest:
                x = rest.pop()
                if isinstance(x, Element):
                    x.parent = e
                    rest += [c for c in reversed(x.children) if isinstance(c, Element)]
                    x.children = [c for c in x.children if not isinstance(c, Element)]
                flat.append(x)
            e.children = flat
        else:
            todo += [(k, depth + 1) for k in e.kids()]
    return root

