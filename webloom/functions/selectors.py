"""CSS selectors over the tree: types, ids, classes, attributes, the usual pseudo-classes and all combinators."""

from __future__ import annotations

import re
from functools import lru_cache

from webloom.functions.dom import Element


class SelectorError(ValueError):
    pass


_TOKEN = re.compile(
    r"""\s*([>+~,])\s*|(\s+)|\#((?:[\w-]|[^\x00-\x7f]|\\.)+)|\.((?:[\w-]|[^\x00-\x7f]|\\.)+)"""
    r"""|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:([\w-]+)(?:\(([^()]*(?:\([^()]*\))?[^()]*)\))?|(\*|[A-Za-z][\w-]*)"""
)


def _attribute(name: str, op: str | None, value: str):
    tests = {
        None: lambda v: True,
        "=": lambda v: v == value,
        "~=": lambda v: value in v.split(),
        "|=": lambda v: v == value or v.startswith(value + "-"),
        "^=": lambda v: bool(value) and v.startswith(value),
        "$=": lambda v: bool(value) and v.endswith(value),
        "*=": lambda v: bool(value) and value in v,
    }
    test = tests[op]
    return lambda e: name in e.attrs and test(e.attrs[name])


def _place(e: Element, same: bool, back: bool) -> int:
    kin = [k for k in e.parent.kids() if not same or k.tag == e.tag] if e.parent else [e]
    at = next(i for i, k in enumerate(kin) if k is e)
    return len(kin) - at if back else at + 1


def _nth(text: str):
    text = text.replace(" ", "").lower()
    text = {"odd": "2n+1", "even": "2n"}.get(text, text)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if not m:
        raise SelectorError(f"cannot read :nth({text})")
    if m[3]:
        return lambda k: k == int(m[3])
    a, b = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)
    return lambda k: (k == b) if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def _pseudo(name: str, inner: str | None):
    if name == "not":
        inside = compile_selector(inner or "")
        return lambda e: not inside(e)
    if name in ("is", "where"):
        return compile_selector(inner or "")
    if name in ("nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type"):
        test, same, back = _nth(inner or ""), name.endswith("type"), "last" in name
        return lambda e: test(_place(e, same, back))
    if name in ("first-child", "last-child", "first-of-type", "last-of-type"):
        same, back = name.endswith("type"), name.startswith("last")
        return lambda e: _place(e, same, back) == 1
    if name in ("only-child", "only-of-type"):
        same = name.endswith("type")
        return lambda e: _place(e, same, False) == 1 == _place(e, same, True)
    if name == "empty":
        return lambda e: not any(isinstance(c, Element) or c for c in e.children)
    if name == "root":
        return lambda e: e.parent is None
    raise SelectorError(f"unknown pseudo-class :{name}")


def _left(e: Element, how: str):
    if how == " ":
        return list(e.above())
    if how == ">":
        return [e.parent] if e.parent else []
    kin = e.parent.kids() if e.parent else [e]
    at = next(i for i, k in enumerate(kin) if k is e)
    return kin[max(0, at - 1) : at] if how == "+" else kin[:at]


@lru_cache(maxsize=1024)
def compile_selector(text: str):
    """A predicate of elements; ``SelectorError`` if the selector cannot be read."""
    groups, parts, simple, at = [], [], [], 0
    text = text.strip()
    unescape = lambda s: re.sub(r"\\(.)", r"\1", s)

    def finish() -> None:
        if not simple:
            raise SelectorError(f"cannot read selector {text!r}")
        parts.append(list(simple))
        simple.clear()

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SelectorError(f"cannot read selector {text!r}")
        at = m.end()
        mark, gap, ident, klass, attr, op, v1, v2, v3, pseudo, inner, tag = m.groups()
        if mark == ",":
            finish()
            groups.append(list(parts))
            parts.clear()
        elif mark or gap:
            finish()
            parts.append(mark or " ")
        elif ident:
            simple.append(lambda e, i=unescape(ident): e.get("id") == i)
        elif klass:
            simple.append(lambda e, c=unescape(klass): c in e.classes())
        elif attr:
            simple.append(_attribute(attr.lower(), op, next((v for v in (v1, v2, v3) if v is not None), "")))
        elif pseudo:
            simple.append(_pseudo(pseudo.lower(), inner))
        elif tag:
            simple.append((lambda e: True) if tag == "*" else (lambda e, t=tag.lower(): e.tag == t))
    finish()
    groups.append(list(parts))

    def match(e: Element, chain: list, k: int) -> bool:
        if not all(test(e) for test in chain[k]):
            return False
        return k == 0 or any(match(x, chain, k - 2) for x in _left(e, chain[k - 1]))

    return lambda e: any(match(e, chain, len(chain) - 1) for chain in groups)


def select(root: Element, selector: str) -> list[Element]:
    """All matches at or below an element, in document order."""
    test = compile_selector(selector)
    return [e for e in root.elements() if test(e)]


def first(root: Element, selector: str) -> Element | None:
    test = compile_selector(selector)
    return next((e for e in root.elements() if test(e)), None)
