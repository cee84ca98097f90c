"""Trees of pages: text, hiding and serialising. A tree has ``html``, ``head`` and ``body`` whatever the source has."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape

from webloom.functions.parsing import MOST_DEPTH, RAW, VOID, tree
from webloom.functions.shadow import composed
from webloom.functions.tree import Comment, Element, number

__all__ = ["BLOCK", "MOST_DEPTH", "SILENT", "VOID", "Comment", "Element", "collapsed", "is_hidden", "number", "parse", "serialise", "squeeze", "texts", "truncated", "visible", "without"]

SILENT = frozenset("script style head noscript template".split())
BLOCK = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())


_HAS_SHADOW = re.compile("shadowroot", re.I)


def parse(html: str) -> Element:
    """The ``html`` element of a document, declarative shadow trees composed; never fails."""
    root = tree(html or "")
    return number(composed(root) if html and _HAS_SHADOW.search(html) else root)


def texts(e: Element) -> list[str]:
    """All texts below an element; of a numbered tree they are a slice."""
    if e.order is not None:
        a, b = e.texts
        return e.order.texts[a:b]
    out: list[str] = []
    todo: list = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, Element):
            todo += reversed(x.children)
        elif not isinstance(x, Comment):
            out.append(x)
    return out


def squeeze(text: str) -> str:
    return " ".join(text.split())


def collapsed(e: Element) -> str:
    """All text below an element, text nodes parted by a space, white space collapsed."""
    return squeeze(" ".join(texts(e)))


def truncated(text: str, n: int) -> str:
    return text if len(text) <= n else text[:n].strip() + "…"


def visible(root: Element, skip_hidden: bool = False) -> str:
    """What a reader sees: blocks on lines of their own with a blank line between, ``br`` as a new line."""
    out: list[str] = []

    def walk(e: Element) -> None:
        if e.tag in SILENT or (skip_hidden and is_hidden(e)):
            return
        if e.tag == "br":
            out.append("\n")
            return
        block = e.tag in BLOCK
        if block:
            out.append("\n\n")
        for c in e.children:
            if isinstance(c, Element):
                walk(c)
            elif not isinstance(c, Comment):
                out.append(re.sub(r"\s+", " ", c) + " ")
        if block:
            out.append("\n\n")

    walk(root)
    lines = [squeeze(x) for x in "".join(out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


_STYLE_HIDES = re.compile(r"display:none|visibility:hidden|-9999px|-999em|-10000px|clip:rect\(0")


def is_hidden(e: Element) -> bool:
    return "hidden" in e.attrs or e.get("aria-hidden").strip().lower() == "true" or bool(_STYLE_HIDES.search(e.get("style").lower().replace(" ", "").replace("\t", "")))


def without(root: Element, drop) -> Element:
    """A copy without the elements (below the root) for which ``drop`` holds, and without comments."""

    def copy(e: Element, parent: Element | None) -> Element:
        twin = Element(e.tag, dict(e.attrs), parent)
        twin.children = [copy(c, twin) if isinstance(c, Element) else c for c in e.children if not isinstance(c, Comment) and not (isinstance(c, Element) and drop(c))]
        return twin

    return number(copy(root, None))


def serialise(e: Element | str) -> str:
    if isinstance(e, Comment):
        return f"<!--{e}-->"
    if isinstance(e, str):
        return escape(e, quote=False)
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in e.attrs.items())
    if e.tag in VOID:
        return f"<{e.tag}{attrs}>"
    inner = "".join(c if isinstance(c, str) and not isinstance(c, Comment) and e.tag in RAW else serialise(c) for c in e.children)
    return f"<{e.tag}{attrs}>{inner}</{e.tag}>"
