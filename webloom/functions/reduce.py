"""From a page to what is worth reading: article selection, cleaning, Markdown.

The article is the block with the best text density: text outside links counts
for it, links against it, and what its parent holds beyond it must be little. This
follows published work on text density and link density of HTML blocks.
"""

from __future__ import annotations

import re

from webloom.functions.dom import BLOCK, SILENT, Comment, Element, collapsed, is_hidden, squeeze, visible, without
from webloom.functions.extract import duplicate_blocks, title_of
from webloom.functions.index import Page
from webloom.functions.text import defang
from webloom.functions.urls import resolve

# What user content may keep.
ALLOWED = frozenset("a abbr b blockquote br caption cite code dd del dfn div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img ins kbd li mark ol p pre q s samp section article main small span strong sub sup table tbody td tfoot th thead tr tt u ul var body html".split())
_KEPT_ATTRS = {"a": ("href", "title"), "img": ("src", "alt", "title"), "abbr": ("title",), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan")}
_JUNK = re.compile(r"\b(?:ad|ads|advert|banner|breadcrumb|comment|cookie|footer|menu|modal|nav|newsletter|popup|promo|related|share|sidebar|social|sponsor|subscribe)s?\b", re.I)


def absolutised(root: Element, url: str) -> Element:
    """Addresses of links and images in full, in place."""
    base = Page(root, url).base
    for e in root.elements():
        for attr in ("href",) if e.tag == "a" else ("src",) if e.tag == "img" else ():
            if attr in e.attrs:
                e.attrs[attr] = resolve(base, e.attrs[attr])
    return root


_NO_TEXT = SILENT | {"iframe", "object", "embed", "form", "input", "button", "select", "textarea"}
_RUNS = re.compile(r"\s*(?:javascript|vbscript|data):", re.I)


def sanitised(root: Element, base: str = "", drop=lambda e: False) -> Element:
    """A copy of only allowed elements and attributes, addresses in full if there is a base.

    What is not allowed gives way to what it holds, unless that is no text; what ``drop`` holds for goes, below the root. The copy is not numbered.
    """

    def clean(e: Element, parent: Element | None) -> list:
        if e.tag in _NO_TEXT or (e is not root and drop(e)):
            return []
        twin = parent
        if e.tag in ALLOWED:
            attrs = {k: e.attrs[k] for k in _KEPT_ATTRS.get(e.tag, ()) if k in e.attrs}
            for k in ("href", "src"):
                if k in attrs:
                    if base:
                        attrs[k] = resolve(base, attrs[k])
                    if _RUNS.match(attrs[k]):
                        del attrs[k]
            twin = Element(e.tag, attrs, parent)
        inner: list = []
        for c in e.children:
            if isinstance(c, Element):
                inner += clean(c, twin)
            elif not isinstance(c, Comment):
                inner.append(c)
        if twin is parent:
            return inner
        twin.children = inner
        return [twin]

    found = clean(root, None)
    if len(found) == 1 and isinstance(found[0], Element):
        return found[0]
    whole = Element("html", {}, None)
    whole.children = found
    return whole


# How blocks are scored -----------------------------------------------------------------------
CANDIDATES = frozenset(("article", "main", "section", "div", "body", "td"))
PROSE = frozenset(("p", "pre", "blockquote"))
LEAST_TEXT, LEAST_PROSE, MOST_PROSE = 140, 25, 400
FAVOUR = {"article": 1.3, "main": 1.2, "body": 0.9}
INNER_BETTER, INNER_AS_GOOD = 1.1, 0.95
# -----------------------------------------------------------------------------------------------------------


def article_of(root: Element) -> Element | None:
    """The densest block, or None if there is too little text. All that a block holds is a difference of prefix sums."""
    page = Page(root)
    prose = page.sums(lambda e: min(n, MOST_PROSE) if e.tag in PROSE and (n := page.chars(e)) >= LEAST_PROSE else 0)
    best, best_score = None, 0.0
    for e in page.elements:
        if e.tag not in CANDIDATES:
            continue
        text = page.chars(e)
        linked = page.linked(e) if text >= LEAST_TEXT else 0
        if text < LEAST_TEXT or linked * 2 > text:
            continue
        if e.tag != "body" and e.attrs and (_JUNK.search(e.get("class")) or _JUNK.search(e.get("id"))):
            continue
        score = (prose[e.last + 1] - prose[e.pre]) * (1 - linked / text) + (text - linked) / (e.last + 1 - e.pre)
        score *= FAVOUR.get(e.tag, 1.0)
        # a wrapper is as good as what it wraps; the inner one has less around it
        if score > best_score * (INNER_BETTER if best is not None and e in best else 1.0) or (best is not None and e in best and score >= INNER_AS_GOOD * best_score):
            best, best_score = e, score
    return best


def shown(root: Element) -> Element:
    """The page without what is hidden; the page itself if nothing is."""
    return without(root, is_hidden) if any(e.attrs and is_hidden(e) for e in root.elements()) else root


def full(root: Element, url: str) -> dict[str, str]:
    """The whole page, without hidden parts and repeated blocks."""
    page = shown(root)
    again = {id(e) for e in duplicate_blocks(page)}
    return {"title": title_of(root), "source": "full", "markdown": markdown(sanitised(page, Page(root, url).base, lambda e: id(e) in again))}


def article(root: Element, url: str) -> dict[str, str]:
    """The main content, hidden parts removed before it is looked for; the full page if there is none."""
    found = article_of(shown(root))
    if found is None:
        return full(root, url)
    title = title_of(root) or next((collapsed(e) for e in found.elements() if e.tag == "h1"), "")
    copy = sanitised(found, Page(root, url).base, lambda e: e.tag in ("nav", "aside", "footer", "form") or bool(e.attrs and _JUNK.search(e.get("class"))))
    return {"title": title, "source": "readability", "markdown": markdown(copy)}


_SPECIAL = re.compile(r"([\\`*_\[\]])")
_GAPS = re.compile(r"[ \t]{2,}|\t")


def spaced(text: str) -> str:
    """Each run of white space as one space, at the ends too."""
    inner = " ".join(text.split())
    return (" " if text[:1].isspace() else "") + inner + (" " if inner and text[-1].isspace() else "")


def markdown(root: Element) -> str:
    """CommonMark: headings, paragraphs, emphasis, links, images, lists, code, quotes, rules, simple tables."""

    def inline(e: Element | str) -> str:
        if isinstance(e, Comment):
            return ""
        if isinstance(e, str):
            return _SPECIAL.sub(r"\\\1", spaced(e))
        if e.tag in SILENT:
            return ""
        inner = "".join(map(inline, e.children))
        core = inner.strip()
        if e.tag == "br":
            return "  \n"
        if e.tag == "img":
            return f"![{squeeze(e.get('alt'))}]({e.get('src')})" if e.get("src") else ""
        if e.tag == "a" and e.get("href") and core:
            return f"[{core}]({e.get('href')})"
        mark = {"b": "**", "strong": "**", "i": "*", "em": "*"}.get(e.tag)
        if mark and core:
            return inner[: len(inner) - len(inner.lstrip())] + mark + core + mark + inner[len(inner.rstrip()) :]
        if e.tag in ("code", "kbd", "samp", "tt") and core:
            return f"`{collapsed(e)}`"
        return inner

    def blocks(e: Element) -> list[str]:
        out: list[str] = []
        run: list[str] = []

        def flush() -> None:
            text = _GAPS.sub(" ", "".join(run)).strip()
            text = re.sub(r" ?\n ?", "  \n", text) if "\n" in text else text
            if text:
                out.append(text)
            run.clear()

        for c in e.children:
            if not isinstance(c, Element) or not (c.tag in BLOCK or any(x.tag in BLOCK for x in c.elements())):
                run.append(inline(c))
                continue
            flush()
            if re.fullmatch("h[1-6]", c.tag):
                text = squeeze("".join(map(inline, c.children)))
                out += [f"{'#' * int(c.tag[1])} {text}"] * bool(text)
            elif c.tag == "pre":
                out.append("```\n" + "".join(x for x in _raw(c)).strip("\n") + "\n```")
            elif c.tag == "blockquote":
                out.append("\n".join(("> " + x).rstrip() for x in "\n\n".join(blocks(c)).split("\n")))
            elif c.tag in ("ul", "ol"):
                items = []
                for k, li in enumerate((x for x in c.kids() if x.tag == "li"), 1):
                    mark = f"{k}. " if c.tag == "ol" else "- "
                    inner = "\n".join(blocks(li)).replace("\n", "\n" + " " * len(mark))
                    items += [mark + inner] * bool(inner)
                out += ["\n".join(items)] * bool(items)
            elif c.tag == "hr":
                out.append("---")
            elif c.tag == "table":
                rows = [[squeeze("".join(map(inline, x.children))).replace("|", "\\|") for x in r.kids() if x.tag in ("td", "th")] for r in c.elements() if r.tag == "tr"]
                width = max(map(len, rows), default=0)
                if width:
                    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                    out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
            else:
                out += blocks(c)
        flush()
        return out

    return "\n\n".join(b for b in blocks(root) if b.strip())


def _raw(e: Element):
    for c in e.children:
        if isinstance(c, Element):
            yield from _raw(c)
        elif not isinstance(c, Comment):
            yield c


def read(root: Element, url: str, mode: str = "article", form: str = "markdown", safe: bool = True) -> dict[str, str]:
    """A page as text: title, content and where the content is from."""
    if mode not in ("article", "full"):
        raise ValueError(f"mode is article or full, not {mode!r}")
    if form not in ("markdown", "text"):
        raise ValueError(f"format is markdown or text, not {form!r}")
    if form == "text":
        return {"title": title_of(root), "source": "text", "content": visible(root, skip_hidden=True)}
    found = article(root, url) if mode == "article" else full(root, url)
    head = f"# {found['title']}\n\n" if found["title"] else ""
    body = found["markdown"].strip()
    return {"title": found["title"], "source": found["source"], "content": (defang(head + body) if safe else head + body) + "\n"}
