"""What a page holds: metadata, links, forms, controls, regions, tables, structured data, records."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections import Counter
from itertools import accumulate

from webloom.functions.dom import SILENT, Comment, Element, collapsed, squeeze, truncated
from webloom.functions.index import SAFE, Page
from webloom.functions.selectors import first, select
from webloom.functions.text import fnv1a64
from webloom.functions.urls import is_internal, resolve

SECTIONING = ("article", "aside", "main", "nav", "section")
LANDMARK_ROLES = ("banner", "navigation", "main", "complementary", "contentinfo", "search", "form", "region")
_ANCHORS = ("main", "nav", "header", "footer", "aside", "section", "article", "form")


_HEADING = re.compile("h[1-6]")


def is_heading(e: Element) -> bool:
    return _HEADING.fullmatch(e.tag) is not None


def _first(*values: str) -> str:
    return next((v for v in values if v), "")


def base_url(root: Element, url: str) -> str:
    return Page(root, url).base


def title_of(root: Element) -> str:
    """The first title's text, else what og:title says last."""
    title = next((collapsed(e) for e in root.elements() if e.tag == "title"), "")
    if title:
        return title
    said = [e.get("content").strip() for e in root.elements() if e.tag == "meta" and _first(e.get("name"), e.get("property")).strip().lower() == "og:title" and "content" in e.attrs]
    return said[-1] if said else ""


def metadata(root: Element, url: str) -> dict[str, str]:
    m: dict[str, str] = {}
    for e in root.elements():
        if e.tag == "meta":
            key = _first(e.get("name"), e.get("property")).strip().lower()
            if key and "content" in e.attrs:
                m[key] = e.get("content").strip()
    link = lambda rel: next((e.get("href") for e in root.elements() if e.tag == "link" and rel in e.get("rel").lower().split() and e.get("href")), "")
    title = next((collapsed(e) for e in root.elements() if e.tag == "title"), "")
    base = base_url(root, url)
    get = lambda *keys: _first(*(m.get(k, "") for k in keys))
    return {
        "title": _first(title, get("og:title")),
        "description": get("description", "og:description", "twitter:description"),
        "site_name": get("og:site_name"),
        "lang": root.get("lang").strip(),
        "canonical": resolve(base, link("canonical")),
        "image": resolve(base, get("og:image", "twitter:image")),
        "author": get("author", "article:author"),
        "published": get("article:published_time"),
        "modified": get("article:modified_time"),
        "theme_color": get("theme-color"),
        "twitter_card": get("twitter:card"),
        "twitter_site": get("twitter:site"),
        "favicon": resolve(base, link("icon")),
    }


def links(root: Element, url: str) -> list[dict]:
    base, seen, out = base_url(root, url), set(), []
    for e in root.elements():
        if e.tag == "a" and "href" in e.attrs:
            href, text = resolve(base, e.get("href")), collapsed(e)
            if href and (href, text) not in seen:
                seen.add((href, text))
                out.append({"pre": e.pre, "text": text, "href": href, "rel": e.get("rel").strip(), "internal": is_internal(href, url)})
    return out


def images(root: Element, url: str) -> list[dict]:
    base = base_url(root, url)
    found = ({"pre": e.pre, "alt": e.get("alt").strip(), "src": resolve(base, e.get("src"))} for e in root.elements() if e.tag == "img")
    return [x for x in found if x["src"]]


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Ids:
    """Stable ids: a hash of what an element is and where; twins are numbered in the order of asking."""

    def __init__(self) -> None:
        self.seen: Counter = Counter()
        self.paths: dict[Element, str] = {}

    def _path(self, parent: Element) -> str:
        """Tags from the nearest anchor (or the 23rd element above) down to a parent; worked out once a parent."""
        path = self.paths.get(parent)
        if path is None:
            chain, x = [], parent
            while x is not None and len(chain) < 23:
                chain.append(x)
                if x.get("id").strip() or x.tag in _ANCHORS:
                    break
                x = x.parent
            ident = chain[-1].get("id").strip()
            tags = ["#" + ident if ident else "@" + chain[-1].tag, *(c.tag for c in reversed(chain[:-1]))]
            path = self.paths[parent] = "".join(t + ">" for t in tags)
        return path

    def mint(self, e: Element, prefix: str, role: str, name: str) -> str:
        path = self._path(e.parent) if e.parent is not None else ""
        data = f"{e.tag}\0{role.strip().translate(_LOWER)}\0{name.strip().translate(_LOWER)}\0{path}{e.tag}>"
        ident = f"{prefix}-{fnv1a64(data.encode()) & 0xFFFFFF:06x}"
        self.seen[ident] += 1
        return ident if self.seen[ident] == 1 else f"{ident}-{self.seen[ident]}"


class Names:
    """Accessible names; the id index is built once a page."""

    def __init__(self, root: Element):
        self.by_id: dict[str, Element] = {}
        for e in root.elements():
            if e.get("id"):
                self.by_id.setdefault(e.get("id"), e)
        found = [e for e in root.elements() if e.tag == "label"]
        self.has_labels, self.labels = bool(found), {e.get("for"): e for e in found if e.get("for")}

    def _labelled(self, e: Element) -> str:
        return squeeze(" ".join(collapsed(self.by_id[i]) for i in e.get("aria-labelledby").split() if i in self.by_id and self.by_id[i] is not e))

    def explicit(self, e: Element) -> str:
        return _first(self._labelled(e), squeeze(e.get("aria-label")), squeeze(e.get("title")))

    def of(self, e: Element) -> str:
        """The first that says something; what comes later is not looked at."""
        if named := self._labelled(e) or squeeze(e.get("aria-label")):
            return named
        if e.tag == "input" and (value := squeeze(e.get("value"))):
            return value
        if self.has_labels and (label := next((collapsed(x) for x in e.above() if x.tag == "label"), "") or (collapsed(self.labels[e.get("id")]) if e.get("id") in self.labels else "")):
            return label
        return squeeze(e.get("alt")) or collapsed(e) or squeeze(e.get("title")) or squeeze(e.get("placeholder"))


def _forms(page: Page, names: Names | None, ids: Ids | None) -> list[dict]:
    """Forms with their fields; without ``ids`` fields have none, and no names are looked for."""
    base, url, out = page.base, page.url, []
    for e in page.elements:
        if e.tag != "form":
            continue
        fields = []
        for f in e.elements():
            if f.tag not in ("input", "select", "textarea"):
                continue
            kind = (f.get("type").strip().lower() or "text") if f.tag == "input" else f.tag
            options = [_first(o.get("value"), collapsed(o)) for o in f.elements() if o.tag == "option"] if f.tag == "select" else []
            value = _first(f.get("value"), collapsed(f)) if f.tag == "textarea" else f.get("value") if f.tag == "input" else ""
            checked = str("checked" in f.attrs).lower() if kind in ("checkbox", "radio") else ""
            prefix = {"select": "sel", "textarea": "txt"}.get(f.tag, "chk" if kind in ("checkbox", "radio") else "inp")
            fields.append({"name": f.get("name"), "type": kind, "value": value, "placeholder": f.get("placeholder"), "required": "required" in f.attrs, "disabled": "disabled" in f.attrs, "checked": checked, "options": options, "id": ids.mint(f, prefix, "", names.of(f)) if ids else None})
        out.append({"pre": e.pre, "id": e.get("id"), "name": e.get("name"), "action": resolve(base, e.get("action")) or url, "method": e.get("method").strip().upper() or "GET", "enctype": e.get("enctype").strip().lower(), "fields": fields})
    return out


def _headings(page: Page, ids: Ids) -> list[dict]:
    out = []
    for e in page.elements:
        if is_heading(e):
            text = collapsed(e)
            out.append({"pre": e.pre, "level": int(e.tag[1]), "text": text, "id": e.get("id") or ids.mint(e, "h", "heading", text)})
    return out


def _tristate(value: str, mixed: bool) -> str:
    value = value.strip().lower()
    return value if value in ("true", "false") or (mixed and value == "mixed") else ""


def is_control(e: Element) -> bool:
    """One of the nine kinds that take part in a page's work but are no plain links."""
    a = e.attrs
    return e.tag in ("button", "summary") or (e.tag == "input" and a.get("type") in ("submit", "button", "reset")) or a.get("role") in ("button", "tab") or "onclick" in a or "tabindex" in a


def _control_kind(e: Element) -> str:
    if e.tag in ("button", "summary"):
        return e.tag
    if e.tag == "input":
        kind = e.get("type").lower()
        return kind if kind in ("submit", "reset") else "button"
    return {"button": "role-button", "tab": "tab"}.get(e.get("role").lower(), "interactive")


def _truth(e: Element, name: str) -> bool:
    return e.get(name).strip().lower() == "true"


def _control(e: Element, page: Page, text: str, ident: str) -> dict:
    checkable = e.tag == "input" and e.get("type").lower() in ("checkbox", "radio")
    href = e.get("href").strip()
    return {
        "pre": e.pre, "text": text, "kind": _control_kind(e), "role": e.get("role"), "id": ident, "selector": page.selector(e),
        "disabled": "disabled" in e.attrs or _truth(e, "aria-disabled"), "required": "required" in e.attrs or _truth(e, "aria-required"),
        "checked": _tristate(e.get("aria-checked"), True) or ("true" if checkable and "checked" in e.attrs else ""), "expanded": _tristate(e.get("aria-expanded"), False),
        "pressed": _tristate(e.get("aria-pressed"), True), "selected": _tristate(e.get("aria-selected"), False), "invalid": "aria-invalid" in e.attrs and e.get("aria-invalid").strip().lower() != "false",
        "value": e.get("value").strip(), "placeholder": e.get("placeholder").strip(), "href": resolve(page.base, href) if href else "",
    }


class Minted:
    """Forms, headings, controls and regions of a page with ids of one counter: twins are numbered in this order of kinds."""

    def __init__(self, root: Element, url: str = ""):
        self.page, self.names, self.ids = Page(root, url), Names(root), Ids()
        self.forms = _forms(self.page, self.names, self.ids)
        self.headings = _headings(self.page, self.ids)
        self.controls = []
        for e in self.page.elements:
            if is_control(e):
                text, kind = self.names.of(e), _control_kind(e)
                prefix = {"summary": "sum", "tab": "tab", "interactive": "el"}.get(kind, "btn")
                self.controls.append(_control(e, self.page, text, self.ids.mint(e, prefix, e.get("role"), text)))

    def regions(self) -> list[dict]:
        return _regions(self.page, self.names, self.ids, {c["pre"] for c in self.controls})


def forms(root: Element, url: str, with_ids: bool = True) -> list[dict]:
    return _forms(Page(root, url), Names(root), Ids()) if with_ids else _forms(Page(root, url), None, None)


def headings(root: Element, url: str = "") -> list[dict]:
    return Minted(root, url).headings


def controls(root: Element, url: str) -> list[dict]:
    return Minted(root, url).controls


def regions(root: Element, url: str = "") -> list[dict]:
    return Minted(root, url).regions()


def role_of(e: Element, names: Names) -> str:
    """The landmark that an element is, or ""."""
    role = e.get("role").strip().lower()
    if role in LANDMARK_ROLES:
        return role if role not in ("form", "region") or names.explicit(e) else ""
    if e.tag in ("nav", "main", "aside"):
        return {"nav": "navigation", "main": "main", "aside": "complementary"}[e.tag]
    if e.tag in ("header", "footer"):
        return "" if any(x.tag in SECTIONING for x in e.above()) else {"header": "banner", "footer": "contentinfo"}[e.tag]
    if e.tag in ("form", "section") and names.explicit(e):
        return {"form": "form", "section": "region"}[e.tag]
    return ""


def _regions(page: Page, names: Names, ids: Ids, own_controls: set[int]) -> list[dict]:
    """Landmarks, each with what it holds and no region within holds; one walk, innermost region at hand."""
    out: dict[int, dict] = {}

    def walk(e: Element, inner: dict | None) -> None:
        role = role_of(e, names)
        if role:
            label = names.explicit(e) or next((collapsed(x) for x in e.elements() if is_heading(x)), "")
            out[e.pre] = {"pre": e.pre, "last": e.last, "role": role, "label": label, "id": ids.mint(e, "rgn", role, label), "links": 0, "forms": 0, "headings": 0, "controls": 0}
        if inner is not None:
            inner["links"] += e.tag == "a" and "href" in e.attrs
            inner["forms"] += e.tag == "form"
            inner["headings"] += bool(is_heading(e))
            inner["controls"] += e.pre in own_controls
        for c in e.kids():
            walk(c, out.get(e.pre, inner))

    walk(page.root, None)
    return list(out.values())


def selector_of(root: Element, e: Element) -> str:
    """A selector of just this element: its id, its tag and classes, or its path."""
    return Page(root).selector(e)


def outline(root: Element) -> str:
    found = [{"level": int(e.tag[1]), "text": t} for e in root.elements() if is_heading(e) and (t := collapsed(e))]
    low = min((h["level"] for h in found), default=1)
    return "\n".join("  " * (h["level"] - low) + "- " + h["text"] for h in found)


def capped_outline(text: str, most: int = 8 << 10) -> str:
    """An outline of at most ``most`` bytes, cut after a line."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    head = raw[:most]
    at = head.rfind(b"\n")
    return head[: at if at > 0 else most].decode(errors="ignore") + "\n… (outline truncated)"


def excerpt(root: Element) -> str:
    return next((truncated(t, 300) for t in (collapsed(e) for e in root.elements() if e.tag == "p") if t), "")


def _cells(row: Element) -> list[Element]:
    return [c for c in row.kids() if c.tag in ("td", "th")]


def tables(root: Element, most: int | None = None, most_rows: int | None = None, most_columns: int = 128, most_chars: int = 500) -> list[dict]:
    """Tables that are not within others, with all their rows unless a caller limits them."""
    out: list[dict] = []
    for e in root.elements():
        if e.tag != "table" or any(x.tag == "table" for x in e.above()) or len(out) == most:
            continue
        rows: list[tuple[Element, bool]] = []
        caption = next((collapsed(c) for c in e.kids() if c.tag == "caption"), "")
        todo = [(c, False) for c in reversed(e.kids())]
        while todo:
            x, head = todo.pop()
            if x.tag == "tr":
                rows.append((x, head))
            elif x.tag != "table":
                todo += [(c, head or x.tag == "thead") for c in reversed(x.kids())]
        cut, rows = most_rows is not None and len(rows) > most_rows, rows[:most_rows]
        grid, carried = [], {}
        for row, _ in rows:
            line: list[str] = []

            def carry(line: list[str] = line) -> None:
                while len(line) in carried and len(line) < most_columns:
                    text, left = carried[len(line)]
                    at = len(line)
                    line.append(text)
                    carried.pop(at)
                    if left > 1:
                        carried[at] = (text, left - 1)

            for c in _cells(row):
                carry()
                span = lambda name, top: min(int(c.get(name).strip()), top) if c.get(name).strip().isdigit() and int(c.get(name).strip()) > 0 else 1  # noqa: B023, E731
                text, down = truncated(collapsed(c), most_chars), span("rowspan", 2000)
                for _ in range(span("colspan", 128)):
                    if len(line) >= most_columns:
                        break
                    if down > 1:
                        carried[len(line)] = (text, down - 1)
                    line.append(text)
                # a span that has just been opened starts with the next row
                for at in [k for k in carried if k < len(line)]:
                    carried[-at - 1] = carried.pop(at)
            while carried and (rest := [k for k in carried if k >= len(line)]) and len(line) < most_columns:
                line += [""] * (min(rest) - len(line))
                carry()
            for at in [k for k in carried if k < 0]:
                carried[-at - 1] = carried.pop(at)
            grid.append(line)
        headed = bool(grid) and (rows[0][1] or (bool(_cells(rows[0][0])) and all(c.tag == "th" for c in _cells(rows[0][0]))))
        headers, body = (grid[0], grid[1:]) if headed else ([], grid)
        if headers or any(body):
            out.append({"pre": e.pre, "caption": caption, "headers": headers, "rows": body, "truncated": cut})
    return out


def json_ld(root: Element, most: int | None = None) -> list:
    out: list = []
    for e in root.elements():
        if e.tag == "script" and e.get("type").strip().lower() == "application/ld+json":
            try:
                found = json.loads("".join(c for c in e.children if isinstance(c, str) and not isinstance(c, Comment)))
            except ValueError:
                continue
            for item in found if isinstance(found, list) else [found]:
                out += item["@graph"] if isinstance(item, dict) and isinstance(item.get("@graph"), list) else [item]
    return out[:most]


def _property(e: Element, base: str) -> str:
    attr = {"meta": "content", "a": "href", "area": "href", "link": "href", "img": "src", "audio": "src", "video": "src", "source": "src", "iframe": "src", "embed": "src", "object": "data", "data": "value", "meter": "value"}.get(e.tag)
    if e.tag == "time" and e.get("datetime"):
        return e.get("datetime").strip()
    if attr:
        return resolve(base, e.get(attr)) if attr in ("href", "src", "data") else e.get(attr).strip()
    return truncated(collapsed(e), 1000)


def microdata(root: Element, url: str, most: int | None = None) -> list[dict]:
    base = base_url(root, url)

    def item(e: Element, depth: int) -> dict:
        found: dict[str, list] = {}
        todo = list(reversed(e.kids()))
        while todo:
            x = todo.pop()
            scope = "itemscope" in x.attrs
            for name in x.get("itemprop").split():
                found.setdefault(name, []).append(item(x, depth + 1) if scope and depth < 6 else _property(x, base))
            if not scope:
                todo += reversed(x.kids())
        return {"type": e.get("itemtype").strip(), "id": e.get("itemid").strip(), "properties": found}

    tops = [e for e in root.elements() if "itemscope" in e.attrs and "itemprop" not in e.attrs and not any("itemscope" in x.attrs for x in e.above())]
    return [item(e, 0) for e in tops[:most]]


def records(root: Element, selector: str, fields: dict[str, str], limit: int = 50) -> list[dict[str, str]]:
    """A record for each match of ``selector`` ("": the document); a field is ``css`` (text) or ``css@attr``."""
    limit = limit if 0 < limit <= 200 else 200
    return [_record(e, sorted(fields), fields) for e in (select(root, selector) if selector.strip() else [root])[:limit]]


def _record(e: Element, names: list[str], fields: dict[str, str]) -> dict[str, str]:
    row = {}
    for name in names:
        css, _, attr = fields[name].partition("@")
        hit = first(e, css) if css.strip() else e
        if hit is None or (attr and attr not in hit.attrs):
            continue
        row[name] = truncated(hit.get(attr).strip() if attr else collapsed(hit), 1000)
    return row


def find(root: Element, query: str, most: int = 100, around: int = 80) -> list[dict]:
    """Text nodes that hold the query, with what stands around it and the headings above."""
    wanted, out, path = query.strip().lower(), [], []
    if not wanted:
        return out

    def walk(e: Element) -> None:
        if e.tag in SILENT:
            return
        if is_heading(e):
            level = int(e.tag[1])
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, collapsed(e)))
        for c in e.children:
            if isinstance(c, Element):
                walk(c)
            elif not isinstance(c, Comment) and len(out) < most and (at := c.lower().find(wanted)) >= 0:
                a, b = max(0, at - around), min(len(c), at + len(wanted) + around)
                out.append({"index": len(out), "snippet": ("… " if a else "") + squeeze(c[a:b]) + (" …" if b < len(c) else ""), "heading_path": " > ".join(t for _, t in path if t)})

    walk(root)
    return out


def duplicate_blocks(root: Element, least_chars: int = 200, least_links: int = 3) -> list[Element]:
    """Later copies of a block with as much text and as many links as that; a copy within the first is none. Only blocks that are large enough are read at all."""
    page = Page(root)
    kept: dict[tuple, Element] = {}
    out: list[Element] = []
    todo = [root]
    while todo:
        e = todo.pop()
        if e.tag in ("script", "style", "template", "noscript") or page.chars(e) < least_chars or page.links(e) < least_links:
            continue
        block = (collapsed(e), tuple(x.get("href") for x in e.elements() if x.tag == "a"))
        before = kept.setdefault(block, e)
        if before is not e and e not in before:
            out.append(e)
        else:
            todo += reversed(e.kids())
    return out


# How repeating groups are weighed; shapes tell apart by their first SHAPE_KIDS children -----------
LEAST_RECORDS, SHAPE_KIDS = 3, 16
LEAST_MEDIAN, MEDIAN_STEP, MOST_MEDIAN = 24, 40, 8
REGION_BIAS = {"main": 20, "article": 20, "region": 5, "complementary": 5, "search": 5, "navigation": -20, "contentinfo": -20, "banner": -20}
NO_CONTENT = 4
# -----------------------------------------------------------------------------------------------------------
_CONTENT = {"heading", "image", "time", "classtext"}


def _field_kinds(e: Element) -> list[tuple[str, str]]:
    """(attribute, kind) of what a record may show of an element; no attribute: its text."""
    data = next((a for a in e.attrs if a.startswith("data-")), "")
    found = [(data, "data")] if data else []
    if is_heading(e):
        found.append(("", "heading"))
    elif e.tag == "a" and "href" in e.attrs:
        found += [("", "link"), ("href", "link")]
    elif e.tag == "img" and "src" in e.attrs:
        found.append(("src", "image"))
    elif e.tag == "time" and "datetime" in e.attrs:
        found.append(("datetime", "time"))
    elif e.classes() and squeeze(" ".join(c for c in e.children if type(c) is str)):
        found.append(("", "classtext"))
    return found


def _schema(page: Page, group: list[Element], fields: list[tuple[Element, str, str]]) -> dict[str, str]:
    """Fields of a group's records by name: those that the first record has and at least half of all records show.

    What a field's selector finds first in a record is looked up in the page's postings, so many fields of large records
    cost no search of each record for each of them.
    """
    lead, half = group[0], (len(group) + 1) // 2
    chosen: dict[str, str] = {}
    specs: set[str] = set()
    after: Counter = Counter()
    for e, attr, kind in fields:
        classes = [c for c in e.classes() if SAFE.match(c)]
        tries = [(e.tag + "".join("." + c for c in classes), e.tag, classes, ""), (f"[{attr}]", "", [], attr), (e.tag, e.tag, [], "")]
        usable = [t for t in tries if (SAFE.match(attr) and kind == "data" if t[3] else SAFE.match(e.tag))]
        field = next((t for t in usable if page.first_in(lead, *t[1:]) is e), None)
        if field is None:
            continue
        spec = f"{field[0]}@{attr}" if attr else field[0]
        if spec in specs:
            continue
        specs.add(spec)
        plain = attr[5:] if kind == "data" else next(iter(e.classes()), "") or {"link": "url" if attr else "link", "image": "image", "time": "date", "heading": "title"}.get(kind, "field")
        name = plain = re.sub("[^a-z0-9_]+", "_", plain.lower()).strip("_")[:32] or "field"
        while name in chosen:
            after[plain] = max(after[plain], 1) + 1
            name = f"{plain}_{after[plain]}"
        shown = 0
        if page.between(lead.pre, group[-1].last, *field[1:]) >= half:  # else too few records can have it
            hits = (page.first_in(g, *field[1:]) for g in group)
            shown = sum(h is not None and bool(h.get(attr).strip() if attr else page.chars(h)) for h in hits)
        chosen[name] = spec if shown >= half else ""
    return {n: f for n, f in chosen.items() if f}


def collections(root: Element, most: int | None = None) -> list[dict]:
    """Repeating records that a page shows, best first, each with a selector of its members and selectors of their fields.

    All groups of a page are weighed, by all their members; none is left out unless a caller asks for the ``most`` best ones.
    """
    names, page = Names(root), Page(root)

    def shape(e: Element, depth: int = 2) -> str:
        kids = e.kids()
        inner = ",".join(shape(k, depth - 1) for k in kids[:SHAPE_KIDS]) + "+" * (len(kids) > SHAPE_KIDS) if depth else ""
        return f"{e.tag}({inner})"

    around: dict[int, str] = {}

    def region(e: Element | None) -> str:
        """The innermost landmark or article that an element is or is within."""
        todo = []
        while e is not None and e.pre not in around:
            todo.append(e)
            e = e.parent
        role = around[e.pre] if e is not None else ""
        for x in reversed(todo):
            role = around[x.pre] = role_of(x, names) or ("article" if x.tag == "article" else "") or role
        return role

    found = []
    for parent in root.elements():
        groups: dict[tuple | str, list[Element]] = {}
        for k in parent.kids():
            groups.setdefault((k.tag, frozenset(k.classes())) if k.classes() else shape(k), []).append(k)
        found += [(parent, g) for g in groups.values() if len(g) >= LEAST_RECORDS]
    if not found:
        return []
    kinds_of = [_field_kinds(e) for e in page.elements]
    sums = {kind: [0, *accumulate(sum(k == kind for _, k in f) for f in kinds_of)] for kind in {k for f in kinds_of for _, k in f}}
    scored = []
    for at, (parent, group) in enumerate(found):
        lead, where = group[0], region(parent)
        kinds = {k for k, s in sums.items() if s[lead.last + 1] > s[lead.pre + 1]}
        sizes = sorted(map(page.chars, group))
        median, content = sizes[len(sizes) // 2], bool(kinds & _CONTENT)
        bias = REGION_BIAS.get(where, 0)
        if content or (median >= LEAST_MEDIAN and bias >= 0):
            scored.append((-(bias + 2 * (len(group).bit_length() - 1) + min(median // MEDIAN_STEP, MOST_MEDIAN) + 2 * len(kinds) - NO_CONTENT * (not content)), at, parent, group, where))
    out: list[dict] = []
    taken: list[tuple[int, int]] = []  # intervals of the parents; none is within another
    alike: dict[tuple, int] = {}

    def count(parent: Element | None, tag: str, classes: frozenset) -> int:
        """How many of a parent's children (or of the page's elements) a tag and classes find; a group is all of them if it has as many."""
        key = (parent, tag, classes)
        if key not in alike:
            alike[key] = len(page.matching(tag, classes)) if parent is None else sum(k.tag == tag and (not classes or classes <= set(k.classes())) for k in parent.kids())
        return alike[key]

    for _, _, parent, group, where in sorted(scored, key=lambda s: s[:2]):
        if len(out) == most:
            break
        at, lead = bisect_left(taken, (parent.pre, parent.last)), group[0]
        if (at and taken[at - 1][1] >= parent.pre) or (at < len(taken) and taken[at][0] <= parent.last) or not SAFE.match(lead.tag):
            continue
        classes = [c for c in lead.classes() if SAFE.match(c)]
        css, named = lead.tag + "".join("." + c for c in classes), frozenset(classes)
        if count(None, lead.tag, named) == len(group):
            selector = css
        else:  # of the parent's children those of these classes, or of this tag
            own = css if count(parent, lead.tag, named) == len(group) else lead.tag if count(parent, lead.tag, frozenset()) == len(group) else ""
            selector = f"{page.selector(parent)} > {own}" if own else ""
        if not selector:
            continue
        fields = _schema(page, group, [(e, attr, kind) for e in page.elements[lead.pre + 1 : lead.last + 1] for attr, kind in kinds_of[e.pre]])
        if fields:
            insort(taken, (parent.pre, parent.last))
            out.append({"root": selector, "count": len(group), "region": where, "fields": fields})
    return out
