"""HTML into a tree by the standard's tree construction: one pass of a regular expression cuts tokens, a stack of open elements places them.

What unclosed formatting reopens, misnested formatting (the adoption agency), tables that hold what tables can't
(foster parenting), selects, templates and foreign elements follow the standard with scripting on, so ``noscript`` is text.
Instead of a state variable the place of a token in the stack tells which rules hold. Elements nest MOST_DEPTH
deep at most. Left out: framesets, quirks, and letter case of foreign names.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

from webloom.functions.tree import Comment, Element

#: So deep do elements nest at most; all walks over a tree rely on it.
MOST_DEPTH = 400

# Classes of elements in the standard --------------------------------------------------------
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
HEAD_ONLY = frozenset("title meta link style script base noscript template basefont bgsound noframes".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset(("title", "textarea"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul h1 h2 h3 h4 h5 h6 pre listing form li dd dt table hr xmp plaintext".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
TABLE_LEVELS = frozenset("table tbody tfoot thead tr colgroup".split())
MARKERS = frozenset("td th caption applet marquee object template".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html table td th marquee object template foreignobject desc math".split())
LIST_SCOPE, BUTTON_SCOPE, TABLE_SCOPE = SCOPE | {"ol", "ul"}, SCOPE | {"button"}, frozenset(("html", "table", "template"))
SPECIAL = SCOPE | CLOSES_P | TABLE_PARTS | VOID - {"wbr"} | frozenset("body br button frameset head iframe img input link noscript object script select style textarea title track".split())
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_WITHIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
# -----------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"""<(?:([a-zA-Z][^\s/>]*+)([^>=]*+(?:=(?:\s*+"[^"]*+"|\s*+'[^']*+')?+[^>=]*+)*+)>|/([a-zA-Z][^\s/>]*+)[^>]*>|!--(?:-?>|(.*?)(?:--!?>|\Z))|([!?/][^>]*)>)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_REFERENCE = re.compile(r"&(?:(#(?:[0-9]+|[xX][0-9a-fA-F]+);?)|([a-zA-Z][a-zA-Z0-9]*+;?)(=?))")
_TAIL = re.compile(r"<(?:[a-zA-Z!?]|/[a-zA-Z!?])")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW | RCDATA}


def _value(text: str) -> str:
    """An attribute's value; what looks like a name without its semicolon, and goes on, stays as it is."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[1] or (m[2] in html5 and (m[2].endswith(";") or not m[3])) else m[0], text)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        value = a or b or c
        out.setdefault(name.lower(), _value(value) if "&" in value else value)
    return out


class Builder:
    def __init__(self) -> None:
        self.root = Element("html", {}, None)
        self.head = Element("head", {}, self.root)
        self.body = Element("body", {}, self.root)
        self.root.children = [self.head, self.body]
        self.open: list[Element] = [self.root, self.head]
        self.active: list[Element | None] = []  # formatting to reopen; None is a marker
        self.form: Element | None = None
        self.counts = {"select": 0, "template": 0, "svg": 0, "math": 0}

    # the stack ---------------------------------------------------------------------------------------------

    def cut(self, at: int) -> None:
        """Close all from ``at`` on."""
        for e in self.open[at:]:
            if e.tag in self.counts:
                self.counts[e.tag] -= 1
            if e.tag in MARKERS:
                self.forget()
        del self.open[at:]

    def forget(self) -> None:
        """Drop formatting up to the last marker."""
        while self.active and self.active.pop() is not None:
            pass

    def find(self, tags: frozenset | tuple, walls: frozenset) -> int:
        """Where the innermost of some elements is in the stack, if no wall is before it; else 0."""
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in tags:
                return at
            if tag in walls:
                return 0
        return 0

    def close(self, tags: frozenset | tuple, walls: frozenset) -> bool:
        at = self.find(tags, walls)
        if at:
            self.cut(at)
        return at > 0

    def to_body(self) -> None:
        if self.open[1] is self.head:
            self.cut(1)
            self.open.append(self.body)

    # placing -----------------------------------------------------------------------------------------------

    def place(self, fostered: bool = True) -> tuple[Element, int | None]:
        """Where the next node goes: a parent, and before which of its children (None: at the end). In front of the table, if a table can't hold it."""
        top = self.open[-1]
        if not fostered or top.tag not in TABLE_LEVELS:
            return top, None
        at = self.find(("table", "template"), frozenset())
        if not at or self.open[at].tag == "template":
            return (self.open[at] if at else top), None
        table = self.open[at]
        if table.parent is None:
            return self.open[at - 1], None
        kids = table.parent.children
        return table.parent, next(i for i in range(len(kids) - 1, -1, -1) if kids[i] is table)

    def put(self, node: Element | Comment, fostered: bool = True) -> None:
        parent, before = self.place(fostered)
        if isinstance(node, Element):
            node.parent = parent
        if before is None:
            parent.children.append(node)
        else:
            parent.children.insert(before, node)

    def text(self, data: str, fostered: bool = True) -> None:
        parent, before = self.place(fostered)
        kids = parent.children
        end = len(kids) if before is None else before
        if end and type(kids[end - 1]) is str:
            kids[end - 1] += data
        else:
            kids.insert(end, data)

    def push(self, tag: str, attrs: dict[str, str], fostered: bool = True) -> Element:
        if len(self.open) > MOST_DEPTH:
            # browsers do not nest deeper either: what comes is beside, not within
            self.cut(MOST_DEPTH)
        e = Element(tag, attrs, None)
        self.put(e, fostered)
        self.open.append(e)
        if tag in self.counts:
            self.counts[tag] += 1
        if tag in MARKERS:
            self.active.append(None)
        return e

    def single(self, tag: str, attrs: dict[str, str], fostered: bool = True) -> None:
        self.put(Element(tag, attrs, None), fostered)

    # formatting --------------------------------------------------------------------------------------------

    def reopen(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.open:
            return
        k = len(self.active)
        while k and self.active[k - 1] is not None and self.active[k - 1] not in self.open:
            k -= 1
        for i in range(k, len(self.active)):
            lost = self.active[i]
            self.active[i] = self.push(lost.tag, dict(lost.attrs))

    def formatting(self, tag: str, attrs: dict[str, str]) -> None:
        self.reopen()
        e = self.push(tag, attrs)
        alike = [i for i in range(self._marker(), len(self.active)) if self.active[i].tag == tag and self.active[i].attrs == attrs]
        if len(alike) >= 3:
            del self.active[alike[0]]
        self.active.append(e)

    def _marker(self) -> int:
        """Where the formatting after the last marker begins."""
        return next((i + 1 for i in range(len(self.active) - 1, -1, -1) if self.active[i] is None), 0)

    def adopt(self, tag: str) -> None:
        """The end of formatting that may be misnested: blocks within it leave it, and get a copy of their own."""
        if self.open[-1].tag == tag and self.open[-1] not in self.active:
            self.cut(len(self.open) - 1)
            return
        for _ in range(8):
            e = next((x for x in reversed(self.active[self._marker() :]) if x.tag == tag), None)
            if e is None:
                self.other_end(tag)
                return
            if e not in self.open:
                self.active.remove(e)
                return
            at = self.open.index(e)
            if not self.find((tag,), SCOPE):
                return
            block_at = next((i for i in range(at + 1, len(self.open)) if self.open[i].tag in SPECIAL), None)
            if block_at is None:
                self.cut(at)
                self.active.remove(e)
                return
            block, above = self.open[block_at], self.open[at - 1]
            bookmark, last = self.active.index(e), block
            for steps, node in enumerate(reversed(self.open[at + 1 : block_at]), 1):
                if steps > 3 and node in self.active:
                    self.active.remove(node)
                if node not in self.active:
                    self.open.remove(node)
                    continue
                twin = Element(node.tag, dict(node.attrs), above)
                self.active[self.active.index(node)] = twin
                self.open[self.open.index(node)] = twin
                if last is block:
                    bookmark = self.active.index(twin) + 1
                self.move(last, twin)
                last = twin
            last.parent.children.remove(last) if last.parent and any(c is last for c in last.parent.children) else None
            if above.tag in TABLE_LEVELS:
                kept, self.open = self.open, self.open[: self.open.index(above) + 1]
                self.put(last)
                self.open = kept
            else:
                last.parent = above
                above.children.append(last)
            twin = Element(e.tag, dict(e.attrs), block)
            twin.children, block.children = block.children, [twin]
            for c in twin.children:
                if isinstance(c, Element):
                    c.parent = twin
            place = self.active.index(e)
            del self.active[place]
            self.active.insert(bookmark - (place < bookmark), twin)
            self.open.remove(e)
            self.open.insert(self.open.index(block) + 1, twin)

    def move(self, e: Element, to: Element) -> None:
        if e.parent is not None:
            e.parent.children = [c for c in e.parent.children if c is not e]
        e.parent = to
        to.children.append(e)

    # tokens ------------------------------------------------------------------------------------------------

    def foreign(self) -> bool:
        """Whether the rules of svg and math hold here."""
        if not (self.counts["svg"] or self.counts["math"]):
            return False
        for e in reversed(self.open):
            if e.tag in ("svg", "math"):
                return True
            if e.tag in HTML_WITHIN:
                return False
        return False

    def data(self, data: str) -> None:
        if data.isspace():
            if len(self.open) == 2 and (self.open[1] is self.head or not self.body.children):
                return
            if self.open[-1].tag in TABLE_LEVELS:
                self.text(data, False)
                return
        elif self.open[1] is self.head and len(self.open) == 2:
            self.to_body()
        self.reopen()
        self.text(data)

    def start(self, tag: str, attrs: dict[str, str], closed: bool = False) -> None:
        top = self.open[-1].tag
        if self.foreign():
            if tag in BREAKS_OUT or (tag == "font" and attrs.keys() & {"color", "face", "size"}):
                while self.foreign():
                    self.cut(len(self.open) - 1)
            else:
                self.single(tag, attrs) if closed else self.push(tag, attrs)
                return
        if tag in ("html", "head", "body"):
            if tag == "body":
                self.to_body()
            if not self.counts["template"]:
                for k, v in attrs.items():
                    {"html": self.root, "head": self.head, "body": self.body}[tag].attrs.setdefault(k, v)
            return
        if self.open[1] is self.head and len(self.open) == 2:
            if tag in HEAD_ONLY:
                self.single(tag, attrs) if tag in VOID else self.push(tag, attrs)
                return
            self.to_body()
        if self.counts["select"] and self.find(("select",), frozenset(("template", "html"))):
            if not self.within_select(tag, attrs):
                return
            top = self.open[-1].tag
        if tag in TABLE_PARTS:
            self.table_part(tag, attrs)
            return
        if top in TABLE_LEVELS and tag in ("form", "input", "script", "style", "template"):
            if tag in ("script", "style", "template"):
                self.push(tag, attrs, False)
                return
            if tag == "input" and attrs.get("type", "").lower() == "hidden":
                self.single(tag, attrs, False)
                return
            if tag == "form":
                if self.form is None:
                    self.single(tag, attrs, False)
                    self.form = self.open[-1].children[-1]
                return
        if top in TABLE_LEVELS and tag == "table":
            if self.close(("table",), TABLE_SCOPE - {"table"}):
                self.start(tag, attrs)
            return
        if tag in CLOSES_P:
            self.block(tag, attrs)
        elif tag in FORMATTING:
            if tag == "a" and any(x.tag == "a" for x in self.active[self._marker() :]):
                old = next(x for x in reversed(self.active[self._marker() :]) if x.tag == "a")
                self.adopt("a")
                self.active = [x for x in self.active if x is not old]
                if old in self.open:
                    self.open.remove(old)
            elif tag == "nobr":
                self.reopen()
                if self.find(("nobr",), SCOPE):
                    self.adopt("nobr")
            self.formatting(tag, attrs)
        elif tag == "image":
            self.start("img", attrs)
        elif tag in VOID:
            if tag in ("area", "br", "embed", "img", "input", "keygen", "wbr"):
                self.reopen()
            self.single(tag, attrs)
        elif tag in ("svg", "math"):
            self.reopen()
            self.single(tag, attrs) if closed else self.push(tag, attrs)
        elif tag in HEAD_ONLY or tag in RAW:
            self.push(tag, attrs)
        else:
            if tag == "button" and self.find(("button",), SCOPE):
                self.implied()
                self.close(("button",), SCOPE)
            elif tag in ("option", "optgroup") and top == "option":
                self.cut(len(self.open) - 1)
            elif tag in ("rb", "rtc", "rp", "rt") and self.find(("ruby",), SCOPE):
                self.implied("rtc" if tag in ("rp", "rt") else "")
            if tag not in ("rb", "rtc", "rp", "rt", "textarea"):
                self.reopen()
            self.push(tag, attrs)

    def block(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "form" and self.form is not None and not self.counts["template"]:
            return
        if tag in ("li", "dd", "dt"):
            same = ("li",) if tag == "li" else ("dd", "dt")
            for at in range(len(self.open) - 1, 0, -1):
                e = self.open[at]
                if e.tag in same:
                    self.cut(at)
                    break
                if e.tag in SPECIAL and e.tag not in ("address", "div", "p"):
                    break
        self.close(("p",), BUTTON_SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.cut(len(self.open) - 1)
        if tag == "hr":
            self.single(tag, attrs)
            return
        if tag == "xmp":
            self.reopen()
        e = self.push(tag, attrs)
        if tag == "form" and not self.counts["template"]:
            self.form = e

    def table_part(self, tag: str, attrs: dict[str, str]) -> None:
        """A start tag that only tables and templates take: what is open above their level is closed, what they imply is opened."""
        at = self.find(frozenset(("td", "th", "caption", "table", "template")), frozenset(("html",)))
        if not at:
            return
        e = self.open[at]
        if e.tag in ("td", "th", "caption"):
            if not self.find(("table",), frozenset(("html", "template"))):
                return
            self.cut(at)
            self.table_part(tag, attrs)
            return
        if e.tag == "template":
            self.single(tag, attrs, False) if tag == "col" else self.push(tag, attrs, False)
            return
        # now the innermost table is open: down to the level that takes the part
        level = {"caption": ("table",), "colgroup": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "col": ("colgroup", "table"), "tr": ("tbody", "thead", "tfoot", "table"), "td": ("tr", "tbody", "thead", "tfoot", "table"), "th": ("tr", "tbody", "thead", "tfoot", "table")}[tag]
        self.cut(self.find(level, frozenset(("html",))) + 1)
        top = self.open[-1].tag
        if tag == "col" and top == "table":
            self.push("colgroup", {}, False)
        elif tag in ("tr", "td", "th") and top == "table":
            self.push("tbody", {}, False)
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            self.push("tr", {}, False)
        self.single(tag, attrs, False) if tag == "col" else self.push(tag, attrs, False)

    def within_select(self, tag: str, attrs: dict[str, str]) -> bool:
        """Whether a start tag within a select goes on as usual (the select is closed then); else it is done, or ignored."""
        if tag in ("option", "optgroup", "hr"):
            if self.open[-1].tag == "option":
                self.cut(len(self.open) - 1)
            if tag != "option" and self.open[-1].tag == "optgroup":
                self.cut(len(self.open) - 1)
            self.single(tag, attrs, False) if tag == "hr" else self.push(tag, attrs, False)
            return False
        if tag in ("script", "template"):
            self.push(tag, attrs, False)
            return False
        if tag == "select" or tag in ("input", "keygen", "textarea") or tag in TABLE_PARTS or tag == "table":
            self.close(("select",), frozenset(("html",)))
            return tag != "select"
        return False

    def implied(self, but: str = "") -> None:
        while self.open[-1].tag in IMPLIED and self.open[-1].tag != but:
            self.cut(len(self.open) - 1)

    def other_end(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self.cut(at)
                return
            if self.open[at].tag in SPECIAL:
                return

    def end(self, tag: str) -> None:
        if self.foreign() and tag not in ("p", "br"):
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag == tag:
                    self.cut(at)
                    return
                if self.open[at].tag in ("svg", "math"):
                    break
        if tag in ("html", "body"):
            self.to_body()
            return
        if tag == "head":
            if self.open[1] is self.head and len(self.open) == 2:
                self.to_body()
            return
        if self.open[1] is self.head and len(self.open) == 2:
            if tag not in ("br", "p"):
                return
            self.to_body()
        if self.counts["select"] and (at := self.find(("select",), frozenset(("html", "template")))):
            if tag in ("select", "option", "optgroup"):
                if tag == "optgroup" and self.open[-1].tag == "option" and self.open[-2].tag == "optgroup":
                    self.cut(len(self.open) - 1)
                if self.open[-1].tag == tag or tag == "select":
                    self.cut(at if tag == "select" else len(self.open) - 1)
                return
            if tag not in TABLE_PARTS and tag != "table":
                if tag in ("script", "template"):
                    self.other_end(tag)
                return
            self.cut(at)
        if tag in FORMATTING:
            self.adopt(tag)
        elif tag == "br":
            self.reopen()
            self.single("br", {})
        elif tag == "p":
            if not self.close(("p",), BUTTON_SCOPE):
                self.push("p", {})
                self.cut(len(self.open) - 1)
        elif tag in HEADINGS:
            self.close(HEADINGS, SCOPE)
        elif tag == "li":
            self.close(("li",), LIST_SCOPE)
        elif tag == "table" or tag in TABLE_PARTS:
            self.close((tag,), frozenset(("html", "template", "table")) - {tag})
        elif tag == "form" and not self.counts["template"]:
            self.form = None
            self.close(("form",), SCOPE)
        elif tag == "template":
            self.close(("template",), frozenset(("html",)))
        elif tag in CLOSES_P or tag in MARKERS or tag in ("button", "select"):
            self.close((tag,), SCOPE - {tag})
        elif tag not in VOID:
            self.other_end(tag)


def tree(html: str) -> Element:
    """The ``html`` element of a document, not numbered yet; never fails."""
    if "\r" in html:
        html = html.replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in html:
        html = html.replace("\0", "")
    b = Builder()
    search, pos, last = _TOKEN.search, 0, html.rfind(">") + 1
    while pos < last:
        m = search(html, pos, last)
        at = m.start() if m else last
        if at > pos:
            text = html[pos:at]
            b.data(unescape(text) if "&" in text else text)
        if m is None:
            pos = last
            break
        pos = m.end()
        name, rest, ended, comment, other = m.groups()
        if name:
            name = name.lower()
            b.start(name, attributes(rest) if rest and not rest.isspace() else {}, rest.endswith("/"))
            if b.open[-1].tag == name and (name in RAW or name in RCDATA) and not b.foreign():
                end = _ENDS[name].search(html, pos)
                stop = end.start() if end else len(html)
                text = html[pos:stop]
                if name == "textarea" and text.startswith("\n"):
                    text = text[1:]
                if text:
                    b.text(unescape(text) if name in RCDATA and "&" in text else text, False)
                b.cut(len(b.open) - 1)
                pos = max(stop, pos)
                if end:
                    close = html.find(">", stop)
                    pos = close + 1 if close >= 0 else len(html)
            elif name in ("pre", "listing") and html.startswith("\n", pos):
                pos += 1
        elif ended:
            b.end(ended.lower())
        elif other is None:
            b.put(Comment(comment or ""), False)
    # behind the last tag: text up to what would begin one
    tail = html[pos:]
    m = _TAIL.search(tail)
    if m and tail.startswith("<!--", m.start()):
        rest = tail[m.start() + 4 :]
        tail = tail[: m.start()]
        if tail:
            b.data(unescape(tail))
        b.put(Comment(rest), False)
    elif tail := tail[: m.start()] if m else tail:
        b.data(unescape(tail))
    return b.root
