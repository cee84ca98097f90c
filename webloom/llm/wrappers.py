"""Main text of pages by wrappers: union-free regular expressions over the token streams of a host's pages.

A page's tags become a nested stream of blocks and texts. The content of a block is a
sequence of slots; a slot is one kind of block (or text), or a group of kinds that
repeats. A page's own repetitions fold into groups first. Streams of a host are then aligned one
after another: kinds that stand in the same order meet and are aligned within, a kind that only one side has becomes
optional, a kind that comes back after others makes a repeated group of all in between, and texts that
differ become text slots, while equal ones stay constants of the template. No alternatives are ever
built (a group repeats optional kinds), so a kind has one place in its sequence, and a wrapper's size depends on
the kinds that pages use, not on their number.

Equal streams are added up by Spark's own aggregation; different ones of a host are aligned in groups of
bounded size, and their wrappers again, until each host has one. Wrappers say which slots are
the main text: what isn't navigation, notice, advert, form or comment by its element or name, isn't constant
over the host, and belongs to the article, or else to the block that holds nearly all of the host's varying text.
"""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.dom import BLOCK, VOID
from webloom.functions.urls import host
from webloom.llm.tables import discard, stored, table
from webloom.llm.textarrays import slices

#: Streams that are aligned by one task at once, about.
FAN_IN = 128
#: Kinds of a sequence and nodes of a wrapper from which on names are forgotten and only elements count.
MOST_KINDS = 64
MOST_NODES = 20_000
#: Blocks nest so deep at most; what would be deeper is beside, as in browsers.
MOST_DEPTH = 150
#: A task's different streams until it sends them on.
HELD = 4096
#: Bytes of wrappers that are sent to all tasks at most; more are joined by host.
SENT_BYTES = 32 << 20
#: So many pages of a host, half of all at least, have to show the same text for it to be the template's.
LEAST_PAGES = 5

# Elements and names that aren't main text ---------------------------------------------------
OUT_TAGS = frozenset("nav aside footer form menu search dialog noscript template select button datalist fieldset object canvas audio video svg math head".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "signup login sidebar sidenav rail widget widgets menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead topbar toolbar footer colophon copyright legal disclaimer comment comments commentlist "
    "respond reply replies disqus discussion share sharing social related recommended recommendations trending form search".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
CORE_WORDS = frozenset("article entry post story content main".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot caption", "table"), "thead": ("tbody thead tfoot caption", "table"), "tfoot": ("tbody thead tfoot caption", "table"),
}
# -----------------------------------------------------------------------------------------------------------

_BLOCKS = (BLOCK | {"body", "center"}) | (OUT_TAGS - {"button", "svg", "math", "object"})
_KEEPS_P = frozenset("li dd dt td th tr tbody thead tfoot".split())
_WALL = frozenset("table td th caption body".split())
_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
_HEAD_ONLY = frozenset("meta link base title style script noscript template body html".split())
_LEAVES = _HEADINGS | frozenset("p li td th dt dd pre blockquote figcaption tr caption summary".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*+)([^>=]*+(?:=(?:\s*+"[^"]*+"|\s*+'[^']*+')?+[^>=]*+)*+)>|</([a-zA-Z][^\s/>]*+)[^>]*>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_HIDES = re.compile(r"display:none|visibility:hidden")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Block:
    """An element of a page that matters for its layout, or a text (``tag`` is then "#")."""

    __slots__ = ("core", "kids", "kind", "link", "out", "saved", "tag", "text")

    def __init__(self, tag: str, kind: str, out: bool = False, text: str = "", link: int = 0):
        self.tag, self.kind, self.out, self.text, self.link = tag, kind, out, text, link
        self.kids: list[Block] = []
        self.core = bare(kind) in ("article", "main")
        self.saved: tuple[list[str], int] | None = None


@lru_cache(1 << 14)
def _seen(tag: str, attrs: str) -> tuple[str, bool]:
    """(kind, whether it isn't main text) by a tag as it stands. Roles count as the elements that have them."""
    given = {}
    for name, *values in _ATTRIBUTE.findall(attrs):
        given.setdefault(name.lower(), unescape("".join(values)))
    names = given.get("class", "").split(), given.get("id", "").split()
    role = given.get("role", "").strip().lower()
    tag = {"main": "main", "article": "article"}.get(role, tag)
    plain = [sorted({re.sub(r"\d+", "", x).lower() for x in part} - {""}) for part in names]
    kind = tag + "".join("." + x for x in plain[0]) + "".join("#" + x for x in plain[1])
    words = {w.lower() for part in names for x in part for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", x)}
    named = words & OUT_WORDS
    if words & CORE_WORDS or tag in _HEADINGS:
        named = named - {"header", "banner"}
    if tag == "article":
        named = named & COMMENT_WORDS
    hidden = "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or bool(_HIDES.search(re.sub(r"\s", "", given.get("style", "").lower())))
    out = hidden or tag in OUT_TAGS or role in OUT_ROLES or (bool(named) and tag not in ("body", "main"))
    return kind + ("!" if out else ""), out


def blocks(html: str) -> Block:
    """The body of a page as nested blocks; never fails. Elements of a line are no blocks unless they are to be left out."""
    root = Block("body", "body")
    stack, buffer, link, link_at = [root], [], 0, 0
    last, pos = html.rfind(">") + 1, 0

    def flush() -> None:
        nonlocal buffer, link
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                stack[-1].kids.append(Block("#", "#", text=text, link=min(link, len(text))))
        buffer, link = [], 0

    def pop(to: int) -> None:
        nonlocal buffer, link, link_at
        while len(stack) > to:
            flush()
            gone = stack.pop()
            if gone.core and not gone.out:
                stack[-1].core = True
            if gone.saved is not None:
                buffer, link = gone.saved
        if link_at > to:
            link_at = 0

    def close(tags: str | frozenset, walls: str | frozenset) -> bool:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in tags:
                pop(at)
                return True
            if stack[at].tag in walls:
                return False
        return False

    def say(text: str) -> None:
        nonlocal link
        if text:
            text = unescape(text) if "&" in text else text
            buffer.append(text)
            if link_at:
                link += len(text.strip())

    while pos < last:
        m = _TOKEN.search(html, pos, last)
        if m is None:
            break
        say(html[pos : m.start()])
        pos = m.end()
        name, attrs, ended = m.groups()
        if name:
            name = name.lower()
            if name in RAW:
                end = _ENDS[name].search(html, pos)
                pos = end.start() if end else len(html)
                continue
            if name in ("br", "wbr"):
                buffer.append(" " if name == "br" else "")
                continue
            if stack[-1].tag == "head" and name not in _HEAD_ONLY:
                pop(len(stack) - 1)
            block = name in _BLOCKS
            if not block and name == "hr":
                flush()
            if name in VOID or name == "html":
                continue
            if name == "body":
                close(frozenset(("head",)), frozenset())
                continue
            if name == "a":
                link_at = len(stack) if "href" in attrs.lower() else 0
            kind, out = _seen(name, attrs)
            if not block:
                if out:  # its text is kept apart, the line goes on behind it
                    inner = Block(name, kind, True)
                    inner.saved = (buffer, link)
                    buffer, link = [], 0
                    stack[-1].kids.append(inner)
                    stack.append(inner)
                continue
            flush()
            if name in _CLOSES:
                what, walls = _CLOSES[name]
                close(frozenset(what.split()), frozenset(walls.split()))
            elif name not in _KEEPS_P:
                close(frozenset(("p",)), _WALL)
            if name in _HEADINGS and stack[-1].tag in _HEADINGS:
                pop(len(stack) - 1)
            if len(stack) > MOST_DEPTH:
                pop(MOST_DEPTH)
            if name == "header" and any(x.tag in ("article", "main") for x in stack):
                kind, out = kind.rstrip("!"), out and kind != "header!"
            elif name == "header":
                kind, out = kind.rstrip("!") + "!", True
            new = Block(name, kind, out)
            stack[-1].kids.append(new)
            stack.append(new)
        elif ended:
            ended = ended.lower()
            if ended == "a":
                link_at = 0
            if ended in _BLOCKS and ended not in ("body", "html"):
                flush()
                close(frozenset((ended,)), _WALL - {ended} if ended in _LEAVES else frozenset(("body",)))
            elif ended not in _BLOCKS and stack[-1].saved is not None and any(x.saved is not None and x.tag == ended for x in stack):
                close(frozenset((ended,)), frozenset(("body",)))
    say(html[pos:])
    pop(1)
    flush()
    return root


def _left_out(b: Block) -> bool:
    """What holds an article isn't left out for its name."""
    return b.out and not b.core


class Node:
    """A kind within a wrapper: how many pages have it, and its sequence, or what its texts are like."""

    __slots__ = ("chars", "high", "kind", "link", "low", "n", "seq")

    def __init__(self, kind: str, n: int = 1, chars: int = 0, link: int = 0, low: int = 0, high: int = 0):
        self.kind, self.n, self.chars, self.link, self.low, self.high = kind, n, chars, link, low, high
        self.seq: list[Slot] = []

    def absorb(self, other: Node, same_page: bool = False) -> None:
        """Align another's sequence with this one."""
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.chars, self.link = self.chars + other.chars, self.link + other.link
        self.n = max(self.n, other.n) if same_page else self.n + other.n
        self.seq = aligned(self.seq, other.seq, same_page)

    def walk(self) -> Iterator[Node]:
        yield self
        for slot in self.seq:
            for x in slot.kinds.values():
                yield from x.walk()


class Slot:
    """One kind, or a repeated group of kinds that may each be missing."""

    __slots__ = ("kinds", "many")

    def __init__(self, kinds: dict[str, Node], many: bool = False):
        self.kinds, self.many = kinds, many


def _join(seq: list[Slot], a: int, b: int) -> None:
    """Make the slots from a to b one repeated group."""
    kinds = seq[a].kinds
    for slot in seq[a + 1 : b + 1]:
        kinds |= slot.kinds
    seq[a : b + 1] = [Slot(kinds, True)]


def aligned(ours: list[Slot], theirs: list[Slot], same_page: bool = False) -> list[Slot]:
    """Two sequences as one. What only one has is optional (its count of pages tells); what comes back makes a repeated group."""
    at = -1  # where we are in ours
    for slot in theirs:
        hits = [i for i, x in enumerate(ours) if not slot.kinds.keys().isdisjoint(x.kinds)]
        if not hits:
            at += 1
            ours.insert(at, slot)
            continue
        a, b = hits[0], hits[-1]
        if a < at:
            b = max(b, at)
        if b > a:
            _join(ours, a, b)
        own = ours[a]
        own.many = own.many or slot.many
        for kind, x in slot.kinds.items():
            if kind in own.kinds:
                own.kinds[kind].absorb(x, same_page)
            else:
                own.kinds[kind] = x
        at = a
    return ours if sum(len(x.kinds) for x in ours) <= MOST_KINDS else coarse(ours)


def bare(kind: str) -> str:
    """A kind without its names; whether it is left out stays."""
    return re.split(r"[.#!]", kind)[0] + ("!" if kind.endswith("!") else "") if kind != "#" else kind


def coarse(seq: list[Slot]) -> list[Slot]:
    """A sequence in which kinds of the same element are one."""
    out: list[Slot] = []
    for slot in seq:
        own = Slot({}, slot.many)
        for kind, x in slot.kinds.items():
            x.kind = bare(kind)
            fold(own, x)
        hits = [i for i, s in enumerate(out) if not s.kinds.keys().isdisjoint(own.kinds)]
        if hits:
            _join(out, hits[0], len(out) - 1)
            for x in own.kinds.values():
                fold(out[-1], x)
        else:
            out.append(own)
    return out


def fold(slot: Slot, x: Node) -> None:
    """One more of a page's blocks in a slot."""
    if x.kind in slot.kinds:
        slot.many = True
        slot.kinds[x.kind].absorb(x, True)
    else:
        slot.kinds[x.kind] = x


def simpler(node: Node) -> Node:
    """A wrapper that knows elements only."""
    for slot in node.seq:
        for x in slot.kinds.values():
            simpler(x)
    node.seq = coarse(node.seq)
    return node


def stream(b: Block, page: int = 0) -> Node:
    """A page's own expression, its repetitions folded. What is left out is a leaf."""
    if b.tag == "#":
        code = xxhash.xxh64_intdigest(b.text) >> 1
        return Node("#", 1, len(b.text), b.link, code, code)
    node = Node(b.kind if _left_out(b) or not b.kind.endswith("!") else b.kind[:-1], low=page, high=page)
    if not _left_out(b):
        for kid in b.kids:
            x = stream(kid)
            hit = next((i for i, slot in enumerate(node.seq) if x.kind in slot.kinds), None)
            if hit is None:
                node.seq.append(Slot({x.kind: x}))
            else:
                if hit < len(node.seq) - 1:
                    _join(node.seq, hit, len(node.seq) - 1)
                fold(node.seq[-1], x)
        if len(node.seq) > MOST_KINDS:
            node.seq = coarse(node.seq)
    return node


def shape(node: Node) -> list:
    return [node.kind, [[int(s.many), [shape(x) for _, x in sorted(s.kinds.items())]] for s in node.seq]]


def figures(node: Node) -> list[tuple[int, int, int, int, int]]:
    """(pages, chars, chars in links, least and greatest hash) of all nodes, in the order of ``shape``."""
    out = [(node.n, node.chars, node.link, node.low, node.high)]
    for s in node.seq:
        for _, x in sorted(s.kinds.items()):
            out += figures(x)
    return out


def rebuilt(form: list, rows: Iterator[tuple[int, int, int, int, int]]) -> Node:
    node = Node(form[0], *next(rows))
    for many, kinds in form[1]:
        found = [rebuilt(k, rows) for k in kinds]
        node.seq.append(Slot({x.kind: x for x in found}, bool(many)))
    return node


def union(nodes: Iterator[Node]) -> Node:
    """One wrapper for all; streams are aligned one after another."""
    out = next(nodes)
    for x in nodes:
        out.absorb(x)
        if sum(1 for _ in out.walk()) > MOST_NODES:
            simpler(out)
    return out


def decided(root: Node) -> dict:
    """The parts of a wrapper that are main text: kind to what is within; a text is 1. Empty if there are none."""
    varies = root.low != root.high
    weights: dict[int, int] = {}

    def constant(x: Node) -> bool:
        return varies and x.low == x.high and x.n >= LEAST_PAGES and 2 * x.n >= root.n

    def weigh(x: Node) -> int:
        if x.kind.endswith("!"):
            w = 0
        elif x.kind == "#":
            w = 0 if constant(x) or 2 * x.link > x.chars else x.chars
        else:
            w = sum(weigh(k) for s in x.seq for k in s.kinds.values())
        weights[id(x)] = w
        return w

    total = weigh(root)
    kids = lambda x: [k for s in x.seq for k in s.kinds.values() if not k.kind.endswith("!")]

    def scopes(x: Node, tag: str) -> list[Node]:
        return [x] if bare(x.kind) == tag and weights[id(x)] else [y for k in kids(x) for y in scopes(k, tag)]

    chosen: list[Node] = []
    within = False
    for tag in ("article", "main"):
        found = scopes(root, tag)
        if found and 4 * sum(weights[id(x)] for x in found) >= total:
            chosen, within = found, tag == "article"
            break
    if not within:
        inner = []
        for x in chosen or [root]:
            while (best := max(kids(x), key=lambda k: weights[id(k)], default=None)) is not None and bare(best.kind) not in _LEAVES | {"#"} and 5 * weights[id(best)] >= 4 * weights[id(x)] > 0:
                x = best
            inner.append(x)
        chosen = inner
    marked = {id(x) for x in chosen}

    def keep(x: Node, inside: bool, tag: str) -> dict | int:
        if x.kind.endswith("!"):
            return {}
        if x.kind == "#":
            heading = tag in _HEADINGS
            return int(inside and (heading or (not constant(x) and (within or 10 * x.link <= 9 * x.chars))))
        inside = inside or id(x) in marked
        below = {k.kind: keep(k, inside, bare(x.kind)) for k in kids(x)}
        return {k: v for k, v in below.items() if v}

    out = keep(root, False, "")
    return out if isinstance(out, dict) else {}


def main_text(page: Block, parts: dict) -> str:
    """The texts of a page that its host's wrapper calls main, a line a block; if there is none, those that the page's own expression does."""

    def walk(b: Block, part: dict, out: list[str]) -> None:
        for kid in b.kids:
            if kid.tag == "#":
                if part.get("#"):
                    out.append(kid.text)
            elif not _left_out(kid):
                kind = kid.kind.rstrip("!")
                below = part.get(kind) or part.get(bare(kind))
                if below:
                    walk(kid, below, out)

    for known in (parts, None):
        lines: list[str] = []
        walk(page, decided(stream(page)) if known is None else known, lines)
        if lines:
            return "\n".join(lines)
    return ""


FOUND = "host string, sid long, at int, form string, n long, chars long, link long, low long, high long"


def streams(rows: DataFrame) -> DataFrame:
    """(host, sid, form, figures) of all different streams; ``rows`` hold host and html. Equal streams are added up."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[list[int]]] = {}

        def send() -> pa.RecordBatch:
            out: list[tuple] = []
            for (name, form), cells in held.items():
                sid = xxhash.xxh64_intdigest(form) >> 1
                out += [(name, sid, at, form if at == 0 else None, *cell) for at, cell in enumerate(cells)]
            held.clear()
            columns = list(zip(*out, strict=True)) or [()] * 9
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

        for batch in batches:
            for part in slices(batch, "html"):
                for name, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    node = stream(blocks(html or ""), xxhash.xxh64_intdigest(html or "") >> 1)
                    key = (name, json.dumps(shape(node), separators=(",", ":"), ensure_ascii=False))
                    mine = figures(node)
                    before = held.get(key)
                    if before is None:
                        held[key] = [list(x) for x in mine]
                    else:
                        for x, y in zip(before, mine, strict=True):
                            x[0] += y[0]
                            x[1] += y[1]
                            x[2] += y[2]
                            x[3] = min(x[3], y[3])
                            x[4] = max(x[4], y[4])
                    if len(held) >= HELD:
                        yield send()
        yield send()

    cells = rows.select("host", "html").mapInArrow(each, FOUND)
    added = cells.groupBy("host", "sid", "at").agg(F.max("form").alias("form"), *[F.sum(c).alias(c) for c in ("n", "chars", "link")], F.min("low").alias("low"), F.max("high").alias("high"))
    whole = added.groupBy("host", "sid").agg(F.max("form").alias("form"), F.array_sort(F.collect_list(F.struct("at", "n", "chars", "link", "low", "high"))).alias("f"))
    return whole.select("host", "sid", "form", F.transform("f", lambda x: F.array(x.n, x.chars, x.link, x.low, x.high)).alias("figures"))


def wrappers(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(host, parts): for each host the parts of its wrapper that are main text, as JSON."""
    state = stored(streams(rows), "streams")
    most = state.groupBy("host").count().agg(F.max("count").alias("m")).first()["m"] or 1

    def joined(last: bool):
        def merge(group: pa.Table) -> pa.Table:
            found = sorted(zip(group["sid"].to_pylist(), group["form"].to_pylist(), group["figures"].to_pylist(), strict=True))
            node = union(rebuilt(json.loads(form), iter(tuple(x) for x in cells)) for _, form, cells in found)
            name = group["host"].slice(0, 1)
            if last:
                return pa.table({"host": name, "parts": pa.array([json.dumps(decided(node), separators=(",", ":"), ensure_ascii=False)], pa.string())})
            return pa.table({"host": name, "sid": pa.array([found[0][0]], pa.int64()), "form": pa.array([json.dumps(shape(node), separators=(",", ":"), ensure_ascii=False)], pa.string()), "figures": pa.array([[list(x) for x in figures(node)]], pa.list_(pa.list_(pa.int64())))})

        return merge

    while most > fan_in:
        groups = -(-most // fan_in)
        dealt = state.withColumn("bucket", F.pmod(F.xxhash64("sid"), F.lit(groups)))
        after = stored(dealt.groupBy("host", "bucket").applyInArrow(joined(False), "host string, sid long, form string, figures array<array<long>>"), "wrappers")
        discard(state)
        state, most = after, after.groupBy("host").count().agg(F.max("count").alias("m")).first()["m"]
    out = stored(state.groupBy("host").applyInArrow(joined(True), "host string, parts string"), "parts")
    discard(state)
    return out


def extracted(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", fan_in: int = FAN_IN, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(id, url, text, n_chars) of each page.

    Null or empty html gives an empty text. Pages whose URL is null or names no host make one host; repeated
    rows are pages of their own. A page without any part that its host's wrapper calls main is judged alone.
    """
    url = F.col(f"`{url_column}`")
    rows = pages.select(F.col(f"`{id_column}`").alias("page_id"), url.alias("url"), F.coalesce(host(url), F.lit("")).alias("host"), F.col(f"`{html_column}`").alias("html"))
    known = wrappers(rows, fan_in)
    size = known.agg(F.sum(F.octet_length("parts") + F.octet_length("host")).alias("s")).first()["s"] or 0
    sent = rows.sparkSession.sparkContext.broadcast({r["host"]: r["parts"] for r in known.collect()}) if size <= sent_bytes else None
    kind = rows.schema["page_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: OrderedDict[str, dict] = OrderedDict()
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for name, html, own in zip(part["host"].to_pylist(), part["html"].to_pylist(), part["parts"].to_pylist() if sent is None else [None] * part.num_rows, strict=True):
                    if name not in read:
                        read[name] = json.loads((sent.value.get(name) if sent is not None else own) or "{}")
                        if len(read) > 500:
                            read.popitem(last=False)
                    texts.append(main_text(blocks(html or ""), read[name]))
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    whole = rows if sent is not None else rows.join(known, "host", "left").select("page_id", "url", "host", "html", "parts")
    return whole.mapInArrow(each, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
