"""Page operators: each a DataFrame of (page_id, url, html) in, rows out."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import dom, extract, reduce, text
from webloom.plans.nodes import per_page, pieces

_META = ("title", "description", "site_name", "lang", "canonical", "image", "author", "published", "modified", "theme_color", "twitter_card", "twitter_site", "favicon")
_FIELD = "array<struct<name:string,type:string,value:string,placeholder:string,required:boolean,disabled:boolean,checked:string,options:array<string>,id:string>>"


def metadata(pages: DataFrame) -> DataFrame:
    return per_page(pages, lambda r, u: [extract.metadata(r, u)], ", ".join(f"{m} string" for m in _META))


def links(pages: DataFrame) -> DataFrame:
    return per_page(pages, extract.links, "pre int, text string, href string, rel string, internal boolean")


def filtered_links(found: DataFrame, query: str = "", internal_only: bool = False) -> DataFrame:
    """Links whose text or address holds the query, whatever its case."""
    q = F.lit(query.lower())
    keep = F.contains(F.lower("text"), q) | F.contains(F.lower("href"), q)
    return found.where(keep & (F.col("internal") | F.lit(not internal_only)))


#: Rows of a page by default and at most, by what they are. Fixed values.
LIMITS = {"links": (200, 1000), "forms": (100, 100), "controls": (300, 300), "records": (50, 200)}


def limited(found: DataFrame, what: str, limit: int | None = None, order: str = "pre") -> DataFrame:
    """The first rows of each page, with ``total`` (rows before the cut) and ``truncated``.

    A limit below 1 or none is the default, one above the ceiling the ceiling. One shuffle by page serves both.
    """
    usual, most = LIMITS[what]
    n = min(limit, most) if limit and limit > 0 else usual
    page = Window.partitionBy("page_id")
    rows = found.withColumn("total", F.count(F.lit(1)).over(page)).withColumn("_place", F.row_number().over(page.orderBy(order)))
    return rows.where(F.col("_place") <= n).withColumn("truncated", F.col("total") > n).drop("_place")


def images(pages: DataFrame) -> DataFrame:
    return per_page(pages, extract.images, "pre int, alt string, src string")


def headings(pages: DataFrame) -> DataFrame:
    return per_page(pages, lambda r, u: extract.headings(r), "pre int, level int, text string, id string")


def outline(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Outlines of pages, whole unless a caller wants ``most`` bytes."""
    return per_page(pages, lambda r, u: [{"outline": extract.outline(r) if most is None else extract.capped_outline(extract.outline(r), most)}], "outline string")


def has_hidden(pages: DataFrame) -> DataFrame:
    """Whether a page has an element that is hidden; ends at the first one."""
    return per_page(pages, lambda r, u: [{"has_hidden": any(dom.is_hidden(e) for e in r.elements())}], "has_hidden boolean")


def forms(pages: DataFrame, *asked: str) -> DataFrame:
    """All forms with all their fields; what is known of each field, or only what is asked for of it (without ``id``, none is worked out)."""
    known = dict(x.split(":", 1) for x in _FIELD.removeprefix("array<struct<").removesuffix(">>").split(","))
    kind = f"array<struct<{','.join(f'{c}:{known[c]}' for c in asked)}>>" if asked else _FIELD

    def kernel(r: dom.Element, u: str) -> list[dict]:
        found = extract.forms(r, u, not asked or "id" in asked)
        return [{**x, "fields": [{c: f[c] for c in asked} for f in x["fields"]]} for x in found] if asked else found

    return per_page(pages, kernel, f"pre int, id string, name string, action string, method string, enctype string, fields {kind}")


def controls(pages: DataFrame) -> DataFrame:
    return per_page(pages, extract.controls, "pre int, text string, kind string, role string, id string, selector string, disabled boolean, required boolean, checked string, expanded string, pressed string, selected string, invalid boolean, value string, placeholder string, href string")


def regions(pages: DataFrame) -> DataFrame:
    return per_page(pages, extract.regions, "pre int, last int, role string, label string, id string, links int, forms int, headings int, controls int")


def tables(pages: DataFrame) -> DataFrame:
    return per_page(pages, lambda r, u: extract.tables(r), "pre int, caption string, headers array<string>, rows array<array<string>>, truncated boolean")


def json_ld(pages: DataFrame) -> DataFrame:
    """Items as JSON text; ``parse_json`` makes a variant of it."""
    return per_page(pages, lambda r, u: [{"place": i, "item": json.dumps(x, ensure_ascii=False)} for i, x in enumerate(extract.json_ld(r))], "place int, item string")


def microdata(pages: DataFrame) -> DataFrame:
    return per_page(pages, lambda r, u: [{"place": i, "type": x["type"], "properties": json.dumps(x["properties"], ensure_ascii=False)} for i, x in enumerate(extract.microdata(r, u))], "place int, type string, properties string")


#: What one answer to a caller holds of a page at most, for those who ask for it; ``rows`` are those of a table. Fixed values.
ANSWER = {"tables": 64, "rows": 2000, "jsonld": 256, "microdata": 128, "regions": 64, "headings": 200, "collections": 4}
#: Structured data of a page by what it is, each a list of items: all of them, or as many as a caller asks for.
DATA = {
    "tables": lambda r, u, most: [{k: v for k, v in t.items() if k != "pre"} for t in extract.tables(r, most.get("tables"), most.get("rows"))],
    "jsonld": lambda r, u, most: extract.json_ld(r, most.get("jsonld")), "microdata": lambda r, u, most: extract.microdata(r, u, most.get("microdata")),
}


def data(pages: DataFrame, kind: str = "", most: dict[str, int] | None = None) -> DataFrame:
    """(page_id, kind, place, item): all structured data of pages as JSON, or that of one kind (tables, jsonld, microdata); one parse a page.

    Nothing is left out unless ``most`` says how many of a kind (and ``rows`` of a table) the caller wants, such as ``ANSWER``.
    """
    if kind and kind not in DATA:
        raise ValueError(f"kind is one of {', '.join(DATA)}, not {kind!r}")
    asked, wanted = [kind] if kind else list(DATA), most or {}
    return per_page(pages, lambda r, u: [{"kind": k, "place": i, "item": json.dumps(x, ensure_ascii=False)} for k in asked for i, x in enumerate(DATA[k](r, u, wanted))], "kind string, place int, item string")


def records(pages: DataFrame, root: str, fields: dict[str, str], limit: int = 50) -> DataFrame:
    """Records by a caller's selectors; a field that has no match is missing from the map."""
    from webloom.functions.selectors import compile_selector

    for css in [root, *(f.partition("@")[0] for f in fields.values())]:
        if css.strip():
            compile_selector(css)  # a selector that cannot be read is an error before any page is
    return per_page(pages, lambda r, u: [{"place": i, "record": list(x.items())} for i, x in enumerate(extract.records(r, root, fields, limit))], "place int, record map<string,string>")


def limited_records(pages: DataFrame, root: str, fields: dict[str, str], limit: int = 0) -> DataFrame:
    """The first records of each page with ``total`` (matches on the page) and ``truncated``; a page is cut as it is read, so no more rows leave it."""
    from webloom.functions.selectors import compile_selector
    from webloom.functions.selectors import select as matches

    for css in [root, *(f.partition("@")[0] for f in fields.values())]:
        if css.strip():
            compile_selector(css)
    usual, most = LIMITS["records"]
    n = min(limit, most) if limit > 0 else usual

    def kernel(r: dom.Element, u: str) -> list[dict]:
        total = len(matches(r, root)) if root.strip() else 1
        return [{"place": i, "record": list(x.items()), "total": total, "truncated": total > n} for i, x in enumerate(extract.records(r, root, fields, n))]

    return per_page(pages, kernel, "place int, record map<string,string>, total long, truncated boolean")


def collections(pages: DataFrame) -> DataFrame:
    return per_page(pages, lambda r, u: [{"place": i, "root": c["root"], "count": c["count"], "region": c["region"], "fields": list(c["fields"].items())} for i, c in enumerate(extract.collections(r))], "place int, root string, count int, region string, fields map<string,string>")


def find(pages: DataFrame, query: str, most: int = 10) -> DataFrame:
    return per_page(pages, lambda r, u: extract.find(r, query, min(most, 100)), "index int, snippet string, heading_path string")


def duplicate_blocks(pages: DataFrame) -> DataFrame:
    return per_page(pages, lambda r, u: [{"pre": e.pre, "tag": e.tag, "links": sum(x.tag == "a" for x in e.elements())} for e in extract.duplicate_blocks(r)], "pre int, tag string, links int")


def select(pages: DataFrame, selector: str, most: int = 256) -> DataFrame:
    """Outer HTML of what a selector finds."""
    from webloom.functions.selectors import compile_selector
    from webloom.functions.selectors import select as matches

    compile_selector(selector)
    return per_page(pages, lambda r, u: [{"pre": e.pre, "tag": e.tag, "html": dom.serialise(e), "selector": extract.selector_of(r, e)} for e in matches(r, selector)[:most]], "pre int, tag string, html string, selector string")


def visible_text(pages: DataFrame, skip_hidden: bool = True) -> DataFrame:
    return per_page(pages, lambda r, u: [{"text": dom.visible(r, skip_hidden)}], "text string")


def stripped(pages: DataFrame) -> DataFrame:
    """How much hiding takes away: elements and comments before and after."""

    def kernel(r: dom.Element, u: str) -> list[dict]:
        count = lambda x: sum(isinstance(c, dom.Comment) for e in x.elements() for c in e.children)
        after = dom.without(r, dom.is_hidden)
        return [{"elements": r.last + 1, "kept": after.last + 1, "comments": count(r), "comments_kept": count(after)}]

    return per_page(pages, kernel, "elements int, kept int, comments int, comments_kept int")


def read(pages: DataFrame, mode: str = "article", form: str = "markdown", safe: bool = True) -> DataFrame:
    """Pages as Markdown or text, with a token estimate."""
    out = per_page(pages, lambda r, u: [reduce.read(r, u, mode, form, safe)], "title string, source string, content string")
    return out.withColumn("tokens", text.estimate_column(F.col("content")))


#: Tokens of a chunk by default and at most. Fixed values.
READ_TOKENS, MOST_READ_TOKENS = 6000, 24_000


def read_chunk(pages: DataFrame, mode: str = "article", form: str = "markdown", selector: str = "", max_tokens: int = 0, cursor: str = "") -> DataFrame:
    """One chunk of each page as a reader asks for it: title, chunk, chunks, content, next_cursor, error.

    ``form`` is markdown, text or raw_html; a selector limits the reading to what it finds. A cursor names a chunk of one content:
    where the page's content is another one, or has no such chunk, ``error`` says so and nothing else is there.
    """
    from webloom.functions.selectors import compile_selector
    from webloom.functions.selectors import select as matches

    budget = min(max_tokens, MOST_READ_TOKENS) if max_tokens > 0 else READ_TOKENS
    at = text.decode_cursor(cursor) if cursor else None
    if cursor and at is None:
        raise ValueError("no cursor")
    if selector:
        compile_selector(selector)

    def kernel(root: dom.Element, url: str) -> list[dict]:
        title = extract.metadata(root, url)["title"]
        if selector:
            found = matches(root, selector)
            top = [e for e in found if not any(a in found for a in e.above())]
            if not top:
                return [{"error": "nothing matches the selector"}]
            markup = "\n".join(dom.serialise(e) for e in top)
            inner = dom.parse(markup)
        else:
            markup, inner = dom.serialise(root), root
        content = markup if form == "raw_html" else reduce.read(inner, url, "full" if selector else mode, form)["content"]
        parts, mark = text.paginate(content, budget), text.fingerprint(content)
        if at and at[0] != mark:
            return [{"error": "the page has changed since the cursor was given"}]
        index = at[1] if at else 0
        if index >= len(parts):
            return [{"error": "no such chunk"}]
        return [{"title": title, "chunk": index, "chunks": len(parts), "content": parts[index], "next_cursor": text.encode_cursor(mark, index + 1) if index + 1 < len(parts) else None}]

    return per_page(pages, kernel, "title string, chunk int, chunks int, content string, next_cursor string, error string")


def paginated(texts: DataFrame, budget: int, key: str = "page_id", column: str = "content", cost_of: Callable[[str], int] = text.estimate) -> DataFrame:
    """Chunks within a token budget, each with the cursor of the next. ``cost_of`` is the estimator of tokens, any function of a text."""
    kind = texts.schema[key].dataType.simpleString()
    from collections.abc import Iterator

    import pyarrow as pa

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            ids, index, chunks, total, cursor = [], [], [], [], []
            for ident, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts, mark = text.paginate(content or "", budget, cost_of), text.fingerprint(content or "")
                for i, part in enumerate(parts):
                    ids.append(ident)
                    index.append(i)
                    chunks.append(part)
                    total.append(len(parts))
                    cursor.append(text.encode_cursor(mark, i + 1) if i + 1 < len(parts) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(chunks, pa.string()), pa.array(cursor, pa.string())], names=[key, "chunk", "chunks", "content", "next_cursor"])

    return texts.select(key, column).mapInArrow(each, f"`{key}` {kind}, chunk int, chunks int, content string, next_cursor string")


#: What browsing counts, each by what has to be found out for it alone.
COUNTS = {
    "links": lambda r, u: len(extract.links(r, u)), "headings": lambda r, u: sum(1 for e in r.elements() if extract.is_heading(e)), "forms": lambda r, u: sum(e.tag == "form" for e in r.elements()),
    "controls": lambda r, u: sum(1 for e in r.elements() if extract.is_control(e)), "images": lambda r, u: len(extract.images(r, u)), "tables": lambda r, u: len(extract.tables(r)),
    "regions": lambda r, u: len(extract.regions(r, u)), "structured": lambda r, u: len(extract.json_ld(r)) + len(extract.microdata(r, u)),
}
_SAID = {
    "title": lambda r, u: extract.title_of(r), "lang": lambda r, u: r.get("lang").strip(), "url": lambda r, u: u,
    "excerpt": lambda r, u: extract.metadata(r, u)["description"] or extract.excerpt(r),
}


def summary(pages: DataFrame, *columns: str) -> DataFrame:
    """What browsing shows: counts of each kind beside title and excerpt (or only the columns asked for), one parse a page, nothing found out that no column needs."""
    made = _SAID | COUNTS
    asked = columns or tuple(c for c in made if c != "url")
    return per_page(pages, lambda r, u: [{c: made[c](r, u) for c in asked}], ", ".join(f"{c} {'int' if c in COUNTS else 'string'}" for c in asked))


_HEAD = ("canonical", "image", "author", "published", "modified", "favicon", "theme_color", "twitter_card", "twitter_site")


def browse(pages: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """One row a page for finding one's way: title, metadata (null if there is none at all), counts, all regions, headings and collections as lists, and the whole outline.

    Lists are whole unless ``most`` says how many regions, headings or collections the caller wants, such as ``ANSWER``.
    """
    wanted = most or {}

    def kernel(r: dom.Element, u: str) -> list[dict]:
        meta, found = extract.metadata(r, u), extract.Minted(r, u)
        head = {k: meta[k] for k in _HEAD}
        regions = [{k: v for k, v in x.items() if k not in ("pre", "last")} for x in found.regions()[: wanted.get("regions")]]
        groups = [{**x, "fields": list(x["fields"].items())} for x in extract.collections(r, wanted.get("collections"))]
        counts = {"links": len(extract.links(r, u)), "forms": len(found.forms), "images": len(extract.images(r, u)), "headings": len(found.headings), "controls": len(found.controls)}
        return [{
            "title": meta["title"], "description": meta["description"], "site_name": meta["site_name"], "lang": meta["lang"], "metadata": head if any(head.values()) else None, "counts": counts, "regions": regions,
            "headings": [{k: h[k] for k in ("level", "text", "id")} for h in found.headings[: wanted.get("headings")]], "collections": groups, "excerpt": meta["description"] or extract.excerpt(r), "outline": extract.outline(r),
        }]

    counts = ",".join(f"{c}:int" for c in ("links", "forms", "images", "headings", "controls"))
    return per_page(
        pages, kernel, "title string, description string, site_name string, lang string, metadata struct<" + ",".join(f"{c}:string" for c in _HEAD) + f">, counts struct<{counts}>, "
        "regions array<struct<role:string,label:string,id:string,links:int,forms:int,headings:int,controls:int>>, headings array<struct<level:int,text:string,id:string>>, "
        "collections array<struct<root:string,count:int,region:string,fields:map<string,string>>>, excerpt string, outline string",
    )


def outlined(pages: DataFrame) -> DataFrame:
    """Headings, each beside its page's whole outline; one parse a page. A page's outline leaves Python once and is put beside its headings row by row."""

    def kernel(r: dom.Element, u: str) -> list[dict]:
        return [{"outline": extract.outline(r), "headings": extract.headings(r, u)}]

    found = per_page(pages, kernel, "outline string, headings array<struct<pre:int,level:int,text:string,id:string>>")
    return found.select("page_id", "outline", F.inline("headings")).select("page_id", "pre", "level", "text", "id", "outline")
