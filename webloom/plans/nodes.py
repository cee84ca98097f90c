"""Pages as relations: one Arrow pass parses each page once and gives the rows that are asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from webloom.functions.dom import Element, collapsed, is_hidden, parse
from webloom.functions.selectors import compile_selector

NODES = "page_id long, pre int, last int, parent int, depth int, tag string, attrs map<string,string>, text string, hidden boolean"
#: Elements whose collapsed text is kept with their row; that of a container repeats what its parts hold.
TEXT_TAGS = frozenset("title h1 h2 h3 h4 h5 h6 p a li td th caption button label option summary figcaption time".split())
BATCH_ROWS = 4000
#: Rows of a batch that are Python objects at once, and characters read after which what was made of them is handed on.
PIECE_ROWS, PIECE_CHARS = 64, 4 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch a few rows at a time, so that a worker holds few of them as objects, whatever Spark sends at once."""
    for at in range(0, batch.num_rows, PIECE_ROWS):
        yield batch.slice(at, PIECE_ROWS)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a compact table dealt to all cores before pages are made of them: a file that Spark reads as one task may hold millions."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def per_page(pages: DataFrame, kernel: Callable[[Element, str], list[dict]], columns: str, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Rows of a kernel over each parsed page, beside the page's key. Only key, URL and HTML travel to Python; null HTML is an empty page."""
    kind = pages.schema[key].dataType.simpleString()
    schema: StructType = _parse_datatype_string(f"`{key}` {kind}, {columns}")  # type: ignore[assignment]
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema.fields][1:]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        chars = 0
        for batch in batches:
            for piece in pieces(batch):
                for ident, markup, address in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    out += [{key: ident, **{n: row.get(n) for n in names}} for row in kernel(parse(markup or ""), address or "")]
                    chars += len(markup or "")
                    if len(out) >= BATCH_ROWS or chars >= PIECE_CHARS:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, chars = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return pages.select(key, html, F.col(url) if url in pages.columns else F.lit("").alias(url)).mapInArrow(each, schema)


def _rows(root: Element, url: str) -> list[dict]:
    inside = -1
    out = []
    for e in root.elements():
        if is_hidden(e):
            inside = max(inside, e.last)
        out.append({"pre": e.pre, "last": e.last, "parent": e.parent.pre if e.parent else None, "depth": e.depth, "tag": e.tag, "attrs": list(e.attrs.items()), "text": collapsed(e) if e.tag in TEXT_TAGS else None, "hidden": e.pre <= inside})
    return out


def nodes(pages: DataFrame) -> DataFrame:
    """A row for each element: interval [pre, last] of document order, parent, depth, tag, attributes, own text, hidden or not."""
    return per_page(pages, _rows, NODES.partition(", ")[2])


def nth_of_type(n: DataFrame) -> DataFrame:
    """Nodes with their place among siblings of the same tag, as a window."""
    from pyspark.sql.window import Window

    return n.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "parent", "tag").orderBy("pre")))


def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(page_id, pre, outer_pre): the innermost node of ``outer`` around each of ``inner`` (those without one are left out).

    One shuffle by page and one sorted pass over both: intervals nest, so a stack of the outer ones that are still open has
    the innermost on top. A task holds that stack only.
    """
    kind = inner.schema["page_id"].dataType.simpleString()
    # an outer node opens behind an inner one of the same place: nothing is within itself
    events = inner.select("page_id", "pre", F.lit(-1).alias("last")).union(outer.select("page_id", "pre", "last"))
    order = events.repartition("page_id").sortWithinPartitions("page_id", "pre", "last")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, stack = None, []
        for batch in batches:
            out: list[tuple] = []
            for ident, pre, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ident != page:
                    page, stack = ident, []
                while stack and stack[-1][1] < pre:
                    stack.pop()
                if last >= 0:
                    stack.append((pre, last))
                elif stack:
                    out.append((ident, pre, stack[-1][0]))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["page_id", "pre", "outer_pre"])

    return order.mapInArrow(each, f"page_id {kind}, pre int, outer_pre int")


def innermost(pages: DataFrame, inner: str, outer: str) -> DataFrame:
    """(page_id, pre, tag, outer_pre, outer_tag) of all elements that one selector finds, with the innermost one that another finds around it (null: none).

    Each page is parsed once and swept once, in document order; nothing is shuffled.
    """
    compile_selector(inner), compile_selector(outer)  # a selector that cannot be read is an error before any page is

    def kernel(root: Element, url: str) -> list[dict]:
        is_inner, is_outer, stack, out = compile_selector(inner), compile_selector(outer), [], []
        for e in root.elements():
            while stack and stack[-1].last < e.pre:
                stack.pop()
            if is_inner(e):
                out.append({"pre": e.pre, "tag": e.tag, "outer_pre": stack[-1].pre if stack else None, "outer_tag": stack[-1].tag if stack else None})
            if is_outer(e):
                stack.append(e)
        return out

    return per_page(pages, kernel, "pre int, tag string, outer_pre int, outer_tag string")
