"""Source texts as relations: sitemaps, robots files, feeds, search answers, classification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from webloom.functions.dom import truncated
from webloom.plans.nodes import pieces
from webloom.sources import content

MOST_ERROR = 300


def per_text(df: DataFrame, kernel: Callable[..., list[dict]], columns: str, key: str, *inputs: str) -> DataFrame:
    """What the kernel makes of each row, with ``error``: null, or why a row's text cannot be read (then nothing else is there). One bad text ends no job."""
    columns += ", error string"
    kind = df.schema[key].dataType.simpleString()
    arrow = to_arrow_schema(_parse_datatype_string(f"`{key}` {kind}, {columns}"))

    def told(values: list) -> list[dict]:
        try:
            return kernel(*values)
        except (ValueError, TypeError, AttributeError, LookupError, ArithmeticError, OSError, EOFError, RecursionError) as e:
            return [{"error": truncated(f"{type(e).__name__}: {e}", MOST_ERROR)}]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            rows = [{key: ident, **row} for ident, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in told(values)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.select(key, *inputs).mapInArrow(each, f"`{key}` {kind}, {columns}")


def sitemap_locs(df: DataFrame, key: str, raw: str) -> DataFrame:
    def kernel(xml: str) -> list[dict]:
        kind, found = content.sitemap((xml or "").encode())
        return [{"kind": kind, "place": i, "loc": loc, "lastmod": mod} for i, (loc, mod) in enumerate(found)]

    return per_text(df, kernel, "kind string, place int, loc string, lastmod string", key, raw)


def robots_rules(df: DataFrame, key: str, raw: str) -> DataFrame:
    """Rules for any agent, each with the regular expression that its pattern stands for."""
    return per_text(df, lambda t: [{"pattern": p, "allow": a, "regex": content.robots_regex(p)} for p, a in content.star_rules(content.robots(t or ""))], "pattern string, allow boolean, regex string", key, raw)


def feed_items(df: DataFrame, key: str, raw: str) -> DataFrame:
    return per_text(df, lambda t: [{"feed": f["title"], "place": i, **x} for f in [content.feed(t or "")] if f for i, x in enumerate(f["items"])], "feed string, place int, title string, link string, date string, summary string", key, raw)


def search_results(df: DataFrame, key: str, raw: str, count: int = 10) -> DataFrame:
    return per_text(df, lambda t: [{"place": i, **x} for i, x in enumerate(content.search_results(t or "", count))], "place int, title string, url string, snippet string", key, raw)


def kinds(df: DataFrame, key: str, content_type: str, raw: str) -> DataFrame:
    return per_text(df, lambda c, r: [{"kind": content.classify(c or "", r.encode() if isinstance(r, str) else bytes(r or b""))}], "kind string", key, content_type, raw).drop("error")  # any bytes have a kind
