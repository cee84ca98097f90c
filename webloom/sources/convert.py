"""Fetched bodies of any kind as Markdown: one converter a kind, chosen by type and first bytes."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.functions import dom, reduce
from webloom.functions.text import fence
from webloom.sources import content
from webloom.sources.resources import decoded_text

_JSON = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def indented(raw: str) -> str:
    """JSON with two spaces a level: numbers, escapes, order and repeated keys stay as they are. ``ValueError`` if it is none."""
    json.loads(raw, parse_constant=_no_constant)
    out: list[str] = []
    depth, before = 0, ""
    for token in _JSON.findall(raw):
        if token in "}]":
            depth -= 1
            if before not in ("{", "["):
                out.append("\n" + "  " * depth)
        elif before in ("{", "[", ","):
            out.append("\n" + "  " * depth)
        out.append(token + " " if token == ":" else token)
        depth += token in ("{", "[")
        before = token
    return "".join(out)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def file_name(url: str) -> str:
    """The last part of an address's path, "" if there is none."""
    try:
        name = posixpath.basename(unquote(urlsplit(url).path).rstrip("/"))
    except ValueError:
        return ""
    return "" if name in (".", "/") else name


def block(text: str, language: str = "") -> str:
    return fence(text, language) + "\n"


def json_block(text: str) -> str:
    """Indented JSON in a fence; what is none, as text."""
    try:
        return block(indented(text), "json")
    except (ValueError, RecursionError):
        return block(text)


# What is said of content that is no text -----------------------------------------------------


def binary_note(name: str, content_type: str, size: int) -> str:
    lines = ["**Binary content**", ""] + [f"- name: {name}"] * bool(name) + [f"- type: `{content_type}`"] * bool(content_type)
    return "\n".join([*lines, f"- bytes: {size}", "", "_This content is not text-extractable._"]) + "\n"


def image_note(name: str, content_type: str, raw: bytes) -> str:
    found = content.image_size(raw)
    kind = content_type.strip() or (found[0].removeprefix("image/") if found else "")
    lines = ["**Image**", ""] + [f"- filename: {name}"] * bool(name) + [f"- type: `{kind}`"] * bool(kind)
    return "\n".join([*lines, f"- dimensions: {found[1]}×{found[2]}" if found else "- dimensions: unknown", f"- bytes: {len(raw)}", "", "_Pass include_bytes=true to retrieve the raw image._"]) + "\n"


# -----------------------------------------------------------------------------------------------------------


def convert(url: str, content_type: str, raw: bytes) -> tuple[str, str, str]:
    """(kind, title, Markdown) of a body. A feed or JSON that can't be read is text; of a PDF, and of bytes that are no text, is told what they are."""
    kind, name = content.classify(content_type, raw), file_name(url)
    if kind in ("json", "text", "feed", "html"):
        text = decoded_text(content_type, raw) or raw.decode("utf-8", "replace")
        if kind == "html":
            page = reduce.read(dom.parse(text), url)
            return kind, page["title"] or name, page["content"]
        if kind == "json":
            return kind, name, json_block(text)
        if kind == "feed":
            try:
                found = content.feed(text)
            except ValueError:
                found = None
            if found:
                return kind, found["title"] or name, content.feed_markdown(found)
        return kind, name, block(text)
    return kind, name, image_note(name, content_type, raw) if kind == "image" else binary_note(name, content_type, len(raw))


def converted(resources: DataFrame, key: str = "id") -> DataFrame:
    """(key, kind, title, content) of fetched bodies (key, url, content_type, body). A null body is empty; each body is converted once, in Arrow batches."""
    kind = resources.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [convert(u or "", t or "", b or b"") for u, t, b in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            kinds, titles, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(titles, pa.string()), pa.array(texts, pa.string())], names=[key, "kind", "title", "content"])

    return resources.select(key, "url", "content_type", "body").mapInArrow(each, f"`{key}` {kind}, kind string, title string, content string")
