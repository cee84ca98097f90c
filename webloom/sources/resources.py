"""Fetched resources as a relation: what status, headers and bytes of a log row say.

Everything is a column of built-in functions, but for inflating and decoding bytes, which are Arrow passes over each row alone.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import estimate_column
from webloom.plans.nodes import PIECE_ROWS

MOST_BYTES = 10 << 20
MOST_RETRY_MS = 30_000
MOST_BACKOFF_MS = 5_000
# Statuses worth another attempt.
RETRY_STATUS = (429, 500, 502, 503, 504)
# Media types by the label of a resource, matched from their start.
LABELS = {
    "html": r"text/html$|application/xhtml\+xml$",
    "css": r"text/css$",
    "images": r"image/",
    "media": r"audio/|video/|application/ogg$",
    "fonts": r"font/|application/font-woff2?$|application/vnd\.ms-fontobject$|application/x-font-(?:ttf|otf|woff)$",
    "js": r"(?:application|text)/(?:java|ecma)script$|application/x-javascript$|application/mjs$",
}


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def resource_label(kind: Column, content_type: Column, url: Column) -> Column:
    """html, css, images, media, fonts, js, xhr, websocket or other; a socket's address and a script's request outrank the media type."""
    out = F.when(url.rlike("(?i)^wss?://"), "websocket").when(kind == "script", "js")
    for label, pattern in LABELS.items():
        out = out.when(media_type(content_type).rlike(f"^(?:{pattern})"), label)
    return out.when(kind == "xmlhttprequest", "xhr").otherwise("other")


#: The largest part of a delay that is added to it. Fixed value.
JITTER = 0.2


def may_retry(status: Column, attempt: Column, most: int = 2) -> Column:
    """A null status is a network error, which is final."""
    return F.coalesce(status.isin(*RETRY_STATUS) & (attempt < most), F.lit(False))


def jitter_ms(delay: Column, seed: Column) -> Column:
    """Up to a fifth of a delay, spread by the seed's hash, so that many clients do not come back at once; the same seed waits the same time."""
    part = F.conv(F.substring(F.md5(seed.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return F.floor(delay * JITTER * part).cast("long")


def retry_delay_ms(attempt: Column, retry_after: Column, now: Column, seed: Column | None = None) -> Column:
    """What the server asks for (seconds or a date ahead), up to 30 s; else a doubling delay up to 5 s, and with a seed its jitter."""
    asked = F.trim(retry_after)
    whole = F.when(asked.rlike("^[0-9]{1,9}$"), asked.cast("long") * 1000)
    date = F.try_to_timestamp(F.regexp_extract(asked, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    ahead = F.unix_millis(date) - F.unix_millis(now)
    own = F.least(F.lit(300).cast("long") * F.pow(F.lit(2), F.least(attempt, F.lit(20))).cast("long"), F.lit(MOST_BACKOFF_MS).cast("long"))
    own = own if seed is None else own + jitter_ms(own, seed)
    return F.coalesce(F.when(whole.isNotNull(), F.least(whole, F.lit(MOST_RETRY_MS).cast("long"))), F.when(ahead > 0, F.least(ahead, F.lit(MOST_RETRY_MS).cast("long"))), own)


def size_error(raw: Column, most: int = MOST_BYTES) -> Column:
    """Null, or why a body is not taken."""
    return F.when(F.octet_length(raw) > most, F.lit(f"response exceeds {most} bytes"))


def inflated_bytes(encoding: str | None, raw: bytes | None, most: int = MOST_BYTES) -> tuple[bytes | None, str | None]:
    """The body without its content coding, and an error in place of it; no more than ``most`` bytes and one are inflated."""
    name = (encoding or "").strip().lower()
    if raw is None or name in ("", "identity"):
        return (raw, None) if raw is None or len(raw) <= most else (None, f"response exceeds {most} bytes")
    windows = {"gzip": [zlib.MAX_WBITS | 16], "x-gzip": [zlib.MAX_WBITS | 16], "deflate": [zlib.MAX_WBITS, -zlib.MAX_WBITS]}.get(name)
    if windows is None:
        return None, f"content encoding {name} is unknown"
    for bits in windows:
        try:
            tool = zlib.decompressobj(bits)
            body = tool.decompress(raw, most + 1)
            if len(body) > most:
                return None, f"response exceeds {most} bytes"
            return (body, None) if tool.eof else (None, f"{name} body is cut short")
        except zlib.error:
            continue
    return None, f"{name} body cannot be read"


def _pieces(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[tuple[list, ...]]:
    """Columns as lists, a few rows at a time, whatever Spark sends at once."""
    for columns in batches:
        for at in range(0, len(columns[0]), PIECE_ROWS):
            yield tuple(c.slice(at, PIECE_ROWS).to_pylist() for c in columns)


def inflated(encoding: Column, raw: Column, most: int = MOST_BYTES) -> Column:
    """struct(body, error)."""

    @F.arrow_udf("body binary, error string")
    def each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, bodies in _pieces(batches):
            made = [inflated_bytes(n, b, most) for n, b in zip(names, bodies, strict=True)]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in made], pa.binary()), pa.array([x[1] for x in made], pa.string())], ["body", "error"])

    return each(encoding, raw)


_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_NAMED = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_TEXTUAL = re.compile(r"text/|[^;]*\+(?:json|xml)$|application/(?:json|xml|javascript|ecmascript)$")


def decoded_text(content_type: str | None, raw: bytes | None) -> str | None:
    """Text of a textual body: by its byte order mark, its header, its first kilobyte, UTF-8 if it is that, else Windows-1252. Null for binary bodies."""
    if raw is None:
        return None
    kind = (content_type or "").split(";")[0].strip().lower()
    generic = kind in ("", "application/octet-stream")
    if raw.startswith((b"%PDF-", b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"\x1f\x8b", b"PK\x03\x04")) or (generic and b"\0" in raw[:512]) or not (generic or _TEXTUAL.match(kind)):
        return None
    for mark, name in _BOMS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    for told in (content_type or "", raw[:1024].decode("latin-1")):
        if m := _NAMED.search(told):
            # what names Latin-1 on the web is read as Windows-1252
            name = {"iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252"}.get(m[1].lower(), m[1])
            try:
                return raw.decode(name, "replace")
            except LookupError:
                continue
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def decoded(content_type: Column, raw: Column) -> Column:
    @F.arrow_udf("string")
    def each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, bodies in _pieces(batches):
            yield pa.array([decoded_text(k, b) for k, b in zip(kinds, bodies, strict=True)], pa.string())

    return each(content_type, raw)


def conditional(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with ``not_modified``: whether the cached row of the URL has the server's etag, or without one its date. One equi-join; a URL is once in the cache."""
    held = cache.select("url", F.col("etag").alias("_etag"), F.col("last_modified").alias("_date"))
    same = F.when(F.coalesce("_etag", F.lit("")) != "", F.col("_etag") == F.col("etag")).otherwise(F.col("_date") == F.col("last_modified"))
    return requests.join(held, "url", "left").withColumn("not_modified", F.coalesce(same, F.lit(False))).drop("_etag", "_date")


def upgraded_title(found: Column, url: Column) -> Column:
    """The converter's title, or the last part of the address."""
    last = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*)?/([^/?#]+)/?(?:[?#]|$)", 1)
    return F.coalesce(F.nullif(F.trim(found), F.lit("")), F.nullif(last, F.lit("")), url)


#: What is added to an error that may pass by itself. Fixed value.
RETRY_HINT = "\n(transient: retrying the same call may succeed)"


def error_line(code: Column, message: Column, retry: Column) -> Column:
    return F.concat(F.format_string("error [%s]: %s", code, message), F.when(retry, F.lit(RETRY_HINT)).otherwise(F.lit("")))


def capped_errors(errors: Column, most: int = 5, runes: int = 300) -> Column:
    """The first errors, each cut, and how many more there are."""
    cut = F.transform(F.slice(errors, 1, most), lambda e: F.when(F.char_length(e) > runes, F.concat(F.substring(e, 1, runes), F.lit("…"))).otherwise(e))
    more = F.size(errors) - most
    return F.when(more > 0, F.concat(cut, F.array(F.format_string("… (%d more)", more)))).otherwise(cut)


# Sites --------------------------------------------------------------------------------------------


def is_markup(content_type: Column, body: Column) -> Column:
    """Whether a body is an HTML or XML shell, whatever path it was served for."""
    return F.lower(F.coalesce(content_type, F.lit(""))).contains("text/html") | F.ltrim(F.substring(body, 1, 512)).rlike(r"(?i)^(?:<!doctype html|<html|<\?xml)")


def _plain(content_type: Column) -> Column:
    return F.lower(F.coalesce(content_type, F.lit(""))).rlike("text/(?:plain|markdown|x-markdown)")


def is_robots(content_type: Column, body: Column) -> Column:
    return ~is_markup(content_type, body) & (_plain(content_type) | body.rlike(r"(?im)^[ \t]*(?:user-agent|sitemap)[ \t]*:"))


def is_llms(content_type: Column, body: Column) -> Column:
    return ~is_markup(content_type, body) & (_plain(content_type) | body.rlike(r"^\s*[#>-]"))


def llms_title(body: Column) -> Column:
    """The first level-one heading among the first 32 lines."""
    heads = F.filter(F.transform(F.slice(F.split(body, "\n"), 1, 32), lambda line: F.trim(line)), lambda line: F.startswith(line, F.lit("# ")))
    return F.coalesce(F.trim(F.substring(F.get(heads, F.lit(0)), 3, 1 << 30)), F.lit(""))


def site(resources: DataFrame, llms_tokens: int = 2000) -> DataFrame:
    """A row an origin from (origin, path, status, content_type, body as text): what its robots and llms files say.

    One aggregation; both files of an origin are two rows, so no group is large. A missing file or a shell gives false and empty values.
    """
    ok, kind, body = F.col("status").between(200, 299), F.col("content_type"), F.coalesce("body", F.lit(""))
    robots = F.when(ok & (F.col("path") == "/robots.txt") & is_robots(kind, body), body)
    llms = F.when(ok & (F.col("path") == "/llms.txt") & is_llms(kind, body), body)
    found = resources.where(F.col("path").isin("/robots.txt", "/llms.txt")).groupBy("origin").agg(F.max(robots).alias("_robots"), F.max(llms).alias("_llms"))
    maps = F.regexp_extract_all(F.coalesce("_robots", F.lit("")), F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), F.lit(1))
    text = F.coalesce("_llms", F.lit(""))
    head = F.substring(text, 1, llms_tokens * 4)
    whole = F.regexp_extract(head, r"(?s)^(.+)\n", 1)
    long = estimate_column(text) > llms_tokens
    cut = F.when(long, F.concat(F.rtrim(F.when(whole != "", whole).otherwise(head), F.lit("\n")), F.lit("\n\n…(content truncated)\n"))).otherwise(text)
    return found.select("origin", F.col("_robots").isNotNull().alias("robots"), maps.alias("sitemaps"), F.col("_llms").isNotNull().alias("llms"), llms_title(text).alias("llms_title"), cut.alias("llms_text"), long.alias("llms_truncated"))
