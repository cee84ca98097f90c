"""Sources other than HTML: classification, feeds, sitemaps, robots, JSON, text, images, search answers."""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
import zlib
from email.utils import parsedate_to_datetime

from webloom.functions.dom import squeeze, truncated
from webloom.functions.text import fence

# First bytes of binary formats.
MAGIC = {b"%PDF-": "pdf", b"\x89PNG\r\n\x1a\n": "image", b"\xff\xd8\xff": "image", b"GIF8": "image", b"\x1f\x8b": "binary", b"PK\x03\x04": "binary"}


def classify(content_type: str, raw: bytes) -> str:
    """html, pdf, json, feed, text, image or binary."""
    for magic, kind in MAGIC.items():
        if raw.startswith(magic):
            return kind
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        return "image"
    kind = content_type.split(";")[0].strip().lower()
    if kind in ("", "application/octet-stream"):
        head = raw[:512].lstrip().lower()
        kind = "text/html" if re.match(rb"<!doctype html|<html|<head|<body|<script|<title|<table|<div|<p[\s>]", head) else "text/xml" if head.startswith(b"<?xml") else "application/octet-stream" if b"\0" in raw[:512] else "text/plain"
    if kind in ("text/html", "application/xhtml+xml"):
        return "html"
    if kind == "application/pdf":
        return "pdf"
    if kind == "image/svg+xml":
        return "text"
    if kind.startswith("image/"):
        return "image"
    if kind in ("application/rss+xml", "application/atom+xml", "application/feed+json"):
        return "feed"
    if kind == "application/json" or kind.endswith("+json"):
        return "feed" if b"jsonfeed.org" in raw[:512] else "json"
    if kind in ("application/xml", "text/xml") or kind.endswith("+xml"):
        return "feed" if re.search(rb"<rss|<feed|<rdf:rdf", raw[:1024].lower()) else "text"
    return "text" if kind.startswith("text/") else "binary"


def json_text(raw: str) -> str:
    """Pretty-printed JSON in a fence; text if it is none."""
    try:
        return fence(json.dumps(json.loads(raw), indent=2, ensure_ascii=False), "json")
    except ValueError:
        return fence(raw)


def plain(markup: str) -> str:
    return squeeze(html.unescape(re.sub(r"<[^>]*>", " ", html.unescape(markup))))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _text(e: ET.Element, *names: str) -> str:
    return next(("".join(c.itertext()).strip() for n in names for c in e if _local(c.tag) == n and "".join(c.itertext()).strip()), "")


def _date(text: str) -> str:
    if re.match(r"\d{4}-\d\d-\d\d", text):
        return text[:10]
    try:
        return parsedate_to_datetime(text).strftime("%Y-%m-%d")
    except (TypeError, ValueError):
        return ""


def feed(raw: str) -> dict | None:
    """RSS, Atom or JSON feed: title, description, link, items (title, link, date, summary); None if it is none."""
    if raw.lstrip().startswith("{"):
        try:
            d = json.loads(raw)
        except ValueError:
            return None
        items = [{"title": i.get("title", ""), "link": i.get("url", ""), "date": _date(i.get("date_published", "")), "summary": truncated(plain(i.get("summary") or i.get("content_text") or i.get("content_html") or ""), 280)} for i in d.get("items", [])]
        return {"title": d.get("title", ""), "description": plain(d.get("description", "")), "link": d.get("home_page_url", ""), "items": items}
    try:
        root = ET.fromstring(raw.strip())
    except ET.ParseError:
        return None
    if _local(root.tag) not in ("rss", "feed", "rdf"):
        return None
    top = next((c for c in root if _local(c.tag) == "channel"), root)
    items = []
    for e in root.iter():
        if _local(e.tag) in ("item", "entry"):
            href = next((c.get("href", "") for c in e if _local(c.tag) == "link" and c.get("href") and c.get("rel", "alternate") == "alternate"), "")
            items.append({"title": plain(_text(e, "title")), "link": _text(e, "link") or href, "date": _date(_text(e, "pubdate", "published", "updated", "date")), "summary": truncated(plain(_text(e, "description", "summary", "content")), 280)})
    link = _text(top, "link") or next((c.get("href", "") for c in top if _local(c.tag) == "link" and c.get("href")), "")
    return {"title": plain(_text(top, "title")), "description": plain(_text(top, "description", "subtitle")), "link": link, "items": items}


def feed_markdown(f: dict) -> str:
    lines = [f"# {f['title'] or '(untitled)'}", ""]
    lines += [f["description"], ""] if f["description"] else []
    lines += [f"Feed: {f['link']}", ""] if f["link"] else []
    lines += [f"## Items ({len(f['items'])})", ""]
    for i in f["items"][:50]:
        title = i["title"] or "(untitled)"
        lines.append("- " + (f"[{title}]({i['link']})" if i["link"] else title) + (f" — {i['date']}" if i["date"] else ""))
        lines += ["  " + i["summary"]] if i["summary"] else []
    lines += ["", f"_Showing first 50 of {len(f['items'])} items._"] if len(f["items"]) > 50 else []
    return "\n".join(lines) + "\n"


def sitemap(raw: bytes, most: int = 50_000) -> tuple[str, list[tuple[str, str]]]:
    """(urlset or sitemapindex, [(loc, lastmod)]); a broken tail is ignored, an unknown root is an error."""
    if raw[:2] == b"\x1f\x8b":
        # no more is inflated than is read
        raw = zlib.decompressobj(zlib.MAX_WBITS | 16).decompress(raw, 32 << 20)
    parser = ET.XMLPullParser(events=("start", "end"))
    kind, out = "", []
    try:
        parser.feed(raw)
        parser.close()
    except ET.ParseError:
        pass
    try:
        for event, e in parser.read_events():
            if not kind:
                kind = _local(e.tag)
                if kind not in ("urlset", "sitemapindex"):
                    raise ValueError(f"a sitemap has a urlset or a sitemapindex, not {kind}")
            if event == "end" and _local(e.tag) in ("url", "sitemap") and len(out) < most:
                loc = _text(e, "loc")
                if loc:
                    out.append((loc, _text(e, "lastmod")))
    except ET.ParseError:
        pass
    if not kind:
        raise ValueError("no sitemap")
    return kind, out


def robots(raw: str) -> dict:
    """Groups (agents, rules, delay) and sitemaps; a user-agent line after a rule begins a new group."""
    groups: list[dict] = []
    maps: list[str] = []
    fresh = False
    for line in raw[: 512 << 10].lstrip("﻿").splitlines():
        key, colon, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not fresh:
                groups.append({"agents": [], "rules": [], "delay": None})
            groups[-1]["agents"].append(value.lower())
            fresh = True
        elif key == "sitemap":
            maps.append(value)
        elif groups and key in ("allow", "disallow", "crawl-delay"):
            fresh = False
            if key == "crawl-delay":
                if re.fullmatch(r"\d+(\.\d+)?", value):
                    groups[-1]["delay"] = float(value)
            else:
                groups[-1]["rules"].append((value, key == "allow"))
    return {"groups": groups, "sitemaps": maps}


def star_rules(parsed: dict) -> list[tuple[str, bool]]:
    return next((g["rules"] for g in parsed["groups"] if "*" in g["agents"]), [])


def robots_regex(pattern: str) -> str:
    """A pattern as an anchored regular expression."""
    end = pattern.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in (pattern[:-1] if end else pattern).split("*")) + ("$" if end else "")


def allowed(rules: list[tuple[str, bool]], path: str) -> bool:
    hits = [(len(p), allow) for p, allow in rules if p and re.search(robots_regex(p), path, re.S)]
    return max(hits)[1] if hits else True


def image_size(raw: bytes) -> tuple[str, int, int] | None:
    """(type, width, height) of PNG, GIF, BMP and JPEG."""
    if raw.startswith(b"\x89PNG") and len(raw) >= 24:
        return "image/png", int.from_bytes(raw[16:20], "big"), int.from_bytes(raw[20:24], "big")
    if raw.startswith(b"GIF8") and len(raw) >= 10:
        return "image/gif", int.from_bytes(raw[6:8], "little"), int.from_bytes(raw[8:10], "little")
    if raw.startswith(b"BM") and len(raw) >= 26:
        return "image/bmp", int.from_bytes(raw[18:22], "little"), abs(int.from_bytes(raw[22:26], "little", signed=True))
    at = 2
    while raw.startswith(b"\xff\xd8") and at + 9 < len(raw) and raw[at] == 0xFF:
        if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
            return "image/jpeg", int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    return None


def manifest(name: str, content_type: str, raw: bytes) -> str:
    """What can be said of bytes that are no text."""
    size = image_size(raw)
    lines = [f"# {name}", "", f"- type: {size[0] if size else content_type or 'application/octet-stream'}"]
    lines += [f"- size: {size[1]} × {size[2]}"] if size else []
    return "\n".join([*lines, f"- bytes: {len(raw)}"]) + "\n"


def search_results(raw: str, count: int = 10) -> list[dict[str, str]]:
    """Answers of a search service that lists them under ``results`` or ``web.results``."""
    try:
        d = json.loads(raw)
    except ValueError:
        return []
    d = d if isinstance(d, dict) else {}
    web = d.get("web") if isinstance(d.get("web"), dict) else {}
    found = d.get("results") if isinstance(d.get("results"), list) else web.get("results")
    found = [r for r in found if isinstance(r, dict)] if isinstance(found, list) else []
    out = [{"title": squeeze(str(r.get("title") or "")), "url": r.get("url") or "", "snippet": plain(str(r.get("content") or r.get("description") or ""))} for r in found]
    return [r for r in out if r["url"]][: min(count, 20)]
