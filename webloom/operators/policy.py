"""Decisions about requests: URL filters, rules, match patterns, content security, cross-origin, integrity."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import dom
from webloom.functions.selectors import SelectorError, compile_selector
from webloom.functions.selectors import select as matches
from webloom.functions.urls import blocked_address
from webloom.operators import rules as R
from webloom.plans.nodes import per_page


def filter_regex(pattern: str, case_sensitive: bool = False) -> str:
    """A URL filter (``||`` host anchor, ``|`` anchors, ``^`` separator, ``*``) as a regular expression."""
    head = tail = ""
    if pattern.startswith("||"):
        head, pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        head, pattern = "^", pattern[1:]
    if pattern.endswith("|"):
        tail, pattern = "$", pattern[:-1]
    if pattern.startswith("*"):
        head = ""
    if pattern.endswith("*"):
        tail = ""
    body = ".*".join("".join(R.SEPARATOR if c == "^" else re.escape(c) for c in part) for part in pattern.strip("*").split("*"))
    return ("" if case_sensitive else "(?i)") + head + body + tail


def match_pattern_regex(pattern: str) -> str:
    """An extension's match pattern as a regular expression over scheme, host, path and query."""
    if pattern == "<all_urls>":
        return r"^(?:https?|wss?|ftp|file)://"
    m = re.fullmatch(r"(\*|[a-z]+)://(\*|(?:\*\.)?[^/*]*)(/.*)", pattern)
    if not m:
        raise ValueError(f"no match pattern: {pattern!r}")
    scheme = r"(?:https?|wss?)" if m[1] == "*" else re.escape(m[1])
    name = r"[^/?#]*" if m[2] == "*" else r"(?:[^/?#]+\.)?" + re.escape(m[2][2:]) if m[2].startswith("*.") else re.escape(m[2])
    return f"(?i)^{scheme}://{name}(?::[0-9]+)?(?-i:{'.*'.join(map(re.escape, m[3].split('*')))})(?:#.*)?$"


def decide(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule that wins for each request: request_id, action, rule_id.

    ``requests``: request_id, url, initiator, type, and method if rules ask for it. ``rules``: rule_id, place (their
    order), priority, action, and url_filter, regex_filter and case_sensitive, or a ready ``regex``; types (empty: all), domains (of the
    initiator; empty: all), third_party (null: either) or domain_type; if they are there, also excluded_types, excluded_domains,
    request_domains, excluded_request_domains, methods and excluded_methods (lists as well), as ``rules_from_json`` gives them.
    ``rules.decisions`` tells how rules are found and which of them wins.
    """
    return R.decisions(requests, R.compiled(rules)).select("request_id", "action", "rule_id")


def robots_decision(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """site, path, allowed. ``rules``: site, pattern, regex, allow; the longest pattern that matches decides, allow wins ties."""
    hits = paths.join(rules, "site", "left").withColumn("_hit", F.expr("pattern <> '' AND path RLIKE regex"))
    best = F.max(F.when(F.col("_hit"), F.struct(F.char_length("pattern").alias("n"), F.col("allow").alias("yes"))))
    return hits.groupBy("site", "path").agg(best.alias("m")).select("site", "path", F.coalesce("m.yes", F.lit(True)).alias("allowed"))


def parse_csp(header: str) -> dict[str, list[str]]:
    """Directive to sources; the first of a repeated directive counts."""
    out: dict[str, list[str]] = {}
    for part in header.split(";"):
        words = part.split()
        if words:
            out.setdefault(words[0].lower(), words[1:])
    return out


def _source_matches(source: str, url: str, own: str) -> bool:
    u, o = urlsplit(url), urlsplit(own)
    low = source.lower()
    if low == "'self'":
        return (u.scheme, u.hostname, u.port) == (o.scheme, o.hostname, o.port)
    if low == "*":
        return u.scheme in ("http", "https", "ws", "wss")
    if re.fullmatch(r"[a-z][a-z0-9+.-]*:", low):
        return u.scheme == low[:-1]
    m = re.fullmatch(r"(?:([a-z][a-z0-9+.-]*)://)?(\*|(?:\*\.)?[^/:*]+)(?::(\d+|\*))?(/.*)?", source, re.I)
    if not m or low.startswith("'"):
        return False
    if (m[1] and u.scheme != m[1].lower()) or (not m[1] and u.scheme not in ("http", "https", "ws", "wss")):
        return False
    name, have = m[2].lower(), (u.hostname or "").lower()
    if name != "*" and not (have.endswith(name[1:]) and have != name[2:] if name.startswith("*.") else have == name):
        return False
    if m[3] and m[3] != "*" and u.port != int(m[3]):
        return False
    return not m[4] or (u.path.startswith(m[4]) if m[4].endswith("/") else u.path == m[4])


def csp_allows(policies: list[str], kind: str, own: str, url: str = "", nonce: str = "", body: bytes | None = None, parser_inserted: bool = True) -> bool:
    """Whether all policies allow a script (``body`` for inline, else ``url``) or a connection."""
    chain = {"script": ("script-src-elem", "script-src", "default-src"), "connect": ("connect-src", "default-src")}[kind]
    for header in policies:
        policy = parse_csp(header)
        sources = next((policy[d] for d in chain if d in policy), None)
        if sources is None:
            continue
        low = [s.lower() for s in sources]
        nonces = [s[7:-1] for s in sources if s.lower().startswith("'nonce-")]
        hashes = [s[1:-1] for s in sources if re.match(r"'sha(256|384|512)-", s.lower())]
        strict = "'strict-dynamic'" in low
        if kind == "script" and nonce and nonce in nonces:
            continue
        if body is not None:
            digests = {f"sha{n}-" + base64.b64encode(hashlib.new(f"sha{n}", body).digest()).decode() for n in (256, 384, 512)}
            if digests & set(hashes) or ("'unsafe-inline'" in low and not (nonces or hashes or strict)):
                continue
            return False
        if kind == "script" and strict:
            if parser_inserted:
                return False
            continue
        if not any(_source_matches(s, url, own) for s in sources):
            return False
    return True


def _starts_with(prefix: Column):
    return lambda t: F.startswith(t, prefix)


def _digest_of(t: Column) -> Column:
    return F.substring_index(F.substring(t, 8, 200), "?", 1)


def integrity_holds(raw: Column, integrity: Column) -> Column:
    """Subresource integrity: the strongest algorithm that is named decides; without a known one nothing is enforced."""
    names = F.split(F.trim(integrity), r"\s+")
    out = F.lit(True)
    for bits in (256, 384, 512):
        named, digest = F.lit(f"sha{bits}-"), F.base64(F.unhex(F.sha2(raw.cast("binary"), bits)))
        own = F.filter(names, _starts_with(named))
        out = F.when(F.size(own) > 0, F.array_contains(F.transform(own, _digest_of), digest)).otherwise(out)
    return out


def cors_allows(origin: Column, allow_origin: Column, credentials: Column, allow_credentials: Column) -> Column:
    return F.when(credentials, (allow_origin == origin) & (allow_credentials == "true")).otherwise((allow_origin == "*") | (allow_origin == origin))


def hiding_selectors(css: str) -> list[str]:
    """Selectors of rules that hide what they match, in order and once each; looks into @media and @supports."""
    css = re.sub(r"/\*.*?\*/", "", css, flags=re.S)
    out: dict[str, None] = {}

    def scan(text: str) -> None:
        at = 0
        while (brace := text.find("{", at)) >= 0:
            head, depth, end = text[at:brace].strip(), 1, brace + 1
            while depth and end < len(text):
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                end += 1
            body = text[brace + 1 : end - 1]
            if head.lower().startswith(("@media", "@supports")):
                scan(body)
            elif not head.startswith("@") and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", body, re.I):
                for s in head.split(","):
                    if s.strip():
                        out.setdefault(s.strip())
            at = end

    scan(css)
    return list(out)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def glob_regex(pattern: str, one: bool = True) -> str:
    """A glob over a whole address: ``*`` is any run, ``?`` one character (or itself, if ``one`` is false)."""
    return "^(?s:" + "".join(".*" if c == "*" else "." if c == "?" and one else re.escape(c) for c in pattern) + ")$"


def script_applies(url: Column, matches: list[str], exclude_matches: list[str] = (), include_globs: list[str] = (), exclude_globs: list[str] = ()) -> Column:
    """Whether a content script runs on a URL: in a match, in no excluded one, in an include glob if there are any, in no excluded glob."""

    def any_of(patterns: list[str]) -> Column:
        return url.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)

    matched = any_of([match_pattern_regex(p) for p in matches]) & ~any_of([match_pattern_regex(p) for p in exclude_matches])
    return matched & (any_of([glob_regex(g) for g in include_globs]) | F.lit(not include_globs)) & ~any_of([glob_regex(g) for g in exclude_globs])


_LISTED = {
    "types": ("resourceTypes",), "excluded_types": ("excludedResourceTypes",), "methods": ("requestMethods",), "excluded_methods": ("excludedRequestMethods",), "domains": ("initiatorDomains", "domains"),
    "excluded_domains": ("excludedInitiatorDomains", "excludedDomains"), "request_domains": ("requestDomains",), "excluded_request_domains": ("excludedRequestDomains",),
}
_RULE = "array<struct<id:int,priority:int,action:struct<type:string,redirect:struct<url:string>>,condition:struct<urlFilter:string,regexFilter:string,isUrlFilterCaseSensitive:boolean,domainType:string," + ",".join(f"{n}:array<string>" for names in _LISTED.values() for n in names) + ">>>"


def rules_from_json(texts: DataFrame, column: str = "raw") -> DataFrame:
    """Rule sets (JSON arrays) as rows, in order, as ``decide`` takes them; the older ``domains`` are initiator domains too, a rule without an action blocks. A text that is no rule set gives none."""
    rows = texts.select(*[c for c in texts.columns if c != column], F.posexplode(F.from_json(F.col(column), _RULE)).alias("place", "_r"))
    c, empty = F.col("_r.condition"), F.array().cast("array<string>")

    def listed(names: tuple[str, ...]) -> Column:
        whole = F.concat(*[F.coalesce(c[n], empty) for n in names])
        return F.transform(whole, F.lower)

    return rows.select(
        *[x for x in rows.columns if x != "_r"], F.col("_r.id").alias("rule_id"), F.greatest(F.coalesce("_r.priority", F.lit(1)), F.lit(1)).alias("priority"),
        F.coalesce(F.nullif(F.col("_r.action.type"), F.lit("")), F.lit("block")).alias("action"), F.coalesce("_r.action.redirect.url", F.lit("")).alias("redirect"), c["urlFilter"].alias("url_filter"), c["regexFilter"].alias("regex_filter"),
        F.coalesce(c["isUrlFilterCaseSensitive"], F.lit(False)).alias("case_sensitive"), F.coalesce(c["domainType"], F.lit("")).alias("domain_type"), *[listed(names).alias(out) for out, names in _LISTED.items()],
    )


# Cross-origin requests; headers are maps with lower-case names --------------------------------------

#: Methods, headers and body types that need no preflight. Fixed values.
SIMPLE_METHODS = ("GET", "HEAD", "POST")
SIMPLE_HEADERS = ("accept", "accept-language", "content-language")
SIMPLE_TYPES = ("application/x-www-form-urlencoded", "multipart/form-data", "text/plain")


def unsafe_headers(headers: Column) -> Column:
    """Names of headers that a preflight has to allow, sorted."""
    safe = lambda k, v: k.isin(*SIMPLE_HEADERS) | ((k == "content-type") & F.lower(F.trim(F.substring_index(v, ";", 1))).isin(*SIMPLE_TYPES))
    return F.array_sort(F.map_keys(F.map_filter(F.coalesce(headers, F.create_map().cast("map<string,string>")), lambda k, v: ~safe(k, v))))


def is_simple(method: Column, headers: Column) -> Column:
    return F.upper(method).isin(*SIMPLE_METHODS) & (F.size(unsafe_headers(headers)) == 0)


def _header(answer: Column, name: str) -> Column:
    return F.trim(F.coalesce(F.try_element_at(answer, F.lit(name)), F.lit("")))


def readable(origin: Column, answer: Column, credentials: Column) -> Column:
    """Whether a page may read a cross-origin answer, by the answer's headers."""
    allowed, same = _header(answer, "access-control-allow-origin"), F.lower(_header(answer, "access-control-allow-origin")) == F.lower(origin)
    return F.when(credentials, same & (allowed != "*") & (F.lower(_header(answer, "access-control-allow-credentials")) == "true")).otherwise((allowed == "*") | same)


def preflight_allows(origin: Column, method: Column, headers: Column, status: Column, answer: Column, credentials: Column) -> Column:
    """Whether the answer to a preflight lets the request go: its origin, its method and each header that is not simple. ``*`` counts without credentials only."""
    told = lambda name: F.filter(F.transform(F.split(F.lower(_header(answer, name)), ","), lambda t: F.trim(t)), lambda t: t != "")
    methods, names = told("access-control-allow-methods"), told("access-control-allow-headers")
    star = lambda found: ~credentials & F.array_contains(found, "*")
    method_ok = F.upper(method).isin(*SIMPLE_METHODS) | star(methods) | F.array_contains(methods, F.lower(method))
    asked = F.filter(unsafe_headers(headers), lambda h: h != "origin")
    return (status < 400) & readable(origin, answer, credentials) & method_ok & (star(names) | (F.size(F.array_except(asked, names)) == 0))


def csp_decision(policies: Column, kind: Column, own: Column, url: Column, nonce: Column, inline: Column) -> Column:
    """Whether all policies (array of header values) allow a script or connection; ``inline`` is the script's text, null for one with an address."""

    @F.pandas_udf("boolean")
    def each(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([csp_allows([x for x in (p if p is not None else []) if x], k, o or "", u or "", n or "", None if b is None else b.encode()) for p, k, o, u, n, b in zip(*columns, strict=True)], dtype=object)

    return each(policies, kind, own, url, nonce, inline)


def _bound(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), 0)


def hextets(address: Column) -> Column:
    """The eight numbers of an IPv6 address (brackets and zone aside), null if it is none."""
    none = F.array().cast("array<string>")
    groups = lambda x: F.when(x == "", none).otherwise(F.split(x, ":", -1))

    def spelled(text: Column) -> Column:
        """With its last four bytes as two groups, if they are written as those of IPv4."""
        bytes_of = F.split(F.regexp_extract(text, r"(?:^|:)([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1), r"\.")
        return _bound(bytes_of, lambda v: F.when(F.size(v) < 4, text).when(
            F.forall(v, lambda x: x.cast("int") <= 255),
            F.concat(F.regexp_extract(text, "^(.*:)[^:]*$", 1), F.concat_ws(":", *[F.hex(F.get(v, k).cast("int") * 256 + F.get(v, k + 1).cast("int")) for k in (0, 2)])),
        ))

    def filled(halves: Column) -> Column:
        """Groups with zeros where the address leaves them out; another number than eight is an error."""
        sides = F.struct(groups(F.get(halves, 0)).alias("a"), F.when(F.size(halves) == 2, groups(F.get(halves, 1))).otherwise(none).alias("b"), F.size(halves).alias("n"))
        return _bound(sides, lambda s: F.when(s.n == 1, s.a).when((s.n == 2) & (F.size(s.a) + F.size(s.b) <= 7), F.concat(s.a, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(s.a) - F.size(s.b), F.lit(0))), s.b)))

    text = F.lower(F.regexp_replace(F.regexp_replace(address, r"^\[|\]$", ""), "%.*$", ""))
    whole = _bound(F.split(_bound(text, spelled), "::", -1), filled)
    return _bound(whole, lambda g: F.when((F.size(g) == 8) & F.forall(g, lambda x: x.rlike("(?i)^[0-9a-f]{1,4}$")), F.transform(g, lambda x: F.conv(x, 16, 10).cast("int"))))


def blocked_host(address: Column) -> Column:
    """Addresses of either family that a crawler must not reach, as a column; IPv4 within IPv6 counts as what it holds. What is no address is blocked.

    Of IPv6: unspecified, loopback, unique local (fc00::/7), link-local (fe80::/10) and multicast (ff00::/8).
    """

    def closed(n: Column) -> Column:
        at = lambda k: F.get(n, k)
        zeros = lambda k: F.forall(F.slice(n, 1, k), lambda x: x == 0)
        own = (zeros(7) & (at(7) <= 1)) | at(0).between(0xFC00, 0xFDFF) | at(0).between(0xFE80, 0xFEBF) | (at(0) >= 0xFF00)
        inner = F.concat_ws(".", F.shiftright(at(6), 8), at(6) % 256, F.shiftright(at(7), 8), at(7) % 256)
        return F.when(n.isNull(), True).when(zeros(5) & (at(5) == 0xFFFF), _bound(inner, blocked_address)).otherwise(own)

    four = address.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    return F.when(address.isNull(), True).when(four, _bound(address, blocked_address)).otherwise(_bound(hextets(address), closed))


def without_matches(pages: DataFrame, selectors: list[str]) -> DataFrame:
    """Pages without what hiding selectors match: html, and removed (outermost elements). Selectors that cannot be read hide nothing."""
    fit = []
    for css in selectors:
        try:
            compile_selector(css)
            fit.append(css)
        except SelectorError:
            continue

    def kernel(root: dom.Element, url: str) -> list[dict]:
        hit = {id(e) for css in fit for e in matches(root, css)}
        top = [e for e in root.elements() if id(e) in hit and not any(id(a) in hit for a in e.above())]
        gone = {e.pre for e in top}
        return [{"html": dom.serialise(dom.without(root, lambda e: e.pre in gone)), "removed": len(top)}]

    return per_page(pages, kernel, "html string, removed int")
