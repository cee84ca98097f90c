"""URLs: resolution, origins, registrable domains, normal forms. Plain functions and Spark columns."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public suffixes of two labels that are in wide use; all others are one label.
TWO_LABEL_SUFFIXES = frozenset("co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp ne.jp or.jp com.br com.cn com.mx co.in co.kr co.nz co.za com.tr com.tw com.sg com.hk github.io".split())
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}


def resolve(base: str, href: str) -> str:
    """The absolute form of a reference, or "" if there is none."""
    href = (href or "").strip()
    if not href:
        return ""
    try:
        if not base:
            return href if urlsplit(href).scheme else ""
        return urljoin(base, href)
    except ValueError:
        return ""


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def registrable(host: str) -> str:
    """eTLD+1 of a host name, "" if it has none."""
    labels = host.strip(".").split(".")
    if len(labels) < 2 or all(x.isdigit() for x in labels):
        return ""
    n = 3 if ".".join(labels[-2:]) in TWO_LABEL_SUFFIXES else 2
    return ".".join(labels[-n:]) if len(labels) >= n else ""


def is_internal(url: str, base: str) -> bool:
    a, b = host_of(url), host_of(base)
    return bool(a) and (a == b or (registrable(a) == registrable(b) != ""))


def normal_map_url(url: str) -> str:
    """http(s) with a host and without fragment, else ""."""
    try:
        u = urlsplit(url.strip())
    except ValueError:
        return ""
    return urlunsplit((u.scheme, u.netloc, u.path, u.query, "")) if u.scheme in ("http", "https") and u.hostname else ""


# Columns ------------------------------------------------------------------------------------------


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def port(url: Column) -> Column:
    """The port, or the scheme's own."""
    named = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    own = F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv])
    return F.coalesce(F.nullif(named, F.lit("")).cast("int"), F.try_element_at(own, scheme(url)))


def origin(url: Column) -> Column:
    """scheme://host:port with the port always shown; "" if there is no host."""
    return F.when(host(url) == "", F.lit("")).otherwise(F.concat(scheme(url), F.lit("://"), host(url), F.lit(":"), port(url).cast("string")))


def registrable_column(name: Column) -> Column:
    labels = F.split(name, r"\.")
    n = F.when(F.array_join(F.slice(labels, -2, 2), ".").isin(*sorted(TWO_LABEL_SUFFIXES)), 3).otherwise(2)
    return F.when((F.size(labels) < n) | name.rlike(r"^[0-9.]+$"), F.lit("")).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), "."))


def normalised(url: Column) -> Column:
    return F.when(scheme(url).isin("http", "https") & (host(url) != ""), F.regexp_replace(url, "#.*$", "")).otherwise(F.lit(""))


def request_path(url: Column) -> Column:
    """Path and query as a request line has them."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest == "", F.lit("/")).when(F.startswith(rest, F.lit("?")), F.concat(F.lit("/"), rest)).otherwise(rest)


def fetch_site(initiator: Column, target: Column) -> Column:
    """same-origin, same-site or cross-site."""
    a, b = registrable_column(host(initiator)), registrable_column(host(target))
    return F.when(origin(initiator) == origin(target), "same-origin").when((a == b) & (a != "") & (scheme(initiator) == scheme(target)), "same-site").otherwise("cross-site")


def redacted(url: Column) -> Column:
    """Values of query parameters that carry secrets are replaced."""
    return F.regexp_replace(url, r"(?i)([?&](?:access_token|api_?key|auth|key|password|secret|sig|signature|token)=)[^&#]*", "$1REDACTED")


def blocked_address(ip: Column) -> Column:
    """IPv4 addresses that a crawler must not reach: loopback, private, link-local, unspecified, multicast, broadcast, shared."""
    parts = F.split(ip, r"\.")
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + F.coalesce(F.try_to_number(x, F.lit("999")).cast("long"), F.lit(0)))
    ranges = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 4), ("255.255.255.255", 32)]
    out = F.lit(False)
    for first, bits in ranges:
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(first.split(".")))
        out = out | n.between(low, low + (1 << (32 - bits)) - 1)
    return out
