import gzip

import pytest
from pyspark.sql import functions as F
from webloom.functions import urls
from webloom.operators import policy
from webloom.sources import content


def test_classify():
    c = content.classify
    assert c("text/html", b"%PDF-1") == "pdf" and c("text/html; charset=x", b"") == "html" and c("image/svg+xml", b"") == "text"
    assert c("application/json", b'{"version":"https://jsonfeed.org/version/1"}') == "feed" and c("text/xml", b"<rss>") == "feed" and c("text/xml", b"<x>") == "text"
    assert c("", b"<!doctype html>") == "html" and c("", b"a\0b") == "binary" and c("", b"hello") == "text" and c("", b"RIFF0000WEBP") == "image"


def test_robots():
    parsed = content.robots("﻿User-agent: a\nUser-agent: *\nDisallow: /p # no\nAllow: /p/ok\nCrawl-delay: 5\nUser-agent: b\nDisallow: /\nSitemap: https://x/s.xml")
    rules = content.star_rules(parsed)
    assert rules == [("/p", False), ("/p/ok", True)] and parsed["sitemaps"] == ["https://x/s.xml"] and parsed["groups"][0]["delay"] == 5
    assert content.allowed(rules, "/p/ok/1") and not content.allowed(rules, "/p/no") and content.allowed(rules, "/")
    assert content.allowed([("/a", False), ("/a", True)], "/a") and not content.allowed([("/*.pdf$", False)], "/x.pdf") and content.allowed([("/*.pdf$", False)], "/x.pdf?1")


def test_sitemap():
    xml = b'<urlset xmlns="u"><url><loc> http://a </loc></url><url><loc></loc></url><url><loc>http://b</loc><lastmod>2020</lastmod></url><url><loc>http://c'
    assert content.sitemap(gzip.compress(xml)) == ("urlset", [("http://a", ""), ("http://b", "2020")])
    with pytest.raises(ValueError):
        content.sitemap(b"<html></html>")


def test_feeds():
    atom = content.feed('<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><title>E</title><link href="http://l"/><updated>2024-01-02T00:00:00Z</updated><summary>a &lt;i&gt;b&lt;/i&gt;</summary></entry></feed>')
    assert atom["items"] == [{"title": "E", "link": "http://l", "date": "2024-01-02", "summary": "a b"}]
    assert "- [E](http://l) — 2024-01-02\n  a b" in content.feed_markdown(atom)
    assert content.feed('{"title":"J","items":[{"title":"x","url":"u"}]}')["items"][0]["link"] == "u" and content.feed("<x/>") is None


def test_search_and_json():
    assert content.search_results('{"web":{"results":[{"title":"a","url":"u","description":"<b>d</b>"},{"title":"no"}]}}') == [{"title": "a", "url": "u", "snippet": "d"}]
    assert content.json_text('{"a":[1]}').startswith('```json\n{\n  "a"') and content.json_text("x`````").startswith("``````")


def test_url_functions():
    assert urls.resolve("https://a.b/c/d", "../e?x#y") == "https://a.b/e?x#y" and urls.resolve("", "/x") == "" and urls.resolve("https://a.b/", "mailto:x@y") == "mailto:x@y"
    assert urls.is_internal("https://x.example.co.uk/", "http://example.co.uk") and not urls.is_internal("https://a.co.uk", "https://b.co.uk")
    assert urls.normal_map_url("https://a/b#c") == "https://a/b" and urls.normal_map_url("ftp://a") == ""


@pytest.mark.parametrize(("rule", "url", "hit"), [("||ads.com^", "https://x.ads.com/1", True), ("||ads.com^", "https://badads.com/", False), ("|https://a", "https://a.b", True), ("x^", "https://a/x", True), ("x^", "https://a/xy", False), ("a*c|", "http://a/b/c", True), ("", "http://any", True), ("*|", "http://any", True)])
def test_url_filters(rule, url, hit):
    import re

    assert bool(re.search(policy.filter_regex(rule), url)) == hit


def test_match_patterns():
    import re

    m = lambda p, u: bool(re.search(policy.match_pattern_regex(p), u))
    assert m("<all_urls>", "https://x/") and m("*://*.a.com/*", "http://b.a.com/x") and m("*://*.a.com/*", "https://a.com/") and not m("https://a.com/x", "https://a.com/X") and not m("*://a.com/*", "file://a.com/")
    with pytest.raises(ValueError):
        policy.match_pattern_regex("a.com")


def test_content_security():
    allows = policy.csp_allows
    own = "https://a.com/p"
    assert allows([], "script", own, "https://x/") and not allows(["default-src 'none'"], "connect", own, "https://a.com/")
    assert allows(["script-src 'self'"], "script", own, "https://a.com/s.js") and not allows(["script-src 'self'", "script-src 'none'"], "script", own, "https://a.com/s.js")
    assert allows(["script-src 'nonce-n'"], "script", own, body=b"x", nonce="n") and not allows(["script-src 'unsafe-inline' 'nonce-n'"], "script", own, body=b"x")
    assert allows(["script-src *.c.com/d/"], "script", own, "https://x.c.com/d/e.js") and not allows(["script-src *.c.com"], "script", own, "https://c.com/")
    assert not allows(["script-src 'strict-dynamic' 'nonce-n' *"], "script", own, "https://x/") and allows(["script-src 'strict-dynamic' 'nonce-n'"], "script", own, "https://x/", parser_inserted=False)


def test_hiding_selectors():
    assert policy.hiding_selectors("/* .no{display:none} */ .a, .b{display : none} @media x{.c{visibility:hidden}} .d{color:red} @font-face{display:none} .a{display:none}") == [".a", ".b", ".c"]


def test_odd_texts_end_no_job(spark):
    from webloom.sources import tables

    odd = [(1, None), (2, ""), (3, "<html></html>"), (4, "[1]"), (5, '{"web":3}'), (6, '{"results":[1]}'), (7, '{"items":3}'), (8, "<urlset><url><loc>https://a.test/</loc></url>")]
    df = spark.createDataFrame(odd, "id long, raw string")
    got = tables.sitemap_locs(df, "id", "raw").collect()
    assert [r.id for r in got if r.error] == [1, 2, 3, 4, 5, 6, 7] and [r.loc for r in got if not r.error] == ["https://a.test/"]
    assert tables.search_results(df, "id", "raw").count() == 0
    assert all(r.error or r.id for r in tables.feed_items(df, "id", "raw").collect())


def test_rules_of_equal_priority(spark):
    """Blocking, redirecting and upgrading are one class: priority, then place; allowing wins ties."""
    rule = "rule_id string, place int, priority int, action string, regex string, types array<string>, domains array<string>, third_party boolean, methods array<string>, request_domains array<string>, excluded_domains array<string>"
    rules = [("r", 0, 2, "redirect", "/x", [], [], None, [], [], []), ("b", 1, 2, "block", "/x", [], [], None, [], [], []), ("a", 2, 1, "allow", "/x", [], [], None, [], [], [])]
    rules += [("u", 3, 5, "upgradeScheme", "/y", [], [], None, ["post"], [], []), ("aa", 4, 5, "allowAllRequests", "/y/open", [], [], None, [], ["cdn.test"], []), ("c", 5, 1, "block", "/z", [], [], None, [], [], ["own.test"])]
    asked = [(1, "http://cdn.test/x", "", "main", "GET"), (2, "http://cdn.test/y/1", "", "main", "POST"), (3, "http://cdn.test/y/1", "", "main", "GET"), (4, "http://a.cdn.test/y/open", "", "main", "POST"), (5, "http://e.test/z", "https://www.own.test/", "main", "GET"), (6, "http://e.test/z", "https://other.test/", "main", "GET")]
    got = policy.decide(spark.createDataFrame(asked, "request_id long, url string, initiator string, type string, method string"), spark.createDataFrame(rules, rule))
    assert {r.request_id: (r.action, r.rule_id) for r in got.collect()} == {1: ("redirect", "r"), 2: ("upgradeScheme", "u"), 3: ("none", None), 4: ("allow", "aa"), 5: ("none", None), 6: ("block", "c")}


def test_addresses_of_both_families(spark):
    asked = ["::1", "fe80::1%eth0", "::ffff:10.0.0.1", "2606:4700::1111", "::", "[::1]", "fd00::1", "fc00::", "ff02::1", "::ffff:8.8.8.8", "::ffff:7f00:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1::2::3", "1:2:3", "12345::", "g::1", "", "10.0.0.1", "8.8.8.8",None,"host", "::ffff:999.1.1.1", "64:ff9b::8.8.8.8", "febf::1", "fec0::1", ":1", ":::"]
    want = [True, True, True, False, True, True, True, True, True, False, True, False, False, True, True, True, True, True, True, False, True, True, True, False, True, False, True, True]
    rows = spark.createDataFrame([(x,) for x in asked], "a string").coalesce(1).select(policy.blocked_host(F.col("a")).alias("b")).collect()
    assert [r.b for r in rows] == want
