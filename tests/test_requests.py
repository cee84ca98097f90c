"""Resources, requests, site maps and states that SQL does not express."""

import gzip
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions.dom import parse
from webloom.functions.extract import capped_outline
from webloom.operators import crawl, policy
from webloom.operators import pages as P
from webloom.operators import requests as Q
from webloom.sources import resources as R
from webloom.streaming import state


def test_inflating_is_bounded_and_total():
    body = b"some words " * 500
    assert R.inflated_bytes("gzip", gzip.compress(body)) == (body, None)
    assert R.inflated_bytes(" Deflate", zlib.compress(body)) == (body, None)
    raw = zlib.compressobj(wbits=-15)
    assert R.inflated_bytes("deflate", raw.compress(body) + raw.flush()) == (body, None)
    assert R.inflated_bytes("gzip", gzip.compress(bytes(5000)), 4999) == (None, "response exceeds 4999 bytes")
    assert R.inflated_bytes("gzip", gzip.compress(bytes(4999)), 4999)[0] == bytes(4999)
    assert R.inflated_bytes("gzip", gzip.compress(body)[:-9])[1] == "gzip body is cut short"
    assert R.inflated_bytes("gzip", b"plain")[1] == "gzip body cannot be read"
    assert R.inflated_bytes("br", b"x")[1] == "content encoding br is unknown"
    assert R.inflated_bytes(None, None) == R.inflated_bytes("gzip", None) == (None, None)


@pytest.mark.parametrize(
    ("kind", "raw", "want"),
    [
        ("text/plain", "é".encode(), "é"),
        ("text/plain", "é".encode("cp1252"), "é"),
        ("text/html; charset=ISO-8859-1", b"\x80", "€"),
        ("text/html", '<meta charset="shift_jis">日'.encode("shift_jis"), '<meta charset="shift_jis">日'),
        ("text/html; charset=nonsense", "é".encode(), "é"),
        ("application/ld+json", b"{}", "{}"),
        ("text/plain", b"%PDF-1.7", None),
        ("", b"a\0b", None),
        ("image/png", b"a", None),
        ("text/plain", b"", ""),
        (None, None, None),
    ],
)
def test_charsets(kind, raw, want):
    assert R.decoded_text(kind, raw) == want


def test_site_map_goes_breadth_first_and_stops(spark):
    arrows = {"a": "bcd", "b": "ea", "c": "bf", "e": "g", "s": "t"}
    url = "https://x/{}".format
    edges = spark.createDataFrame([(url(a), i, url(b)) for a, bs in arrows.items() for i, b in enumerate(bs)], "url string, pre int, target string")
    seeds = spark.createDataFrame([("https://x/a#top",), ("https://y/",)], "url string")
    listed = spark.createDataFrame([("https://x/s", 2), ("https://x/c", 1), ("https://z/q", 0)], "url string, place int")

    def found(**limits):
        rows = crawl.site_map(seeds, edges, listed, **limits).orderBy("origin", "place").collect()
        return [(r.url[-1], r.source, r.depth) for r in rows if r.origin == "https://x"], {r.truncated for r in rows if r.origin == "https://x"}

    start = [("a", "crawl", 0), ("c", "sitemap", 0), ("s", "sitemap", 0)]
    assert found() == ([*start, ("b", "crawl", 1), ("d", "crawl", 1), ("e", "crawl", 2), ("f", "crawl", 2)], {False})
    assert found(most_depth=3)[0][-1] == ("g", "crawl", 3)
    assert found(most_urls=4) == ([*start, ("b", "crawl", 1)], {True})
    assert found(most_urls=7, most_depth=2)[1] == {False}


def test_whole_sites_are_mapped(spark):
    """Without a limit no URL of a site is left out, and none is said to be."""
    url = "https://x/{}".format
    edges = spark.range(3000).select(F.lit(url("a")).alias("url"), F.col("id").cast("int").alias("pre"), F.format_string(url("%d"), "id").alias("target")).union(spark.range(1500).select(F.format_string(url("%d"), "id"), F.lit(0), F.format_string(url("n%d"), "id")))
    seeds = spark.createDataFrame([(url("a"),)], "url string")
    listed = spark.range(2500).select(F.format_string(url("s%d"), "id").alias("url"), F.col("id").cast("int").alias("place"))
    rows = crawl.site_map(seeds, edges, listed, None).collect()
    assert len(rows) == 1 + 2500 + 3000 + 1500 and not any(r.truncated for r in rows)
    want = ["a", *[f"s{i}" for i in range(2500)], *[str(i) for i in range(3000)], *[f"n{i}" for i in range(1500)]]
    assert [r.url[len("https://x/"):] for r in sorted(rows, key=lambda r: r.place)] == want


def test_forms_tell_what_is_wrong(spark):
    html = "<form id=one action=/go><textarea name=t>a\nb</textarea><input type=radio name=r checked></form><form name=two method=post enctype='multipart/form-data'></form>"
    pages = spark.createDataFrame([(1, "https://x/p?q", html), (2, None, None)], "page_id long, url string, html string")
    ask = lambda **k: {r.page_id: r for r in Q.form_requests(pages, **k).collect()}
    assert ask()[1].error == "2 forms, name one" and ask()[2].error == "no form"
    assert ask(index=0)[1].target == "https://x/go?r=on&t=a%0Ab"
    assert ask(index=5)[1].error == ask(name="three")[1].error == "no such form"
    two = ask(name="two", values={"k": "v w"})[1]
    assert (two.method, two.target, two.body, two.multipart) == ("POST", "https://x/p?q", "k=v+w", True)


def test_reading_by_cursor(spark):
    html = "<main>" + "".join(f"<p>Paragraph {i} says something of its own, at some length.</p>" for i in range(12)) + "</main>"
    pages = spark.createDataFrame([(1, "https://x/", html)], "page_id long, url string, html string")
    ask = lambda **k: P.read_chunk(pages, mode="full", max_tokens=60, **k).collect()[0]
    parts = [ask()]
    while parts[-1].next_cursor:
        parts.append(ask(cursor=parts[-1].next_cursor))
    assert len(parts) == parts[0].chunks > 2 and "Paragraph 11" in parts[-1].content
    assert ask(cursor=T.encode_cursor("0", 1)).error == "the page has changed since the cursor was given"
    mark = T.decode_cursor(parts[0].next_cursor)[0]
    assert ask(cursor=T.encode_cursor(mark, 99)).error == "no such chunk"
    assert ask(selector="table").error == "nothing matches the selector"
    with pytest.raises(ValueError):
        ask(cursor="!")


def test_outline_is_cut_after_a_line():
    text = "\n".join("- é" * 10 for _ in range(400))
    cut = capped_outline(text)
    assert len(cut.encode()) < 8300 and set(cut.split("\n")[:-1]) == {"- é" * 10}
    assert capped_outline("- a") == "- a"


def test_successful_controls():
    html = "<form><input name=a><input name=b type=submit value=1><input type=checkbox name=c><select name=d><option>1<option selected value=''>2</select><select name=e><option>1</select><fieldset name=f></fieldset><input value=x></form>"
    form = next(e for e in parse(html).elements() if e.tag == "form")
    assert Q.successful(form) == [("a", ""), ("d", ""), ("e", "")]


def test_globs():
    import re

    assert re.match(policy.glob_regex("a?c*"), "abc.d") and not re.match(policy.glob_regex("a?c"), "abcd")
    assert re.match(policy.glob_regex("a?c*", one=False), "a?c") and not re.match(policy.glob_regex("a?c", one=False), "abc")


def test_stores_forget_and_remember_why():
    s = state.Store(most=2, ttl=10, remembered=100, most_tombstones=2)
    told = [s.take(t, k) for t, k in [(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "b"), (14, "a"), (15, "d")]]
    assert told == ["created", "created", "used", "created", "expired (capacity)", "expired (idle)", "created"]
    assert s.take(16, "d", close=True) == "closed" and s.take(17, "d") == "created" and s.take(18, "zz", close=True) == "absent"
    assert s.take(200, "a") == "created"


def test_labels_over_a_table_equal_a_plain_fold(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, f"o{i % 3 and 1}", i * i % 7, start + timedelta(milliseconds=170 * i)) for i in range(300)] + [(300, None, 1, start)]
    df = spark.createDataFrame(rows, "event_id long, owner string, user long, ts timestamp").repartition(5)
    got = {r.event_id: r.label for r in state.session_labels(df, "owner", "user", most=3, ttl=2.0).collect()}
    sent = {r.event_id: r.label for r in state.throttled(df, "owner").collect()}
    cached = {r.event_id: r.label for r in state.site_cache_labels(df.selectExpr("*", "user % 2 = 0 AS there"), "owner", "user", "there", ttl=1.0).collect()}
    want, notes, held = {}, {}, {}
    stores, last, cache = {}, {}, {}
    for i, owner, user, at in sorted(rows, key=lambda r: (r[3], r[0])):
        want[i] = stores.setdefault(owner, state.Store(3, 2.0)).take(at.timestamp(), user)
        notes[i] = "sent" if owner not in last or at - last[owner] >= timedelta(milliseconds=500) else "held"
        last[owner] = at if notes[i] == "sent" else last[owner]
        when = cache.get((owner, user))
        fresh = when is not None and (at - when).total_seconds() < 1.0
        held[i] = ("hit" if user % 2 == 0 else "negative hit") if fresh else "miss"
        cache[owner, user] = when if fresh else at
    assert got == want and sent == notes and cached == held
    assert state.throttled(df.limit(0), "owner").count() == 0


def test_uploads_open_only_what_is_looked_at(spark):
    """Files of a form with too many are not opened; the others give what ready files give."""
    rows = [(1, ["a", "b64", "both", "a"]), (2, ["x"] * 9), (3, ["a", "bad"]), (4, ["", "a"]), (5, ["a", "b64"]), (6, []), (7, ["big"] * 3)]
    forms = spark.createDataFrame(rows, "id long, files array<string>")

    def opened(f):
        text = F.when(f == "x", F.raise_error(F.lit("opened"))).when(f == "b64", "").when(f == "big", F.repeat(F.lit("x"), 3 << 19)).otherwise("aé")
        return F.struct(F.when(f == "", " ").otherwise("file").alias("field"), F.lit("").alias("filename"), F.lit("m").alias("mime"), F.when(f == "bad", "").otherwise(text).alias("content"), F.when(f.isin("b64", "both"), "YWJjZA==").when(f == "bad", "!!").otherwise("").alias("content_base64"))

    u = F.col("u")
    got = {r.id: (r.error, r.n) for r in forms.withColumn("u", Q.uploaded(F.col("files"), opened)).select("id", u.error.alias("error"), F.transform(u.parts, lambda p: F.octet_length(p.data)).alias("n")).collect()}
    assert got == {1: ("files[2]: give content or content_base64, not both", None), 2: ("too many files: 9 (max 8)", None), 3: ("files[1]: invalid base64", None), 4: ("files[0]: field is required", None), 5: (None, [3, 4]), 6: (None, []), 7: ("upload too large: over 4194304 bytes total", None)}


def test_workers_hold_few_rows_at_once():
    """A batch is read a few rows at a time, and what was made of them is handed on."""
    import pyarrow as pa

    from webloom.plans.nodes import PIECE_ROWS, pieces

    batch = pa.RecordBatch.from_pydict({"a": list(range(1000)), "b": ["x"] * 1000})
    found = list(pieces(batch))
    assert max(p.num_rows for p in found) == PIECE_ROWS and [v for p in found for v in p.column(0).to_pylist()] == list(range(1000))


def test_forms_with_asked_fields_are_the_same(spark):
    """What is asked for of each field is what all of it has; no form or field is left out."""
    html = "<form name=a><input name=x value=1><input type=checkbox checked value=2><select><option>p<option value=q>r</select></form><form><textarea>t</textarea></form>"
    pages = spark.createDataFrame([(1, "https://x/", html), (2, None, None)], "page_id long, url string, html string")
    cut = F.transform("fields", lambda f: F.struct(f["value"].alias("value"), f["checked"].alias("checked"), f["options"].alias("options"), f["id"].alias("id")))
    whole = P.forms(pages).withColumn("fields", cut)
    assert [len(r.fields) for r in whole.orderBy("pre").collect()] == [3, 1]
    for asked in (("value", "checked", "options", "id"), ("value", "options")):
        want = whole.withColumn("fields", F.transform("fields", lambda f: F.struct(*[f[c].alias(c) for c in asked])))  # noqa: B023
        assert sorted(map(str, P.forms(pages, *asked).collect())) == sorted(map(str, want.collect()))
