"""Shadow trees, suffix tables, versions, sitemap indexes, archives and data sources, on small cases."""

import bisect
import gzip
import io
import random
import struct
import zipfile
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webloom.functions import dom
from webloom.operators import crawl, domains, versions
from webloom.sources import archives, stores

INNER = [
    ("<x-a><template shadowrootmode=open><h2><slot name=t>none</slot></h2><slot></slot></template>body<b slot=t>Title</b></x-a>", '<x-a><h2><b slot="t">Title</b></h2>body</x-a>'),
    ("<x-a><template shadowroot=open><slot name=t>kept <slot name=u>deep</slot></slot></template><i slot=other>gone</i></x-a>", "<x-a>kept deep</x-a>"),
    ("<div><template>inert</template>y</div>", "<div><template>inert</template>y</div>"),
    ("<x-a><template shadowrootmode=open><x-b><template shadowrootmode=open>[<slot></slot>]</template><slot></slot></x-b></template>in</x-a>", "<x-a><x-b>[in]</x-b></x-a>"),
    ("<x-a><template shadowrootmode=open><slot></slot><slot></slot></template><u>z</u></x-a>", "<x-a><u>z</u><u>z</u></x-a>"),
]


@pytest.mark.parametrize(("html", "want"), INNER)
def test_shadow(html, want):
    assert dom.serialise(dom.parse(html)).split("<body>")[1].removesuffix("</body></html>") == want


def test_shadow_stays_bounded():
    html = "<x-a><template shadowrootmode=open><slot></slot><slot></slot></template>" * 60 + "<i>x</i>" + "</x-a>" * 60
    root = dom.parse(html)
    assert 100_000 < root.last < 2_100_000 and max(e.depth for e in root.elements()) <= dom.MOST_DEPTH
    deep = "".join("<div>" * 100 + "<x-a><template shadowrootmode=open>" + "<p-q>" * 60 + "<slot></slot></template>" for _ in range(3)) + "end"
    root = dom.parse(deep)
    assert max(e.depth for e in root.elements()) <= dom.MOST_DEPTH and "end" in dom.visible(root)


def test_registrable(spark):
    rules = domains.suffix_rules(spark.createDataFrame([(r,) for r in ("com", "co.uk", "uk", "*.ck", "!www.ck", "// x", "", " jp ", "*.kobe.jp", "!city.kobe.jp", "com")], "rule string"))
    want = {"a.b.com": "b.com", "b.com": "b.com", "com": "", "x.co.uk": "x.co.uk", "co.uk": "", "y.uk": "y.uk", "a.b.ck": "a.b.ck", "b.ck": "", "ck": "", "www.ck": "www.ck", "q.www.ck": "www.ck", "c.kobe.jp": "", "d.c.kobe.jp": "d.c.kobe.jp", "e.city.kobe.jp": "city.kobe.jp", "unknown.tld": "unknown.tld", "tld": "", "10.0.0.1": "", "": ""}
    hosts = spark.createDataFrame([(h.upper() if i % 2 else h + ".",) for i, h in enumerate(want) if h] + [("",), (None,), ("b.com",)], "host string")
    got = {r.host: r.domain for r in domains.registrable(hosts, rules).collect() if r.host is not None}
    assert got == want
    joined = domains.with_domain(hosts.withColumn("k", F.lit(1)), rules, F.col("host"))
    assert joined.count() == hosts.count() and joined.where("host IS NULL").first().domain in (None, "")
    assert domains.registrable(hosts.limit(0), rules).count() == 0
    assert {r.domain for r in domains.registrable(hosts.where("host = 'B.COM' OR host = 'b.com'"), rules.limit(0)).collect()} == {"b.com"}


def test_as_of(spark):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    moment = lambda: start + timedelta(minutes=rng.randrange(6000))
    told = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", moment(), i) for i in range(120)] + [("hot", start, 900), ("hot", start, 901), (None, start, 5), ("k1", None, 6)]
    asked = [(i, "hot" if rng.random() < 0.7 else f"k{rng.randrange(7)}", moment()) for i in range(400)] + [(1000, "hot", start), (1001, None, start), (1002, "hot", None), (1000, "hot", start)]
    by = defaultdict(list)
    for key, ts, v in sorted((x for x in told if x[0] and x[1]), key=lambda x: (x[0], x[1], x[2])):
        by[key].append((ts, v))

    def seen(key, ts):
        at = bisect.bisect_right(by[key], (ts, 10**9)) if key and ts else 0
        return by[key][at - 1][1] if at else None

    v, r = spark.createDataFrame(told, "key string, ts timestamp, version long"), spark.createDataFrame(asked, "id long, key string, ts timestamp")
    for step in (86_400, 600, 10**7):
        got = versions.as_of(r, v, "key", "ts", "version", step)
        assert sorted(((x.id, x.version) for x in got.collect()), key=str) == sorted(((i, seen(k, t)) for i, k, t in asked), key=str)
    assert versions.as_of(r, v.limit(0), "key", "ts", "version").where("version IS NOT NULL").count() == 0


def test_sitemap_limits(spark):
    index = lambda *urls: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"
    site = "https://a.test"
    bodies = {f"{site}/i.xml": index(*[f"{site}/m{k}.xml" for k in range(9)], f"{site}/i.xml", f"{site}/bad.xml"), f"{site}/bad.xml": "<html>", **{f"{site}/m{k}.xml": f"<urlset><url><loc>{site}/p{k}</loc></url><url><loc>https://b.test/q</loc></url></urlset>" for k in range(9)}}
    rows = [(u, 500 if u.endswith("m1.xml") else 200, gzip.compress(b.encode()) if u.endswith("m2.xml") else b.encode()) for u, b in bodies.items()]
    resources = spark.createDataFrame(rows, "url string, status int, body binary")
    starts = spark.createDataFrame([(site, 0, f"{site}/i.xml"), (site, 1, f"{site}/none.xml"), ("https://c.test", 0, "https://c.test/s.xml"), (site, 2, f"{site}/i.xml#x")], "origin string, place int, url string")
    locs, files = crawl.expanded(starts, resources)
    assert sorted(r.url for r in locs.collect()) == [f"{site}/p{k}" for k in range(9) if k != 1]
    assert {(r.url[-7:], r.kind) for r in files.where("origin = 'https://a.test' AND place <= 4").collect()} == {("t/i.xml", "sitemapindex"), ("one.xml", None), ("/m0.xml", "urlset"), ("/m1.xml", None)}
    assert files.where("error IS NOT NULL").count() == 1 and files.where("truncated").count() == 0
    locs, files = crawl.expanded(starts, resources, most_files=5)
    assert locs.count() == 2 and files.where("truncated").count() == 5 and files.where("NOT truncated").count() == 1


def packed(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_archives(spark):
    good = packed(a="1", b__c="22")
    lying = bytearray(packed(bomb=b"\0" * 100_000))
    at = lying.rfind(b"PK\x01\x02")
    lying[at + 24 : at + 28] = struct.pack("<I", 10)  # the directory says that it is small
    crx2 = b"Cr24" + struct.pack("<III", 2, 3, 4) + b"keysign"[:7] + good
    rows = [("good", good), ("crx2", crx2), ("crx3", b"Cr24" + struct.pack("<II", 3, 5) + b"12345" + good), ("crx9", b"Cr24" + struct.pack("<IIII", 9, 1, 1, 1)), ("short", b"Cr24"), ("header", b"Cr24" + struct.pack("<III", 2, 1 << 30, 1)), ("cut", good[:-30]), ("empty", b""), ("null", None), ("big", packed(x="y" * 2000)), ("all", packed(x="y" * 900, z="y" * 900)), ("lying", bytes(lying))]
    got = archives.entries(spark.createDataFrame(rows, "path string, content binary"), most_entry=1000, most_total=1500).collect()
    errors = {r.path: r.error for r in got if r.error}
    assert set(errors) == {p for p, _ in rows} - {"good", "crx2", "crx3"}
    assert errors["big"] == "an entry is too large" and errors["all"] == "the archive is too large"
    assert {(r.path, r.name, bytes(r.body)) for r in got if r.name and r.path in ("good", "crx2")} == {(p, n, b) for p in ("good", "crx2") for n, b in (("a", b"1"), ("b/c", b"22"))}
    assert [archives.clean_name(n) for n in ("/a/./b", "../x", "a/../../x", ".", "c\\d")] == ["a/b", "", "", "", ""]


def test_messages(spark):
    assert archives.expand("a $$1 $1 $2 $NAME$ $none$ $", {"name": "<$1>"}, ["x"]) == "a $1 x  <x> $none$ $"
    found = spark.createDataFrame([("p", "manifest.json", b'{"manifest_version":3,"name":"__MSG_A__ __MSG_b__!","default_locale":"fr"}'), ("p", "_locales/fr/messages.json", b"{}"), ("p", "_locales/en/messages.json", b'{"a":{"message":"hi $1"},"B":{"message":""}}'), ("q", "manifest.json", b"{"), ("r", "manifest.json", b"{}")], "path string, name string, body binary")
    m = archives.manifests(found)
    assert {r.path: r.error for r in m.collect()} == {"p": None, "q": "the manifest is no JSON object", "r": "the manifest has no version"}
    told = archives.messages(found, m)
    assert {(r.key, r.locale) for r in told.collect()} == {("a", "en"), ("b", "en")}
    twice = m.where("path = 'p'").select("path", "name").union(m.where("path = 'p'").select("path", "name"))
    assert [r.name for r in archives.translated(twice, "name", told).collect()] == ["hi  !"] * 2


def test_sources(spark, tmp_path):
    stores.registered(spark)
    start = datetime(2024, 1, 1)
    rows = [(f"https://h{i % 7}.test/{i}", 200 + i % 3, "text/html", start + timedelta(days=i), f"b{i}".encode()) for i in range(60)]
    stores.write_log(spark.createDataFrame(rows, "url string, status int, content_type string, fetched_at timestamp, body binary"), f"{tmp_path}/log")
    log = spark.read.format("fetchlog").load(f"file://{tmp_path}/log")
    assert log.count() == 60
    asked = log.where("host = 'h3.test' AND status <> 201 AND fetched_at > '2024-01-10' AND length(body) > 0")
    assert sorted(r.url for r in asked.collect()) == sorted(u for u, s, _, t, _ in rows if "//h3." in u and s != 201 and t > datetime(2024, 1, 10))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan fetchlog" in plan and "host" not in plan.split("Filter")[1].split("\n")[0].split("BatchScan")[0].replace("isnotnull(host", "")
    assert len(stores.FetchLogReader({"path": f"{tmp_path}/log"}).partitions()) > len(_pruned(tmp_path)) >= 1
    assert log.where("host = 'nowhere.test'").count() == 0
    spark.createDataFrame([("q", '{"results":[{"url":"https://a/","title":"t"},{"url":""},{"url":"https://b/"}]}'), ("q2", "not json"), ("q3", None)], "query string, body string").write.json(f"{tmp_path}/answers")
    found = spark.read.format("searchanswers").load(f"{tmp_path}/answers")
    assert sorted((r.query, r.place, r.url) for r in found.collect()) == [("q", 0, "https://a/"), ("q", 1, "https://b/")]
    assert found.where("query = 'q2'").count() == 0 and found.where("query = 'q' AND place = 1").count() == 1


def _pruned(tmp_path):
    from pyspark.sql.datasource import EqualTo

    reader = stores.FetchLogReader({"path": f"{tmp_path}/log"})
    assert list(reader.pushFilters([EqualTo(("host",), "h3.test"), EqualTo(("body",), b"x")])) == [EqualTo(("body",), b"x")]
    return reader.partitions()
