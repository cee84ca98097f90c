"""Selectors proved by an index, sums over document order, sweeps over nested intervals."""

import random
import time

from pyspark.sql import functions as F

from webloom.functions import dom, extract
from webloom.functions.index import Page
from webloom.functions.selectors import select
from webloom.plans import nodes as N


def any_page(rng, n=60):
    tags, classes = ["div", "p", "a", "li", "section", "b-c"], ["a", "b", "c", "9x", "d:e", "-f", "--g", "é"]
    out = ""
    for _ in range(n):
        tag = rng.choice(tags)
        attrs = (f" id='{rng.choice(['i', 'j', 'k ', '1', 'x.y'])}'" if rng.random() < 0.15 else "") + (f" class='{' '.join(rng.choices(classes, k=rng.randrange(4)))}'" if rng.random() < 0.7 else "")
        out += f"<{tag}{attrs}>" + rng.choice(["", "word ", "two  words "]) + (f"</{tag}>" if rng.random() < 0.6 else "")
    return out


def test_every_selector_finds_just_its_element():
    rng = random.Random(5)
    for _ in range(60):
        root = dom.parse(any_page(rng))
        page = Page(root)
        for e in root.elements():
            assert select(root, page.selector(e)) == [e]


def test_shortest_proof_wins():
    root = dom.parse("<div id=a class=x></div><p class='u v'></p><p class='v u'></p><p class='u'></p><i class=q></i><em></em><b id=d></b><b id=d></b><s class='m n'></s><s class='m'></s><s class='n'></s>")
    made = [Page(root).selector(e) for e in root.elements() if e.tag not in ("html", "head", "body")]
    assert made[0] == "#a" and made[4:6] == ["i.q", "em"] and made[8] == "s.m.n"
    assert all("nth-of-type" in s for s in made[1:4] + made[6:8])


def test_many_controls_take_little_time():
    def took(n):
        root = dom.parse("<main>" + "".join(f"<div><button class='btn wide'>b{k}</button></div>" for k in range(n)) + "</main>")
        start = time.perf_counter()
        found = extract.controls(root, "")
        assert len(found) == n and found[-1]["selector"].endswith(f"div:nth-of-type({n}) > button:nth-of-type(1)")
        return time.perf_counter() - start

    took(50)
    assert min(took(1600) for _ in range(3)) < 0.2


def test_sums_are_those_of_the_parts():
    rng = random.Random(6)
    for _ in range(30):
        root = dom.parse(any_page(rng))
        page = Page(root)
        for e in root.elements():
            assert page.chars(e) == len(dom.collapsed(e))
            assert page.linked(e) == sum(len(dom.collapsed(a)) for a in e.elements() if a.tag == "a")
            assert page.links(e) == sum(a.tag == "a" for a in e.elements())


def test_twins_are_numbered_over_all_kinds():
    found = extract.Minted(dom.parse("<form><input name=q></form><button>a</button><button>a</button><nav></nav><nav></nav>"))
    assert found.controls[1]["id"] == found.controls[0]["id"] + "-2"
    ids = [r["id"] for r in found.regions()]
    assert ids[1] == ids[0] + "-2" and found.forms[0]["fields"][0]["id"].startswith("inp-")


def test_sweeps_find_the_innermost(spark):
    rng = random.Random(7)
    pages = [(i, "", any_page(rng, 80)) for i in range(12)] + [(50, "", None), (51, "", "<div><p><div>x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = set()
    for ident, _, html in pages:
        for e in dom.parse(html).elements():
            if e.tag in ("p", "a"):
                outer = next((x for x in e.above() if x.tag in ("div", "section")), None)
                want.add((ident, e.pre, outer.pre if outer else None))
    got = N.innermost(df, "p, a", "div, section")
    assert {(r.page_id, r.pre, r.outer_pre) for r in got.collect()} == want
    n = N.nodes(df)
    found = N.within(n.where("tag IN ('p', 'a')"), n.where("tag IN ('div', 'section')"))
    assert {tuple(r) for r in found.collect()} == {w for w in want if w[2] is not None}
    assert N.within(n.limit(0), n).count() == 0 and N.innermost(df.limit(0), "p", "div").count() == 0
    # what is both is not within itself
    own = N.within(n.where("tag = 'div'"), n.where("tag = 'div'"))
    assert own.where(F.col("pre") <= F.col("outer_pre")).count() == 0
