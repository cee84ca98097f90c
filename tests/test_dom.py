from webloom.functions import dom, extract, reduce, text
from webloom.functions.selectors import SelectorError, select

import pytest

BEACH = """<main><div class=huts><article class=hut><h3 class=title>Dune</h3><em class=rate>12 crowns</em><button class=ask data-key=north-3 type=button>?</button></article>
<article class=hut><h3 class=title>Heron</h3><em class=rate>47 crowns</em><button class=ask type=button data-key=pier-8>?</button></article>
<article class=hut><h3 class=title>Kelp</h3></article><article class=hut><em class=rate>5 crowns</em></article></div></main>"""


def test_unclosed_formatting_goes_on():
    assert dom.serialise(dom.parse("<p><b>x<p>y</p><footer>z</footer>")) == "<html><head></head><body><p><b>x</b></p><p><b>y</b></p><footer><b>z</b></footer></body></html>"


def test_tree_has_html_head_body_whatever_comes():
    for raw in ("", "x", "<td>x", "</p>", "<", "<!--", "<a href", "\0<b"):
        root = dom.parse(raw)
        assert [e.tag for e in root.kids()] == ["head", "body"]
        assert root.pre == 0 and root.last == sum(1 for _ in root.elements()) - 1


def test_selectors():
    root = dom.parse("<ul id=u><li>a<li class='x y'>b<li>c</ul><p lang=en-GB>d")
    tags = lambda s: [dom.collapsed(e) for e in select(root, s)]
    assert tags("#u > li") == ["a", "b", "c"]
    assert tags("li.x.y + li") == ["c"]
    assert tags("li ~ li") == ["b", "c"]
    assert tags("li:nth-of-type(2n+1)") == ["a", "c"]
    assert tags("[lang|=en], li:not(.x):last-child") == ["c", "d"]
    with pytest.raises(SelectorError):
        select(root, "li:::")


def test_records_leave_out_what_is_missing():
    found = extract.records(dom.parse(BEACH), "article.hut", {"title": ".title", "rate": ".rate", "key": "button.ask@data-key"})
    assert found == [{"title": "Dune", "rate": "12 crowns", "key": "north-3"}, {"title": "Heron", "rate": "47 crowns", "key": "pier-8"}, {"title": "Kelp"}, {"rate": "5 crowns"}]


def test_collections_round_trip():
    rows = "".join(f"<div class=berth><h4 class=boat>Boat number {k}</h4><span class=length>{k + 4} metres</span><a class=book href=/b{k}>reserve</a></div>" for k in range(5))
    root = dom.parse(f"<main><section>{rows}</section></main>")
    found = extract.collections(root)
    assert len(found) == 1 and found[0]["region"] == "main" and found[0]["count"] == len(select(root, found[0]["root"])) == 5
    assert len(found[0]["fields"]) >= 2
    assert extract.collections(dom.parse("<nav><ol>" + "<li><a href=/tide>tables of the tide for each harbour</a>" * 4 + "</ol></nav>")) == []
    assert extract.collections(dom.parse("<main><p class=q><b>one</b></p><p class=q><b>two</b></p></main>")) == []


def test_tables():
    t = lambda html: extract.tables(dom.parse(html))
    down = t("<table><tr><th>river<th>mouth<tr><td>Ems<td rowspan=3>sea<tr><td>Elbe<tr><td>Eider<tr><td>Inn<td>Danube</table>")[0]
    assert down["headers"] == ["river", "mouth"] and down["rows"] == [["Ems", "sea"], ["Elbe", "sea"], ["Eider", "sea"], ["Inn", "Danube"]]
    both = t("<table><tr><td>1<td colspan=3 rowspan=2>wide<tr><td>2<tr><td>3<td>4<td>5<td>6</table>")[0]
    assert both["rows"] == [["1", "wide", "wide", "wide"], ["2", "wide", "wide", "wide"], ["3", "4", "5", "6"]]
    assert t("<table><tr><td>p<td>q<td>r<td rowspan=2>down<tr><td>s<td>t</table>")[0]["rows"][1] == ["s", "t", "", "down"]
    assert len(t("<table><tr><td><table><tr><td>inner<td>one</table><td>outer</table>")) == 1
    assert t("<p>none</p>") == []


def test_structured_data():
    ld = '<script type="application/ld+json">'
    root = dom.parse(f'{ld}["x",{{"y":0}}]</script>{ld}not json</script>{ld}{{"@graph":[{{"z":true}}],"k":1}}</script><script>{{"no":1}}</script>{ld}7</script>')
    assert extract.json_ld(root) == ["x", {"y": 0}, {"z": True}, 7]
    # a list of measurements: values of many kinds of elements, a thing within a thing within a thing, one name three times
    rows = "".join(f"<li itemprop=reading itemscope><data itemprop=level value={k}.5>{k} and a half</data><time itemprop=taken datetime=2024-0{k}-01>month {k}</time></li>" for k in (1, 2, 3))
    html = f"<base href=/gauges/><ol itemscope itemid=urn:g7 itemtype=Gauge>{rows}<li><span itemprop=place itemscope itemtype=Weir><span itemprop=keeper itemscope><meta itemprop=phone content=' 12 '></span><object itemprop=plan data=plan.pdf></object></span></ol><p itemprop=stray>no item</p>"
    md = extract.microdata(dom.parse(html), "https://water.test/a/b")
    assert [(m["type"], m["id"]) for m in md] == [("Gauge", "urn:g7")]
    assert [r["properties"] for r in md[0]["properties"]["reading"]] == [{"level": [f"{k}.5"], "taken": [f"2024-0{k}-01"]} for k in (1, 2, 3)]
    place = md[0]["properties"]["place"][0]
    assert place["type"] == "Weir" and place["properties"]["plan"] == ["https://water.test/gauges/plan.pdf"] and place["properties"]["keeper"][0]["properties"] == {"phone": ["12"]}
    assert set(md[0]["properties"]) == {"reading", "place"}


def test_deep_pages_are_read():
    root = dom.parse("<div>" * 5000 + "<p>end of it</p>" + "</div>" * 5000 + "<p>after")
    assert max(e.depth for e in root.elements()) <= dom.MOST_DEPTH + 1 and sum(e.tag == "div" for e in root.elements()) == 5000
    assert "end of it" in dom.visible(root) and "after" in dom.visible(root)
    for mode in ("article", "full"):
        assert "end of it" in reduce.read(root, "https://e.org/", mode=mode)["content"]
    extract.regions(root), extract.find(root, "end"), extract.duplicate_blocks(root), dom.serialise(root)


def test_landmarks_and_names():
    roles = lambda html: [(r["role"], r["links"]) for r in extract.regions(dom.parse(html))]
    assert roles("<header></header><main><header></header><nav><a href=x>y</a></nav></main><footer></footer>") == [("banner", 0), ("main", 0), ("navigation", 1), ("contentinfo", 0)]
    assert roles("<section></section><form></form><section aria-label=x></section>") == [("region", 0)]
    root = dom.parse("<label>Wrapped <input id=i type=submit></label><button aria-label=L aria-labelledby=t>x</button><b id=t>by</b>")
    names = extract.Names(root)
    assert [names.of(e) for e in root.elements() if e.tag in ("input", "button")] == ["Wrapped", "by"]


def test_controls_and_ids():
    got = extract.controls(dom.parse("<button id=go onclick=x>Press me</button><a href=/x>no</a><input type=submit value=Send disabled><div role=tab aria-selected=true>T</div><button>a</button><button>a</button>"), "")
    assert [(c["kind"], c["text"]) for c in got] == [("button", "Press me"), ("submit", "Send"), ("tab", "T"), ("button", "a"), ("button", "a")]
    assert got[1]["disabled"] and got[2]["selected"] == "true" and got[0]["selector"] == "#go"
    assert got[4]["id"] == got[3]["id"] + "-2"


def test_selector_of_every_element_finds_just_it():
    root = dom.parse(BEACH + "<p class='a b'>x<p class=a>y<div id=d><i>z</i></div>")
    for e in root.elements():
        assert select(root, extract.selector_of(root, e)) == [e]


def test_hidden_and_duplicates():
    root = dom.parse("<p>a<p hidden>b<div style='DISPLAY : none'><p>c</div><i aria-hidden=true>d</i><!-- e -->")
    assert dom.collapsed(dom.without(root, dom.is_hidden)) == "a"
    block = "<div>" + "word " * 60 + "<a href=1>1</a><a href=2>2</a><a href=3>3</a></div>"
    assert [e.tag for e in extract.duplicate_blocks(dom.parse(block + block))] == ["div"]
    assert extract.duplicate_blocks(dom.parse("<section>" + block + "</section>")) == []


def test_find():
    got = extract.find(dom.parse("<h1>A</h1><h2>B</h2><p>The apple. An APPLE.</p><script>apple</script><h2>C</h2><b>apple</b>"), " Apple ")
    assert [(g["index"], g["heading_path"]) for g in got] == [(0, "A > B"), (1, "A > C")]
    assert extract.find(dom.parse("x"), " ") == []


def test_read():
    body = "<nav><a href=/a>menu</a></nav><article><h1>T</h1>" + "<p>Some <b>bold</b> text with a <a href=/x>link</a> and words enough to count as prose here.</p>" * 5 + "<img src=/i.png alt=pic><p hidden>secret</p></article><div class=ad>buy</div><script>evil()</script>"
    out = reduce.read(dom.parse("<title>T</title>" + body), "https://e.org/")
    assert out["source"] == "readability" and "**bold**" in out["content"] and "[link](https://e.org/x)" in out["content"] and "[image: pic — https://e.org/i.png]" in out["content"]
    assert not any(w in out["content"] for w in ("secret", "buy", "evil", "menu"))
    assert reduce.read(dom.parse("<p>short"), "")["source"] == "full"
    with pytest.raises(ValueError):
        reduce.read(dom.parse(""), "", mode="text")


def test_paginate_and_cursor():
    assert text.paginate("", 10) == [""] and text.paginate("a\n\nb", 0) == ["a\n\nb"]
    blocks = ["x" * 40, "y" * 40, "\n".join("z" * 30 for _ in range(4))]
    parts = text.paginate("\n\n".join(blocks), 15)
    assert "".join(parts).replace("\n", "") == "".join(blocks).replace("\n", "")
    assert text.paginate("w" * 1000, 10) == ["w" * 1000]
    assert text.decode_cursor(text.encode_cursor("abc", 7)) == ("abc", 7) and text.decode_cursor("!") is None
    assert text.fingerprint("") == f"{text.FNV_OFFSET:x}" and text.fingerprint("a") == "af63dc4c8601ec8c"


def test_large_pages_are_read_whole():
    """No row, item or table of a page is left out, however many it has, unless a caller limits them."""
    root = dom.parse("<table>" + "<tr><td>x" * 2500 + "</table>" + "<table><tr><td>y</table>" * 70 + '<script type="application/ld+json">{"a":1}</script>' * 300 + "<div itemscope><b itemprop=n>z</b></div>" * 150)
    found = extract.tables(root)
    assert len(found) == 71 and len(found[0]["rows"]) == 2500 and not found[0]["truncated"]
    assert len(extract.json_ld(root)) == 300 and len(extract.microdata(root, "")) == 150
    assert extract.tables(root, 1, 7)[0]["truncated"] and len(extract.tables(root, 1, 7)[0]["rows"]) == 7 and len(extract.json_ld(root, 5)) == 5


def test_ids_work_out_a_path_once_a_parent():
    root = dom.parse("<main><form>" + "<input name=a>" * 50 + "</form></main>")
    ids, fields = extract.Ids(), [e for e in root.elements() if e.tag == "input"]
    made = [ids.mint(f, "inp", "", "") for f in fields]
    assert len(set(made)) == 50 and made[1] == made[0] + "-2" and list(ids.paths) == [fields[0].parent] and ids.paths[fields[0].parent].endswith("form>")


def test_white_space_runs_become_one_space():
    import random
    import re

    rng = random.Random(3)
    for _ in range(2000):
        t = "".join(rng.choice(" \t\n\r\x0b\x0c\x1c\x85\xa0\u2003\u200bab") for _ in range(rng.randrange(7)))
        assert reduce.spaced(t) == re.sub(r"\s+", " ", t) and reduce._GAPS.sub(" ", t) == re.sub(r"[ \t]+", " ", t)


def test_collections_weigh_every_group_member_and_field_of_a_page():
    """Groups behind many others, records behind many that differ, fields behind many others and collections behind the best ones are all there."""
    chrome = "<div><i>1</i><i>2</i><i>3</i></div>" * 600
    shelf = lambda name, n: f"<section class=w{name}>" + "".join(f"<div class={name}><h4>{name} number {k}</h4></div>" for k in range(n)) + "</section>"
    found = extract.collections(dom.parse(chrome + "".join(shelf(f"s{k}", 3) for k in range(12))))
    assert [c["root"] for c in found] == [f"div.s{k}" for k in range(12)] and len(extract.collections(dom.parse(chrome + shelf("s", 3)), 1)) == 1
    late = "".join(f"<div class=r><h4>name</h4>{'' if 0 < k < 30 else '<b class=rate>5</b>'}</div>" for k in range(90))
    assert extract.collections(dom.parse(late))[0]["fields"] == {"title": "h4", "rate": "b.rate"}
    wide = "<div class=w>" + "".join(f"<p><u></u><b class=c{k}>x</b></p>" for k in range(300)) + "</div>"
    assert len(extract.collections(dom.parse(wide * 3))[0]["fields"]) == 300
    odd = "<o:p class=q><b:c class=z>text</b:c><i class=z>more</i></o:p>" * 3 + "<p class=q><o:x class=n data-1=a>text</o:x><i class=m>more</i></p>" * 3
    assert [c["root"] for c in extract.collections(dom.parse(odd))] == ["p.q"]
