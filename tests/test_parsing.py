"""Tree construction: trees that the HTML standard demands, for cases of our own."""

import random

import pytest

from webloom.functions import dom

CASES = [
    # what tables can't hold goes in front of them
    ("<table>x<tr><td>y</table>", "x<table><tbody><tr><td>y</td></tr></tbody></table>"),
    ("<table><p>a<tr><td>b</td></tr>c</table>d", "<p>a</p>c<table><tbody><tr><td>b</td></tr></tbody></table>d"),
    ("<table><b>q<tr><td>r", "<b>q</b><table><tbody><tr><td>r</td></tr></tbody></table>"),
    ("<table><tr><i>one</i><td>two<table><em>three</em></table></table>", "<i>one</i><table><tbody><tr><td>two<em>three</em><table></table></td></tr></tbody></table>"),
    ("<table> <tr> <td>z", "<table> <tbody><tr> <td>z</td></tr></tbody></table>"),
    ("<table><tr><td>1<td>2<tr><th>3<tfoot><tr><td>4", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></tbody><tfoot><tr><td>4</td></tr></tfoot></table>"),
    ("<table><caption>k<tr><td>v", "<table><caption>k</caption><tbody><tr><td>v</td></tr></tbody></table>"),
    ("<table><col><col span=2><td>a", "<table><colgroup><col><col span=\"2\"></colgroup><tbody><tr><td>a</td></tr></tbody></table>"),
    ("<table><input type=hidden name=n><input name=m></table>", "<input name=\"m\"><table><input type=\"hidden\" name=\"n\"></table>"),
    ("<table><tr><td><table><tr><td>in</td></tr></table>out</td></tr></table>after", "<table><tbody><tr><td><table><tbody><tr><td>in</td></tr></tbody></table>out</td></tr></tbody></table>after"),
    ("<td>cell", "cell"),
    ("<table><script>s()</script><tr><td>t", "<table><script>s()</script><tbody><tr><td>t</td></tr></tbody></table>"),
    ("<table><table><tr><td>u", "<table></table><table><tbody><tr><td>u</td></tr></tbody></table>"),
    # misnested and unclosed formatting
    ("<i>a<u>b</i>c</u>", "<i>a<u>b</u></i><u>c</u>"),
    ("<em>a<div>b</em>c</div>", "<em>a</em><div><em>b</em>c</div>"),
    ("<b>a<p>b</b>c<p>d", "<b>a</b><p><b>b</b>c</p><p>d</p>"),
    ("<a href=1>x<div>y<a href=2>z", '<a href="1">x</a><div><a href="1">y</a><a href="2">z</a></div>'),
    ("<p><s>a<p>b<p>c</s>d", "<p><s>a</s></p><p><s>b</s></p><p><s>c</s>d</p>"),
    ("<b><b><b><b><p>x", "<b><b><b><b><p>x</p></b></b></b></b>"),
    ("<table><tr><td><b>in cell<td>next</table>on", "<table><tbody><tr><td><b>in cell</b></td><td>next</td></tr></tbody></table>on"),
    # implied ends
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<h1>a<h2>b</h3>c", "<h1>a</h1><h2>b</h2>c"),
    ("<p>a</div>b<p>c</p></p>", "<p>ab</p><p>c</p><p></p>"),
    ("<button>a<button>b", "<button>a</button><button>b</button>"),
    ("<form>a<form>b</form>c", "<form>ab</form>c"),
    ("<pre>\n\nx</pre><textarea>\n&lt;b></textarea>", "<pre>\nx</pre><textarea>&lt;b&gt;</textarea>"),
    ("<select><option>a<option>b<b>c<optgroup label=g><option>d<div>e</select>f", '<select><option>a</option><option>bc</option><optgroup label="g"><option>de</option></optgroup></select>f'),
    ("<ruby>a<rp>(<rt>b<rp>)</ruby>", "<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>"),
    # foreign elements, templates, references
    ("<svg><path/><g><desc><i>x</i></desc></g></svg>y", "<svg><path></path><g><desc><i>x</i></desc></g></svg>y"),
    ("<svg><a><p>out", "<svg><a></a></svg><p>out</p>"),
    ("<div><template><td>a</template>b</div>", "<div><template><td>a</td></template>b</div>"),
    ("<a title='&amp;&copy=1&copy;&notit;&lt' href=/x/>z", '<a title="&amp;&amp;copy=1©&amp;notit;&lt;" href="/x/">z</a>'),
    ("a<!--b--><!-->c<!--d--!>e<!doctype html><?p?></ x>f", "a<!--b--><!---->c<!--d-->ef"),
    ("x < y & z<a", "x &lt; y &amp; z"),
]


@pytest.mark.parametrize(("html", "want"), CASES)
def test_trees(html, want):
    root = dom.parse(html)
    got = dom.serialise(root)
    assert got == f"<html><head></head><body>{want}</body></html>"


def test_head_and_body():
    got = dom.serialise(dom.parse("<!DOCTYPE html><html lang=x><head>\n<title>a &amp; b</title><meta name=n><noscript><p>no</noscript></head>\n<body class=k><p>c</body></html>d"))
    assert got == '<html lang="x"><head><title>a &amp; b</title><meta name="n"><noscript><p>no</noscript></head><body class="k"><p>cd</p></body></html>'


def sound(root):
    order = list(root._walk())
    assert order == list(root.elements()) and [e.pre for e in order] == list(range(len(order)))
    for e in order:
        assert all(c.parent is e for c in e.kids())
        assert [x.pre for x in e._walk()] == list(range(e.pre, e.last + 1))
        assert dom.texts(e) == [c for x in [e] for c in plain(x)]
        kin = [k for k in e.parent.kids() if k.tag == e.tag] if e.parent else [e]
        assert kin[e.nth - 1] is e and e.depth <= dom.MOST_DEPTH + 1


def plain(e):
    for c in e.children:
        if isinstance(c, dom.Element):
            yield from plain(c)
        elif not isinstance(c, dom.Comment):
            yield c


def test_any_tokens_make_a_sound_tree():
    rng = random.Random(9)
    tags = "a b i p div table tr td tbody caption col select option button form li ul dd svg desc math mi template script title head body html h1 span nobr font textarea frameset noscript".split()
    for _ in range(400):
        html = "".join(rng.choice(["<{}>", "</{}>", "<{} class=c>", "<{}/>", "x", " ", "<!--c-->", "&amp;", "<"]).format(rng.choice(tags)) for _ in range(rng.randrange(60)))
        root = dom.parse(html)
        sound(root)
        again = dom.serialise(root)
        assert [e.tag for e in root.kids()][:2] == ["head", "body"] and isinstance(again, str)


def test_long_and_deep_pages_take_time_in_proportion():
    import time

    def took(n):
        html = "<b><i>" * 5 + "<p>text &amp; more <a href=/x>link</a><table><tr><td>a<p>b</table>" * n
        start = time.perf_counter()
        dom.parse(html)
        return time.perf_counter() - start

    took(50)
    assert took(4000) < 40 * max(took(400), 0.002)
