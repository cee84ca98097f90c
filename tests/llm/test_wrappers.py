"""Main text of pages that are rendered from known articles, and alignments of streams."""

import json
import random
from html import escape

import pytest

from webloom.llm import wrappers as W

WORDS = "river stone über façade light & <dark> moon \"quoted\" it's tea 100% rain wind sand".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def marked(rng, text):
    """A text as it may stand in a page: entities, elements of a line, white space of all kinds."""
    words = [escape(w, quote=rng.random() < 0.5) for w in text.split(" ")]
    for k in range(0, len(words), 7):
        words[k] = rng.choice(["<b>{}</b>", "<a href='/x'>{}</a>", "<em class=lead>{}</em>", "{}", "<!-- note -->{}", "<script>var a='<p>';</script>{}", '<span class="ad">buy this</span>{}', "<span hidden>no</span>{}"]).format(words[k])
    return "".join(w + rng.choice([" ", "\n  ", "\t", "<br>"]) for w in words)


def article(rng):
    out = [("h1", prose(rng, 5))]
    for _ in range(rng.randrange(1, 9)):
        out.append((rng.choice(["p", "p", "p", "h2", "li", "blockquote"]), prose(rng, rng.randrange(8, 40))))
    return out


def body(rng, parts):
    out, inside = "", False
    for tag, text in parts:
        if (tag == "li") != inside:
            out, inside = out + ("</ul>" if inside else "<ul>"), not inside
        end = f"</{tag}>" if tag not in ("p", "li") or rng.random() < 0.5 else ""
        out += f"<{tag}>{marked(rng, text)}{end}\n"
    return out + "</ul>" * inside


def semantic(rng, parts):
    menu = "".join(f'<li><a href="/{k}">{prose(rng, 1)}</a>' for k in range(rng.randrange(2, 9)))
    comments = "".join(f'<article class="comment c{k}"><p>{prose(rng, 30)}</article>' for k in range(rng.randrange(4)))
    ad = f'<div class="ad-slot-{rng.randrange(9)}"><p>{prose(rng, 12)}</p></div>' if rng.random() < 0.5 else ""
    half = len(parts) // 2
    return (
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class='has-sidebar'><header><h2>{prose(rng, 3)}</h2></header><nav><ul>{menu}</ul></nav>"
        f"<div id=cookie-notice>{prose(rng, 20)}</div><main><article id=post-{rng.randrange(999)}><header>{body(rng, parts[:1])}</header>{body(rng, parts[1:half + 1])}{ad}{body(rng, parts[half + 1:])}"
        f"<footer>shared {rng.randrange(99)} times</footer></article><aside>{prose(rng, 60)}</aside><section id=comments><h3>Comments</h3>{comments}</section></main><form action=/s><p>{prose(rng, 9)}<input name=q></form><footer>{prose(rng, 12)}</footer>"
    )


def plain(rng, parts):
    """No element and no name tells: only the host's template does."""
    links = "".join(f"<div><a href='/{k}'>{prose(rng, 2)}</a></div>" for k in range(5))
    return (
        f"<body><div class=x7><div class=q1>{links}</div><div class=q2><p>Join our club of readers today and never miss a story again, whatever you do</p></div>"
        f"<div class=q3><div class=z>{body(rng, parts)}</div></div><div class=q4><p>All of this is written by hand in a small house by the sea</p></div></div>"
    )


def tables(rng, parts):
    return f"<table><tr><td><a href=/a>{prose(rng, 2)}</a><td>" + body(rng, parts) + "</table>"


@pytest.mark.parametrize("render", [semantic, plain, tables])
def test_main_text_is_the_article(spark, render):
    rng = random.Random(4)
    pages, want = [], {}
    for i in range(60):
        parts = article(rng)
        pages.append((i, f"https://h{i % 2}.example.com/{i}", render(rng, parts)))
        want[i] = "\n".join(" ".join(t.split()) for _, t in parts)
    pages += [(100, None, None), (101, "https://h0.example.com/", ""), (102, None, "<p>a &amp; b<p>c"), (102, None, "<p>a &amp; b<p>c"), (103, "no url", "x < y"), (104, "https://h0.example.com/i", "<nav>menu</nav>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS text", "3 AS parts").repartition(3)
    got = W.extracted(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    for i, text in want.items():
        assert by[i].text == text
    assert [by[i].text for i in range(100, 105)] == ["", "", "a & b\nc", "x < y", ""]
    for how in ({"fan_in": 4}, {"sent_bytes": 0}):
        assert sorted(map(tuple, W.extracted(df, **how).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert W.extracted(df.limit(0)).count() == 0


def told(html):
    return W.stream(W.blocks(html))


def form(node):
    """An expression in short: ? by counts of pages, + for repetition."""

    def of(x, n):
        inner = "".join(slot(s, x.n) for s in x.seq)
        return (x.kind + (f"({inner})" if inner else "")) + ("?" if x.n < n else "")

    def slot(s, n):
        kinds = [of(x, n) for x in s.kinds.values()]
        return " " + (("(" + " ".join(kinds) + ")") if len(kinds) > 1 else kinds[0]) + ("+" if s.many else "")

    return of(node, node.n).replace("( ", "(")


def test_mismatches_become_groups_and_slots():
    a, b = "<div><h2>a</h2><ul><li>x<li>y</ul></div>", "<div><h2>b</h2><p>t</p><ul><li>z</ul></div>"
    assert form(W.union(iter([told(a), told(b)]))) == "body(div(h2(#) p(#)? ul(li(#)+)))"
    squares = "<h2>a</h2><p>b</p><h2>c</h2><p>d</p>"
    assert form(told(squares)) == "body((h2(#) p(#))+)"
    turned = form(W.union(iter([told("<h2>a</h2><p>b"), told("<p>b</p><h2>c</h2>")])))
    assert turned in ("body((h2(#) p(#))+)", "body((p(#) h2(#))+)")
    u = W.union(iter([told("<p>a</p><div>same</div>"), told("<p>b</p><div>same</div>")]))
    p, div = (next(iter(s.kinds.values())).seq[0].kinds["#"] for s in u.seq)
    assert p.low != p.high and div.low == div.high  # a slot, and a constant


def test_streams_come_back_and_many_kinds_forget_names():
    node = W.union(iter(told(f"<div class='a b{chr(97 + k % 26)}{chr(97 + k // 26)}x'><p>{k}</p></div>") for k in range(200)))
    assert len([x for s in node.seq for x in s.kinds]) <= W.MOST_KINDS and "div" in {W.bare(k) for s in node.seq for k in s.kinds}
    assert sum(x.chars for x in node.walk()) == sum(len(str(k)) for k in range(200))
    again = W.rebuilt(json.loads(json.dumps(W.shape(node))), iter(W.figures(node)))
    assert W.shape(again) == W.shape(node) and W.figures(again) == W.figures(node)


def test_odd_markup():
    text = lambda html: W.main_text(W.blocks(html), {})
    assert text("<p>one<p title='a > b'>two<br>three<div>four") == "one\ntwo three\nfour"
    assert text("<a <b <c" * 2000) == "<a <b <c" * 2000
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<p>it's <a href=x>a &lt;tag&gt;</a> &#8212; &nope; ok</p>") == "it's a <tag> — &nope; ok"
    assert text("<!-- <p>no</p> <p>none</p>") == ""
    assert text("<p>a</p><script>if (a<b) document.write('</p>')") == "a"
    assert text("<p>" + "long words " * 50_000 + "</p>") == " ".join(["long words"] * 50_000)
