"""Converters of fetched bodies, and JSON that is laid out anew without being changed."""

import json
import random

import pytest

from webloom.sources import convert


def test_json_is_laid_out_as_it_is():
    assert convert.indented('{"b":1,"a":[],"b":{"x":[1,{"y":null}]}}') == '{\n  "b": 1,\n  "a": [],\n  "b": {\n    "x": [\n      1,\n      {\n        "y": null\n      }\n    ]\n  }\n}'
    assert convert.indented(' 12345678901234567890.10e+5 ') == "12345678901234567890.10e+5"
    assert convert.indented('["a, {b}: \\"c\\" \\u00e9"]') == '[\n  "a, {b}: \\"c\\" \\u00e9"\n]'
    rng = random.Random(2)

    def any_value(depth):
        return rng.choice([lambda: rng.random(), lambda: rng.randrange(99), lambda: "".join(rng.choice('a"\\{}[],: é\n') for _ in range(5)), lambda: None, lambda: True, lambda: [any_value(depth - 1) for _ in range(rng.randrange(4))] if depth else [], lambda: {str(k): any_value(depth - 1) for k in range(rng.randrange(4))} if depth else {}])()

    for _ in range(200):
        value = any_value(4)
        assert convert.indented(json.dumps(value, separators=(",", ":"))) == json.dumps(value, indent=2)
    for bad in ("", "{", "[1,]", "NaN", "{'a':1}", "1 2"):
        with pytest.raises(ValueError):
            convert.indented(bad)


def test_kinds():
    assert convert.convert("https://e.org/a/doc.html", "text/html", b"<title>T</title><p>short")[:2] == ("html", "T")
    assert convert.convert("https://e.org/", "", b"<rss")[0] in ("feed", "text", "html")
    assert convert.convert("", "", b"") == ("text", "", "```\n\n```\n")
    assert convert.convert("https://e.org/x%20y.png?z", "", b"GIF89a\x02\x00\x03\x00")[2].splitlines()[2:5] == ["- filename: x y.png", "- type: `gif`", "- dimensions: 2×3"]
    assert "dimensions: unknown" in convert.convert("", "image/webp", b"RIFF0000WEBP")[2]
    assert convert.convert("https://[bad", "application/pdf", b"%PDF-1")[0] == "pdf"


def test_frame(spark):
    rows = [(1, "https://e.org/j", "application/json", b'{"a":1}'), (2, None, None, None), (1, "https://e.org/j", "application/json", b'{"a":1}')]
    df = spark.createDataFrame(rows, "id long, url string, content_type string, body binary").selectExpr("*", "1 AS kind")
    got = [tuple(r) for r in convert.converted(df).collect()]
    assert sorted(got) == [(1, "json", "j", '```json\n{\n  "a": 1\n}\n```\n')] * 2 + [(2, "text", "", "```\n\n```\n")]
    assert convert.converted(df.limit(0)).count() == 0
