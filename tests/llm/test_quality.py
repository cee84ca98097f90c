"""Verdicts of quality rules against plain Python, long texts and other scripts among them."""

import math
import random
import re

from pyspark.sql import functions as F

from webloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def verdict(text):
    """The names of the rules that a text fails, and whether it fails the base."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for a in range(n - 7):
        seen.setdefault(tuple(words[a : a + 8]), []).append(a)
    again = {a + k for places in seen.values() if len(places) > 1 for a in places for k in range(8)}
    chars, symbols = sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>")
    other = len(text.encode()) > 1.5 * len(text)
    failed = []
    if n < 20:
        failed.append("length")
    if not 2 <= chars / max(n, 1) <= 15:
        failed.append("word_length")
    if symbols / max(n, 1) > 0.25:
        failed.append("symbols")
    if n >= 50 and not other and sum(w.lower() in Q.STOP_WORDS for w in words) / n < 0.02:
        failed.append("stop_words")
    if lines and (len(lines) - len(set(lines))) / len(lines) > 0.5:
        failed.append("repeated_lines")
    if n and len(again) / n > 0.3:
        failed.append("repeated_words")
    if n >= 20 and len(set(words)) / math.sqrt(n) < 1:
        failed.append("word_variety")
    if n and sum(a == b for a, b in zip(words, words[1:], strict=False)) / n > 0.3:
        failed.append("runs")
    return failed, n < 20 or 100 * len(again) > 30 * n


def texts():
    rng = random.Random(4)
    natural = lambda n: " ".join(rng.choice(["the", "of", "and", *(f"w{int(rng.paretovariate(0.7)) % 50_000}" for _ in range(4))]) for _ in range(n))
    cyrillic = " ".join("".join(rng.choice("абвгдежзик") for _ in range(5)) for _ in range(300))
    few = " ".join(rng.choice(["one", "of", "five", "words", "here"]) for _ in range(400))
    out = [natural(n) for n in (0, 1, 19, 20, 49, 50, 300, 30_000)] + [cyrillic, few, "a b " * 60, "same line of text\n" * 12, "x" * 400, "# " * 30 + natural(20), "der die das " * 10, "zorg blip " + " ".join(f"q{k}" for k in range(80)), None, ""]
    return [(i, t) for i, t in enumerate(out)] + [(3, out[3]), (None, out[6])]


def test_verdicts(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("failed", F.lit("x")).withColumn("n_words", F.lit(-1)).repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.failed, r.base_failed, r.kept) for r in Q.quality(df).collect()), key=str)
    want = []
    for i, t in rows:
        failed, base = verdict(t)
        want.append((i, len(WORD.findall(t or "")), ",".join(failed), base, not base and not failed))
    assert got == sorted(want, key=str)
    kept = {i for i, *_, k in got if k}
    assert {3, 5, 6, 7, 8} <= kept  # natural texts of any length, and another script


def test_no_text_is_too_long():
    assert all(r.most is None or r.metric != "n_words" for r in Q.RULES)
    # of 10^8 words a natural text has a hundred thousand different ones at least
    variety = next(r for r in Q.RULES if r.name == "word_variety")
    assert 100_000 / math.sqrt(10**8) >= variety.least
