"""Variant groups against trying all edits of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from webloom.llm import spelling as S

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def edits(w, letters=LETTERS):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return out - {w}


def plain_words(docs, least_chars=5, least=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= least_chars and k >= least}


def plain_groups(n):
    near = {w: [e for e in edits(w) if e in n] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def corpus(seed=2):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcéÀß") for _ in range(rng.randrange(3, 9))) for _ in range(40)]
    docs = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(120)):
            w = base[min(int(rng.expovariate(0.2)), 39)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k:], w[:k] + rng.choice("abcÿ") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", ", ", "_1", "\n"]).join(words)))
    long = "abcde " * 3000 + "x" * 5000 + " " + "x" * 5000 + "y " + "x" * 5000 + " " + ("x" * 5000 + " " + "x" * 5000 + "y ") * 3
    return [*docs, (None, None), (None, "abcde abcde"), (1, docs[1][1]), (1, docs[1][1]), (900, ""), (901, "12 -- ."), (902, long)]


def test_neighbours_are_those_of_all_edits():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abzÀÿ") for _ in range(rng.randrange(1, 7))) for _ in range(700)})
    shard = S.Trie.of(S.trie(words, np.arange(len(words))).parts())
    place = {w: i for i, w in enumerate(words)}
    asked = [*words[:300], "zz", "aaaaaaaaab", "ÿ", ""]
    got = [(int(q), int(h)) for a, b in S.neighbours(shard, asked) for q, h in zip(a, b, strict=True)]
    want = [(q, place[e]) for q, w in enumerate(asked) for e in edits(w, "abzÀÿ") if e in place]
    assert sorted(got) == sorted(want) and len(want) > 1000
    assert list(S.neighbours(S.trie(["é"], np.array([3])), [])) == []


def test_small_blocks_follow_the_same_states(monkeypatch):
    monkeypatch.setattr(S, "STATES", 5)
    words = sorted({w for x in ("banana", "bananas", "anna") for w in edits(x, "abns")})
    shard = S.trie(words, np.ones(len(words), np.int64))
    got = sorted((int(q), words[h]) for a, b in S.neighbours(shard, ["banana", "anna"]) for q, h in zip(a, b, strict=True))
    assert got == sorted([(0, w) for w in edits("banana", "abns")] + [(1, w) for w in edits("anna", "abns")])


def test_words_and_groups(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("w")).repartition(3)
    counted = S.words(df)
    want = plain_words(docs)
    assert {r.word: r.n for r in counted.collect()} == want and len(want) > 100
    for shard_chars, sent in ((1 << 20, 1 << 26), (150, 4000)):  # one shard; many, sent in rounds
        got = S.grouped(counted, shard_chars=shard_chars, sent_bytes=sent)
        assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == plain_groups(want)
    assert S.grouped(S.words(df.limit(0))).count() == 0


def test_ties_go_to_the_smallest_word(spark):
    counted = spark.createDataFrame([("haben", 3), ("habet", 6), ("habe", 6), ("habed", 5), ("xhaben", 6)], "word string, n long")
    got = {r.word: (r.form, r.n_near, r.form_n) for r in S.grouped(counted).collect()}
    assert got["haben"] == ("habe", 4, 6) and got["habe"] == (None, 3, None) and got["habed"] == (None, 3, None)
