"""Operators that compare documents or order them, and the pipeline, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import mixing, ngram_join, substring_dedup, tally
from webloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def passages(seed=5, n=150):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcé") + str(rng.randrange(30)) for _ in range(k)) for k in (34, 35, 36, 40, 60, 100)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            if rng.random() < 0.5:
                p = rng.choice(shared).split()
                parts.append(" ".join(p[rng.randrange(6) : len(p) - rng.randrange(3)]))
            parts.append("\n ".join(rng.choice("abc") + str(rng.randrange(1000)) for _ in range(rng.randrange(40))))
        out.append((i, "  ".join(parts)))
    return [*out, (500, None), (501, ""), (501, ""), (5, out[5][1]), (None, out[7][1]), (502, "x " * 80)]


def test_substring_dedup(spark):
    docs = passages()
    count = Counter()
    words = [WORD.findall(t or "") for _, t in docs]
    for w in words:
        count.update(tuple(w[a : a + 35]) for a in range(len(w) - 34))
    want = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = {j for a in range(len(w) - 34) if count[tuple(w[a : a + 35])] > 1 for j in range(a, a + 35)}
        rest = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest(), rest))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("_key", F.lit(1)).withColumn("places", F.lit(1))
    got = substring_dedup.deduplicated(df, texts=True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert substring_dedup.deduplicated(df.limit(0)).count() == 0


def near(seed=7, n=160):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [rng.choice("abcdefgh") + str(rng.randrange(12)) for _ in range(rng.randrange(80))] if i % 4 == 0 else (rng.choice(out)[1] or "").split()
        for _ in range(rng.randrange(3) * (i % 4 > 0)):
            if w:
                w[rng.randrange(len(w))] = "z" + str(rng.randrange(99))
        out.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    star = [f"s{k}" for k in range(100)]
    out += [(300 + k, " ".join([*star[:k], "changed", *star[k + 1 :]])) for k in range(40)] + [(290, " ".join(star))]
    return [*out, (401, None), (402, ""), (402, "A b"), (403, "a B"), (404, " a"), (None, out[9][1]), (405, "q w e r t y")]


def classes(docs, n, percent):
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[a : a + n]) for a in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for x, s in enumerate(sets):
        for g in s:
            holders[g].append(x)
    for x, s in enumerate(sets):
        for y, both in Counter(y for g in s for y in holders[g] if y > x).items():
            if 100 * both >= percent * (len(s) + len(sets[y]) - both):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(docs):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return sorted([(i, len(sets[x]), least.get(root(x)) if sets[x] else i) for x, (i, _) in enumerate(docs)], key=str)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, n, percent):
    docs = near()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("v", F.lit(1)).withColumn("gram", F.lit(1))
    got = ngram_join.joined(df, n, percent)
    assert sorted(map(tuple, got.collect()), key=str) == classes(docs, n, percent)


def test_representatives(spark):
    docs = near()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_row", F.lit(1)).withColumn("_id", F.lit(1))
    kept = ngram_join.representatives(df, 5, 80)
    assert kept.columns == df.columns
    want = [i for i, n, c in classes(docs, 5, 80) if n and i == c]
    assert sorted({r.doc_id for r in kept.where(r"text RLIKE '[^\\s]'").collect()}) == sorted(set(want))
    assert ngram_join.representatives(df.limit(0)).count() == 0


def test_representatives_go_by_row_not_by_id(spark):
    """Unlike documents stay whatever their ids, null or equal; of copies one stays."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near_a = a.replace("a30", "z")
    rows = [(None, a), (None, b), (7, near_a), (7, c), (3, a), (7, c), (None, b), (9, ""), (9, None)]
    kept = [tuple(r) for r in ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (None, b), (7, c), (9, ""), (9, None)], key=str)


def test_prefix_lengths_lose_no_pair():
    import numpy as np

    for percent in (80, 90):
        for a in range(1, 60):
            for b in range(a, 60):
                need = -(-percent * (a + b) // (100 + percent))
                if need <= a:  # the least intersection leaves no room outside of both prefixes
                    pa, pb = ngram_join.prefix_length(np.array([a, b]), percent)
                    assert a - pa < need or b - pb < need


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_pass_at_their_first_shared_ngram(spark, percent):
    """And the smaller one is early there, so that it is a hub."""
    rng = random.Random(percent)
    rows, want = [], 0
    for _ in range(400):
        n, size = rng.randrange(1, 80), rng.randrange(1, 80)
        own = rng.sample(range(100), n)
        other = rng.sample(own, min(n, size)) if rng.random() < 0.5 else [*own[: rng.randrange(n + 1)], *range(100, 100 + rng.randrange(12))]
        a, b = sorted((sorted(own), sorted(other)), key=len)
        both = set(a) & set(b)
        if both and 100 * len(both) >= percent * len({*a, *b}):
            want += 1
            rows.append((len(a), a.index(min(both)), len(b), b.index(min(both)), *[0] * 16))
    names = [f"{h}{p}" for h in ("", "h") for p in ngram_join._PARITIES]
    df = spark.createDataFrame(rows, f"n long, place long, hn long, hplace long, {', '.join(f'{x} long' for x in names)}")
    assert want > 50 and df.where(ngram_join._early(percent)).where(ngram_join._may_be_similar(percent)).count() == want


def test_unlike_documents_of_one_template_make_no_pairs(spark, monkeypatch):
    """Each shares 5-grams of its prefix with all others, but too late to be similar to any (0.79 of 0.8)."""
    template = " ".join(f"t{k}" for k in range(200))
    rows = [(i, template + "".join(f" own{i}-{k}" for k in range(26))) for i in range(60)]
    made, stored = [], ngram_join.stored

    def counting(df, name):
        out = stored(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "stored", counting)
    df = spark.createDataFrame([*rows, (100, rows[7][1] + " more")], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.representatives(df, 5, 80).collect()) == list(range(60))
    assert sum(made) < 5


def test_ngrams_of_one_document_go_first(spark):
    """Without room in the table of frequent n-grams too: prefixes of n-grams that no other set has make no candidates."""
    rows = [(k, " ".join([*(f"s{j}" for j in range(40)), *(f"own{k}-{j}" for j in range(40))])) for k in range(6)]
    vertices = ngram_join.vertices_of(spark.createDataFrame(rows, "doc_id long, text string"), 3, "doc_id", "text")
    sets = vertices.select("v", "grams").cache()
    held = [ngram_join.unpack(r.grams) for r in sets.collect()]
    often = {g for g, n in Counter(g for h in held for g in h.tolist()).items() if n > 1}
    assert len(often) == 38
    for most in (0, 10, 1 << 19):
        order = ngram_join.order_of(sets, 32, most)
        for h in held:
            first = order.sort(h, np.zeros(len(h), np.int64)).tolist()
            assert sorted(first) == h.tolist() and not often & set(first[: len(h) - len(often)])
    order = ngram_join.order_of(sets, 32, 0, 0)
    assert order.shared is None and order.sort(held[0], np.zeros(len(held[0]), np.int64)).tolist() == held[0].tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70)]
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 70: 50, 100: 50}


def earliest_deadline_first(parts, blocks):
    """(source index, block, slot, release, deadline) of every block, with exact fractions; windows start anew when a source is used up."""
    done, out, t = [0] * len(parts), [], 0
    while any(d < b for d, b in zip(done, blocks)):
        live = [i for i, (d, b) in enumerate(zip(done, blocks)) if d < b]
        w = {i: parts[i] for i in live} if any(parts[i] for i in live) else dict.fromkeys(live, 1)
        w = {i: Fraction(p, sum(w.values())) for i, p in w.items() if p}
        since, count = t, dict.fromkeys(w, 0)
        while all(done[i] < blocks[i] for i in w):
            due, i = min((math.ceil((count[i] + 1) / w[i]), i) for i in w if math.floor(count[i] / w[i]) <= t - since)
            out.append((i, done[i], t, since + math.floor(count[i] / w[i]), since + due))
            done[i] += 1
            count[i] += 1
            t += 1
    return out


@pytest.mark.parametrize("weights", [None, {"s0": 0.9995, "s1": 0.0005, "s2": 0.0}, {"s0": 3, "s1": float("nan"), "s3": 1}, {}])
def test_mixing(spark, weights):
    rng = random.Random(3)
    rows = [(i, rng.choice(["s0", "s0", "s0", "s1", "s2", "s3", None, ""])) for i in range(400)] + [(None, "s1"), (7, rng.choice(["s0", "s1"]))]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(3).withColumn("n", F.lit(1)).withColumn("block", F.lit(1)).withColumn("_deal", F.lit(1))
    got = mixing.schedule(df, weights, block_docs=4).collect()
    counts = Counter(s for _, s in rows)
    sources = sorted(counts, key=lambda s: (s is None, s or ""))
    raw = [math.sqrt(counts[s]) if weights is None else max(0.0, weights.get(s, 0.0) if s is not None else 0.0) for s in sources]
    raw = [0.0 if math.isnan(x) else x for x in raw]
    exact = [mixing.PRECISION * x / sum(raw) if sum(raw) else 0.0 for x in raw]
    parts = [math.floor(x) for x in exact]
    for k in sorted(range(len(raw)), key=lambda k: parts[k] - exact[k])[: mixing.PRECISION - sum(parts) if sum(raw) else 0]:
        parts[k] += 1
    blocks = [-(-counts[s] // 4) for s in sources]
    plan = {(i, b): (slot, release, due) for i, b, slot, release, due in earliest_deadline_first(parts, blocks)}
    assert all(release <= slot < due for slot, release, due in plan.values())
    want = Counter()
    for k, s in enumerate(sources):
        ids = sorted((i for i, x in rows if x == s), key=lambda i: (hashlib.md5(str("" if i is None else i).encode()).hexdigest(), i or 0))
        for rank, i in enumerate(ids):
            slot, release, due = plan[k, rank // 4]
            want[i, s, rank // 4, rank % 4, release, due, slot] += 1
    assert Counter(map(tuple, got)) == want
    # against the weights themselves, until a source is used up
    order = [i for (i, _), _ in sorted(plan.items(), key=lambda x: x[1])]
    for t in range(len(order)):
        if any(order[:t].count(i) >= blocks[i] for i in range(len(sources)) if raw[i]) or not sum(raw):
            break
        assert all(abs(order[:t].count(i) - t * x / sum(raw)) < 1 for i, x in enumerate(raw))
    assert mixing.schedule(df.limit(0)).count() == 0


def test_many_sources_keep_their_shares(spark):
    """150 sources, of which one has half of the weight, over a schedule of several strides."""
    counts = spark.range(150).select(F.concat(F.lit("s"), F.col("id")).alias("source"), F.when(F.col("id") == 0, 300).otherwise(4).alias("n")).coalesce(1)
    weights = {"s0": 0.5} | {f"s{k}": 0.5 / 149 for k in range(1, 150)}
    rows = mixing.pattern(mixing.shares(counts, weights, block_docs=1)).collect()
    order = [r.source for r in sorted(rows, key=lambda r: r.slot)]
    assert [r.slot for r in sorted(rows, key=lambda r: r.slot)] == list(range(896))
    seen = Counter()
    for t, s in enumerate(order[:590], 1):  # no source is used up before
        seen[s] += 1
        assert abs(seen["s0"] - t * 0.5) < 1 and abs(seen["s7"] - t * weights["s7"]) < 1
    larger = mixing.shares(counts, weights, block_docs=1, most_blocks=100).collect()
    assert {r.block_docs for r in larger} == {9} and sum(r.blocks for r in larger) <= 100 + 150


def test_mixed_keeps_rows_and_columns(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit(1).alias("turns"), F.lit(2).alias("_row"))
    out = mixing.mixed(df, block_docs=8)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_pipeline(spark):
    """Every stage against what it was given."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(90_001, "12 34 !!", "en", "src1", 8), (90_002, None, "en", None, None)], docs.schema)
    docs = docs.union(extra).cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mix", "tokens"]
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, at, "").cache()
        before = {r.doc_id: r for r in at.collect()}
        now = after.collect()
        if name != "tokens":
            assert after.columns == docs.columns
        if name == "language":
            assert not {90_001, 90_002} & {r.doc_id for r in now} and len(now) >= 0.98 * len(before)
        elif name == "near_duplicates":
            same = classes([(r.doc_id, r.text) for r in before.values()], 5, 80)
            assert sorted(r.doc_id for r in now) == sorted(i for i, n, c in same if not n or i == c)
        elif name == "personal_data":
            assert len(now) == len(before) and not any("@" in (r.text or "") and re.search(r"\w@\w+\.\w", r.text) for r in now)
            assert sum(r.text == before[r.doc_id].text for r in now) > 0.8 * len(now)
        else:
            assert sorted(r.doc_id for r in now) == sorted(before)
        at = after


def test_pipeline_result_has_the_mix(spark, tmp_path):
    """However many files the mix is read from, slot and place are in the result."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10_000))
    corpus_pipeline.mix(spark, docs, "").repartition(7).write.parquet(str(tmp_path / "mix"))
    got = corpus_pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mix")), "").collect()
    want = {r.doc_id: (r.source, r.slot, r.place) for r in mixing.schedule(docs).collect()}
    assert {r.doc_id: (r.source, r.slot, r.place) for r in got} == want and len(got) == len(want)
    assert len({(r.slot, r.place) for r in got}) == len(got)


def test_packed_sets_and_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 500):
        h = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        assert (tally.unpack(tally.pack(h)) == h).all()
        packed = ngram_join.pack_sets(np.concatenate((h, h)), np.repeat([0, 2], len(h)), 3)
        assert [ngram_join.unpack(x.as_buffer()).tolist() for x in packed] == [np.unique(h >> np.uint64(8)).tolist(), [], np.unique(h >> np.uint64(8)).tolist()]
    for _ in range(300):
        pool = np.unique(rng.integers(0, 1 << 40, 120).astype(np.uint64))
        a, b = (np.sort(rng.permutation(pool)[: rng.integers(90, len(pool) + 1)]) for _ in range(2))
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert ngram_join.similar(a, b, 80) == (100 * both >= 80 * either)
