"""Codes of vectors against comparing every part with every entry."""

import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from webloom.llm import vector_codes as V


def plain(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector) in any order; the same in scalar steps."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    near = lambda v, b: min((sum((x - y) ** 2 for x, y in zip(v, e, strict=True)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        after = []
        for p, b in enumerate(books):
            got = defaultdict(list)
            for _, v in kept:
                got[near(cut(v, p), b)[1]].append(cut(v, p))
            after.append([[sum(c) // len(c) for c in zip(*got[k], strict=True)] if k in got else e for k, e in enumerate(b)])
        books = after
    found = [(i, [near(cut(v, p), b) for p, b in enumerate(books)]) for i, v in kept]
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found), key=str), books


def test_nearest_is_exact_with_ties():
    rng = np.random.default_rng(3)
    for spread in (2, 40, 100_000):
        entries = rng.integers(-spread, spread, (200, 5))
        entries[50:60] = entries[3]  # repeated entries
        queries = np.concatenate([rng.integers(-2 * spread, 2 * spread, (700, 5)), entries[:30]])
        at, d = V.nearest(V.ball_tree(entries), entries, queries)
        all_ = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (at == all_.argmin(axis=1)).all() and (d == all_.min(axis=1)).all()
    at, d = V.nearest(V.ball_tree(entries[:1]), entries[:1], queries)
    assert (at == 0).all()
    assert len(V.nearest(V.ball_tree(entries), entries, queries[:0])[0]) == 0


def test_roots_are_exact():
    x = np.array([0, 1, 2, 3, 4, 5, 2**52 - 1, 2**52, (2**30 - 1) ** 2 - 1, (2**30 - 1) ** 2, (2**30 - 1) ** 2 + 1])
    assert V.root_down(x).tolist() == [math.isqrt(k) for k in x.tolist()]
    assert V.root_up(x).tolist() == [math.isqrt(k) + (math.isqrt(k) ** 2 < k) for k in x.tolist()]


def test_coded(spark):
    rng = random.Random(5)
    vectors = [(i, [round(rng.gauss(0, 0.2), 1) for _ in range(8)]) for i in range(400)]
    odd = [(1000, None), (1001, [0.1] * 7 + [None]), (1002, [0.1] * 7 + [float("nan")]), (1003, [float("-inf")] + [0.1] * 7), (1004, [])]
    same = [(7, vectors[7][1]), (7, vectors[8][1]), (None, vectors[9][1])]  # repeated ids and rows
    want, books = plain(vectors + same)
    df = spark.createDataFrame(vectors + odd + same, "vec_id long, embedding array<float>").withColumn("_code", F.lit("x")).withColumn("label", F.lit(None).cast("int")).repartition(5)
    rows, got = V.coded(df)
    assert sorted(map(tuple, rows.select("_row.vec_id", "_code", "_error").collect()), key=str) == want
    assert [b.tolist() for b in got] == books
    assert rows.select("_row._code").distinct().collect() == [("x",)]


def test_coded_few_none_and_uneven(spark):
    few = [(i, [float(i), 0.0, 1.0, -1.0]) for i in range(3)]
    rows, _ = V.coded(spark.createDataFrame(few, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, rows.select("_row.vec_id", "_code", "_error").collect())) == plain(few)[0]
    rows, books = V.coded(spark.createDataFrame(few, "vec_id long, embedding array<double>").limit(0))
    assert rows.count() == 0 and sum(len(b) for b in books) == 0
    mixed = [(i, [0.5] * 6) for i in range(5)] + [(9, [1.0] * 4), (10, [1e30] * 6)]
    rows, books = V.coded(spark.createDataFrame(mixed, "vec_id long, embedding array<double>"))
    assert [b.shape[1] for b in books] == [2, 2, 1, 1]
    assert {r[0] for r in rows.select("_row.vec_id").collect()} == {0, 1, 2, 3, 4}


def test_query_sums_labels(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, [rng.random() for _ in range(4)], None if i % 3 == 0 else i % 2) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = V.query(spark, str(tmp_path)).collect()
    total = defaultdict(int)
    label = {i: k for i, _, k in rows}
    for r in got:
        total[label[r.vec_id]] += r.error
    assert len(got) == 300 and all(r.label_error == total[label[r.vec_id]] for r in got) and len(total) == 3
