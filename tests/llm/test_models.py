"""Trained operators: samples that are never empty, held-out rows, and scores against plain sets and scalar sums."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import language_id, quality_mil
from webloom.llm.tables import last_code

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_last_code():
    assert last_code(1.0, 5) == 2**63 - 1 and last_code(0.5, 0) == 2**62 - 1
    assert last_code(1e-30, 77) == 77 and last_code(0.0, 0) == 0
    assert last_code(3e-7, 0) == int(3e-7 * 2**63) - 1 > 0


def test_languages_are_learned_from_the_smallest_part(spark, docs):
    model = language_id.train(docs.where(~language_id.held_out()), train_docs=1, train_chars=1)
    assert model.languages == sorted(r.lang for r in docs.select("lang").distinct().collect() if r.lang)
    assert all(((model.cells[0] >> np.uint64(i)) & np.uint64(1)).any() for i in range(len(model.languages)))
    got = language_id.predicted(docs, model, keep=("lang",)).collect()
    assert len({r.lang_pred for r in got} - {"und"}) == len(model.languages)
    assert sum(r.lang == r.lang_pred for r in got) > 0.5 * len(got)
    assert language_id.in_known_language(docs, model).count() > 0.3 * docs.count()


def test_language_by_plain_sets(spark, docs):
    """Without filters: the n-grams that are typical of a language as a set each, all held-out rows."""
    learn = docs.where(~language_id.held_out()).where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").collect()
    model = language_id.train(docs.where(~language_id.held_out()))
    count = defaultdict(Counter)
    for r in learn:
        found, _, _ = language_id.grams([r.text], language_id.SIZES)
        count[r.lang].update(g for part in found for g in part.tolist())
    count = {k: {g: n for g, n in c.items() if n >= language_id.LEAST_COUNT} for k, c in count.items()}
    weight = {k: sum(c.values()) for k, c in count.items()}
    most = defaultdict(float)
    for k, c in count.items():
        for g, n in c.items():
            most[g] = max(most[g], n / weight[k])
    typical = {k: {g for g, n in c.items() if n / weight[k] * language_id.RATIO >= most[g]} for k, c in count.items()}
    rows = docs.where(language_id.held_out()).select("text").collect()
    names, score, fit = model.decide([r.text or "" for r in rows], language_id.SIZES)
    right = 0
    for r, name, s, f in zip(rows, names, score, fit, strict=True):
        found, _, has = language_id.grams([r.text or ""], language_id.SIZES)
        grams = [g for part in found for g in part.tolist()]
        if not has[0]:
            assert name == "und"
            continue
        share = {k: sum(g in t for g in grams) / max(len(grams), 1) for k, t in typical.items()}
        best = sorted(share.values())
        if best[-1] - best[-2] > 0.02:
            assert share[name] == best[-1]
            right += 1
        # false positives are corrected for on the whole; a text of few n-grams can be off by some
        assert abs(f - share[name]) < 0.02 + 2 / math.sqrt(max(len(grams), 1)) and abs(s - share[name] / max(sum(share.values()), 1e-12)) < 0.05 + 2 / math.sqrt(max(len(grams), 1))
    assert right > 0.8 * len(rows)


def test_language_of_held_out_rows(docs):
    model = language_id.train(docs.where(~language_id.held_out()))
    got = language_id.predicted(docs.where(language_id.held_out()), model, keep=("lang", "text")).where("lang IS NOT NULL AND length(text) > 20").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert language_id.predicted(docs.limit(0), model).count() == 0 and language_id.in_known_language(docs.limit(0), model).count() == 0


def test_quality_of_held_out_rows_and_scalar_scores(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality_mil.train(docs.where(~quality_mil.held_out()), labels.where(~quality_mil.held_out()), epochs=20)
    rows = docs.where(quality_mil.held_out())
    got = quality_mil.scored(rows, model, keep=("doc_id", "text")).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.doc_id in known]
    assert len(held) >= 8 and sum(known[r.doc_id] == r.predicted for r in held) >= 0.85 * len(held)
    p, sigmoid = model.p, lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    for r in got[:12]:
        x, per = quality_mil.passages(spark.createDataFrame([(r.text or "",)], "t string").toArrow()["t"].combine_chunks())
        assert int(per[0]) == r.passages == len(x)
        hidden, weight = [], []
        for row in x.astype(np.float64):
            u = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale, strict=True)]
            h = [math.tanh(sum(a * b for a, b in zip(u, p["W"][:, k], strict=True)) + p["b"][k]) for k in range(p["W"].shape[1])]
            gate = [math.tanh(sum(a * b for a, b in zip(h, p["V"][:, k], strict=True))) * sigmoid(sum(a * b for a, b in zip(h, p["U"][:, k], strict=True))) for k in range(p["V"].shape[1])]
            hidden.append(h)
            weight.append(sum(g * w for g, w in zip(gate, p["w"], strict=True)))
        top = max(weight)
        soft = [math.exp(w - top) for w in weight]
        z = [sum(a * h[k] for a, h in zip(soft, hidden, strict=True)) / sum(soft) for k in range(len(hidden[0]))]
        assert abs(sigmoid(sum(a * b for a, b in zip(z, p["c"], strict=True)) + float(p["d"][0])) - r.score) < 1e-6
    assert quality_mil.scored(docs.limit(0), model).count() == 0


def test_quality_is_learned_from_one_row_at_least(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = {r.score for r in quality_mil.scored(docs, quality_mil.train(docs, labels, train_docs=1, train_chars=1, epochs=1)).collect()}
    assert scores != {0.5}  # that is what nothing at all was learned from
    assert quality_mil.train(docs.withColumn("more", F.lit(1)), labels, train_docs=3, epochs=1) is not None
