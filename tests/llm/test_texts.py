"""Operators on single texts: rules, language, BPE, quality, personal data, language model, media."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webloom.llm import bpe, language_id, lm_scoring, media, pii, quality_mil, quality_rules
from webloom.llm.textarrays import LETTERS, as_long, words_of

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "a", "é\x0b b\xa0c", "x" * 30_000, "w " * 15_000, "a b c d e f g h i " * 3, "#*$ <|> & %\n#*$ <|> & %\n\nz"]


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents, odd ones, a repeated row, a null id, and columns whose names operators use themselves."""
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_000 + i, t, "en") for i, t in enumerate(ODD)] + [(10_001, "", "en"), (None, "no id here", None)], "doc_id long, text string, lang string")
    df = real.union(odd)
    for name in ("_text", "_key", "_words", "score", "v", "n", "kind", "spans"):
        df = df.withColumn(name, F.lit(1))
    return df.cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def by_text(rows, found, *columns):
    """Results in the order of ids, so that rows with equal ids can be compared as bags."""
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)


def test_words(rows):
    import pyarrow as pa

    for lower in (False, True):
        texts = [t for _, t in rows]
        w = words_of(pa.array(texts), lower)
        want = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t) for t in texts]
        assert w.counts.tolist() == list(map(len, want))
        names = {}
        for word, h in zip([x for t in want for x in t], w.hashes.tolist(), strict=True):
            assert names.setdefault(h, word) == word
        assert len(set(names.values())) == len(names)


def rule_figures(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(docs, rows):
    got = by_text(rows, quality_rules.quality(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((i, *rule_figures(t)) for i, t in rows), key=str)
    assert quality_rules.quality(docs).where("base_failed AND kept").count() == 0
    only = quality_rules.quality(docs, (quality_rules.Rule("r", "n_words", most=50, from_words=10),))
    assert only.where("failed = 'r'").count() == sum(50 < len(WORD.findall(t)) for _, t in rows)
    assert quality_rules.quality(docs.limit(0)).count() == 0


def test_language_id(spark, docs):
    model = language_id.train(docs.where(~language_id.held_out()))
    got = language_id.predicted(docs, model, keep=("doc_id", "lang", "text")).collect()
    assert len(got) == docs.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    real = [r for r in got if r.doc_id is not None and r.doc_id < 10_000]
    assert sum(r.lang == r.lang_pred for r in real) >= 0.97 * len(real)
    assert all(0 <= r.score <= 1 for r in got)
    kept = language_id.in_known_language(docs, model)
    assert kept.columns == docs.columns and kept.where("text IS NULL OR text = ''").count() == 0
    none = language_id.train(docs.where("false"))
    assert {r.lang_pred for r in language_id.predicted(docs, none).collect()} == {"und"}
    # probes find all that was put in, in the right language
    gram = np.arange(1, 2000, dtype=np.uint64) * np.uint64(7919)
    f = language_id.BitmaskFilter.build(["a", "b"], "a", gram, (np.arange(1999) % 2).astype(np.int64))
    assert ((f.probe(gram, 0) >> (np.arange(1999) % 2).astype(np.uint64)) & np.uint64(1)).all()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe(docs, rows, library):
    def want(t):
        ids = library.encode(t, add_special_tokens=False).ids
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = by_text(rows, bpe.encoded(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(((i, *want(t)) for i, t in rows), key=str)
    with_ids = bpe.encoded(docs, ids=True)
    back = bpe.decoded(with_ids).where("doc_id = 10003").first()
    assert (back.tokens, back.text) == ("a</w>", "a")
    assert bpe.encoded(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aAbnit'sé \n1<|>endoftextstar", max_size=60)))
def test_bpe_any_text(text):
    encoder = bpe._encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    global _LIBRARY
    _LIBRARY = globals().get("_LIBRARY") or Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = _LIBRARY.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == ids
    assert encoder.decode(ids) == _LIBRARY.decode(ids, skip_special_tokens=False)


def test_quality_mil(spark, docs, rows):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality_mil.train(docs.where(~quality_mil.held_out()), labels.where(~quality_mil.held_out()), epochs=20)
    got = quality_mil.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.doc_id in known]
    assert sum(known[r.doc_id] == r.predicted for r in held) >= 0.9 * len(held)
    assert {r.score for r in quality_mil.scored(docs, quality_mil.train(docs, labels.where("false"))).collect()} == {0.5}


def test_gradient_of_attention():
    rng = np.random.default_rng(1)
    x, per, label = rng.normal(size=(7, quality_mil.FEATURES)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    m = quality_mil.GatedAttention.fit(x.astype(np.float32), per, label, epochs=1)
    first = np.cumsum(per) - per
    loss = lambda: -np.mean(label * np.log(m.forward(x, first)["y"]) + (1 - label) * np.log(1 - m.forward(x, first)["y"]))
    for name, g in m._gradient(x, first, label).items():
        at = (0,) * g.ndim
        keep = m.p[name][at]
        decay = 1e-4 * keep if g.ndim == 2 else 0
        m.p[name][at] = keep + 1e-5
        up = loss()
        m.p[name][at] = keep - 1e-5
        down = loss()
        m.p[name][at] = keep
        assert abs((up - down) / 2e-5 - (g[at] - decay)) < 1e-5


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_of(t):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])]
            fine = {"email": True, "ip": name == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0, "phone": 9 <= len(d) <= 15}[name]
            if fine:
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "0", ".", "@", "a", "-", "+", " ", "(", "é", "4111111111111111", "192.168.0.1", "x@y.z", "+1 (415) 555-0100"]), max_size=20).map("".join))
def test_patterns(text):
    assert pii.base_spans(text) == spans_of(text)


def test_patterns_are_linear():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "+1" * 100_000, "a@" * 100_000, "1." * 100_000):
        pii.base_spans(text)


def test_personal_data(spark, docs, rows):
    got = by_text(rows, pii.detected(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    shown = lambda s: hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in s).encode()).hexdigest()
    assert got == sorted(((i, *[sum(x[0] == k for x in s) for k in range(4)], shown(s)) for i, s in ((i, spans_of(t)) for i, t in rows)), key=str)
    assert pii.detected(docs.limit(0)).count() == 0


def test_terms_that_disclose(spark):
    texts = [f"plain words number {w} about nothing" for w in "abcdefgh"] + ["call Zanzibar at +1 415 555 0100 now", "write Zanzibar or +1-415-555-0100 maybe", "words about nothing at all"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.detected(df).collect()}
    assert all(not found[i] for i in (*range(8), 10))
    assert "term:5:13" in found[8].split(",") and "term:6:14" in found[9].split(",")
    clean = {r.doc_id: r.text for r in pii.sanitised(df.withColumn("terms", F.lit(0))).collect()}
    assert "Zanzibar" not in clean[8] + clean[9] and "<PHONE>" in clean[8] and clean[0] == texts[0]


def test_terms_that_disclose_go_wherever_they_stand(spark):
    """Far from the mention, in texts without any pattern, whatever the case, and short ones too."""
    far = " and so on" * 30
    texts = [f"plain words number {w} about nothing" for w in "abcdefghijklmnopqrstuvwxyz"] * 20
    texts += [f"call Zanzibar or Bo at +1 415 555 0100 now{far} ZANZIBAR é Bo", "write Zanzibar or Bo: +1-415-555-0100 maybe", "nothing but zanzibar, bo"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    clean = [r.text.lower() for r in pii.sanitised(df).orderBy("doc_id").collect()]
    assert not any(re.search(r"\b(zanzibar|bo)\b", t) for t in clean) and clean[:520] == texts[:520]
    spans = {r.doc_id: (r.spans, r.n_term) for r in pii.detected(df).collect()}
    assert spans[522] == ("term:12:20,term:22:24", 2) and spans[520][1] == 5  # "or" stands by the number in both texts


def python_steps(node, above: bool = False) -> int:
    """How many Python steps of a plan stand in one task with another above them."""
    name = node.nodeName()
    runs = name in ("MapInArrow", "ArrowEvalPython", "PythonMapInArrow")
    below = False if "Exchange" in name else above or runs
    kids = node.children()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [kids.apply(i) for i in range(kids.size())]
    return int(runs and above) + sum(python_steps(x, below) for x in inner)


def test_sanitising_takes_one_worker_a_task(spark):
    """Two Python steps in a task hold two workers, and these live on through later stages."""
    df = spark.createDataFrame([(0, "call Zanzibar at +1 415 555 0100 now"), (1, "write Zanzibar or +1-415-555-0100 maybe"), (2, None), (3, ""), (4, "x")] * 2, "doc_id long, text string")
    out = pii.sanitised(df)
    assert python_steps(out._jdf.queryExecution().executedPlan()) == 0
    assert Counter(r.text for r in out.collect() if r.doc_id > 1) == {None: 2, "": 2, "x": 2} and out.count() == 10
    chained = df.withColumn("s", F.pandas_udf(lambda x: x, "string")("text")).mapInArrow(lambda b: b, "doc_id long, text string, s string")
    assert python_steps(chained._jdf.queryExecution().executedPlan()) == 1


def test_disclosure_against_brute_force(spark):
    """Figures of every value, group and kind; a term of a group goes where no value repeats."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["oak", "elm", "fir", "ash", "yew"]) for _ in range(12)) for _ in range(60)]
    texts += [f"{rng.choice(['oak', 'elm'])} desk kestrel x{k}@aviary.example fir" for k in range(4)] + [f"ring +4930 {k}555 1234 lantern {rng.choice(['ash', 'yew'])}" for k in range(3)] + ["lantern", "kestrel oak", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = pii.found(df).cache()
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosing(found, pii.term_counts(df), len(texts), generalise_from=-9.0).collect()}
    near, mentioned, rows, names = defaultdict(set), defaultdict(set), Counter(), {}
    for i, t in enumerate(texts):
        words = {w.lower() for w in re.findall("[A-Za-z\x80-\U0010ffff]+", t or "")}
        rows.update(words)
        for e, _, a, b in pii.nearby(t or "", spans_of(t or "")):
            near[e, t[a:b].lower()].add(i)
            mentioned[e].add(i)
    code = lambda w: int(as_long(words_of(pa.array([w]), lower=True, of=LETTERS).hashes)[0])
    want = {(e, code(w)): 1 + math.log(len(x) / rows[w]) / -math.log(len(mentioned[e]) / len(texts)) for (e, w), x in near.items() if len({texts[i] for i in x}) >= 2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    shown = {r.doc_id: r for r in pii.detected(df).collect()}
    assert shown[len(texts) - 3].n_term == 1 and "term:0:7" in shown[len(texts) - 3].spans
    assert "EMAIL TERM" in pii.redact("kestrel", [{"start": 0, "end": 7, "removed": False, "kind": 0}])


@pytest.mark.parametrize("most_words", [1 << 20, 100])
def test_language_model(docs, rows, most_words):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {t: [*WORD.findall(t.translate(low)), None] for _, t in rows}
    count = Counter(w for i, t in rows if zlib.crc32(str(i if i is not None else "").encode()) % 10 for w in tokens[t])
    n, v = sum(count.values()), len(count)
    df = docs.select("doc_id", "text", lm_scoring.held_out().alias("held_out"))
    model, words = lm_scoring.train(df.where("NOT held_out"), most_words=most_words)
    got = lm_scoring.scored(df, model, words, keep=("doc_id", "held_out")).collect()
    assert (model.n_tokens, model.n_distinct) == (n, v) and len(model.hot) <= most_words
    want = sorted(((i, len(tokens[t]), sum(w in count for w in tokens[t]), round(sum(log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[t]), 4)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got), key=str) == want
    assert all(r.score < 0 for r in got)


def test_language_model_counts_all_words_and_pairs(spark):
    """Whatever the bounds on what is broadcast, scores are those of all words and pairs, once-seen ones too."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, rng.integers(0, 60)) % 400) for _ in range(120)]
    train, words, pairs = texts[:100], Counter(), Counter()
    for x in train:
        w = [*x.split(), None]
        words.update(w)
        pairs.update(zip(w, w[1:]))
    level = lambda n: 1 + int(np.floor(np.log2(n) * 2 + 1e-9))
    least = lambda n: float(np.ceil(2 ** ((level(n) - 1) / 2) - 1e-9)) if n else 0.0
    total = sum(least(n) + 0.1 for n in words.values()) + 0.1
    want = []
    for i, x in enumerate(texts):
        w, s = [*x.split(), None], 0.0
        for k, v in enumerate(w):
            p = (least(words[v]) + 0.1) / total
            if k and words[w[k - 1]]:
                p = 0.5 * min(least(pairs[w[k - 1], v]) / 2 ** (level(words[w[k - 1]]) / 2), 1) + 0.5 * p
            s += log10(p)
        want.append((i, round(s, 5)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for most_words, most_pairs in ((1 << 20, 60), (40, 60), (40, 1 << 21), (0, 0)):
        model, table = lm_scoring.train(df.where("doc_id < 100"), most_words=most_words, most_pairs=most_pairs)
        got = sorted((r.doc_id, r.score) for r in lm_scoring.scored(df, model, table).collect())
        # a false hit of the filter raises a score now and then, nothing lowers one
        assert all(a[1] >= b[1] - 1e-4 for a, b in zip(got, want, strict=True))
        assert sum(abs(a[1] - b[1]) < 1e-4 for a, b in zip(got, want, strict=True)) >= 100


def test_probabilities_sum_to_one_at_most(docs):
    df = docs.select("doc_id", "text")
    model, words = lm_scoring.train(df)
    all_words = np.array([r.key for r in words.collect()], np.int64).view(np.uint64)
    for before in all_words[:3]:
        pairs = np.stack([np.full(len(all_words), before), all_words], axis=1).reshape(-1)
        p = 10 ** model.log10(pairs, np.arange(0, len(pairs), 2))[1::2]
        assert p.sum() <= 1.01


def test_log_frequency_filter():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 3000).astype(np.uint64)
    counts = np.random.default_rng(1).integers(1, 5000, 3000)
    f = lm_scoring.LogFrequencyFilter(int(lm_scoring.level_of(counts).sum()))
    f.add(keys, lm_scoring.level_of(counts))
    found = f.level(keys)
    assert (found >= lm_scoring.level_of(counts)).all() and (found == lm_scoring.level_of(counts)).mean() > 0.97
    assert (lm_scoring.least_of(lm_scoring.level_of(counts)) <= counts).all() and (lm_scoring.most_of(lm_scoring.level_of(counts)) > counts - 1e-6).all()


def test_media(docs, rows):
    got = {(r.doc_id, r.payload_sha256): r for r in media.text_media(docs).collect()}
    for i, t in rows:
        raw = t.encode()
        payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        r = got[i, hashlib.sha256(payload).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))


def test_images():
    rng = np.random.default_rng(0)
    g, c = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(g)) == g).all() and (media.decode(media.encode_bmp(c)) == c).all()
    assert (media.decode(b"P2 # c\n2 2 255\n0 10\n20 255") == [[0, 10], [20, 255]]).all()
    assert (media.decode(b"P1\n2 2\n01 10") == np.array([[1, 0], [0, 1]]) * 255).all() and (media.decode(b"P4\n2 2\n\x40\x80") == np.array([[1, 0], [0, 1]]) * 255).all()
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"P5", b"P5 9 9 255\nxx", b"BM", b"GIF89a"):
        with pytest.raises(ValueError):
            media.decode(bad)
    assert (media.read_tiles(media.write_tiles(g, 2)) == g).all()
    wide = np.repeat(np.repeat(g.astype(float), 4, 0), 3, 1)
    brute = wide.reshape(4, 5, 3, 7).mean(axis=(1, 3))  # 20 by 21 samples in 4 by 3 boxes
    assert np.allclose(media.area_resize(g, 4, 3), brute)


def test_odd_images_give_nulls(spark):
    bmp = bytearray(media.encode_bmp(np.zeros((2, 2, 3), np.uint8)))
    palette = b"BM" + (54 + 4 + 4).to_bytes(4, "little") + bytes(4) + (58).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + b"\1\0\x08\0" + bytes(16) + (1).to_bytes(4, "little") + bytes(4) + bytes(4) + b"\7\0\0\0"
    odd = [b"P2 1 1 255 " + b"9" * 23, b"P2 1 1 255 300", b"P1 1 1 7", palette, bytes(bmp[:40]), b"P5 9", b"", None, b"P5 99999999999 9 255 x"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "image_id long, image binary")
    got = media.image_features(df, "image_id", "image").collect()
    assert len(got) == len(odd) and all(r.feature is None and r.tiles is None for r in got)
    assert media.image_features(df.limit(0), "image_id", "image").count() == 0


def test_image_table(spark):
    good = media.encode_pgm(np.arange(64, dtype=np.uint8).reshape(8, 8))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"x")), (3, None)], "id long, image binary")
    got = {r.id: r for r in media.image_features(df, "id", "image", 4, 4).collect()}
    assert media.read_tiles(bytes(got[1].tiles)).shape == (4, 4) and got[1].feature == "f" * 16 and got[2].tiles is None and got[3].feature is None
