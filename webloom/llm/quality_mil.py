"""A quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Every passage is described by
figures that do not depend on its language (rates of signs, repetition, word and
sentence shape) and encoded as h = tanh(W x). Gated attention

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) )

weighs the passages, and the weighted sum of the encodings is scored by a
logistic unit. Encoder, attention and unit are learned together, from labels of
whole texts only, on at most about ``TRAIN_DOCS`` labelled texts chosen by a hash
of their ids; every text is scored whole.

Defined results: a null text is as an empty one, which has one passage of zeros;
equal texts get equal scores; without training rows, or with one label only, the
score is the mean label (0.5 without any); repeated rows get equal scores; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.tables import crc_split, documents, last_code, narrow, table
from webloom.llm.textarrays import slices, window_hashes, words_of

PASSAGE = 64
TRAIN_DOCS = 8000
TRAIN_CHARS = 60_000_000
HIDDEN = 16
ATTENTION = 8
EPOCHS = 30
THRESHOLD = 0.3

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?", "#*$%&|<>", "'\"()-_/=+@"), start=1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0x80:] = 7
CLASSES = 8
SHAPES = 16
FEATURES = CLASSES + 10 + SHAPES


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a batch of texts, and how many passages each text has (one at least)."""
    words = words_of(column)
    n_docs, counts = words.n_docs, words.counts
    per = np.maximum(-(-counts // PASSAGE), 1)
    total = int(per.sum())
    first = np.cumsum(per) - per
    x = np.zeros((total, FEATURES), dtype=np.float32)
    n = len(words.hashes)
    if not n:
        return x, per
    doc = words.doc_of()
    passage = first[doc] + (np.arange(n) - words.doc_start[:-1][doc]) // PASSAGE
    size = np.bincount(passage, minlength=total).astype(np.float64)
    share = np.maximum(size, 1)
    length = words.end - words.begin
    # characters: those between the start of a word and its end, by class
    starts = np.concatenate(([0], np.cumsum(length)[:-1]))
    source = np.arange(int(length.sum())) - np.repeat(starts - words.begin, length)
    of = np.repeat(passage, length)
    chars = np.bincount(of, minlength=total)
    kinds = np.bincount(of * CLASSES + _CLASS[words.data[source]], minlength=total * CLASSES).reshape(total, CLASSES)
    x[:, :CLASSES] = kinds / np.maximum(chars, 1)[:, None]
    at = CLASSES

    def add(values: np.ndarray) -> None:
        nonlocal at
        x[:, at] = values
        at += 1

    def rate(flag: np.ndarray) -> np.ndarray:
        return np.bincount(passage[flag], minlength=total) / share

    h = words.hashes
    order = np.lexsort((h, passage))
    hs, ps = h[order], passage[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ps[1:] != ps[:-1])
    add(np.bincount(ps[new], minlength=total) / share)
    for back in (1, 2):
        same = np.zeros(n, dtype=bool)
        same[back:] = (h[back:] == h[:-back]) & (passage[back:] == passage[:-back])
        add(rate(same))
    four = np.flatnonzero(np.append(passage[3:] == passage[:-3], [False] * min(3, n))) if n > 3 else np.zeros(0, np.int64)
    if len(four):
        w, p = window_hashes(h, four, 4), passage[four]
        order = np.lexsort((w, p))
        ws, ps = w[order], p[order]
        again = np.zeros(len(ws), dtype=bool)
        again[1:] = (ws[1:] == ws[:-1]) & (ps[1:] == ps[:-1])
        add(np.bincount(ps[again], minlength=total) / share)
    else:
        add(np.zeros(total))
    add(np.bincount(passage, weights=length, minlength=total) / share / 10)
    add(np.sqrt(np.maximum(np.bincount(passage, weights=length.astype(float) ** 2, minlength=total) / share - (np.bincount(passage, weights=length, minlength=total) / share) ** 2, 0)) / 10)
    head, tail = _CLASS[words.data[words.begin]], _CLASS[words.data[words.end - 1]]
    add(rate(head == 2))
    add(rate(tail == 4))
    add(rate((tail == 5) | (head == 5)))
    add(np.minimum(size / PASSAGE, 1))
    # shapes: class of first and last sign and length, in hashed places
    shape = (head * 31 + tail * 7 + np.minimum(length, 12)) * 2654435761 % 4294967296 * SHAPES // 4294967296
    x[:, at : at + SHAPES] = np.bincount(passage * SHAPES + shape, minlength=total * SHAPES).reshape(total, SHAPES) / share[:, None]
    return x, per


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class GatedAttention:
    """The learned model; bags are rows of passages, told apart by their first row."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "y": _sigmoid(z @ p["c"] + p["d"][0])}

    def score(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(per), self.constant)
        if not len(per):
            return np.zeros(0)
        return self.forward(x.astype(np.float64), np.cumsum(per) - per)["y"]

    @classmethod
    def fit(cls, x: np.ndarray, per: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 0, rate: float = 0.01, batch: int = 64) -> GatedAttention:
        mean = float(label.mean()) if len(label) else 0.5
        if not len(label) or label.min() == label.max():
            return cls(np.zeros(1), np.ones(1), {}, mean)
        rng = np.random.default_rng(seed)
        f = x.shape[1]
        p = {"W": rng.normal(0, f**-0.5, (f, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
        model = cls(x.mean(axis=0), x.std(axis=0) + 1e-3, p)
        moment, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        start = np.cumsum(per) - per
        for _ in range(epochs):
            order = rng.permutation(len(per))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                rows = np.concatenate([np.arange(start[d], start[d] + per[d]) for d in own])
                step += 1
                grad = model._gradient(x[rows].astype(np.float64), np.cumsum(per[own]) - per[own], label[own])
                for k, g in grad.items():
                    moment[k] = 0.9 * moment[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    p[k] -= rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return model

    def _gradient(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, o = self.p, self.forward(x, first)
        dy = (o["y"] - label) / len(label)
        dz = dy[:, None] * p["c"]
        bag, h, a = o["bag"], o["h"], o["a"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        gate = de[:, None] * p["w"]
        dt, ds = gate * o["s"] * (1 - o["t"] ** 2), gate * o["t"] * o["s"] * (1 - o["s"])
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        dpre = dh * (1 - h**2)
        out = {"c": o["z"].T @ dy, "d": np.array([dy.sum()]), "w": (o["t"] * o["s"]).T @ de, "V": h.T @ dt, "U": h.T @ ds, "W": o["x"].T @ dpre, "b": dpre.sum(axis=0)}
        return {k: g + (1e-4 * p[k] if p[k].ndim == 2 else 0) for k, g in out.items()}


def described(docs: DataFrame, keep: tuple[str, ...], text_column: str = "text") -> DataFrame:
    """Passage features of each text, as raw 32-bit floats, beside the columns ``keep``."""
    rows = docs.select(F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_text"), *[F.col(f"`{c}`") for c in keep])
    carried = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", 4 << 20):
                x, per = passages(batch.column(0))
                cut = np.cumsum(per)
                raw = [x[b - n : b].tobytes() for b, n in zip(cut, per, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(per, pa.int64()), pa.array(raw, pa.binary())], names=[*keep, "passages", "features"])

    return rows.mapInArrow(each, f"{carried}passages long, features binary")


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, epochs: int = EPOCHS) -> GatedAttention:
    """Learn from a sample of the rows that have a text and a label, of at most about ``train_docs`` texts and ``train_chars`` characters, and of one at least."""
    known = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    code = F.shiftrightunsigned(F.xxhash64("id"), 1)
    sizes = docs.select(F.col(f"`{id_column}`").alias("id"), F.length(F.col(f"`{text_column}`")).alias("size")).join(known, "id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"), F.min(code).alias("least")).first()
    chosen = code <= F.lit(last_code(min(1.0, train_docs / max(sizes["n"], 1), train_chars / max(sizes["chars"] or 1, 1)), sizes["least"] or 0)).cast("long")
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")).where(chosen).join(known.where(chosen), "id")
    got = described(rows, ("id", "label")).select("id", "label", "passages", "features").toArrow().sort_by([("id", "ascending")])
    if not got.num_rows:
        return GatedAttention.fit(np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0))
    x = np.frombuffer(b"".join(got["features"].to_pylist()), dtype=np.float32).reshape(-1, FEATURES)
    return GatedAttention.fit(x, got["passages"].to_numpy(), got["label"].to_numpy(), epochs)


def scored(docs: DataFrame, model: GatedAttention, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Each text's score and verdict beside the columns ``keep``, with its number of passages."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    keep = keep or (id_column,)
    rows = docs.select(F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_text"), *[F.col(f"`{c}`") for c in keep])
    carried = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", 4 << 20):
                x, per = passages(batch.column(0))
                # rounded, so that sums taken in another order give the same number
                score = np.round(sent.value.score(x, per), 9)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(per, pa.int64())], names=[*keep, "score", "predicted", "passages"])

    return rows.mapInArrow(each, f"{carried}score double, predicted int, passages long")


def held_out(id_column: str = "doc_id") -> Column:
    return crc_split(id_column, 5) == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return scored(narrow(docs, "doc_id", "text").withColumn("held_out", held_out()), model, keep=("doc_id", "held_out"))
