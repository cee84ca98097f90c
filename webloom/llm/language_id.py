"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has one cell of language bits where a plain one has a
bit, so a probe of an n-gram gives all languages that hold it at once. A text's
n-grams are probed together; the hits of each language are counted, corrected
for the filter's false positives, and the language with the largest share wins.

A language's filter holds the n-grams that are typical of it: at least
``least_count`` times in the training texts and at least 1/``ratio`` as frequent
as in the language where they are most frequent. Training texts are a sample of
at most about ``train_docs`` texts a language, chosen by a hash of the id, so that what
is learned stays within that bound on any input; all texts are judged.

Defined results: null texts and texts without a letter are ``und`` with score
0; ties go to the language whose name sorts first; texts with letters but
without a known n-gram get the language with most training texts and score 0;
without training texts everything is ``und``; repeated rows get equal results;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.tables import crc_split, documents, last_code, narrow
from webloom.llm.tally import trim
from webloom.llm.textarrays import mix, slices

NONE = "und"
TRAIN_DOCS = 6000
TRAIN_CHARS = 20_000_000
SIZES = (1, 2, 3, 4)
PROBES = 3
BITS_PER_GRAM = 16
LEAST_COUNT = 3
RATIO = 3.0
MOST_LANGUAGES = 4096
LEAST_FIT = 0.3
SLICE_BYTES = 512 << 10

_SPACE = 0x20
_STOP = 0x0A
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str], sizes: tuple[int, ...] = SIZES) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams of each size, the text of each, and which texts have a letter.

    Letters are lower-cased; runs of anything else are one space; n-grams with
    two spaces' worth of gap or two texts in them do not exist.
    """
    joined = "\n" + "\n".join(" " + t.lower().replace("\n", " ") + " " for t in texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    stop = code == _STOP
    doc_all = np.cumsum(stop) - 1
    # the space before a text's first letter counts too
    kept[:-1] |= stop[:-1] | (letter[1:] & ~letter[:-1])
    kept |= stop
    symbol = np.where(letter, code, np.where(stop, _STOP, _SPACE)).astype(np.uint64)
    # a run of other signs leaves two spaces at most; drop the second
    space = kept & ~letter & ~stop
    at = np.flatnonzero(kept)
    s = space[at]
    twice = np.zeros(len(at), dtype=bool)
    twice[1:] = s[1:] & s[:-1]
    at = at[~twice]
    symbol, doc = symbol[at], doc_all[at]
    has = np.zeros(len(texts) + 1, dtype=bool)
    has[doc_all[letter]] = True
    out, docs = [], []
    for n in sizes:
        width = len(symbol) - n + 1
        if width <= 0:
            out.append(np.zeros(0, np.uint64))
            docs.append(np.zeros(0, np.int64))
            continue
        acc = np.full(width, n, dtype=np.uint64)
        fine = np.ones(width, dtype=bool)
        for k in range(n):
            part = symbol[k : k + width]
            acc = acc * np.uint64(0x100000001B3) + part
            fine &= part != _STOP
        if n == 1:
            fine &= symbol[:width] != _SPACE
        out.append(mix(acc[fine] * _STEP))
        docs.append(doc[:width][fine])
    return out, docs, has[: len(texts)]


@dataclass
class BitmaskFilter:
    """Cells of language bits, as wide as there are languages, up to 64 a plane: ``cells[p]`` holds those from 64p on."""

    languages: list[str]
    default: str
    cells: np.ndarray
    probes: int

    @classmethod
    def build(cls, languages: list[str], default: str, gram: np.ndarray, language: np.ndarray, probes: int = PROBES, bits: int = BITS_PER_GRAM) -> BitmaskFilter:
        largest = int(np.bincount(language, minlength=1).max()) if len(language) else 0
        size = 1 << max(10, int(np.ceil(np.log2(max(largest * bits, 1)))))
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= np.iinfo(t).bits or t is np.uint64)
        cells = np.zeros((-(-len(languages) // 64) or 1, size), dtype=kind)
        out = cls(languages, default, cells, probes)
        for k in range(probes):
            np.bitwise_or.at(cells, (language // 64, out._cell(gram, k)), (np.uint64(1) << (language % 64).astype(np.uint64)).astype(kind))
        return out

    def _cell(self, gram: np.ndarray, k: int) -> np.ndarray:
        step = (gram >> np.uint64(33)) | np.uint64(1)
        return ((gram + np.uint64(k) * step) & np.uint64(self.cells.shape[1] - 1)).astype(np.int64)

    def probe(self, gram: np.ndarray, plane: int) -> np.ndarray:
        found = self.cells[plane][self._cell(gram, 0)]
        for k in range(1, self.probes):
            found &= self.cells[plane][self._cell(gram, k)]
        return found

    @cached_property
    def false_rate(self) -> np.ndarray:
        """How often an n-gram that a language lacks is found there all the same; worked out once a worker."""
        one = self.cells.dtype.type
        fill = [np.count_nonzero(self.cells[i // 64] & (one(1) << one(i % 64))) / self.cells.shape[1] for i in range(len(self.languages))]
        return np.array(fill) ** self.probes

    def shares(self, texts: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the corrected share of its n-grams in each language; which texts have a letter."""
        found, docs, has = grams(texts, sizes)
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        one = self.cells.dtype.type
        for gram, doc in zip(found, docs, strict=True):
            total += np.bincount(doc, minlength=len(texts))[: len(texts)]
            for plane in range(len(self.cells)):
                bits = self.probe(gram, plane)
                for i in range(plane * 64, min(plane * 64 + 64, len(self.languages))):
                    hits[:, i] += np.bincount(doc, weights=(bits & (one(1) << one(i % 64)) != 0).astype(np.float64), minlength=len(texts))[: len(texts)]
        wrong = self.false_rate
        rate = hits / np.maximum(total, 1)[:, None]
        return np.clip((rate - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1), has

    def decide(self, texts: list[str], sizes: tuple[int, ...]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (the winner's part of all shares) and fit (its own share) of each text."""
        if not self.languages:
            return [NONE] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        share, has = self.shares(texts, sizes)
        best = share.argmax(axis=1)
        top = share[np.arange(len(texts)), best] if len(texts) else np.zeros(0)
        score = np.where(has, top / np.maximum(share.sum(axis=1), 1e-12), 0.0)
        names = [NONE if not h else self.languages[b] if t > 0 else self.default for h, b, t in zip(has, best, top, strict=True)]
        return names, np.clip(score, 0, 1), np.where(has, top, 0.0)


def train(labelled: DataFrame, text_column: str = "text", language_column: str = "lang", id_column: str = "doc_id", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, sizes: tuple[int, ...] = SIZES, least_count: int = LEAST_COUNT, ratio: float = RATIO) -> BitmaskFilter:
    """Learn from rows with a text and a language, at most about ``train_docs`` of them and ``train_chars`` characters a language.

    Rows are chosen by a 63-bit hash of id and text; each language has at least the row of its smallest hash, however much there is.
    """
    rows = labelled.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{language_column}`").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    code = F.shiftrightunsigned(F.xxhash64("id", "text"), 1)
    counts = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.min(code).alias("least")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return BitmaskFilter.build([], NONE, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    default = max(languages, key=lambda x: (counts[x]["n"], x))
    index = {name: i for i, name in enumerate(languages)}
    limit = F.create_map(*[x for name, r in counts.items() for x in (F.lit(name), F.lit(last_code(min(1.0, train_docs / r["n"], train_chars / max(r["chars"], 1)), r["least"])).cast("long"))])
    sample = rows.where(code <= limit[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                of = np.array([index[x] for x in batch.column(1).to_pylist()])
                found, docs, _ = grams(batch.column(0).to_pylist(), sizes)
                gram, lang = np.concatenate(found), of[np.concatenate(docs)]
                for i in np.unique(lang):
                    values, n = np.unique(gram[lang == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i), pa.int32()), pa.array(values.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
        trim()

    tallied = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count).toArrow()
    lang, gram, n = (np.ascontiguousarray(tallied[c].to_numpy(), dtype=np.int64) for c in ("lang", "gram", "n"))
    gram = gram.view(np.uint64)
    weight = np.bincount(lang, weights=n, minlength=len(languages))
    share = n / np.maximum(weight, 1)[lang]
    _, which = np.unique(gram, return_inverse=True)
    most = np.zeros(which.max() + 1 if len(which) else 0)
    np.maximum.at(most, which, share)
    typical = share * ratio >= most[which]
    return BitmaskFilter.build(languages, default, gram[typical], lang[typical])


def predicted(docs: DataFrame, model: BitmaskFilter, sizes: tuple[int, ...] = SIZES, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of each text: id (or the columns ``keep``), lang_pred, score, fit."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    rows = narrow(docs, text_column, *(keep or (id_column,)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_column, SLICE_BYTES):
                names, score, fit = sent.value.decide([t or "" for t in batch.column(0).to_pylist()], sizes)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(score), pa.array(fit)], names=[*batch.schema.names[1:], "lang_pred", "score", "fit"])
        trim()

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns[1:])
    return rows.mapInArrow(each, f"{schema}, lang_pred string, score double, fit double")


def in_known_language(docs: DataFrame, model: BitmaskFilter, least_fit: float = LEAST_FIT, sizes: tuple[int, ...] = SIZES, text_column: str = "text") -> DataFrame:
    """The whole rows whose text has letters and, of its n-grams, at least the share ``least_fit`` in one language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    place = docs.columns.index(text_column)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.names[place], SLICE_BYTES):
                names, _, fit = sent.value.decide([t or "" for t in batch.column(place).to_pylist()], sizes)
                yield batch.filter(pa.array([x != NONE and y >= least_fit for x, y in zip(names, fit, strict=True)], pa.bool_()))
        trim()  # the worker goes on to other operators' tasks

    return docs.mapInArrow(each, docs.schema)


def held_out(id_column: str = "doc_id") -> Column:
    return crc_split(id_column, 4) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predicted(rows, model, keep=("doc_id", "held_out"))
