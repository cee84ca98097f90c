"""Removal of word sequences that occur elsewhere, found by difference-cover anchors.

Of every text, windows of ``ANCHOR`` words are hashed only where the position modulo
``PERIOD`` lies in a difference cover. For any two positions there is a shift
below PERIOD that brings both into the cover, so two equal windows of
ANCHOR + PERIOD - 1 words, wherever they start, share an anchor at one offset.

1. Count anchors; those that occur once are done with.
2. Around each repeated anchor, hash the full windows that contain it (the match
   extends over the anchor's both sides) and count these.
3. A word is removed if a window over it occurs twice or more in the input.

Texts that are alike are told by one key: they are judged by their number, and
only their first in each task goes on. Counts and joins run on hashes with sums taken before
the shuffle; no group is ever gathered, but the windows of one text. A filter of fixed
size keeps most anchors and windows without a partner out of the joins that decide.

Defined results: a null text has no words; a text shorter than a window loses
nothing, even if it is repeated; equal texts of a window or more lose all their
words; an empty table gives an empty one; rows with equal ids are rows of their
own; other columns are ignored. Windows are judged on the input alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.sieve import sieve_of
from webloom.llm.tables import documents, stored
from webloom.llm.textarrays import Words, as_long, slices, utf8_buffers, window_hashes, words_of

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
FLUSH = 2 << 20

assert {(a - b) % PERIOD for a in COVER for b in COVER} == {*range(PERIOD)}

_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position in its text and text of each anchor of the texts that hold a window."""
    counts = words.counts
    room = np.where(counts >= WINDOW, counts - ANCHOR + 1, 0)
    doc = np.repeat(np.arange(words.n_docs), room)
    place = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room)
    chosen = _IN_COVER[place % PERIOD]
    doc, place = doc[chosen], place[chosen]
    return window_hashes(words.hashes, words.doc_start[:-1][doc] + place, ANCHOR), place, doc


def around(place: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (and texts) of the windows that contain an anchor at one of the places; each once."""
    first, last = np.maximum(place - PERIOD + 1, 0), np.minimum(place, counts[doc] - WINDOW)
    size = np.maximum(last - first + 1, 0)
    starts = np.repeat(first, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    code = np.unique((np.repeat(doc, size).astype(np.int64) << 40) | starts)
    return code & ((1 << 40) - 1), code >> 40


def _fresh(keys: pa.Array, seen: set) -> pa.Array:
    """Which rows are the first of their key in this task."""
    out = []
    for k in keys.to_pylist():
        out.append(k not in seen)
        seen.add(k)
    return pa.array(out, pa.bool_())


def _tally(rows: DataFrame, hashes_of, column: str) -> DataFrame:
    """(hash, n) of what ``hashes_of`` finds in the batches; each text of a task once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held: list[np.ndarray] = []

        def flush():
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                for a in range(0, len(h), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(as_long(h[a : a + (1 << 18)])), pa.array(n[a : a + (1 << 18)], pa.int64())], names=[column, "n"])

        size = 0
        for whole in batches:
            for batch in slices(whole, "_text"):
                batch = batch.filter(_fresh(batch.column(0), seen))
                held.append(hashes_of(batch))
                size += len(held[-1])
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows.mapInArrow(each, f"{column} long, n long").groupBy(column).agg(F.sum("n").alias("n")).where("n > 1").select(column)


def _columns(values: list[tuple], types: list) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*values, strict=True) if values else [()] * len(types), types, strict=True)]


def kept_words(raw: bytes, starts: list[int], window: int = WINDOW) -> tuple[int, bytes]:
    """How many words the windows cover, and the other words joined by one space."""
    words = raw.split()  # bytes.split() cuts at space and 0x09-0x0D
    keep = np.ones(len(words), dtype=bool)
    for s in starts:
        keep[s : s + window] = False
    return len(words) - int(keep.sum()), b" ".join(compress(words, keep.tolist()))


def _plain(rows: DataFrame, id_column: str, kind: str) -> DataFrame:
    """Each row as it is if nothing is removed: id, key, n_words, kept_sha256."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(2))
            out = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                words = data[a:b].tobytes().split()
                out.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), *_columns(out, [pa.int64(), pa.string()])], names=[id_column, "_key", "n_words", "_sha"])

    return rows.mapInArrow(each, f"`{id_column}` {kind}, _key long, n_words long, _sha string")


def _repeats(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored texts that hold a repeated anchor (_key, _text, places of such anchors), and (_key, starts of repeated windows)."""
    spark = rows.sparkSession
    repeated = stored(_tally(rows.select("_key", "_text"), lambda b: anchors(words_of(b.column(1)))[0], "anchor"), "anchors")
    sent = spark.sparkContext.broadcast(sieve_of(repeated, "anchor"))  # of fixed size

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for whole in batches:
            for batch in slices(whole, "_text"):
                batch = batch.filter(_fresh(batch.column(0), seen))
                h, place, doc = anchors(words_of(batch.column(1)))
                may = sent.value.passes(h)
                cut = pa.array(np.searchsorted(doc[may], np.arange(batch.num_rows + 1)), pa.int32())
                out = pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(cut, pa.array(as_long(h[may]))), pa.ListArray.from_arrays(cut, pa.array(place[may], pa.int32()))], names=["_key", "_text", "anchors", "places"])
                yield out.filter(pa.array(np.diff(cut.to_numpy()) > 0))

    texts = stored(rows.select("_key", "_text").mapInArrow(candidates, "_key long, _text string, anchors array<long>, places array<int>"), "candidates")
    marks = texts.select("_key", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("_key", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"))
    exact = marks.join(repeated, "anchor", "left_semi").groupBy("_key").agg(F.collect_set("place").alias("places"))
    # a text that several tasks hold goes on once for each of them; its copies are judged by their number
    texts = stored(texts.select("_key", "_text").join(exact, "_key"), "extended")

    def starts_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = words_of(batch.column(1))
        lists = batch.column(2)
        place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        start, doc = around(place, doc, words.counts)
        return window_hashes(words.hashes, words.doc_start[:-1][doc] + start, WINDOW, seed=1), start, doc

    windows = stored(_tally(texts, lambda b: starts_of(b)[0], "hash"), "windows")
    sent_windows = spark.sparkContext.broadcast(sieve_of(windows, "hash"))  # of fixed size

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for whole in batches:
            for batch in slices(whole, "_text"):
                batch = batch.filter(_fresh(batch.column(0), seen))
                h, start, doc = starts_of(batch)
                may = sent_windows.value.passes(h)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(h[may])), pa.array(batch.column(0).to_numpy(zero_copy_only=False)[doc[may]], pa.int64()), pa.array(start[may], pa.int32())], names=["hash", "_key", "start"])

    found = texts.mapInArrow(spots, "hash long, _key long, start int").join(windows, "hash", "left_semi")
    return texts, found.groupBy("_key").agg(F.collect_set("start").alias("starts"))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", texts: bool = False) -> DataFrame:
    """One row a row: id, n_words, n_removed, kept_sha256, and with ``texts`` the kept words themselves."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_text"), F.col(f"`{id_column}`").alias("_id")).select(F.xxhash64("_text").alias("_key"), F.col("_id").alias(id_column), "_text")
    plain = stored(_plain(rows, id_column, kind), "plain")
    copies = plain.groupBy("_key").agg(F.count(F.lit(1)).alias("_copies"))
    held, starts = _repeats(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                out = []
                for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    n, rest = kept_words(text.encode(), places)
                    out.append((n, hashlib.sha256(rest).hexdigest(), rest.decode() if texts else None))
                yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(out, [pa.int64(), pa.string(), pa.string()])], names=["_key", "_removed", "_cut", "_rest"])

    done = held.select("_key", "_text").join(starts, "_key").mapInArrow(cut, "_key long, _removed long, _cut string, _rest string")
    done = done.groupBy("_key").agg(F.first("_removed").alias("_removed"), F.first("_cut").alias("_cut"), *[F.first("_rest").alias("_rest")] * texts)
    judged = copies.join(done, "_key", "left")
    all_gone = (F.col("_copies") > 1) & (F.col("n_words") >= WINDOW)
    out = plain.join(judged, "_key")
    columns = [
        F.col(f"`{id_column}`"),
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("_cut", "_sha")).alias("kept_sha256"),
    ]
    if not texts:
        return out.select(*columns)
    whole = rows.groupBy("_key").agg(F.first("_text").alias("_text"))
    return out.join(whole, "_key").select(*columns, F.when(all_gone, F.lit("")).otherwise(F.coalesce("_rest", F.array_join(F.filter(F.split("_text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), " "))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir))
