"""Joining documents whose sets of word n-grams are alike, by rare-first prefix filtering.

1. Sets. A document is its set of distinct n-gram hashes. Texts are read once; sets
   are stored packed, each set of a task once. Equal sets are one vertex from here on,
   so copies cost nothing further.
2. Order. Document frequencies of all n-grams are counted; the most frequent ones (a
   bounded table) go last in every set, by the level of their frequency; before them
   go those that a filter of fixed size knows, of two documents or more if it has room
   for them all; all others go first, by hash. Any one order gives the same links; this
   one fills prefixes with n-grams of one document, which make no candidates.
3. Prefixes. Two sets of similarity t share an n-gram among the first
   n - ceil(t n) + 1 of each. N-grams that are in one prefix only are dropped.
4. Candidates. Sets that share a prefix n-gram are compared with hubs of its list: one hub, then 8, 64
   and so on, those with most links first, until all that are left belong together.
   Hubs are members whose n-gram is early enough to be the first that they share with
   a set of their size or larger. Length, positional and suffix filters come before a pair is made; the last bounds
   what two sets do not share by the parities of their members in 512 ranges of
   hashes. No pair is verified twice. Pairs that are
   connected already need no verification, so no group is ever paired in full
   unless its members are all unlike each other.
5. Components of the verified links: those of each round are joined onto the classes
   of the rounds before.

Defined results: texts without words (null too) are linked with nothing; texts of
fewer words than n are one n-gram; rows are linked by their texts alone, so equal
sets are linked and equal ids are not; a component's id is the smallest id in it,
nulls aside; an empty table gives an empty one; other columns are kept by
``representatives`` and ignored elsewhere. Texts of any length are taken whole.
Set sizes count n-grams by 48 bits of their hashes, links compare 40.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.components import components
from webloom.llm.sieve import Sieve, sieve_of
from webloom.llm.tables import discard, documents, narrow, packed, release, stored
from webloom.llm.tally import bucket_count, counted, trim
from webloom.llm.textarrays import Words, as_long, mix, slices, window_hashes, words_of

WORDS = 3
PERCENT = 90
MOST_FREQUENT = 1 << 19
MOST_SHARED = 1 << 24
SLICE_BYTES = 2 << 20
SLICE_ROWS = 1 << 12
END_BITS = 24
COUNT_BITS = 48
MEMBER_BITS = 40
SUFFIX_BINS = 16
PARITY_BITS = 512
HUB_GROWTH = 8

_MEMBER = np.uint64((1 << MEMBER_BITS) - 1)
_BYTES = MEMBER_BITS // 8
_LEVELS = 6


def sets_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending within it: (hash of COUNT_BITS, text)."""
    counts = words.counts
    room = np.maximum(counts - n + 1, 0)
    doc = np.repeat(np.arange(words.n_docs, dtype=np.uint64), room)
    start = np.arange(int(room.sum())) + np.repeat(words.doc_start[:-1] - (np.cumsum(room) - room), room)
    keys = [(doc << np.uint64(COUNT_BITS)) | (window_hashes(words.hashes, start, n, seed=2) >> np.uint64(64 - COUNT_BITS))]
    for few in range(1, n):
        short = np.flatnonzero(counts == few)
        keys.append((short.astype(np.uint64) << np.uint64(COUNT_BITS)) | (window_hashes(words.hashes, words.doc_start[:-1][short], few, seed=2) >> np.uint64(64 - COUNT_BITS)))
    key = np.concatenate(keys)
    key.sort()
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return key & np.uint64((1 << COUNT_BITS) - 1), (key >> np.uint64(COUNT_BITS)).astype(np.int64)


def vertex_of(h: np.ndarray, d: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each text's set, and the set's size."""
    size = np.bincount(d, minlength=n_docs)
    key = np.zeros(n_docs, dtype=np.uint64)
    has = size > 0
    if has.any():
        key[has] = np.add.reduceat(mix(h), (np.cumsum(size) - size)[has])
    return mix(key + size.astype(np.uint64)), size


def pack_sets(h: np.ndarray, d: np.ndarray, n_docs: int) -> pa.Array:
    """Sets of COUNT_BITS, ascending, as binary values: their distinct members of MEMBER_BITS, ascending, one after another."""
    members = h >> np.uint64(COUNT_BITS - MEMBER_BITS)
    new = np.ones(len(members), dtype=bool)
    new[1:] = (members[1:] != members[:-1]) | (d[1:] != d[:-1])
    raw = np.ascontiguousarray(members[new].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES])
    ends = np.concatenate(([0], np.cumsum(np.bincount(d[new], minlength=n_docs)))) * _BYTES
    return pa.Array.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])


def unpack(raw: bytes | memoryview | pa.Buffer) -> np.ndarray:
    """Members from their bytes."""
    wide = np.zeros((len(raw) // _BYTES, 8), np.uint8)
    wide[:, :_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _BYTES)
    return wide.reshape(-1).view("<u8")


def vertices_of(docs: DataFrame, n: int, id_column: str, text_column: str, row_key: Column | None = None) -> DataFrame:
    """(id, v, n_shingles, grams, _row_key) of each row; ``grams`` is null where the task has sent that set before."""
    kind = docs.schema[id_column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for whole in batches:
            for batch in slices(whole, "_text", SLICE_BYTES):
                for a in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(a, SLICE_ROWS)
                    words = words_of(part.column(0), lower=True)
                    h, d = sets_of(words, n)
                    vertex, size = vertex_of(h, d, words.n_docs)
                    new = []
                    for v, k in zip(vertex.tolist(), size.tolist(), strict=True):
                        new.append(k > 0 and v not in seen)
                        seen.add(v)
                    grams = pc.if_else(pa.array(new, pa.bool_()), pack_sets(h, d, words.n_docs), pa.scalar(None, pa.binary()))
                    yield pa.RecordBatch.from_arrays([part.column(1), pa.array(as_long(vertex)), pa.array(size, pa.int64()), grams, part.column(2)], names=[id_column, "v", "n_shingles", "grams", "_row_key"])
        trim()

    key = F.lit(None).cast("long") if row_key is None else row_key
    rows = docs.select(F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_text"), F.col(f"`{id_column}`").alias(id_column), key.alias("_row_key"))
    return rows.mapInArrow(each, f"`{id_column}` {kind}, v long, n_shingles long, grams binary, _row_key long")


def _sets(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(member, text, vertex, size) of stored sets (v, grams), some rows at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            raw = part.column(1).cast(pa.large_binary())
            ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            size = np.diff(ends) // _BYTES
            vertex = np.ascontiguousarray(part.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            yield unpack(raw.buffers()[2].slice(ends[0], ends[-1] - ends[0])), np.repeat(np.arange(len(size)), size), vertex, size


class Order:
    """Frequent n-grams and the levels of their frequencies, and a filter of less frequent ones; sorts sets rare-first."""

    def __init__(self, gram: np.ndarray, df: np.ndarray, shared: Sieve | None = None):
        self.shared = shared
        order = np.argsort(gram)
        self.gram = gram[order]
        self.level = np.minimum(1 + np.floor(np.log2(np.maximum(df[order], 1)) * 2), (1 << _LEVELS) - 1).astype(np.uint8)

    @cached_property
    def may(self) -> np.ndarray:
        """Most n-grams are told to be infrequent by one look at this small table; workers make it, so that it isn't sent."""
        may = np.zeros(1 << 22, dtype=bool)
        may[(self.gram & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        return may

    def levels(self, h: np.ndarray) -> np.ndarray:
        # what the filter takes for shared without being so is later in all sets alike
        out = np.zeros(len(h), dtype=np.uint64) if self.shared is None else self.shared.passes(h).astype(np.uint64)
        if len(self.gram):
            maybe = np.flatnonzero(self.may[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            code = h[maybe]
            at = np.minimum(np.searchsorted(self.gram, code), len(self.gram) - 1)
            out[maybe] = np.where(self.gram[at] == code, self.level[at], out[maybe])
        return out

    def sort(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The members by text, frequency and hash: one sort of numbers made of the three."""
        key = (d.astype(np.uint64) << np.uint64(MEMBER_BITS + _LEVELS)) | (self.levels(h) << np.uint64(MEMBER_BITS)) | h
        key.sort()
        return key & _MEMBER


def order_of(sets: DataFrame, buckets: int, most: int = MOST_FREQUENT, most_shared: int = MOST_SHARED) -> Order:
    """Count all n-grams of stored sets and keep the most frequent, at most ``most`` of them, and a filter of at most ``most_shared``; a histogram finds the cuts."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for h, *_ in _sets(batches):
            yield h

    frequent = stored(counted(sets, codes, buckets, least=2), "frequencies")
    level = F.floor(F.log2("n") * 4 + 1e-9)
    total, cut, low = 0, None, None
    for row in sorted(frequent.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["l"]):
        total += row["k"]
        cut = row["l"] if total <= most else cut
        low = row["l"] if total <= most_shared else low
    shared = None if low is None else sieve_of(frequent.where(level >= low), "key")  # of fixed size
    if cut is None:
        out = Order(np.zeros(0, np.uint64), np.zeros(0, np.int64), shared)
    else:
        kept = frequent.where(level >= cut).toArrow()
        out = Order(np.ascontiguousarray(kept["key"].to_numpy(), np.int64).view(np.uint64), np.ascontiguousarray(kept["n"].to_numpy(), np.int64), shared)
    discard(frequent)
    return out


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return size - -(-percent * size // 100) + 1


def _prefixes(h: np.ndarray, d: np.ndarray, size: np.ndarray, order: Order, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix n-grams with their texts and positions."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    chosen = place < prefix_length(size, percent)[d]
    return order.sort(h, d)[chosen], d[chosen], place[chosen]


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets of members reach the similarity; the suffix filter goes first.

    Numbers fall into bins by their first bits; differences of bin sizes add up to a
    bound of how many members the sets do not share.
    """
    total = len(left) + len(right)
    need = -(-percent * total // (100 + percent))  # least intersection
    edges = np.arange(1, SUFFIX_BINS, dtype=np.uint64) << np.uint64(MEMBER_BITS - 4)
    sizes = [np.diff(np.concatenate(([0], np.searchsorted(s, edges), [len(s)]))) for s in (left, right)]
    if np.abs(sizes[0] - sizes[1]).sum() > total - 2 * need:
        return False
    both = np.concatenate((left, right))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (total - shared)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, stored. Only sets of vertices that may be in a pair are dealt out, each once."""
    ends = pairs.select(F.col("a").alias("v")).union(pairs.select("b"))
    sieve = pairs.sparkSession.sparkContext.broadcast(sieve_of(ends, "v", END_BITS))  # of fixed size

    def asked_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            yield batch.filter(pa.array(sieve.value.passes(v)))
            del batch
        trim()

    near = sets.mapInArrow(asked_for, "v long, grams binary").groupBy("v").agg(F.first("grams").alias("grams"))
    a = near.select(F.col("v").alias("a"), F.col("grams").alias("ga"))
    b = near.select(F.col("v").alias("b"), F.col("grams").alias("gb"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [similar(unpack(x.as_buffer()), unpack(y.as_buffer()), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            ends_of = pa.RecordBatch.from_arrays([pa.array(c.to_numpy(zero_copy_only=False)) for c in batch.columns[:2]], names=["a", "b"])
            del batch  # whole sets: they go before the next ones come
            yield ends_of.filter(pa.array(fine, pa.bool_()))
        trim()

    fresh = stored(pairs.join(b, "b").join(a, "a").select("a", "b", "ga", "gb").mapInArrow(each, "a long, b long"), "links")
    sieve.destroy()  # on the driver too
    return fresh


def parities(h: np.ndarray, d: np.ndarray, n_docs: int) -> np.ndarray:
    """For each set whether it has an odd number of members in each of PARITY_BITS ranges of hashes: rows of 64-bit words."""
    count = np.bincount(d * PARITY_BITS + (h >> np.uint64(MEMBER_BITS - 9)).astype(np.int64), minlength=n_docs * PARITY_BITS)
    return np.packbits((count & 1).astype(bool).reshape(n_docs, PARITY_BITS), axis=1, bitorder="little").view("<i8")


_PARITIES = [f"p{k}" for k in range(PARITY_BITS // 64)]


def _need(both: Column, percent: int) -> Column:
    """The least intersection of similar sets whose sizes add up to ``both``."""
    return F.ceil(percent * both / F.lit(100 + percent))


def _early(percent: int) -> Column:
    """Whether a list's member has enough n-grams from the list's one on to be similar to a set of its size.

    Of two similar sets the smaller one has, at the first n-gram that they share: all
    that they share are there or later. So hubs need not be other members.
    """
    return _need(2 * F.col("n"), percent) <= F.col("n") - F.col("place")


def _may_be_similar(percent: int) -> Column:
    """Length, positional and suffix filters of a list's member (n, place, p...) against a hub (hn, hplace, hp...).

    The positional one takes the list's n-gram for the first that both share, with
    none before it: similar sets pass at their first one, and need not at others. A
    range in which one set has an odd number of members and the other an even one
    holds a member that they do not share; the suffix filter adds these up.
    """
    need = _need(F.col("n") + F.col("hn"), percent)
    most = F.least(F.col("n") - F.col("place"), F.col("hn") - F.col("hplace"))
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"h{p}"))) for p in _PARITIES), F.lit(0))
    return (100 * F.least("n", "hn") >= percent * F.greatest("n", "hn")) & (most >= need) & (apart <= F.col("n") + F.col("hn") - 2 * need)


def _classes(labels: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Labels (v, c, links) with new links (a, b) taken in: only the classes that these connect are labelled anew."""
    ends = fresh.select(F.col("a").alias("v")).union(fresh.select("b")).groupBy("v").agg(F.count(F.lit(1)).alias("more"))
    if labels is None:
        return stored(components(fresh).join(ends, "v").select("v", "c", F.col("more").alias("links")), "components")
    base = stored(labels.join(ends, "v", "full").select("v", F.coalesce("c", "v").alias("c"), (F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("links")), "classes")
    of = base.select("v", "c")
    between = fresh.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    renamed = components(between)
    out = stored(base.join(renamed.toDF("c", "to"), "c", "left").select("v", F.coalesce("to", "c").alias("c"), "links"), "components")
    discard(base, renamed)
    return out


def links(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(v, c) of all vertices that are linked with another. ``lists``: (gram, v, n, place, p...) of shared prefix n-grams."""
    labels, done = None, []
    hubs, compared = 1, 0
    while True:
        if labels is None:
            now = lists.withColumn("c", F.col("v")).withColumn("links", F.lit(0).cast("long"))
        else:
            now = lists.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v")).withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
        # lists whose members are not all of one component yet, nor all compared with each early one; sums, so that tasks send one row a list
        entry = F.when(_early(percent), F.struct((-F.col("links")).alias("few"), "c", "v", "n", "place", *_PARITIES))
        open_ = now.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(entry).alias("k"), *([F.min(entry).alias("h")] if hubs == 1 else []))
        open_ = open_.where((F.col("lo") != F.col("hi")) & (F.col("k") > compared))
        if hubs > 1:
            before, lists = lists, stored(now.join(open_.select("gram"), "gram", "left_semi"), "lists")
            discard(before)
            if lists.isEmpty():
                discard(lists, *done)
                return None if labels is None else labels.select("v", "c")
            now = lists
            first = Window.partitionBy("gram").orderBy(F.desc("links"), "c", "v")
            open_ = now.where(_early(percent)).withColumn("k", F.row_number().over(first)).where(F.col("k") <= hubs).select("gram", F.struct("c", "v", "n", "place", *_PARITIES).alias("h"))
        hub = open_.select("gram", F.col("h.v").alias("hub"), F.col("h.n").alias("hn"), F.col("h.place").alias("hplace"), F.col("h.c").alias("hc"), *[F.col(f"h.{p}").alias(f"h{p}") for p in _PARITIES])
        pairs = now.join(hub, (now["gram"] == hub["gram"]) & (F.col("c") != F.col("hc")) & _may_be_similar(percent))
        pairs = pairs.select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b"), F.lit(False).alias("old"))
        for old in done:
            pairs = pairs.union(old.withColumn("old", F.lit(True)))
        pairs = stored(pairs.groupBy("a", "b").agg(F.max("old").alias("old")).where("NOT old").select("a", "b"), "pairs")
        done.append(pairs)
        if not pairs.isEmpty():
            fresh = _verified(pairs, sets, percent)
            if not fresh.isEmpty():
                spent, labels = labels, _classes(labels, fresh)
                discard(spent)
            discard(fresh)
        release(lists.sparkSession)
        lists = lists.drop("c", "links")
        compared, hubs = hubs, hubs * HUB_GROWTH


def joined(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a row: id, n_shingles, component_id."""
    rows, classes = _joined(narrow(docs, id_column, text_column), n, percent, id_column, text_column, None)
    named = classes.select("v", "component_id")
    with_words = rows.where("n_shingles > 0").join(named, "v").select(f"`{id_column}`", "n_shingles", "component_id")
    without = rows.where("n_shingles = 0").select(f"`{id_column}`", "n_shingles", F.col(f"`{id_column}`").alias("component_id"))
    return with_words.unionByName(without)


def _joined(docs: DataFrame, n: int, percent: int, id_column: str, text_column: str, row_key: Column | None) -> tuple[DataFrame, DataFrame]:
    """Stored rows (id, v, n_shingles, _row_key) and vertices (v, c, component_id, row_key: that of the row which stands for the component)."""
    spark = docs.sparkSession
    vertices = stored(vertices_of(docs, n, id_column, text_column, row_key), "sets")
    rows = stored(vertices.drop("grams"), "vertices")
    sets = vertices.where("grams IS NOT NULL").select("v", "grams")
    buckets = bucket_count(docs, text_column)
    order = spark.sparkContext.broadcast(order_of(sets, buckets))  # at most MOST_FREQUENT entries

    def prefix_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for h, d, _, size in _sets(batches):
            yield _prefixes(h, d, size, order.value, percent)[0]

    shared = stored(counted(sets, prefix_grams, buckets, least=2), "shared")
    sieve = spark.sparkContext.broadcast(sieve_of(shared, "key"))  # of fixed size
    discard(shared)
    release(spark)  # as each of the next steps: at any time files of one step's shuffles are there

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, d, vertex, size in _sets(batches):
            gram, doc, place = _prefixes(h, d, size, order.value, percent)
            may = sieve.value.passes(gram)
            cut = pa.array(np.searchsorted(doc[may], np.arange(len(vertex) + 1)), pa.int32())
            bits = parities(h, d, len(vertex))
            out = pa.RecordBatch.from_arrays([pa.array(as_long(vertex)), pa.array(size, pa.int64()), *[pa.array(np.ascontiguousarray(x)) for x in bits.T], pa.ListArray.from_arrays(cut, pa.array(as_long(gram[may]))), pa.ListArray.from_arrays(cut, pa.array(place[may], pa.int64()))], names=["v", "n", *_PARITIES, "prefix", "places"])
            yield out.filter(pa.array(np.diff(cut.to_numpy()) > 0))
        trim()

    found = sets.mapInArrow(candidates, f"v long, n long, {', '.join(f'{p} long' for p in _PARITIES)}, prefix array<long>, places array<long>")
    found = stored(found.groupBy("v").agg(F.first(F.struct("n", *_PARITIES, "prefix", "places")).alias("x")).select("v", "x.*"), "prefixes")
    order.destroy()  # on the driver too
    sieve.destroy()
    release(spark)
    lists = found.select("v", "n", *_PARITIES, F.explode(F.arrays_zip("prefix", "places")).alias("x")).select(F.col("x.prefix").alias("gram"), "v", "n", F.col("x.places").alias("place"), *_PARITIES)
    linked = links(lists, sets, percent)
    discard(vertices, found)
    release(spark)
    # the row of the smallest id stands for a component; null ids come last, then the row's key decides
    first = F.min(F.struct(F.col(f"`{id_column}`").isNull().alias("none"), F.col(f"`{id_column}`").alias("id"), "_row_key")).alias("first")
    classes = rows.where("n_shingles > 0").groupBy("v").agg(first)
    classes = classes.join(linked, "v", "left").select("v", "first", F.coalesce("c", "v").alias("c")) if linked is not None else classes.select("v", "first", F.col("v").alias("c"))
    least = classes.groupBy("c").agg(F.min("first").alias("least"))
    return rows, classes.join(least, "c").select("v", "c", F.col("least.id").alias("component_id"), F.col("least._row_key").alias("row_key"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component, and all rows without words.

    It is the row with the smallest id (nulls last); of several such rows of one
    component, one text by its key, and one row of those with equal id and text.
    Rows of different components all stay, whatever their ids. Only rows that may
    have to go are sent through a shuffle.
    """
    key = F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    rows, classes = _joined(narrow(docs, id_column, text_column), n, percent, id_column, text_column, key)
    stay = classes.select(F.col("row_key").alias("_row_key")).distinct().withColumn("stays", F.lit(True))
    times = rows.where("n_shingles > 0").groupBy("_row_key").agg(F.count(F.lit(1)).alias("times"))
    judged = times.join(stay, "_row_key", "left").where("stays IS NULL OR times > 1")
    judged = stored(judged.select(F.col("_row_key").alias("_judged"), F.coalesce("stays", F.lit(False)).alias("_stays")), "judged")
    sieve = docs.sparkSession.sparkContext.broadcast(sieve_of(judged, "_judged"))  # of fixed size

    @F.pandas_udf("boolean")
    def may(own: pd.Series) -> pd.Series:
        return pd.Series(sieve.value.passes(own.to_numpy(np.int64).view(np.uint64)))

    all_rows = packed(docs, _own=key).withColumn("_may", may("_own"))
    asked = all_rows.where("_may").join(judged, F.col("_own") == F.col("_judged"), "left")
    once = asked.where("_stays").groupBy("_own").agg(F.first("_row").alias("_row")).select("_row")
    return all_rows.where("NOT _may").select("_row").union(asked.where("_stays IS NULL").select("_row")).union(once).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(documents(spark, sf_dir))
