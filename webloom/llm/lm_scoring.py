"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a logarithmic scale; the filter
holds a pair once for each level up to its count's, so a count comes back by
probing level after level until a probe fails. All pairs are in filters, one for
each shard of the keys, sized by its entries; texts ask a shard for their pairs
by one shuffle. Frequent words and pairs are broadcast besides, up to
``most_words`` and ``most_pairs``, and need not be asked for; other words are
joined. So every word and every pair of the training corpus counts, at any size,
and the bounds only decide which way a count comes.

    P(v | u) = b * pair(u, v) / word(u) + (1 - b) * P(v)
    P(v)     = word(v) / Z,   one share is left for all unknown words

A text's score is a sum: log P(v) of each token, log(1 - b) for each that follows
a known word, and for each pair that was seen the log of what it adds,

    1 + b * pair(u, v) / (word(u) * (1 - b) * P(v)).

Pair counts are rounded down and the count that divides them up, so the
probabilities after a word never sum to more than one.

The exact smoothed unigram score beside it needs each token's count: frequent
words go along as a bounded table, all others are joined on the word.

Defined results: a null text is as an empty one and holds the end token alone; a
text's hashes stand for its words, lower-cased in A-Z; repeated rows get equal
scores; an empty table gives an empty one; other columns are ignored; a document
is split over batches never, over tasks never.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.tables import crc_split, documents, narrow, release, stored
from webloom.llm.tally import SCHEMA, Sender, bucket_count, merged, trim
from webloom.llm.textarrays import Words, as_long, mix, slices, words_of

SMOOTHING = 0.1
MOST_WORDS = 1 << 20
MOST_PAIRS = 1 << 21
LEVELS_A_DOUBLING = 2
PAIR_WEIGHT = 0.5
GUARD = 2
BITS_PER_ENTRY = 12
PROBES = 6
PAIR_BITS = 48
SLICE_BYTES = 4 << 20
SLICE_ROWS = 1 << 16
END = np.uint64(0x5EED0E4D)  # the end token's hash; no word's is known to be it

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def level_of(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and ``LEVELS_A_DOUBLING`` more for each doubling, rounded down."""
    return 1 + np.floor(np.log2(np.maximum(count, 1)) * LEVELS_A_DOUBLING + 1e-9).astype(np.int64)


def least_of(level: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(level > 0, np.ceil(2.0 ** ((level - 1) / LEVELS_A_DOUBLING) - 1e-9), 0.0)


def most_of(level: np.ndarray) -> np.ndarray:
    """A bound that no count of a level reaches beyond."""
    return np.where(level > 0, 2.0 ** (level / LEVELS_A_DOUBLING), 0.0)


class LogFrequencyFilter:
    """Quantised counts of 64-bit keys in one Bloom filter."""

    def __init__(self, entries: int, bits: int = BITS_PER_ENTRY, probes: int = PROBES):
        self.size = 1 << max(13, int(np.ceil(np.log2(max(entries * bits, 1)))))
        self.bits = np.zeros(self.size // 8, dtype=np.uint8)
        self.probes = probes
        self.highest = 0

    @classmethod
    def of(cls, bits: bytes, highest: int) -> LogFrequencyFilter:
        """A filter from its stored bits."""
        out = cls(0)
        out.bits, out.size, out.highest = np.frombuffer(bits, np.uint8), len(bits) * 8, highest
        return out

    def _start(self, key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """A key's first place on a level (modulo the size) and the step to its others."""
        h = mix(key + np.uint64(level * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        return h, (h >> np.uint64(32)) | np.uint64(1)

    def add(self, keys: np.ndarray, levels: np.ndarray) -> None:
        # a byte a bit while bits are set, a part of the filter at a time
        part = min(self.size, 1 << 26)
        for first in range(0, self.size, part):
            flags = np.unpackbits(self.bits[first >> 3 : (first + part) >> 3], bitorder="little").view(bool)
            some, left, level = keys, levels, 1
            while len(some):
                place, step = self._start(some, level)
                for _ in range(self.probes):
                    at = place & np.uint64(self.size - 1)
                    place = place + step
                    if part < self.size:
                        at = at[(at >= np.uint64(first)) & (at < np.uint64(first + part))] - np.uint64(first)
                    flags[at.astype(np.int64)] = True
                self.highest = max(self.highest, level)
                more = left > level
                some, left, level = some[more], left[more], level + 1
            self.bits[first >> 3 : (first + part) >> 3] = np.packbits(flags, bitorder="little")

    def _has(self, keys: np.ndarray, level: int) -> np.ndarray:
        alive = np.arange(len(keys))
        place, step = self._start(keys, level)
        for _ in range(self.probes):
            at = place & np.uint64(self.size - 1)
            some = np.flatnonzero((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            alive, step = alive[some], step[some]
            place = place[some] + step
        return alive

    def level(self, keys: np.ndarray) -> np.ndarray:
        """How many levels in a row are found for each key."""
        unique, back = np.unique(keys, return_inverse=True)
        found = np.zeros(len(unique), dtype=np.int64)
        alive, level = np.arange(len(unique)), 1
        while len(alive) and level <= self.highest:
            alive = alive[self._has(unique[alive], level)]
            found[alive] = level
            level += 1
        return found[back]


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0xD1342543DE82EF95) + right) >> np.uint64(64 - PAIR_BITS)


def filter_of(pairs: np.ndarray, levels: np.ndarray) -> LogFrequencyFilter:
    """A filter with ``GUARD`` levels below each pair's own: an unseen pair needs so many more false hits to count as seen once."""
    out = LogFrequencyFilter(int((levels + GUARD).sum()))
    out.add(pairs, levels + GUARD)
    return out


def pair_level(held: LogFrequencyFilter, pairs: np.ndarray) -> np.ndarray:
    """Levels of pairs in a filter made by ``filter_of``."""
    return np.maximum(held.level(pairs) - GUARD, 0)


def tokens_with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text's, and each text's first place."""
    starts = words.doc_start[:-1] + np.arange(words.n_docs)
    out = np.empty(len(words.hashes) + words.n_docs, dtype=np.uint64)
    ends = words.doc_start[1:] + np.arange(words.n_docs)
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[inner] = words.hashes
    out[ends] = END
    return out, starts


@dataclass
class Model:
    filter: LogFrequencyFilter
    n_tokens: int
    n_distinct: int
    hot: np.ndarray  # sorted hashes of frequent words
    hot_count: np.ndarray
    total: float  # of all words' counts, as P(v) uses them
    weight: float
    least_pair: int  # the level that every pair in the filter has at least
    all_pairs: bool  # whether the filter holds every pair
    shards: int
    sharded: DataFrame | None  # (shard, highest, bits): the filters of all pairs; not broadcast

    def exact(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of frequent words (0: not among them), and whether each is among them."""
        if not len(self.hot):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hot, hashes), len(self.hot) - 1)
        known = self.hot[at] == hashes
        return np.where(known, self.hot_count[at], 0), known

    def chance(self, level: np.ndarray) -> np.ndarray:
        """P(v) of words by their level; 0: unknown."""
        return (least_of(level) + SMOOTHING) / self.total

    def gain(self, pair: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """log10 of what a pair adds, by the levels of the pair and of its words."""
        share = np.where(pair > 0, np.minimum(least_of(pair) / np.maximum(most_of(left), 1), 1.0), 0.0)
        return np.log10(1 + self.weight * share / ((1 - self.weight) * self.chance(right)))

    def levels(self, tokens: np.ndarray, starts: np.ndarray, exact: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Levels of tokens and of the pairs that end at them (0 at a text's first); -1: the stored counts have to tell. ``exact``: what ``exact`` gave, if it was asked."""
        count, known = exact or self.exact(tokens)
        word = np.where(known, level_of(count), 0 if len(self.hot) == self.n_distinct else -1)
        pair = np.zeros(len(tokens), dtype=np.int64)
        inner = np.ones(len(tokens), dtype=bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        # a pair below the least level of all pairs was not put in: only a chain of false hits counts wrongly
        found = pair_level(self.filter, pair_key(tokens[at - 1], tokens[at]))
        pair[at] = np.where(found >= self.least_pair, found, 0 if self.all_pairs else -1)
        pair[at[(word[at - 1] == 0) | (word[at] == 0)]] = 0
        return word, pair

    def log10(self, tokens: np.ndarray, starts: np.ndarray, levels: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """log10 of P(token | token before it, if any) for each token, of what is broadcast; without a level a summand is left out."""
        word, pair = levels or self.levels(tokens, starts)
        before = np.concatenate(([0], word[:-1])) if len(word) else word
        before[starts] = 0
        out = np.where(word >= 0, np.log10(self.chance(word)), 0.0) + np.where(before > 0, np.log10(1 - self.weight), 0.0)
        return out + np.where((pair > 0) & (before > 0) & (word > 0), self.gain(pair, before, word), 0.0)


def _tally(rows: DataFrame, shards: int, most_pairs: int) -> DataFrame:
    """(kind, key, n, highest, bits): kind 0 words and ends, 1 filters (``key`` the shard, ``n`` its pairs that are not of kind 2), 2 frequent pairs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Sender(shards), Sender(shards, shards)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                tokens, starts = tokens_with_ends(words_of(batch.column(0), lower=True))
                inner = np.ones(max(len(tokens) - 1, 0), dtype=bool)
                inner[starts[1:] - 1] = False
                yield from pairs.add(pair_key(tokens[:-1], tokens[1:])[inner])
                yield from words.add(tokens)
        yield from pairs.flush()
        yield from words.flush()
        trim()

    def counts(kind: int, key: np.ndarray, n: np.ndarray) -> pa.Table:
        k = len(key)
        return pa.table([pa.array(np.full(k, kind), pa.int32()), pa.array(as_long(key)), pa.array(n, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["kind", "key", "n", "highest", "bits"])

    def merge(group: pa.Table) -> pa.Table:
        """All of one bucket: its words, or its pairs' filter and the most frequent of its pairs."""
        bucket = group["bucket"][0].as_py()
        key, n = merged(group, shards)
        if bucket < shards:
            return counts(0, key, n)
        level = level_of(n)
        held = filter_of(key, level)
        # the most frequent levels that have no more than this shard's part of most_pairs
        above = np.cumsum(np.bincount(level)[::-1])[::-1]
        often = level >= int((above > most_pairs // shards).sum())
        row = [[1], [bucket - shards], [int((~often).sum())], [held.highest], [held.bits.tobytes()]]
        one = pa.table([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["kind", "key", "n", "highest", "bits"])
        return pa.concat_tables([one, counts(2, key[often], n[often])])

    return rows.mapInArrow(each, SCHEMA).groupBy("bucket").applyInArrow(merge, "kind int, key long, n long, highest int, bits binary")


def _cut(counts: DataFrame, most: int) -> int:
    """The least level such that at most ``most`` entries are of it or above: a histogram of at most 130 rows decides."""
    level = F.floor(F.log2("n") * LEVELS_A_DOUBLING + 1e-9)
    rows = sorted(((r["l"], r["k"]) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, cut = 0, None
    for at, k in rows:
        total += k
        if total > most:
            break
        cut = at
    return 1 << 62 if cut is None else int(np.ceil(2.0 ** (cut / LEVELS_A_DOUBLING) - 1e-6))


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(column), dtype=np.int64)


def train(docs: DataFrame, text_column: str = "text", most_words: int = MOST_WORDS, most_pairs: int = MOST_PAIRS, weight: float = PAIR_WEIGHT) -> tuple[Model, DataFrame]:
    """Count all rows. Gives the model and the stored table of all words' counts (key, n)."""
    rows = docs.select(F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    shards = bucket_count(rows, "text")
    all_counts = stored(_tally(rows, shards, most_pairs), "lm-counts")
    release(docs.sparkSession)
    words = all_counts.where("kind = 0").select("key", "n")
    sharded = all_counts.where("kind = 1").select(F.col("key").cast("int").alias("shard"), "highest", "bits")
    sums = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_tokens, n_distinct = int(sums["n"] or 0), int(sums["v"])
    hot = words.where(F.col("n") >= _cut(words, most_words)).toArrow()
    frequent = all_counts.where("kind = 2").select("key", "n").toArrow()
    all_pairs = not all_counts.where("kind = 1 AND n > 0").count()
    key, count = _numbers(hot["key"]).view(np.uint64), _numbers(hot["n"])
    pair, often = _numbers(frequent["key"]).view(np.uint64), level_of(_numbers(frequent["n"]))
    held = filter_of(pair, often)
    # as many rows as levels
    by_level = words.groupBy(_level(F.col("n")).alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()
    total = SMOOTHING + sum(r["k"] * (float(least_of(np.int64(r["level"]))) + SMOOTHING) for r in sorted(by_level))
    order = np.argsort(key)
    least_pair = int(often.min()) if len(often) else 1
    return Model(held, n_tokens, n_distinct, key[order], count[order], total, weight, least_pair, all_pairs, shards, sharded), words


def _level(n: Column) -> Column:
    """``level_of`` in Spark; 0 for no count."""
    return F.when(n > 0, 1 + F.floor(F.log2(n) * LEVELS_A_DOUBLING + 1e-9)).otherwise(0)


def _least(level: Column) -> Column:
    return F.when(level > 0, F.ceil(F.pow(F.lit(2.0), (level - 1) / LEVELS_A_DOUBLING) - 1e-9)).otherwise(0)


def _gain(model: Model, pair: Column, left: Column, right: Column) -> Column:
    """``Model.gain`` in Spark."""
    share = F.least(_least(pair) / F.pow(F.lit(2.0), left / LEVELS_A_DOUBLING), F.lit(1.0))
    return F.log10(1 + model.weight * share * model.total / ((1 - model.weight) * (_least(right) + SMOOTHING)))


def _packed_keys(key: np.ndarray, shards: int) -> np.ndarray:
    """Keys of one shard each, without the bits that tell the shard, in as few bytes as PAIR_BITS leave."""
    width = (PAIR_BITS - shards.bit_length() + 8) // 8
    return (key // np.uint64(shards)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _unpacked(raw: bytes, shard: int, shards: int) -> np.ndarray:
    width = (PAIR_BITS - shards.bit_length() + 8) // 8
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.reshape(-1).view("<u8") * np.uint64(shards) + np.uint64(shard)


def _told(asked: DataFrame, model: Model, sent, names: list[str], schema: str) -> DataFrame:
    """Rows of texts as they are, what pairs add to each text, and pairs of which a word's count is still open.

    Rows of ``asked`` with ``_keys`` meet the filter of their shard. What a partition's
    shards add to a text becomes one row.
    """
    shards = model.shards
    partitions = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filters = model.sharded.select(F.col("shard").alias("_shard"), "highest", "bits")

    def rows_of(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], batch.schema.field(c).type if c in batch.schema.names else pa.int64()) if c in columns else pa.nulls(n, batch.schema.field(c).type if c in batch.schema.names else pa.int64()) for c in names], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, m = {}, [], sent.value  # a shard's part of all texts is as large as the shard's part of the tally
        for batch in batches:
            for row in batch.filter(batch.column("bits").is_valid()).select(["_shard", "highest", "bits"]).to_pylist():
                held[row["_shard"]] = LogFrequencyFilter.of(row["bits"], row["highest"])
            texts = batch.filter(batch.column("_at").is_valid())
            yield rows_of(texts, **{c: texts.column(c) for c in names if c in texts.schema.names})
            rest = batch.filter(batch.column("_keys").is_valid()).select(["_shard", "_base", "_keys", "_rows", "_levels", "_left", "_right"])
            if rest.num_rows:
                waiting.append((rest, texts.slice(0, 0)))
        # all that asks a shard is asked at once
        asks: dict[tuple[int, bool], list[dict]] = {}
        for batch, _ in waiting:
            for row in batch.to_pylist():
                asks.setdefault((row["_shard"], row["_left"] is not None), []).append(row)
        at, gain = [], []
        for (shard, is_open), some in asks.items():
            joined = lambda c: b"".join([r[c] for r in some])  # noqa: E731, B023
            key = _unpacked(joined("_keys"), shard, shards)
            level = pair_level(held[shard], key) if shard in held else np.zeros(len(key), np.int64)
            seen = np.flatnonzero(level)
            if not len(seen):
                continue
            base = np.repeat([r["_base"] for r in some], [len(r["_rows"]) // 2 for r in some])
            of = (base + np.frombuffer(joined("_rows"), np.uint16).astype(np.int64))[seen]
            if is_open:
                yield rows_of(waiting[0][1], _at=of, level=level[seen], left=np.frombuffer(joined("_left"), np.int64)[seen], right=np.frombuffer(joined("_right"), np.int64)[seen])
                continue
            both = np.frombuffer(joined("_levels"), np.uint8).reshape(-1, 2)[seen].astype(np.int64)
            texts, back = np.unique(of, return_inverse=True)
            at.append(texts)
            gain.append(np.bincount(back, m.gain(level[seen], both[:, 0], both[:, 1])))
        if at:
            texts, back = np.unique(np.concatenate(at), return_inverse=True)
            yield rows_of(waiting[0][1], _at=texts, score=np.bincount(back, np.concatenate(gain)))
        trim()

    return asked.unionByName(filters, allowMissingColumns=True).repartition(partitions, "_shard").mapInArrow(each, schema)


def scored(docs: DataFrame, model: Model, words: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each text's figures: the columns ``keep``, n_tokens, n_known, base_score, score."""
    spark = docs.sparkSession
    small = replace(model, sharded=None)
    sent = spark.sparkContext.broadcast(small)  # at most MOST_WORDS and MOST_PAIRS entries
    keep = keep or (id_column,)
    rows = docs.select(F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_text"), *[F.col(f"`{c}`") for c in keep])
    carried = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    all_words = len(model.hot) == model.n_distinct
    figures = ["n_tokens", "n_known", "base_score", "score"]
    names = [*keep, *figures, "_at", "_rare", "_shard", "_base", "_keys", "_rows", "_levels", "_left", "_right"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        shards = np.uint64(m.shards)
        floor = np.log10(SMOOTHING / (m.n_tokens + SMOOTHING * (m.n_distinct + 1)))
        at = TaskContext.get().partitionId() << 33  # rows are numbered by task, then by place
        for whole in batches:
            for batch in (x.slice(a, SLICE_ROWS) for x in slices(whole, "_text", SLICE_BYTES) for a in range(0, x.num_rows, SLICE_ROWS)):
                tokens, starts = tokens_with_ends(words_of(batch.column(0), lower=True))
                n = np.diff(np.append(starts, len(tokens)))
                count, known = m.exact(tokens)
                sure = np.log10((count + SMOOTHING) / (m.n_tokens + SMOOTHING * (m.n_distinct + 1)))
                base = np.add.reduceat(np.where(known, sure, floor if all_words else 0.0), starts)
                n_known = np.add.reduceat(known.astype(np.int64), starts)
                # words and pairs are looked up once for all that asks for them
                level, pair = m.levels(tokens, starts, (count, known))
                score = np.add.reduceat(m.log10(tokens, starts, (level, pair)), starts)
                other = np.flatnonzero(~known) if not all_words else np.zeros(0, np.int64)
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(other, np.append(starts, len(tokens))), pa.int32()), pa.array(as_long(tokens[other])))
                k = batch.num_rows
                ids = np.arange(at, at + k)
                none = [pa.nulls(k, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score), pa.array(ids), rare, pa.array(ids % m.shards, pa.int32()), *none], names=names)

                before = np.concatenate(([0], level[:-1]))
                left = np.concatenate(([END], tokens[:-1]))
                row = np.repeat(np.arange(k), n).astype(np.uint16)
                whole_words = (before >= 0) & (level >= 0)
                for places, is_open in ((np.flatnonzero((pair < 0) & whole_words), False), (np.flatnonzero((pair != 0) & ~whole_words), True)):
                    key = pair_key(left[places], tokens[places])
                    of = (key % shards).astype(np.int64)
                    # numbers of 16 bits are sorted by their digits
                    order = np.argsort(of.astype(np.uint16) if m.shards <= 1 << 16 else of, kind="stable")
                    places, key, of = places[order], key[order], of[order]
                    cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))).tolist() if len(of) else []
                    ends = [*cuts[1:], len(of)]
                    packed = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())  # noqa: E731, B023
                    j = len(cuts)
                    if j:
                        lr = (packed(left[places]), packed(tokens[places])) if is_open else (pa.nulls(j, pa.binary()), pa.nulls(j, pa.binary()))
                        both = np.stack([before[places], level[places]], axis=1).astype(np.uint8)
                        empty = [pa.nulls(j, c.type) for c in batch.columns[1:]] + [pa.nulls(j, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays([*empty, pa.array(of[cuts], pa.int32()), pa.array(np.full(j, at), pa.int64()), packed(_packed_keys(key, m.shards)), packed(row[places]), packed(both), *lr], names=names)
                at += k

    result = f"{carried}, n_tokens long, n_known long, base_score double, score double, _at long, _rare array<long>"
    first = rows.mapInArrow(each, f"{result}, _shard int, _base long, _keys binary, _rows binary, _levels binary, _left binary, _right binary")
    if all_words and model.all_pairs:
        return first.select(*[F.col(f"`{c}`") for c in keep], *figures)
    told = stored(_told(first, model, sent, [*keep, *figures, "_at", "_rare", "level", "left", "right"], f"{result}, level long, left long, right long"), "lm-told")
    release(spark)
    found = told.where("level IS NULL").drop("_rare", "level", "left", "right")
    if not all_words:
        # words that are in no bounded table, and pairs with one, are counted by joins on the word
        pairs = told.where("level IS NOT NULL").select("_at", "level", "left", "right")
        for side in ("left", "right"):
            pairs = pairs.join(words.select(F.col("key").alias(side), _level(F.col("n")).alias(f"{side}_level")), side)
        single = told.where(F.size("_rare") > 0).select("_at", F.explode("_rare").alias("key")).join(words, "key", "left")
        got, seen = F.coalesce(F.col("n"), F.lit(0)), F.col("n").isNotNull()
        floor = float(np.log10(SMOOTHING / (model.n_tokens + SMOOTHING * (model.n_distinct + 1))))
        followed = F.when(seen & (F.col("key") != int(END)), float(np.log10(1 - model.weight))).otherwise(0.0)
        zero = F.lit(0).cast("long")
        single = single.select("_at", zero.alias("n_tokens"), seen.cast("long").alias("n_known"), (F.log10((got + SMOOTHING) / SMOOTHING) + floor).alias("base_score"), (F.log10((_least(_level(got)) + SMOOTHING) / model.total) + followed).alias("score"))
        pairs = pairs.select("_at", zero.alias("n_tokens"), zero.alias("n_known"), F.lit(0.0).alias("base_score"), _gain(model, F.col("level"), F.col("left_level"), F.col("right_level")).alias("score"))
        found = found.unionByName(single, allowMissingColumns=True).unionByName(pairs, allowMissingColumns=True)
    sums = found.groupBy("_at").agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in keep], *[F.sum(c).alias(c) for c in figures])
    return sums.select(*[F.col(f"`{c}`") for c in keep], *figures)


def held_out(id_column: str = "doc_id") -> Column:
    return crc_split(id_column, 10) == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(documents(spark, sf_dir), "doc_id", "text").withColumn("held_out", held_out())
    model, words = train(docs.where("NOT held_out"))
    out = scored(docs, model, words, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
