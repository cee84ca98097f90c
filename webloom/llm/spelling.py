"""Groups of spelling variants: words at a distance of one edit, found by automata over a trie.

The words of a table are counted (one shuffle of partial counts), sorted into shards of
neighbouring words, and each shard becomes a compact trie: a bitmap of labels and the place of the
first child for each node, children of a node side by side. A few shards at a time, bounded by their
bytes, are sent to all workers. There each word's automaton of distance one is intersected
with each shard depth-first: a stack of blocks of states (word, node, place in the word), of which the last
block is followed first. Each edit has one canonical form, so a neighbour is accepted once:
of equal letters in a row the last is deleted, and a letter is never inserted before its equal.

A word's answers from all shards are added up. Forms of forms are followed by joining
the table of forms with itself; as a form is at least twice as frequent as its word, the
number of joins grows with the logarithm of a logarithm of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.tables import discard, documents, stored

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_CHARS = 5
LEAST_COUNT = 3
#: A form has to be so many times as frequent as the word.
TIMES = 2
#: Letters of the words of a shard, and bytes of the shards that are sent at once.
SHARD_CHARS = 2 << 20
SENT_BYTES = 96 << 20
#: Words of a task that asks, and of a file.
TASK_WORDS = 1 << 14
FILE_WORDS = 1 << 18
#: Words of a block, and states that are followed at once.
BLOCK_WORDS = 4096
STATES = 1 << 17

#: Letters by their place in a bitmap: a to z, then the accented ones.
_PLACE = np.full(256, 127, np.uint8)
_PLACE[97:123] = np.arange(26)
_PLACE[0xC0:0x100] = np.arange(26, 90)
_ONE = np.uint64(1)


def lowered(x: Column) -> Column:
    """A-Z in lower case, all else as it is. Most words are so already."""
    return F.when(F.lower(x) == x, x).otherwise(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = LEAST_CHARS, least: int = LEAST_COUNT, slip: int = 97) -> DataFrame:
    """(word, n) of all whole texts: runs of letters, of which a hash of document and run picks one in ``slip`` to lose a letter (0: none).

    Null texts have no words, a null id counts as the empty text; repeated rows count each time.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.col(f"`{text_column}`"), F.lit(RUN), 0)).alias("w")).withColumn("w", lowered(F.col("w")))
    if slip:
        rows = rows.withColumn("h", F.crc32(F.concat("i", F.lit(":"), "w").cast("binary")))
        at = (F.col("h") % F.length("w")).cast("int")
        rows = rows.select(F.when(F.col("h") % slip == 0, F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))).otherwise(F.col("w")).alias("w"))
    return rows.where(F.length("w") >= least_chars).groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


@dataclass
class Trie:
    """Nodes by depth; children of a node lie side by side from ``first`` on, in the order of ``low``'s and ``high``'s bits."""

    label: np.ndarray  # of the way to each node
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    ends: np.ndarray  # the word that ends here, or -1
    count: np.ndarray  # of each word
    begin: np.ndarray  # of each word's letters, and where the last ends
    letters: np.ndarray

    def parts(self) -> list[bytes]:
        return [x.tobytes() for x in (self.label, self.low, self.high, self.first, self.ends, self.count, self.begin, self.letters)]

    @staticmethod
    def of(parts: list[bytes]) -> Trie:
        kinds = (np.uint8, np.uint64, np.uint64, np.int32, np.int32, np.int64, np.int64, np.uint8)
        return Trie(*(np.frombuffer(p, k) for p, k in zip(parts, kinds, strict=True)))

    def child(self, node: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Each node's child by its label, or -1."""
        wide = label >= 64
        bit = _ONE << (label & np.uint8(63)).astype(np.uint64)
        low, high = self.low[node], self.high[node]
        has = np.where(wide, high, low) & bit != 0
        below = np.where(wide, np.bitwise_count(low).astype(np.int64) + np.bitwise_count(high & (bit - _ONE)), np.bitwise_count(low & (bit - _ONE)))
        return np.where(has & (label < 127), self.first[node] + below, -1)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``node``, child) of all children."""
        n = np.bitwise_count(self.low[node]).astype(np.int64) + np.bitwise_count(self.high[node])
        of = np.repeat(np.arange(len(node)), n)
        return of, self.first[node][of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]


def _ragged(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.concatenate(([0], np.cumsum(sizes))), np.frombuffer("".join(strings).encode("latin-1"), np.uint8)


def trie(strings: list[str], count: np.ndarray) -> Trie:
    """A trie over different words in ascending order, all of them at least one letter long."""
    begin, letters = _ragged(strings)
    size = np.diff(begin)
    # letters that a word shares with the one before it
    shared = np.zeros(len(strings), np.int64)
    live, depth = np.arange(1, len(strings)), 0
    while len(live):
        live = live[(size[live] > depth) & (size[live - 1] > depth)]
        live = live[letters[begin[live] + depth] == letters[begin[live - 1] + depth]]
        depth += 1
        shared[live] = depth
    # a node for each letter after those: in the order of words, then dealt by depth
    fresh = size - shared
    word = np.repeat(np.arange(len(strings)), fresh)
    level = shared[word] + np.arange(len(word)) - (np.cumsum(fresh) - fresh)[word]
    order = np.argsort(level, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)  # 0 is the root
    label = _PLACE[letters[begin[word] + level]]
    # the parent of a word's first node is the last node of the level above that came before it
    parent = np.empty(len(order), np.int64)
    inner = level > shared[word]
    parent[inner] = place[np.flatnonzero(inner) - 1]
    heads = np.flatnonzero(~inner)
    starts = np.searchsorted(level[order], np.arange(int(level.max(initial=0)) + 2))
    for d in np.unique(level[heads]).tolist():
        own = heads[level[heads] == d]
        if d == 0:
            parent[own] = 0
        else:
            above = order[starts[d - 1] : starts[d]]
            parent[own] = place[above[np.searchsorted(above, own) - 1]]
    nodes = len(order) + 1
    low, high, first = np.zeros(nodes, np.uint64), np.zeros(nodes, np.uint64), np.zeros(nodes, np.int32)
    bit = _ONE << (label & np.uint8(63)).astype(np.uint64)
    np.bitwise_or.at(low, parent[label < 64], bit[label < 64])
    np.bitwise_or.at(high, parent[label >= 64], bit[label >= 64])
    by_place = parent[order]
    lead = np.flatnonzero(np.concatenate(([True], by_place[1:] != by_place[:-1]))) if len(order) else order
    first[by_place[lead]] = lead + 1
    ends = np.full(nodes, -1, np.int32)
    ends[place[np.cumsum(fresh) - 1]] = np.arange(len(strings))
    return Trie(np.append(np.uint8(127), label[order]), low, high, first, ends, np.asarray(count, np.int64), begin, letters)


def neighbours(shard: Trie, strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, word of the shard) at a distance of exactly one edit, each pair once."""
    begin, letters = _ragged(strings)
    size, letters = np.diff(begin), np.append(_PLACE[letters], np.uint8(127))
    at = lambda word, i: np.where(i < size[word], letters[np.minimum(begin[word] + i, len(letters) - 1)], np.uint8(127)).astype(np.uint8)
    # states before the edit: each word's own way down, one step a round
    stack: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = [(np.arange(len(strings)), np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64), False)]
    while stack:
        word, node, i, edited = stack.pop()
        if len(word) > STATES:
            half = len(word) // 2
            stack += [(word[half:], node[half:], i[half:], edited), (word[:half], node[:half], i[:half], edited)]
            continue
        own = at(word, i)
        if edited:
            done = i == size[word]
            hit = shard.ends[node[done]]
            if (hit >= 0).any():
                yield word[done][hit >= 0], hit[hit >= 0]
            word, node, i, own = word[~done], node[~done], i[~done], own[~done]
            below = shard.child(node, own)
            go = below >= 0
            if go.any():
                stack.append((word[go], below[go], i[go] + 1, True))
            continue
        # the word's next letter is deleted, if it is the last of its equals
        cut = (i < size[word]) & (at(word, i + 1) != own)
        after = [(word[cut], node[cut], i[cut] + 1)]
        # another letter stands instead of it, or before it
        of, kid = shard.children(node)
        other = shard.label[kid] != own[of]
        of, kid = of[other], kid[other]
        instead = i[of] < size[word[of]]
        after += [(word[of[instead]], kid[instead], i[of[instead]] + 1), (word[of], kid, i[of])]
        below = shard.child(node, own)
        go = below >= 0
        if go.any():
            stack.append((word[go], below[go], i[go] + 1, False))
        w, n, j = (np.concatenate(x) for x in zip(*after, strict=True))
        if len(w):
            stack.append((w, n, j, True))


def _few(df: DataFrame, each: int, rows: int | None = None) -> DataFrame:
    """A frame in no more partitions than its rows need, so that small tables make few files."""
    return df.coalesce(-(-(df.count() if rows is None else rows) // each) or 1)


def shards(counted: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """A row (size, parts) a trie of neighbouring words; words are dealt by ranges, and a task cuts what it gets into tries of ``shard_chars`` letters."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, counts, held = [], [], 0

        def built() -> pa.RecordBatch:
            parts = trie(strings, np.concatenate(counts)).parts()
            return pa.RecordBatch.from_pydict({"size": pa.array([sum(map(len, parts))], pa.int64()), "parts": pa.array([parts], pa.list_(pa.binary()))})

        for batch in batches:
            own, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            start = 0
            while start < len(own):
                stop = start
                while stop < len(own) and held < shard_chars:
                    held += len(own[stop])
                    stop += 1
                strings += own[start:stop]
                counts.append(n[start:stop])
                start = stop
                if held >= shard_chars:
                    yield built()
                    strings, counts, held = [], [], 0
        if strings:
            yield built()

    chars = counted.agg(F.sum(F.length("word")).alias("c")).first()["c"] or 0
    k = -(-chars // shard_chars) or 1
    ranges = counted.select("word", "n").repartitionByRange(k, "word").coalesce(k)  # if the session deals out more, its ranges are joined again
    return ranges.sortWithinPartitions("word").mapInArrow(each, "size long, parts array<binary>")


def answers(counted: DataFrame, sent: list[list[bytes]]) -> DataFrame:
    """(word, n, n_near, best_n, best) of each word with neighbours in the shards that are sent."""
    everywhere = counted.sparkSession.sparkContext.broadcast(sent)  # SENT_BYTES and one shard at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [Trie.of(p) for p in everywhere.value]
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_WORDS):
                part = batch.slice(start, BLOCK_WORDS)
                strings = part.column(0).to_pylist()
                near = np.zeros(len(strings), np.int64)
                best: list[tuple[int, str] | None] = [None] * len(strings)
                for t in tries:
                    pairs = list(neighbours(t, strings))
                    if not pairs:
                        continue
                    query, hit = (np.concatenate(x) for x in zip(*pairs, strict=True))
                    near += np.bincount(query, minlength=len(strings))
                    # the first of each query: most frequent, then smallest, as words of a shard are ascending
                    order = np.lexsort((hit, -t.count[hit], query))
                    query, hit = query[order], hit[order]
                    lead = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
                    for q, h in zip(query[lead].tolist(), hit[lead].tolist(), strict=True):
                        own = (-int(t.count[h]), t.letters[t.begin[h] : t.begin[h + 1]].tobytes().decode("latin-1"))
                        best[q] = own if best[q] is None else min(best[q], own)
                keep = np.flatnonzero(near)
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array([strings[k] for k in keep], pa.string()), "n": part.column(1).take(pa.array(keep)), "n_near": pa.array(near[keep], pa.int64()),
                    "best_n": pa.array([-best[k][0] for k in keep], pa.int64()), "best": pa.array([best[k][1] for k in keep], pa.string()),
                })

    return _few(counted, TASK_WORDS).select("word", "n").mapInArrow(each, "word string, n long, n_near long, best_n long, best string")


def near_words(counted: DataFrame, shard_chars: int = SHARD_CHARS, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(word, n_near, form, form_n): all words that have neighbours; ``counted`` holds different words of letters and their counts."""
    cut = stored(shards(counted, shard_chars), "tries")
    found, sent, size = [], [], 0

    def ask() -> None:
        found.append(stored(answers(counted, sent), "near"))

    for row in cut.select("size", "parts").toLocalIterator():
        sent.append([bytes(p) for p in row["parts"]])
        size += row["size"]
        if size >= sent_bytes:
            ask()
            sent, size = [], 0
    if sent or not found:
        ask()
    discard(cut)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return reduce(DataFrame.unionAll, found).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("form"), (-F.col("b.less")).alias("form_n"))


def grouped(counted: DataFrame, times: int = TIMES, shard_chars: int = SHARD_CHARS, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all counted words. A form is the most frequent neighbour (of equal ones the smallest) if it is ``times`` (2 or more) as frequent."""
    near = near_words(counted, shard_chars, sent_bytes)
    good = F.col("form_n") >= times * F.col("n")
    rows = counted.join(near, "word", "left").select(
        "word", F.when(good, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form_n")).alias("form_n"),
    )
    n = counted.count()
    rows = stored(_few(rows, FILE_WORDS, n), "forms")
    # where each word with a form leads; what has none ends the way
    way = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = way.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = stored(_few(step, FILE_WORDS, n), "roots")
        more = not step.where("moved").isEmpty()
        discard(way)
        way = step.drop("moved")
        way._webloom_path = step._webloom_path
        if not more:
            break
    return _few(rows.join(way, "word", "left"), FILE_WORDS, n).select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(stored(words(documents(spark, sf_dir)), "words"))


ORACLE_SQL = f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS k, w, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) GROUP BY ALL),
hashed AS (SELECT w, n, (SELECT xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(k)) + 1), lambda i: ('0x' || hex(encode(k)[i:i]))::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) FROM crc) AS h FROM runs),
counted AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substring(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, i, left(word, i) || substring(word, i + 2) AS rest FROM counted, unnest(range(length(word))) AS u(i)),
near AS MATERIALIZED (SELECT a.word AS word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN counted w ON w.word = c.rest UNION SELECT w.word, c.word FROM cut c JOIN counted w ON w.word = c.rest),
best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS form_n, arg_min(other, (-o.n, other COLLATE "C")) AS form FROM near JOIN counted o ON o.word = other GROUP BY near.word),
forms AS MATERIALIZED (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * c.n THEN form END AS form, CASE WHEN form_n >= {TIMES} * c.n THEN form_n END AS form_n FROM counted c LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root FROM forms UNION ALL SELECT way.word, f.form FROM way JOIN forms f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT way.word, way.root FROM way JOIN forms e ON e.word = way.root WHERE e.form IS NULL) r USING (word)"""
