"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks. With a share w of all slots, its block j (from 0) is
released at floor(j / w) and due at ceil((j + 1) / w); each slot takes the released
block with the earliest deadline. After t slots a source has then had less than
one block more or less than w t. There is no cycle and no rounding of shares to
slots: weights are whole numbers of PRECISION parts, and releases and deadlines
come from them exactly over the whole schedule.

When a source has no blocks left, the others share the slots in proportion to
their weights, and windows count from that slot on. So every slot has a block. A
source of weight 0 gets slots only once all others are used up; then those left
have equal shares.

A block has ``block_docs`` documents, or as many more as keep the schedule at
MOST_BLOCKS slots (and one a source): the schedule is one fold over its slots, and its size has
a bound whatever the number of documents. All else is joins and sums.
A document's place within its source needs no sort of a whole source: documents
are dealt by the first digits of a digest of their id, counted by (source, digits),
and numbered within these small groups, whose offsets are running sums over
counts only (at most 16 ** DIGITS a source).

Defined results: all rows are kept, each in one slot; a null source is a source
of its own, a null id is as the empty text; weights that are missing, negative or
not numbers count as 0; rows with equal ids follow each other in any order; an empty
table gives an empty one; other columns are kept by ``mixed`` and ignored elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.tables import documents, packed

BLOCK_DOCS = 64
MOST_BLOCKS = 1 << 17
PRECISION = 1 << 30
DAMPING = 0.5
DIGITS = 4
STRIDE = 256


def shares(counts: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(source, parts, blocks, block_docs) of each source of (source, n). Weights default to the square root of a source's rows."""
    if weights is None:
        raw = F.sqrt(F.col("n").cast("double"))
    else:
        pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w) if math.isfinite(w) and w > 0 else 0.0))]
        raw = F.coalesce(F.create_map(*pairs)[F.coalesce(F.col("source"), F.lit(""))], F.lit(0.0)) if pairs else F.lit(0.0)
        raw = F.when(F.col("source").isNull(), 0.0).otherwise(raw)
    df = counts.withColumn("raw", raw)
    total = df.agg(F.sum("raw").alias("all"), F.greatest(F.lit(block_docs), F.ceil(F.sum("n") / F.lit(most_blocks))).cast("long").alias("block_docs"))
    exact = F.coalesce(F.lit(float(PRECISION)) * F.col("raw") / F.when(F.col("all") > 0, F.col("all")), F.lit(0.0))
    # one row of totals: the join adds columns, it multiplies nothing
    df = df.join(F.broadcast(total)).withColumn("exact", exact).withColumn("whole", F.floor("exact").cast("long"))
    # parts add up to PRECISION: what is left goes to the largest remainders; these windows are over sources, not documents
    left = F.lit(PRECISION) - F.sum("whole").over(Window.partitionBy("all"))
    place = F.row_number().over(Window.partitionBy("all").orderBy(F.desc(F.col("exact") - F.col("whole")), F.col("source").isNull(), "source"))
    parts = F.col("whole") + F.when((F.col("all") > 0) & (place <= left), 1).otherwise(0)
    return df.select("source", parts.alias("parts"), F.ceil(F.col("n") / F.col("block_docs")).cast("long").alias("blocks"), "block_docs")


def _bound(value: Column, start: Column, use) -> Column:
    """``use(start, value)`` with the value worked out once: a fold over one element."""
    return F.aggregate(F.array(value), start, use)


def pattern(parts: DataFrame) -> DataFrame:
    """Earliest-deadline-first over all blocks: (source, block, slot, release, deadline), block_docs.

    The table of sources becomes one row of arrays. The fold goes by strides, so that no
    growing list is copied at each slot.
    """
    one = parts.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "parts", "blocks"))).alias("s"), F.max("block_docs").alias("block_docs"))
    one = one.where(F.size("s") > 0).withColumn("slots", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x.blocks))
    zero, long = F.lit(0).cast("long"), "long"

    def weigh(done: Column) -> Column:
        """Parts of the sources that have blocks left; equal ones if all of these are of weight 0."""
        live = F.transform("s", lambda x, i: F.when(F.get(done, i) < x.blocks, x.parts))
        some = F.exists(live, lambda p: p > 0)
        return F.transform(live, lambda p: F.when(some, F.coalesce(p, zero)).otherwise(F.when(p.isNull(), zero).otherwise(F.lit(1).cast(long))))

    def total(w: Column) -> Column:
        return F.aggregate(w, zero, lambda a, x: a + x)

    def state(done, count, w, all_, since, order) -> Column:
        return F.struct(done.alias("done"), count.alias("count"), w.alias("w"), all_.alias("all"), since.alias("since"), order.alias("order"))

    def choose(st, t):
        released = F.transform(st.w, lambda w, i: F.when((w > 0) & (F.floor(F.get(st.count, i) * st.all / w) <= t - st.since), F.struct(F.ceil((F.get(st.count, i) + 1) * st.all / w).alias("d"), i.alias("i"))))

        def take(st, pick):
            i = pick.i
            add = lambda xs: F.transform(xs, lambda x, k: F.when(k == i, x + 1).otherwise(x))
            entry = F.struct(i.alias("i"), F.get(st.done, i).alias("block"), t.alias("slot"), (st.since + F.floor(F.get(st.count, i) * st.all / F.get(st.w, i))).alias("release"), (st.since + pick.d).alias("deadline"))
            more = state(add(st.done), add(st.count), st.w, st.all, st.since, F.concat(st.order, F.array(entry)))
            # its last block: the others' windows start anew
            return F.when(F.get(st.done, i) + 1 < F.get("s", i).blocks, more).otherwise(_bound(add(st.done), more, lambda m, done: _bound(weigh(done), m, lambda m, w: state(done, F.transform(done, lambda x: zero), w, total(w), t + 1, m.order))))

        return _bound(F.array_min(released), st, take)

    nothing = F.array().cast("array<struct<i:int,block:bigint,slot:bigint,release:bigint,deadline:bigint>>")
    none_done = F.transform("s", lambda x: zero)
    start = F.struct(state(none_done, none_done, weigh(none_done), total(weigh(none_done)), zero, nothing).alias("now"), F.array(nothing).alias("parts"))

    def stride(held, first):
        last = F.least(first + STRIDE, F.col("slots")) - 1
        run = F.aggregate(F.sequence(first, last), held.now, choose)
        return _bound(run, held, lambda h, st: F.struct(state(st.done, st.count, st.w, st.all, st.since, nothing).alias("now"), F.concat(h.parts, F.array(st.order)).alias("parts")))

    # sources without rows do not come up, so there is a slot at least
    one = one.withColumn("order", F.aggregate(F.sequence(zero, F.col("slots") - 1, F.lit(STRIDE).cast(long)), start, stride, lambda h: F.flatten(h.parts)))
    rows = one.select("s", "block_docs", F.explode("order").alias("x"))
    return rows.select(F.get("s", F.col("x.i")).source.alias("source"), "x.block", "x.slot", "x.release", "x.deadline", "block_docs")


def _digest(id_column: str):
    return F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))


def placed(rows: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows with columns ``_id`` and ``_source`` and a struct ``_mix`` of block, place, release, deadline and slot added.

    Rows go through one shuffle: they are numbered and given their offsets by the same key, of which no part is null.
    """
    none, name = F.col("_source").isNull(), F.coalesce(F.col("_source"), F.lit(""))
    ids = rows.select(none.alias("_none"), name.alias("_name"), F.substring(_digest("_id"), 1, DIGITS).alias("_deal"))
    dealt = ids.groupBy("_none", "_name", "_deal").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.partitionBy("_none", "_name").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.withColumn("_before", F.coalesce(running, F.lit(0))).drop("n")
    counts = dealt.groupBy("_none", "_name").agg(F.sum("n").alias("n")).select(F.when(~F.col("_none"), F.col("_name")).alias("source"), "n")
    turns = pattern(shares(counts, weights, block_docs))
    # MOST_BLOCKS entries and one a source at most
    per_source = turns.groupBy("source").agg(F.first("block_docs").alias("_docs"), F.array_sort(F.collect_list(F.struct("block", "slot", "release", "deadline"))).alias("_turns"))
    per_source = per_source.select(F.col("source").isNull().alias("_none"), F.coalesce(F.col("source"), F.lit("")).alias("_name"), "_docs", "_turns")

    own = rows.columns
    key = ["_none", "_name", "_deal"]
    df = rows.withColumn("_digest", _digest("_id")).withColumns({"_none": none, "_name": name, "_deal": F.substring("_digest", 1, DIGITS)})
    df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_digest", "_id")))
    df = df.join(offsets.hint("merge"), key).join(F.broadcast(per_source), ["_none", "_name"])
    rank = (F.col("_before") + F.col("_n") - 1).cast("long")
    block = F.floor(rank / F.col("_docs"))
    turn = F.get("_turns", block.cast("int"))
    mix = F.struct(block.alias("block"), (rank % F.col("_docs")).alias("place"), turn.release.alias("release"), turn.deadline.alias("deadline"), turn.slot.alias("slot"))
    return df.select(*own, mix.alias("_mix"))


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """Where each document goes: id, source, block, place within it, release, deadline and slot."""
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{source_column}`").alias("_source"))
    return placed(rows, weights, block_docs).select(F.col("_id").alias(id_column), F.col("_source").alias(source_column), "_mix.*")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """The whole rows in the order of the schedule, over range partitions; columns as they were."""
    rows = packed(docs, _id=F.col(f"`{id_column}`"), _source=F.col(f"`{source_column}`"))
    return placed(rows, weights, block_docs).orderBy("_mix.slot", "_mix.place").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(documents(spark, sf_dir))


#: The same schedule, chosen slot by slot in a recursive query.
ORACLE_SQL = f"""
WITH RECURSIVE counts AS (SELECT coalesce(source, '') AS src, source IS NULL AS none, count(*) AS n FROM documents GROUP BY ALL),
sized AS (SELECT *, greatest({BLOCK_DOCS}, ceil(sum(n) OVER () / {MOST_BLOCKS}.0))::BIGINT AS docs FROM counts),
exact AS (SELECT *, {PRECISION}::DOUBLE * sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER () AS x FROM sized),
weighed AS (SELECT src, none, docs, ((n + docs - 1) // docs)::BIGINT AS blocks,
  floor(x)::BIGINT + (row_number() OVER (ORDER BY x - floor(x) DESC, none, src) <= {PRECISION} - sum(floor(x)::BIGINT) OVER ())::BIGINT AS parts FROM exact),
numbered AS (SELECT *, row_number() OVER (ORDER BY none, src) AS i FROM weighed),
lists AS (SELECT list(parts ORDER BY i) AS parts, list(blocks ORDER BY i) AS blocks, sum(blocks)::BIGINT AS slots, count(*) AS k FROM numbered),
run AS (
  SELECT 0::BIGINT AS t, parts, blocks, slots, k, list_transform(parts, lambda p: 0::BIGINT) AS done, list_transform(parts, lambda p: 0::BIGINT) AS cnt,
    parts AS w, list_sum(parts)::BIGINT AS total, 0::BIGINT AS since, 0::BIGINT AS pick, 0::BIGINT AS block, 0::BIGINT AS release, 0::BIGINT AS deadline
  FROM lists
  UNION ALL
  SELECT t + 1, parts, blocks, slots, k, done2,
    CASE WHEN done2[chosen] < blocks[chosen] THEN list_transform(range(1, k + 1), lambda i: cnt[i] + (i = chosen)::BIGINT) ELSE list_transform(parts, lambda p: 0::BIGINT) END,
    w2, list_sum(w2)::BIGINT, CASE WHEN done2[chosen] < blocks[chosen] THEN since ELSE t + 1 END,
    chosen, done[chosen], since + (cnt[chosen] * total) // w[chosen], since + ((cnt[chosen] + 1) * total + w[chosen] - 1) // w[chosen]
  FROM (
    SELECT *, list_transform(range(1, k + 1), lambda i: CASE WHEN done2[i] < blocks[i] THEN parts[i] ELSE 0 END) AS w2
    FROM (
      SELECT *, list_transform(range(1, k + 1), lambda i: done[i] + (i = chosen)::BIGINT) AS done2
      FROM (
        SELECT *, list_sort(list_transform(
          list_filter(range(1, k + 1), lambda i: w[i] > 0 AND (cnt[i] * total) // greatest(w[i], 1) <= t - since),
          lambda i: {{'d': ((cnt[i] + 1) * total + w[i] - 1) // w[i], 'i': i}}))[1].i AS chosen
        FROM run WHERE t < slots)))
),
ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rank FROM documents),
placed AS (
  SELECT doc_id, source, rank // docs AS block, rank % docs AS place, i FROM ranked JOIN numbered ON coalesce(source, '') = src AND (source IS NULL) = none)
SELECT doc_id, source, placed.block, place, release, deadline, t - 1 AS slot
FROM placed JOIN run ON run.pick = placed.i AND run.block = placed.block AND run.t > 0
"""
