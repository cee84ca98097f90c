"""Vectors as short codes: a codebook for each part of a vector, entries found by ball trees.

A vector's components become integers, the vector is cut into parts, and each part
is told by the index of its nearest codebook entry. Codebooks are learned in rounds:
tasks assign parts and add up what each entry got; the driver sees a sum for each
entry and component, whatever the number of vectors.

The nearest entry is looked for in a ball tree over the entries of a part position:
a query walks down to the leaf whose centre is nearest, and then visits every ball that may
hold an entry as near as the best so far. Radii are rounded up and distances down, so that rounding
never hides an entry; a ball that is just as near is visited too, so that ties are seen; and
what decides is the squared distance in integers, ties to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from webloom.llm.tables import stored, table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Entries of a leaf at most.
LEAF = 16
#: Vectors that are worked on at once.
ROWS = 4096
#: Labels whose sums are sent along to all tasks at most; more are joined by a shuffle.
MOST_SENT_LABELS = 100_000


def squares(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors, in integers: a row a query, a column a point."""
    return (queries * queries).sum(axis=1)[:, None] - 2 * (queries @ points.T) + (points * points).sum(axis=1)[None, :]


def root_down(x: np.ndarray) -> np.ndarray:
    """The largest integers whose squares are at most x."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    r += (r + 1) * (r + 1) <= x
    return r


def root_up(x: np.ndarray) -> np.ndarray:
    """The smallest integers whose squares are at least x."""
    r = root_down(x)
    return r + (r * r < x)


@dataclass
class Ball:
    """Entries ``index`` (ascending) within ``radius`` of ``centre``; a leaf has no balls below."""

    centre: np.ndarray
    radius: int
    index: np.ndarray
    below: tuple[Ball, Ball] | tuple[()] = ()


def ball_tree(entries: np.ndarray, index: np.ndarray | None = None, leaf: int = LEAF) -> Ball:
    """A tree over integer entries, halved along the component in which they spread most."""
    index = np.arange(len(entries)) if index is None else index
    own = entries[index]
    centre = own.sum(axis=0) // len(own)
    ball = Ball(centre, int(root_up(squares(own, centre[None, :])).max()), index)
    if len(index) > leaf:
        order = np.argsort(own[:, np.argmax(own.max(axis=0) - own.min(axis=0))], kind="stable")
        half = len(index) // 2
        ball.below = (ball_tree(entries, np.sort(index[order[:half]]), leaf), ball_tree(entries, np.sort(index[order[half:]]), leaf))
    return ball


def nearest(tree: Ball, entries: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each query's nearest entry, ties to the lower index. All queries walk the tree together."""
    n = len(queries)
    best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, len(entries))
    seen = np.full(n, -1)  # the leaf that a query went to first
    leaves: list[Ball] = []

    def verify(ball: Ball, rows: np.ndarray) -> None:
        d = squares(queries[rows], entries[ball.index])
        k = d.argmin(axis=1)  # the first of equal ones: the index is ascending
        far, which = d[np.arange(len(rows)), k], ball.index[k]
        better = (far < best[rows]) | ((far == best[rows]) & (which < at[rows]))
        best[rows[better]], at[rows[better]] = far[better], which[better]

    def descend(ball: Ball, rows: np.ndarray) -> None:
        if not ball.below:
            seen[rows] = len(leaves)
            leaves.append(ball)
            if len(rows):
                verify(ball, rows)
            return
        a, b = (squares(queries[rows], x.centre[None, :])[:, 0] for x in ball.below)
        descend(ball.below[0], rows[a <= b])
        descend(ball.below[1], rows[a > b])

    def visit(ball: Ball, rows: np.ndarray) -> None:
        near = root_down(squares(queries[rows], ball.centre[None, :])[:, 0]) - ball.radius
        rows = rows[near <= root_up(best[rows])]
        if not len(rows):
            return
        if ball.below:
            visit(ball.below[0], rows)
            visit(ball.below[1], rows)
        else:
            rows = rows[seen[rows] != next(i for i, x in enumerate(leaves) if x is ball)]
            if len(rows):
                verify(ball, rows)

    if n:
        descend(tree, np.arange(n))
        visit(tree, np.arange(n))
    return at, best


def bounds(width: int, parts: int) -> list[int]:
    """Where parts begin and end; if they can't be equal, the first ones are one longer."""
    return [0, *np.cumsum([width // parts + (i < width % parts) for i in range(parts)]).tolist()]


def most_component(width: int) -> int:
    """So large may a component be (in size, scaled) for all distances to fit 64 bits."""
    return int((1 << 60) / max(width, 1)) ** 0.5 // 2


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64).reshape(-1, width)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def usable(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows whose vector can be coded, and its length.

    These are vectors without null, NaN or infinite components. If lengths differ, the
    most frequent one counts (of equally frequent ones the shortest) and others are dropped, empty vectors too;
    so are vectors with components too large for distances in 64 bits (from 65,536 on for vectors of 64).
    """
    v = F.col(f"`{column}`")
    finite = vectors.where(v.isNotNull() & (F.size(v) > 0)).where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    width = finite.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    width = width[0]["n"] if width else 0
    most = most_component(width) / SCALE
    return finite.where((F.size(v) == width) & F.forall(v, lambda x: F.abs(x) < most)), width


def first_entries(kept: DataFrame, id_column: str, column: str, width: int, entries: int) -> np.ndarray:
    """The vectors of the smallest ids (null ids last; of equal ids the smaller vector first), at most ``entries``."""
    rows = kept.select(F.col(f"`{id_column}`").alias("i"), F.col(f"`{column}`").alias("v")).orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    return np.floor(np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), width) * SCALE).astype(np.int64)


def learned(kept: DataFrame, column: str, books: list[np.ndarray], cuts: list[int], rounds: int) -> list[np.ndarray]:
    """Codebooks after rounds of assigning all parts and moving each entry to the floor of its parts' mean; unused entries stay."""
    width = cuts[-1]

    def totals(books: list[np.ndarray]):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = [ball_tree(b) for b in books]
            sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
            for batch in _slices(batches):
                x = _matrix(batch.column(0), width)
                for p, (tree, book, total) in enumerate(zip(trees, books, sums, strict=True)):
                    own = x[:, cuts[p] : cuts[p + 1]]
                    at, _ = nearest(tree, book, own)
                    np.add.at(total, at, np.concatenate([own, np.ones((len(own), 1), np.int64)], axis=1))
            rows = [(p, k, total[k].tolist()) for p, total in enumerate(sums) for k in np.flatnonzero(total[:, -1]).tolist()]
            yield pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int32()), "entry": pa.array([r[1] for r in rows], pa.int32()), "sums": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})

        return each

    for _ in range(rounds):
        found = kept.select(F.col(f"`{column}`")).mapInArrow(totals(books), "part int, entry int, sums array<long>")
        cells = found.select("part", "entry", F.posexplode("sums").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        # a row for each entry and component, and one for its count
        moved = cells.groupBy("part", "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s.x).alias("sums")).collect()
        books = [b.copy() for b in books]
        for r in moved:
            *total, n = (int(x) for x in r["sums"])
            books[r["part"]][r["entry"]] = [t // n for t in total]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows with ``_row`` (the row without its vector), ``_code`` and ``_error``; the codebooks).

    Rows are those of ``usable``; repeated rows are rows of their own. With fewer vectors than
    ``entries`` each is an entry; with none there are no rows and no entries. Codes
    are entry indexes in two hexadecimal digits (more for more than 256 entries), in order of parts.
    """
    kept, width = usable(vectors, column)
    cuts = bounds(width, parts)
    start = first_entries(kept, id_column, column, width, entries)
    books = learned(kept, column, [start[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)], cuts, rounds if len(start) else 0)
    digits = max(2, len(f"{max(entries, 1) - 1:x}"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [ball_tree(b) for b in books]
        for batch in _slices(batches):
            x = _matrix(batch.column(1), width)
            found = [nearest(tree, book, x[:, cuts[p] : cuts[p + 1]]) for p, (tree, book) in enumerate(zip(trees, books, strict=True))]
            codes = ["".join(f"{k:0{digits}x}" for k in row) for row in np.stack([at for at, _ in found], axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string()), pa.array(sum(d for _, d in found), pa.int64())], names=["_row", "_code", "_error"])

    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns if c != column]).alias("_row"), F.col(f"`{column}`").alias("_vector"))
    if not len(start):
        return rows.select("_row", F.lit("").alias("_code"), F.lit(0).cast("long").alias("_error")).limit(0), books
    schema = StructType([rows.schema["_row"], StructField("_code", StringType()), StructField("_error", LongType())])
    return rows.mapInArrow(each, schema), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable rows of ``embeddings``; errors are summed over equal labels (nulls together) before they meet the rows again."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows, books = coded(vectors)
    rows = stored(rows.select(F.col("_row.vec_id").alias("vec_id"), F.col("_row.label").alias("label"), F.col("_code").alias("code"), F.col("_error").alias("error")), "codes")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    few = sums.limit(MOST_SENT_LABELS + 1).count() <= MOST_SENT_LABELS
    out = rows.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry."""
    dot = "list_inner_product(v::DOUBLE[], w::DOUBLE[])"
    own = "list_inner_product(v::DOUBLE[], v::DOUBLE[])"
    other = "list_inner_product(w::DOUBLE[], w::DOUBLE[])"
    near = lambda k: f"SELECT r, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, q.p, v, e, ({own} - 2 * {dot} + {other})::BIGINT AS d FROM q JOIN b{k} ON q.p = b{k}.p) GROUP BY r, p, v"
    steps = [f"b0 AS MATERIALIZED (SELECT q.p, k.e, q.v AS w FROM q JOIN (SELECT r, (row_number() OVER (ORDER BY vec_id) - 1) AS e FROM kept QUALIFY e < {entries}) k USING (r))"]
    for k in range(rounds):
        steps.append(f"n{k} AS MATERIALIZED ({near(k)})")
        steps.append(f"s{k} AS (SELECT p, e, list(x ORDER BY i) AS w FROM (SELECT p, e, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM n{k}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM q) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e)")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.w, b.w) AS w FROM b{k} b LEFT JOIN s{k} s ON s.p = b.p AND s.e = b.e)")
    return f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, p, list_slice(v, (p * len(v) // {parts} + 1)::BIGINT, ((p + 1) * len(v) // {parts})::BIGINT) AS v FROM kept, (SELECT unnest(range({parts})) AS p)),
{", ".join(steps)}, f AS ({near(rounds)}),
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY r)
SELECT kept.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY kept.label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN c USING (r)"""


ORACLE_SQL = _oracle()
