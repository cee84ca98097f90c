"""Personal data: patterns, and terms that give protected values away.

Patterns find e-mail and IP addresses, card and phone numbers. Protected entities
are each value, the group that it belongs to (mail domain, address block, card issuer,
dialling area) and its kind: a term may give away whose address follows, or that
one does. Terms near a mention reveal its entities as far as the corpus ties
them together: with p(c) the share of documents that mention entity c, and p(c | t)
the share of documents with term t that have it near c,

    disclosure(t, c) = 1 + log p(c | t) / -log p(c)

is the part of c's information that t carries (pointwise mutual information over
information content). From ``remove_from`` on a term is removed, from
``generalise_from`` on it is generalised to the category that the corpus puts it in, that of terms
beside the kind of value that it reveals most, if at least ``support`` different texts
tie the two. All figures are counts over the whole corpus, and so is what follows
from them: a term that reveals any entity goes wherever it stands, in all texts.

Defined results: a null text is as an empty one and has no spans; equal texts
have equal spans, and repeated rows count as often as they are there, but for
``support`` once; spans of one kind never overlap; where a span of a term would
touch a pattern's, there is none; an empty table gives an empty one; other
columns are kept by ``sanitised`` and ignored elsewhere. All scans are linear in
the length of a text, however long its runs of digits or letters are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.sieve import sieve_of
from webloom.llm.tables import documents, packed, stored
from webloom.llm.tally import trim
from webloom.llm.textarrays import LETTERS, as_long, slices, words_of

KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")
AROUND = 8
SUPPORT = 2
REMOVE_FROM = 0.9
GENERALISE_FROM = 0.5
FLUSH = 1 << 20
SLICE_BYTES = 2 << 20
PIECE_ROWS = 256

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match that starts within a run of digits would also start at the run's first digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_WORD = re.compile("[A-Za-z\x80-\U0010ffff]+")

Span = tuple[int, int, int]  # kind, start, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a local part reaches back as far as its letters do, but not into the match before."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (int(d) * 2 - 9 if d > "4" else int(d) * 2) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start and then by kind."""
    out: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def entities_of(kind: int, value: str) -> list[int]:
    """Numbers of a protected value, of its group and of its kind: alike however the value is written."""
    plain = value.lower() if kind < 2 else re.sub("[^0-9]", "", value)
    group = plain.rpartition("@")[2] if kind == 0 else ".".join(plain.split(".")[:2]) if kind == 1 else plain[: 6 if kind == 2 else 4]
    names = (f"{kind}:{plain}", f"group {kind}:{group}", f"kind {kind}")
    return [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True) for x in names]


def words_and_cover(text: str, spans: list[Span]) -> tuple[list[tuple[int, int]], np.ndarray, list[tuple[int, int]]]:
    """A text's words, which of them touch a span, and each span's first word and the one after its last."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    covered = np.zeros(len(words), dtype=bool)
    starts = [w[0] for w in words]
    reach = []
    for _, a, b in spans:
        first = bisect_left(starts, a)
        if first and words[first - 1][1] > a:
            first -= 1
        last = bisect_left(starts, b)
        covered[first:last] = True
        reach.append((first, last))
    return words, covered, reach


def nearby(text: str, spans: list[Span], around: int = AROUND) -> list[tuple[int, int, int, int]]:
    """(entity, kind, start, end) of each term within ``around`` words of a mention and outside of all spans."""
    words, covered, reach = words_and_cover(text, spans)
    out = {}
    for (kind, a, b), (first, last) in zip(spans, reach, strict=True):
        entities = entities_of(kind, text[a:b])
        for k in [*range(max(0, first - around), first), *range(last, min(len(words), last + around))]:
            if not covered[k]:
                out |= {(entity, kind, words[k]): None for entity in entities}
    return [(entity, kind, a, b) for entity, kind, (a, b) in out]


_FOUND = "_key long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<kind:int,start:int,end:int>>, near array<struct<entity:long,kind:int,term:long,start:int,end:int,first:int>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_NEAR = pa.struct([("entity", pa.int64()), ("kind", pa.int32()), ("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("first", pa.int32())])


def found(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", around: int = AROUND) -> DataFrame:
    """One row a row: id, key of the text, figures by kind, pattern spans, and terms near them (``first``: 1 once a text for an entity and term)."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_column}`"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_text")).withColumn("_key", F.xxhash64("_text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", SLICE_BYTES):
                spans, near, terms = [], [], []
                for text in batch.column(1).to_pylist():
                    spans.append(base_spans(text))
                    near.append(nearby(text, spans[-1], around) if spans[-1] else [])
                    terms += [text[a:b] for _, _, a, b in near[-1]]
                codes = iter(as_long(words_of(pa.array(terms, pa.string()), lower=True, of=LETTERS).hashes).tolist())
                lists = []
                for row in near:
                    seen: set = set()
                    out = []
                    for entity, of, a, b in row:
                        pair = (entity, next(codes))
                        out.append({"entity": entity, "kind": of, "term": pair[1], "start": a, "end": b, "first": int(pair not in seen)})
                        seen.add(pair)
                    lists.append(out)
                counts = [pa.array([sum(s[0] == k for s in row) for row in spans], pa.int64()) for k in range(4)]
                base = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in spans], pa.list_(_SPAN))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *counts, base, pa.array(lists, pa.list_(_NEAR))], names=[id_column, "_key", "n_email", "n_ip", "n_card", "n_phone", "base", "near"])
        trim()

    return rows.mapInArrow(each, f"`{id_column}` {kind}, {_FOUND}")


def term_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(term, rows): in how many rows each term occurs. Tasks add up what they can before the shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            if held:
                term, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                for a in range(0, len(term), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(as_long(term[a : a + (1 << 18)])), pa.array(n[a : a + (1 << 18)], pa.int64())], names=["term", "rows"])

        size = 0
        for whole in batches:
            for batch in slices(whole, "_text", SLICE_BYTES):
                words = words_of(batch.column(0), lower=True, of=LETTERS)
                doc = words.doc_of()
                order = np.lexsort((words.hashes, doc))
                h, d = words.hashes[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                held.append(h[new])
                size += int(new.sum())
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()
        trim()

    texts = docs.select(F.col(f"`{text_column}`").alias("_text")).where("_text IS NOT NULL")
    return texts.mapInArrow(each, "term long, rows long").groupBy("term").agg(F.sum("rows").alias("rows"))


def disclosing(mentions: DataFrame, terms: DataFrame, n_rows: int, support: int = SUPPORT, generalise_from: float = GENERALISE_FROM) -> DataFrame:
    """(entity, kind, term, disclosure) of the pairs that reach the threshold. ``mentions`` is stored output of ``found``."""
    near = mentions.select("_key", F.explode("near").alias("x")).where("x.first = 1").groupBy("_key", "x.entity", "x.kind", "x.term").agg(F.count(F.lit(1)).alias("rows"))
    pairs = near.groupBy("entity", "kind", "term").agg(F.sum("rows").alias("both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support)
    # an entity without terms around it needs no figure
    entities = mentions.select(F.explode(F.array_distinct(F.transform("near", lambda x: x.entity))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("mentioned"))
    joined = pairs.join(terms, "term").join(entities, "entity")
    information = -F.log(F.col("mentioned") / F.lit(float(max(n_rows, 1))))
    part = F.when(information > 0, 1 + F.log(F.least(F.col("both") / F.col("rows"), F.lit(1.0))) / information).otherwise(0.0)
    return joined.withColumn("disclosure", part).where(F.col("disclosure") >= generalise_from).select("entity", "kind", "term", "disclosure")


_PLACE = pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def places(docs: DataFrame, terms: DataFrame, text_column: str = "text") -> DataFrame:
    """(_key, places): where terms stand outside of patterns, in each row that may have any of ``terms`` (a sieve lets some others through)."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve_of(terms, "term"))  # of a fixed size

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = sent.value
        for whole in batches:
            for batch in slices(whole, "_text", SLICE_BYTES):
                words = words_of(batch.column(0), lower=True, of=LETTERS)
                hits = np.flatnonzero(sieve.passes(words.hashes))
                doc = words.doc_of()[hits]
                rows, lists = [], []
                for d in np.unique(doc).tolist():
                    text = batch.column(0)[d].as_py()
                    at, covered, _ = words_and_cover(text, base_spans(text))
                    of = hits[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
                    first = int(words.doc_start[d])
                    found = [{"term": term, "start": at[k - first][0], "end": at[k - first][1]} for k, term in zip(of.tolist(), as_long(words.hashes[of]).tolist(), strict=True) if not covered[k - first]]
                    if found:
                        rows.append(d)
                        lists.append(found)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows, pa.int64())), pa.array(lists, pa.list_(_PLACE))], names=["_key", "places"])
        trim()

    texts = docs.select(F.col(f"`{text_column}`").alias("_text")).where("_text IS NOT NULL").withColumn("_key", F.xxhash64("_text"))
    return texts.mapInArrow(each, "_key long, places array<struct<term:long,start:int,end:int>>")


def term_spans(docs: DataFrame, revealing: DataFrame, text_column: str = "text", remove_from: float = REMOVE_FROM) -> DataFrame:
    """(_key, terms): the spans of revealing terms in each text that has any, near a mention or not; ``removed`` else generalised."""
    most = F.max(F.struct("disclosure", (-F.col("kind")).alias("first"))).alias("x")
    terms = stored(revealing.groupBy("term").agg(most).select("term", F.col("x.disclosure").alias("d"), (-F.col("x.first")).alias("kind")), "pii-revealing")
    once = places(docs, terms, text_column).groupBy("_key").agg(F.first("places").alias("places"))
    found = once.select("_key", F.explode("places").alias("x")).select("_key", "x.*").join(terms, "term")
    return found.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", (F.col("d") >= remove_from).alias("removed"), "kind"))).alias("terms"))


def _figures(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    mentions = stored(found(docs, id_column, text_column), "pii-found")
    n = mentions.count()
    terms = term_spans(docs, disclosing(mentions, term_counts(docs, text_column), n), text_column)
    return mentions, stored(terms, "pii-terms")


def _in(keys: DataFrame):
    """Whether a ``_key`` may be one of ``keys``: the others need no join."""
    sent = keys.sparkSession.sparkContext.broadcast(sieve_of(keys, "_key"))  # of a fixed size

    @F.pandas_udf("boolean")
    def may(key: pd.Series) -> pd.Series:
        return pd.Series(sent.value.passes(key.to_numpy(np.int64).view(np.uint64)))

    return may("_key")


def _shown(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def detected(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's spans: id, figures by kind, base_sha256, spans (as text), n_term."""
    mentions, terms = _figures(docs, id_column, text_column)
    by_start = F.transform("base", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    mentions = mentions.drop("near").withColumn("_may", _in(terms))
    with_terms = mentions.where("_may").join(terms, "_key", "left")
    without = mentions.where("NOT _may").withColumn("terms", F.lit(None).cast(terms.schema["terms"].dataType))
    added = F.transform(F.coalesce("terms", F.array().cast(terms.schema["terms"].dataType)), lambda s: F.struct(s.start.alias("start"), F.lit(TERM).alias("kind"), s.end.alias("end")))
    both = with_terms.select(*without.columns).unionByName(without)
    return both.select(f"`{id_column}`", "n_email", "n_ip", "n_card", "n_phone", F.sha2(_shown(by_start), 256).alias("base_sha256"), _shown(F.concat(by_start, added)).alias("spans"), F.size(added).cast("long").alias("n_term"))


def redact(text: str, terms: list[dict]) -> str:
    """A text with pattern spans replaced by their kind (overlaps as one), revealing terms removed or generalised."""
    marks = [(a, b, f"<{KINDS[kind].upper()}>") for kind, a, b in base_spans(text)] + [(t["start"], t["end"], "" if t["removed"] else f"<{KINDS[t['kind']].upper()} TERM>") for t in terms]
    out, at = [], 0
    for a, b, mark in sorted(marks):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with sanitised texts; all other columns, and null texts, stay as they are.

    No task runs Python twice: each such step would hold a worker of its own, and workers live on.
    """
    _, terms = _figures(docs, id_column, text_column)
    sent = docs.sparkSession.sparkContext.broadcast(sieve_of(terms, "_key"))  # of a fixed size
    rows = packed(docs, _text=F.col(f"`{text_column}`")).withColumn("_key", F.when(F.col("_text").isNotNull(), F.xxhash64("_text"))).drop("_text")
    columns = docs.columns
    place = columns.index(text_column)

    @F.pandas_udf("boolean")
    def may(key: pd.Series) -> pd.Series:
        return pd.Series(sent.value.passes(key.to_numpy(np.int64).view(np.uint64)))

    def redacted(part: pa.RecordBatch, terms_of: list) -> pa.RecordBatch:
        own = part.column(0).flatten()
        # without terms, a text has to be looked at only if it has a digit or an at sign: no pattern matches else
        own[place] = pa.array([redact(t, x or []) if t and (x or _MARK.search(t)) else t for t, x in zip(own[place].to_pylist(), terms_of, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays(own, names=columns)

    def with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(a, PIECE_ROWS)
                yield redacted(part, part.column(1).to_pylist())
        trim()

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of all rows those that the sieve does not let through."""
        for batch in batches:
            for a in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(a, PIECE_ROWS)
                key = part.column(1)
                asked = sent.value.passes(key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                part = part.filter(pa.array(~asked | key.is_null().to_numpy(zero_copy_only=False)))
                yield redacted(part, [None] * part.num_rows)
        trim()

    # merged, as a broadcast join would leave both Python steps in one task
    asked = rows.where(F.col("_key").isNotNull()).where(may("_key")).join(terms.hint("merge"), "_key", "left").select("_row", "terms")
    return asked.mapInArrow(with_terms, docs.schema).union(rows.select("_row", "_key").mapInArrow(without, docs.schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(documents(spark, sf_dir))
