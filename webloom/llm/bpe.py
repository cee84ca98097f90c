"""BPE encoding and decoding by a pair occurrence index.

The words of a partition are laid out in one sequence of symbols. An index maps
each mergeable pair to all its positions; ranks that have positions are taken in
ascending order, all positions of a rank are merged from the left, and each
merge adds the two pairs that it makes to the index. Every distinct word is
encoded once; results are kept in the worker within a bound of entries.

The tokenizer's file (a public vocabulary with ranked merges, word-end suffix,
byte alphabet, canonical composition and lower case) is a parameter. It is read
on the driver and sent along, so workers need not have it.

Defined results: a null text is as an empty one (no ids, empty decoded text);
special tokens in a text are single ids; rows are independent, so ties do not occur
and repeated rows give repeated results; an empty table gives an empty one; other
columns are ignored. Texts and words of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, normalizers, pre_tokenizers

from webloom.llm.tables import documents, narrow
from webloom.llm.tally import trim
from webloom.llm.textarrays import slices

CACHED_WORDS = 150_000
SLICE_BYTES = 1 << 20

# The public tokenizer's split pattern, with Unicode white space spelled out.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACE + r"\p{L}\p{N}]+")


#: Outside Latin letters, composed as they are, and common signs, Unicode versions differ.
_FAR = regex.compile("[^\\x00-\u024f\u2010-\u2027\u20ac]")


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself if Latin-1 prints it, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class PairIndexEncoder:
    """Encodes words and texts with the merges of a tokenizer file's text."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.made_by = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        self.ranks = {left << 32 | right: rank for rank, (left, right, _) in enumerate(self.made_by)}
        self.sorted_pairs = np.array(sorted(self.ranks), dtype=np.int64)
        self.sorted_ranks = np.array([self.ranks[p] for p in self.sorted_pairs.tolist()], dtype=np.int64)
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.norm = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex("\\s+"), " "), normalizers.Lowercase()])
        self.cut = pre_tokenizers.Split(Regex(_PATTERN), "removed", invert=True)
        self.stops = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.known: dict[str, str] = {}
        self.shown: dict[str, str] = {}
        for content, i in self.special.items():
            self.known[content], self.shown[content] = str(i), content

    def split(self, text: str) -> list[str]:
        """The words (and special tokens) of a text, after its normal form."""
        if self.stops and "<" in text:
            parts, at = [], 0
            for m in self.stops.finditer(text):
                parts += [*self._split(text[at : m.start()]), m[0]]
                at = m.end()
            return parts + self._split(text[at:])
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if text.isascii() or not _FAR.search(text):
            return _SPLIT.findall(text.lower())
        # other scripts: the tokenizers library knows its own Unicode version
        return [w for w, _ in self.cut.pre_tokenize_str(self.norm.normalize_str(text))]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word, all words merged together through one pair index.

        ``symbols`` holds all words, one after another, each closed by -1; a
        symbol that a merge has used up is -2 and ``after`` and ``before`` lead
        past it. A pair is one number, left << 32 | right.
        """
        ranks, made_by = self.ranks, self.made_by
        symbols: list[int] = []
        for word in words:
            raw = word.encode()
            symbols += map(self.inner.__getitem__, raw[:-1])
            symbols += (self.final[raw[-1]], -1)
        size = len(symbols)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        flat = np.array(symbols, dtype=np.int64)
        pairs = (flat[:-1] << 32) | flat[1:]
        pairs[(flat[:-1] < 0) | (flat[1:] < 0)] = -1
        which = np.searchsorted(self.sorted_pairs, pairs)
        which[which == len(self.sorted_pairs)] = 0
        held = np.flatnonzero(self.sorted_pairs[which] == pairs)
        rank_of = self.sorted_ranks[which[held]]
        order = np.argsort(rank_of, kind="stable")
        held, rank_of = held[order], rank_of[order]
        active, first = np.unique(rank_of, return_index=True)
        index = dict(zip(active.tolist(), (x.tolist() for x in np.split(held, first[1:])), strict=True)) if len(held) else {}
        heap = active.tolist()
        get, pop, push = ranks.get, heapq.heappop, heapq.heappush
        while heap:
            rank = pop(heap)
            left, right, made = made_by[rank]
            places = index.pop(rank)
            places.sort()
            for k, at in enumerate(places):
                nxt = after[at]
                if symbols[at] != left or symbols[nxt] != right:
                    continue
                symbols[at], symbols[nxt] = made, -2
                after[at] = far = after[nxt]
                before[far] = at
                lowest = rank + 1
                other = symbols[far]
                if other >= 0 and (found := get(made << 32 | other)) is not None:
                    if found in index:
                        index[found].append(at)
                    else:
                        index[found] = [at]
                        push(heap, found)
                    lowest = found
                back = before[at]
                if back >= 0 and (other := symbols[back]) >= 0 and (found := get(other << 32 | made)) is not None:
                    if found in index:
                        index[found].append(back)
                    else:
                        index[found] = [back]
                        push(heap, found)
                    if found < lowest:
                        lowest = found
                if lowest <= rank and k + 1 < len(places):  # what has just come up goes first
                    if rank in index:
                        index[rank] += places[k + 1 :]
                    else:
                        index[rank] = places[k + 1 :]
                        push(heap, rank)
                    break
        out, at = [], 0
        flat = np.array(symbols, dtype=np.int64)
        left_over = flat[flat != -2]
        ends = np.flatnonzero(left_over == -1).tolist()
        ids = left_over.tolist()
        for end in ends:
            out.append(ids[at:end])
            at = end + 1
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that aren't known yet, all at once."""
        new = [w for w in words if w not in self.known]
        for word, ids in zip(new, self.encode_words(new), strict=True):
            self.known[word] = " ".join(map(str, ids))
            self.shown[word] = " ".join(map(self.token.__getitem__, ids))

    def batch(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids and its tokens, either joined by one space."""
        split = [self.split(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            for kept in (self.known, self.shown):
                for word in [w for w in kept if w not in self.special]:
                    del kept[word]
        self.learn(set().union(*split))
        known, shown = self.known.__getitem__, self.shown.__getitem__
        for words in split:
            yield " ".join(map(known, words)), " ".join(map(shown, words))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in next(self.batch([text]))[0].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by one space, as a tokenizer without decoder gives them."""
        return " ".join(map(self.token.__getitem__, ids))

    def readable(self, ids: Iterable[int]) -> str:
        """The text that tokens stand for: bytes joined, a space at each word's end."""
        out = bytearray()
        for i in ids:
            token = self.token[i]
            if i in self.special.values():
                out += token.encode() + b" "
                continue
            end = bool(self.suffix) and token.endswith(self.suffix)
            out += bytes(self.byte_of[c] for c in (token[: -len(self.suffix)] if end else token)) + b" " * end
        return out.decode("utf-8", "replace").rstrip(" ")


@lru_cache(maxsize=2)
def _encoder(definition: str) -> PairIndexEncoder:
    return PairIndexEncoder(definition)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode each text: id, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` also the ids."""
    with open(path or default_path(), encoding="utf-8") as f:
        definition = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(definition)  # a vocabulary file, of its own fixed size
    kind = docs.schema[id_column].dataType.simpleString()
    fields = [id_column, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        trim()  # of what other operators' tasks have left in this worker
        for whole in batches:
            for batch in slices(whole, whole.schema.names[1], SLICE_BYTES):
                counts, digests, shown, lists = [], [], [], []
                for line, tokens in encoder.batch([t or "" for t in batch.column(1).to_pylist()]):
                    counts.append(line.count(" ") + 1 if line else 0)
                    digests.append(hashlib.sha256(line.encode()).hexdigest())
                    shown.append(hashlib.sha256(tokens.encode()).hexdigest())
                    if ids:
                        lists.append(np.array(line.split(), dtype=np.int32))
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(shown, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(lists, pa.list_(pa.int32()))] if ids else []), names=fields)
        trim()

    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return narrow(docs, id_column, text_column).mapInArrow(each, schema)


def decoded(ids: DataFrame, path: str | None = None, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Lists of ids as text again: id, tokens (joined by one space), text (bytes joined, a space after each word)."""
    with open(path or default_path(), encoding="utf-8") as f:
        sent = ids.sparkSession.sparkContext.broadcast(f.read())
    kind = ids.schema[id_column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(encoder.decode, lists), pa.string()), pa.array(map(encoder.readable, lists), pa.string())], names=[id_column, "tokens", "text"])

    return narrow(ids, id_column, ids_column).mapInArrow(each, f"`{id_column}` {kind}, tokens string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))
