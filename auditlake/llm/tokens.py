"""Encoding of texts with a public byte-level BPE vocabulary (problem 8).

Words are cut by the vocabulary's pattern and each word is merged on a contiguous rank
array: part boundaries and the ranks of adjacent pairs; scan for the smallest rank,
delete that boundary, refresh the two neighbouring ranks. Words above `LONG` bytes use
a heap over the same ranks, so that a run of one character stays n log n.

The vocabulary (fixed size, under 1 MB) is read on the driver from a path parameter and
broadcast. Each Python worker keeps a bounded dictionary of words already encoded. One
pass over the texts, no shuffle.

Defined results: null and empty texts give an empty list; texts that spell a special
token are ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG, REMEMBERED = 400, 300_000
NONE = 1 << 40


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by the contiguous rank array."""
    bounds = list(range(len(word) + 1))
    get = ranks.get
    pair = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pair and (low := min(pair)) < NONE:
        i = pair.index(low)
        del bounds[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(word[bounds[i] : bounds[i + 2]], NONE)
        if i:
            pair[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the same merges taken from a heap of (rank, start)."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    rank_at = lambda i: ranks.get(word[i : end[end[i]]], NONE) if end[i] < n else NONE
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_at(i)) < NONE]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone], end[i] = False, stop
        if stop < n:
            before[stop] = i
        for j in (i, before[i]):
            if j >= 0 and (r := rank_at(j)) < NONE:
                heapq.heappush(heap, (r, j, end[end[j]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts with a rank table, remembering a bounded number of words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks, self.words, self.known = ranks, regex.compile(pattern).findall, {}

    def word(self, w: str) -> list[int]:
        b = w.encode()
        r = self.ranks.get(b)
        ids = [r] if r is not None else merge_short(b, self.ranks) if len(b) <= LONG else merge_long(b, self.ranks)
        if len(b) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[w] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for w in self.words(text or ""):
            out += known.get(w) or self.word(w)
        return out


def _mapper(shared, pattern: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value, pattern)
        for b in batches:
            lists = [np.asarray(enc.encode(t), np.int32) for t in b.column(1).to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            if count_only:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), b.column(2)], ["doc_id", "n_tokens", "source"])
                continue
            at = np.zeros(len(lists) + 1, np.int32)
            np.cumsum(sizes, out=at[1:])
            flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), flat)], ["doc_id", "ids"])

    return run


def _encoded(docs: DataFrame, schema: str, vocabulary: str, pattern: str, count_only: bool) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    extra = ["source"] if count_only else []
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *extra).mapInArrow(_mapper(shared, pattern, count_only), schema)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens."""
    return _encoded(docs, "doc_id bigint, ids array<int>", vocabulary, pattern, False)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, source) of every document."""
    return _encoded(docs, "doc_id bigint, n_tokens bigint, source string", vocabulary, pattern, True)
