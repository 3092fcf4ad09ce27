"""Encoding with a public byte-level BPE vocabulary (problem 6): two-tier lookup.

Texts are cut into pre-tokens by the vocabulary's pattern. A pre-token that is itself in the
vocabulary is resolved whole by a minimal perfect hash: one slot for each entry, found with
one hash and one displacement, and one comparison to tell a hit from a miss. Misses are
merged by rank with a heap over a doubly linked list of parts, in O(n log n) of their bytes.
Each distinct pre-token of a batch is resolved once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import apart

#: Where the vocabulary is, unless a path is given.
VOCABULARY = os.environ.get("STRATA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Size of a vocabulary file that is sent to every executor, at most.
MAX_FILE = 64 << 20
#: Entries and characters of the cache of merged misses, characters of a slice of a batch.
CACHE, CACHED_CHARS, SLICE = 100_000, 200, 1 << 21

_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(h: int, d: int) -> int:
    h = (h + d * _GOLDEN) & _MASK
    h ^= h >> 32
    h = (h * 0xD6E8FEB86659FD93) & _MASK
    return h ^ (h >> 32)


class PerfectHash:
    """A minimal perfect hash of byte strings, with the entries in its slots.

    Entries are spread over buckets of two on average; from the largest bucket on, each
    takes the first displacement that sends its entries to free slots. Buckets of one
    entry take the free slots that are left, written as negative displacements.
    """

    def __init__(self, entries: dict[bytes, int]) -> None:
        self.n = n = len(entries)
        self.n_buckets = max(1, n // 2)
        self.slots: list[bytes | None] = [None] * n
        self.values = np.full(n, -1, np.int32)
        self.shift = [0] * self.n_buckets
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(self.n_buckets)]
        for entry in entries:
            h = xxhash.xxh64_intdigest(entry)
            buckets[h % self.n_buckets].append((h, entry))
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            items = buckets[b]
            if not items:
                break
            if len(items) == 1:
                if free is None:
                    free = iter([i for i, e in enumerate(self.slots) if e is None])
                places, self.shift[b] = [next(free)], 0
                self.shift[b] = -places[0] - 1
            else:
                d = 1
                while True:
                    places = [_mix(h, d) % n for h, _ in items]
                    if len(set(places)) == len(places) and all(self.slots[p] is None for p in places):
                        break
                    d += 1
                self.shift[b] = d
            for p, (_, entry) in zip(places, items):
                self.slots[p] = entry
                self.values[p] = entries[entry]
        self.values = self.values.tolist()

    def get(self, entry: bytes) -> int:
        """Its value, -1 if it is no entry."""
        h = xxhash.xxh64_intdigest(entry)
        d = self.shift[h % self.n_buckets]
        slot = -d - 1 if d < 0 else _mix(h, d) % self.n
        return self.values[slot] if self.slots[slot] == entry else -1


class Encoder:
    """Encodes texts; special tokens are neither added nor recognised."""

    def __init__(self, ranks: PerfectHash, pattern: str = PATTERN) -> None:
        self._rank = ranks.get
        self._split = regex.compile(pattern).findall
        self._cache: dict[str, list[int]] = {}
        self._pairs: dict[bytes, int] = {}

    def token(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        found = self._cache.get(text)
        if found is not None:
            return found
        data = text.encode()
        whole = self._rank(data)
        out = [whole] if whole >= 0 else self._merge(data)
        if len(text) <= CACHED_CHARS:
            if len(self._cache) >= CACHE:
                self._cache.clear()
            self._cache[text] = out
        return out

    def _pair(self, data: bytes) -> int:
        rank = self._pairs.get(data)
        if rank is None:
            rank = self._rank(data)
            if len(data) <= 16:
                if len(self._pairs) >= CACHE:
                    self._pairs.clear()
                self._pairs[data] = rank
        return rank

    def _merge(self, data: bytes) -> list[int]:
        """Merge the adjacent parts of least rank, leftmost first, until none has a rank."""
        n = len(data)
        end = list(range(1, n + 1))  # of the part that begins here; 0 once it is gone
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (rank := self._pair(data[i : i + 2])) >= 0:
                heap.append((rank, i, i + 1, i + 2))
        heapq.heapify(heap)
        while heap:
            _, left, middle, right = heapq.heappop(heap)
            if end[left] != middle or middle >= n or end[middle] != right:
                continue  # one of the two has changed since
            end[left], end[middle] = right, 0
            if right < n:
                before[right] = left
                if (rank := self._pair(data[left : end[right]])) >= 0:
                    heapq.heappush(heap, (rank, left, right, end[right]))
            if (prior := before[left]) >= 0 and (rank := self._pair(data[prior:right])) >= 0:
                heapq.heappush(heap, (rank, prior, left, right))
        out, i = [], 0
        while i < n:
            out.append(self._rank(data[i : end[i]]))
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        out: list[int] = []
        for t in self._split(text) if text else ():
            out += self.token(t)
        return out

    def encode_column(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of a batch of texts; each distinct pre-token of it is resolved once."""
        memo: dict[str, list[int]] = {}
        flat: list[int] = []
        offsets = [0]
        for text in texts:
            for t in self._split(text) if text else ():
                ids = memo.get(t)
                if ids is None:
                    ids = memo[t] = self.token(t)
                flat += ids
            offsets.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.asarray(flat, np.int32), pa.int32()))


_HASHES: dict[str, PerfectHash] = {}
_ENCODERS: dict[str, Encoder] = {}


def load(vocabulary: str = VOCABULARY) -> tuple[str, PerfectHash]:
    """Digest and perfect hash of a rank file, built once a process and content."""
    if os.path.getsize(vocabulary) > MAX_FILE:
        raise ValueError(f"{vocabulary} has more than {MAX_FILE} bytes")
    with open(vocabulary, "rb") as f:
        data = f.read()
    name = hashlib.sha256(data).hexdigest()
    if name not in _HASHES:
        lines = (line.split() for line in data.splitlines() if line)
        _HASHES[name] = PerfectHash({base64.b64decode(a): int(b) for a, b in lines})
    return name, _HASHES[name]


def encoder(name: str, ranks: PerfectHash) -> Encoder:
    """The encoder of a perfect hash, kept with its caches for the life of a process."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(ranks)
    return _ENCODERS[name]


def slices(texts: list[str | None], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with at most `most` characters each, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, ids: the token ids of each row's text, in one pass without a shuffle.

    Null and empty texts both give an empty list; strings of special tokens are ordinary
    text; repeated rows and null ids stay as they are; other columns are not read. The
    vocabulary file is read and hashed by the driver and sent to the executors; its size is
    fixed and checked.
    """
    apart([id], ("ids",))
    sent = df.sparkSession.sparkContext.broadcast(load(vocabulary))
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(*sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), e.encode_column(texts[a:b])], names=[id, "ids"])

    schema = T.StructType([T.StructField(id, df.schema[id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)
