"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one resolves a whole pre-token by a *minimal perfect hash* of the vocabulary: hash-and-displace
over as many slots as there are entries, one probe and one comparison of bytes. Tier two takes what
is not in the vocabulary: its bytes form a doubly linked list, a heap holds the mergeable
neighbours by rank, and the lowest rank (leftmost on ties) is merged until none is left.

Edge cases: a null text counts as the empty text; an empty text has no ids and decodes to no bytes;
repeated rows give repeated results; extra columns of the input are ignored; an empty table gives
an empty result. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from siftmark.llm.common import bounded_batches

#: Entries, and their characters, of each of the two generations of the pre-token memo of a worker.
MEMO, MEMO_CHARS = 200_000, 8_000_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PerfectHash:
    """Minimal perfect hash of byte strings to their values: one slot for each key."""

    def __init__(self, items: dict[bytes, int], load: int = 3):
        n = self.n = len(items)
        self.m = max(1, n // load)
        buckets: list[list[tuple[bytes, int]]] = [[] for _ in range(self.m)]
        for key in items:
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % self.m].append((key, h))
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        self.displace = [0] * self.m
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            own, d = buckets[b], 0
            while own:
                slots = {self._slot(h, d) for _, h in own}
                if len(slots) == len(own) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            for key, h in own:
                s = self._slot(h, d)
                self.keys[s], self.values[s] = key, items[key]
            self.displace[b] = d

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x >> 32) % self.n

    def get(self, key: bytes) -> int:
        """The value of ``key``, or -1 if it is not a key."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        s = self._slot(h, self.displace[h % self.m])
        return self.values[s] if self.keys[s] == key else -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.ranks = ranks
        self.words = PerfectHash(ranks)
        self.pattern = pattern
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.memo, self.new, self.old, self.chars = memo, {}, {}, 0

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("split", "new", "old")}

    def __setstate__(self, state):
        self.__dict__.update(state, split=regex.compile(state["pattern"]).findall, new={}, old={}, chars=0)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by merges, lowest rank first, leftmost on ties."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # of the part that starts at i
        left = list(range(-1, n - 1))
        right = list(range(1, n + 1))
        due = [-1] * n  # rank at which the part at i merges with its right neighbour
        heap = []
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2], -1)) >= 0:
                due[i] = r
                heap.append((r, i))
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if due[i] != r:
                continue
            j = right[i]
            end[i], right[i], due[j] = end[j], right[j], -1
            if right[i] < n:
                left[right[i]] = i
                due[i] = ranks.get(piece[i : end[right[i]]], -1)
                if due[i] >= 0:
                    heapq.heappush(heap, (due[i], i))
            else:
                due[i] = -1
            if (k := left[i]) >= 0:
                due[k] = ranks.get(piece[k : end[i]], -1)
                if due[k] >= 0:
                    heapq.heappush(heap, (due[k], k))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = right[i]
        return ids

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the perfect hash first, then merges."""
        whole = self.words.get(piece)
        return [whole] if whole >= 0 else self.merge(piece)

    def _fresh(self, piece: str) -> bytes:
        found = self.new.get(piece) or self.old.get(piece)
        if found is None:
            found = np.array(self.piece(piece.encode()), "<u4").tobytes()
        if len(self.new) >= self.memo or self.chars >= MEMO_CHARS:
            self.old, self.new, self.chars = self.new, {}, 0
        self.new[piece] = found
        self.chars += len(piece)
        return found

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, miss = self.new.get, self._fresh  # if the memo turns over within a text, the rest goes by miss()
        return b"".join([known(p) or miss(p) for p in self.split(text)])

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids."""
        return b"".join(map(self.tokens.__getitem__, ids))


def _worker(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value  # stays in the worker between tasks, and its memo with it
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = bpe.encode_bytes(text.as_py() or "")
                decoded = bpe.decode(np.frombuffer(ids, "<u4").tolist())
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def token_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``vocabulary`` is the path of a file of base64 tokens and ranks, read by the driver; the table
    that workers get is as large as the vocabulary, whatever the corpus. Row-local, no shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(ByteBPE(read_ranks(vocabulary), pattern))
    return docs.select("doc_id", "text").mapInArrow(_worker(shared), SCHEMA)
