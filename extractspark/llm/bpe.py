"""Byte-level BPE by a two-tier lookup, and its inverse.

A pre-token that is a vocabulary entry as a whole gets its id from a minimal perfect hash (hash and displace: a bucket's
seed sends its entries to free slots; every slot is used) and one comparison. Any other pre-token is merged over linked
bytes with a heap of candidate pairs, least rank first and leftmost among equals. Workers remember encoded pre-tokens.

Defined results: a null or empty text has no ids; repeated rows are encoded each for itself; a null doc_id stays null;
an empty table gives no rows; further columns are ignored. Texts of any length are cut only where a pre-token starts.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .common import column, lean, segments, slices

#: Pre-tokens that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64
_digest = xxhash.xxh3_64_intdigest


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots."""

    def __init__(self, keys: list[bytes], load: int = 4) -> None:
        n = len(keys)
        self.buckets = max(1, -(-n // load))
        self.seeds = [0] * self.buckets
        self.keys: list[bytes] = [b""] * n
        self.values: list[int] = [-1] * n
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            groups[_digest(key, 0) % self.buckets].append(i)
        free = bytearray(b"\1") * n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        spare = None  # what the larger buckets have left, for buckets of one entry
        for b in order:
            group = groups[b]
            if not group:
                break
            if len(group) > 1:
                seed = 1
                while len(set(slots := [_digest(keys[i], seed) % n for i in group])) < len(group) or not all(free[s] for s in slots):
                    seed += 1
            else:
                spare = spare or iter([s for s in range(n) if free[s]])
                slots = [next(spare)]
                seed = -slots[0] - 1
            self.seeds[b] = seed
            for i, s in zip(group, slots, strict=True):
                free[s], self.keys[s], self.values[s] = 0, keys[i], i

    def find(self, key: bytes) -> int:
        """Index of key among the keys, -1 if it isn't one."""
        if not self.keys:
            return -1
        seed = self.seeds[_digest(key, 0) % self.buckets]
        slot = -seed - 1 if seed < 0 else _digest(key, seed) % len(self.keys)
        return self.values[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: linked runs of bytes, a heap of neighbouring pairs."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the run that starts here; 0: no run starts here
    before = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two has grown or gone
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (rank, i, end[stop]))
        left = before[i]
        if left >= 0 and (rank := ranks.get(piece[left:stop])) is not None:
            heappush(heap, (rank, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Little-endian ids of a pre-token."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        entries = list(self.ranks)
        self.whole = PerfectHash(entries)
        self.ids = [self.ranks[x] for x in entries]
        self.bytes_of = {i: x for x, i in self.ranks.items()}
        # White space as Unicode defines it, as in the reference tokenizer; the module's own \s has four controls more.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    def __missing__(self, token: str) -> bytes:
        piece = token.encode()
        at = self.whole.find(piece)
        ids = np.asarray([self.ids[at]] if at >= 0 else merge(piece, self.ranks), dtype="<u4").tobytes()
        if len(token) <= LONGEST:
            if len(self) > REMEMBERED:
                self.clear()
            self[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join([b"".join(map(self.__getitem__, self.split(part))) for part in segments(text, 1 << 20)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (array of int, if asked for), n_tokens, and the digests of the ids and of what they decode to."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks, pattern)
        for batch in slices(batches, "text", 4 << 20):
            ids = [code.encode(t or "") for t in column(batch, "text").to_pylist()]
            out = [column(batch, "doc_id")]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in ids], pa.list_(pa.int32())))
            out += [pa.array([len(x) // 4 for x in ids], pa.int64())]
            out += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(code.decode(x)).hexdigest() for x in ids])]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, " + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks, pattern)
        for batch in batches:
            texts = [code.decode(np.asarray(x or [], "<u4").tobytes()).decode(errors="replace") for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")
