"""Near duplicates by circulant MinHash, banding and exact verification.

A document's set holds its distinct five-word shingles (64-bit hashes). Two permutations make all signature coordinates:
the first spreads a shingle over the universe of 32-bit numbers, the second is applied to that place shifted circularly by
1, 2, ..., K; coordinate k is the least image over the set. Bands of equal coordinates name buckets; five coordinates in
each of 40 bands miss a pair at the threshold 0.75 with a chance of 0.00002, at 0.8 of 0.0000002.

Equal sets are one class from the start. Each bucket then ties its members to the least of them only, its lead; those
ties are verified on the full sets, and what holds joins members to components. So copies, however many, cost one tie
each, and no bucket is spelled out as pairs.

One more round looks across components, among the members of one lead c. Both linked with c would be one component; so of
a pair to be looked at one, x, is not. A member is written as what it lacks of c (a mask over c's shingles) and what it has
beyond c; from these the intersection of two members follows exactly: |x & c| + |y & c| - |c| + |lacked by both| + |had by
both|. Members not linked with c meet all members in blocks of bounded size, the counts of a whole block at once, and only
links that join two components leave a block. So no pair is ever a row.

Components come from alternating large-star and small-star steps on the links, each written to the shared folder.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer than five
words are one shingle; rows that share a doc_id are one document (linked); a row with null doc_id is linked with nothing,
its component is null and it is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .common import column, drop_folder, lean, new_folder, scratch, slices, trim, written

SHINGLE, BANDS, ROWS = 5, 40, 5
#: Linked if FRACTION[1] * intersection >= FRACTION[0] * union.
FRACTION = (75, 100)
#: Members not linked with their lead, and members, in a block of the second round, and the bytes of each; a group's bytes.
BLOCK, BLOCK_BYTES, GROUP_BYTES = (1000, 4000), (4 << 20, 16 << 20), 8 << 20
_SEGMENT = 1 << 20
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(_SEGMENT + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of data; memory doesn't grow with a word's distance from the start."""
    up, down = _powers()
    all_bytes = np.frombuffer(data, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data):
        stop = min(at + _SEGMENT, len(data))
        if stop < len(data):
            gaps = np.flatnonzero(_SPACE[all_bytes[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # one word longer than a segment
                tail = next((i for i in range(stop, len(data), _SEGMENT) if _SPACE[all_bytes[i : i + _SEGMENT]].any()), None)
                stop = len(data) if tail is None else tail + int(np.flatnonzero(_SPACE[all_bytes[tail : tail + _SEGMENT]])[0]) + 1
                first = at + int(np.argmin(_SPACE[all_bytes[at:stop]]))
                starts.append(np.array([first]))
                word = data[first:stop].rstrip(b" \t\n\v\f\r").lower()
                hashes.append(np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64))
                at = stop
                continue
        part = all_bytes[at:stop]
        word = ~_SPACE[part]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        first, last = edge[::2], edge[1::2]
        if len(first):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_TABLE[part] * up[: len(part)], out=sums[1:])
            starts.append(first + at)
            hashes.append(mix((sums[last] - sums[first]) * down[first]))
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    encoded = [(t or "").encode() for t in texts]
    bounds = np.cumsum([0] + [len(e) + 1 for e in encoded])
    starts, words = word_hashes(b"\n".join(encoded))
    at = np.searchsorted(starts, bounds)
    whole = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        whole += words[j : j + len(whole)] * _PLACES[j]
    whole = mix(whole)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(whole[a : b - SHINGLE + 1]))
        elif b > a:
            few = np.sum(words[a:b] * _PLACES[: b - a], dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], k: int = BANDS * ROWS) -> np.ndarray:
    """Coordinates of non-empty sets, a row each: least image of the shifted places."""
    out = np.zeros((len(sets), k), np.uint32)
    if not sets:
        return out
    sizes = [len(s) for s in sets]
    everything = mix(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D))  # the first permutation, cut to the universe
    places = (everything >> np.uint64(32)).astype(np.uint32)
    step, start, done = 1 << 16, 0, 0
    while done < len(sets):
        stop, size = done, 0
        while stop < len(sets) and (size == 0 or size + sizes[stop] <= step):
            size += sizes[stop]
            stop += 1
        if size <= step:
            out[done:stop] = _least(places[start : start + size], np.cumsum([0, *sizes[done : stop - 1]]), k)
        else:  # one long document, piece by piece
            out[done] = np.min([_least(places[a : min(a + step, start + size)], np.array([0]), k)[0] for a in range(start, start + size, step)], axis=0)
        start, done = start + size, stop
    return out


def _least(places: np.ndarray, firsts: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((k, len(firsts)), np.uint32)
    x, y = np.empty_like(places), np.empty_like(places)
    c1, c2, c3 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F)
    for j in range(k):  # the second permutation, of the place shifted by j + 1
        np.subtract(places, np.uint32(j + 1), out=x)
        np.multiply(x, c1, out=x)
        np.right_shift(x, 15, out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, c2, out=x)
        np.right_shift(x, 13, out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, c3, out=x)
        np.minimum.reduceat(x, firsts, out=out[j])
    return out.T


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE)
    for j in range(ROWS):
        key = mix(key ^ parts[:, :, j]) + np.uint64(j + 1)
    return mix(key)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), two halves of the set's digest, band keys (empty sets: none)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sets = shingle_sets(column(batch, "text").to_pylist())
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(signatures([sets[i] for i in full]))
            packed: list[bytes | None] = [None] * len(sets)
            for r, i in enumerate(full):
                packed[i] = keys[r].tobytes()
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(packed, pa.binary())], names=["doc_id", "n", "d1", "d2", "packed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n long, d1 long, d2 long, packed binary")


def banded(classes: DataFrame) -> DataFrame:
    """A row for each band of each class: key and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                keys = np.frombuffer(b"".join(column(part, "packed").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(column(part, "id").to_numpy(), BANDS))], names=["key", "id"])

    return classes.select("id", "packed").mapInArrow(lean(run), "key long, id long")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and set of the documents named by ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([s.tobytes() for s in shingle_sets(column(batch, "text").to_pylist())], pa.binary())], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    # Of a size unknown beforehand: merged, at any size, so that the plan doesn't turn with the input.
    return texts.join(ids.hint("merge"), "id").mapInArrow(lean(run), "id long, shingles binary")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and their sets x, y."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")


def _own(x: pa.Scalar, y: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sets, and which of the second's members the first lacks."""
    s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
    at = np.searchsorted(s, t)
    at[at == len(s)] = 0
    return s, t, (s[at] != t) if len(s) else np.ones(len(t), bool)


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n (size of b's set), common (size of the intersection) and linked, for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, common, linked = [], [], []
            for x, y in zip(column(batch, "x"), column(batch, "y"), strict=True):
                s, t, own = _own(x, y)
                c = len(t) - int(own.sum())
                n.append(len(t))
                common.append(c)
                linked.append(c > 0 and FRACTION[1] * c >= FRACTION[0] * (len(s) + len(t) - c))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(n, pa.int64()), pa.array(common, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "n", "common", "linked"])

    found = with_sets(pairs, sets).mapInArrow(lean(run), "a long, b long, n long, common long, linked boolean")
    return found.groupBy("a", "b").agg(F.max("n").alias("n"), F.max("common").alias("common"), F.max("linked").alias("linked"))


def deltas(ties: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, lead_set (which set of a), its size, n (size of b's set), common, lacked (a mask over a's set) and beyond (what
    a lacks) for each tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, size, n, common, lacked, beyond = [], [], [], [], [], []
            for x, y in zip(column(batch, "x"), column(batch, "y"), strict=True):
                s, t, own = _own(x, y)
                there = np.zeros(-(-len(s) // 64) * 64, bool)
                there[: len(s)] = True
                there[np.searchsorted(s, t[~own])] = False
                which.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True))
                size.append(len(s))
                n.append(len(t))
                common.append(len(t) - int(own.sum()))
                lacked.append(np.packbits(there).tobytes())
                beyond.append(t[own].tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), *(pa.array(v, pa.int64()) for v in (which, size, n, common)), pa.array(lacked, pa.binary()), pa.array(beyond, pa.binary())], names=["a", "b", "lead_set", "size", "n", "common", "lacked", "beyond"])

    return with_sets(ties, sets).mapInArrow(lean(run), "a long, b long, lead_set long, size long, n long, common long, lacked binary, beyond binary")


def _block_links(asks: np.ndarray, members: np.ndarray, of: dict[str, np.ndarray], lacked: pa.Array, beyond: pa.Array) -> Iterator[tuple[int, int]]:
    """Links between members of one lead that join components: those that ask against all. Both are row numbers of the columns."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    size, n, common, component, ids = int(of["size"][members[0]]), of["n"][members], of["common"][members], of["component"][members].tolist(), of["id"][members].tolist()
    masks = np.frombuffer(b"".join(lacked[k].as_buffer() for k in members.tolist()), np.uint64).reshape(len(members), -1)
    own = [np.frombuffer(beyond[k].as_buffer(), np.uint64) for k in members.tolist()]
    owner = np.repeat(np.arange(len(members), dtype=np.int32), [len(o) for o in own])
    values = np.concatenate(own)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for x in asks.tolist():
        mine = np.frombuffer(beyond[x].as_buffer(), np.uint64)
        low, high = np.searchsorted(values, mine), np.searchsorted(values, mine, "right")
        many = high - low
        hits = owner[np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
        both = np.bincount(hits, minlength=len(members)) + np.bitwise_count(masks & np.frombuffer(lacked[x].as_buffer(), np.uint64)).sum(axis=1, dtype=np.int64)
        shared = of["common"][x] + common - size + both
        for i in np.flatnonzero((shared > 0) & (FRACTION[1] * shared >= FRACTION[0] * (of["n"][x] + n - shared))).tolist():
            c, d = find(int(of["component"][x])), find(component[i])
            if c != d:
                root[max(c, d)] = min(c, d)
                yield int(of["id"][x]), ids[i]


def components(links: DataFrame) -> DataFrame:
    """id and component (least id) of every id in links (a, b)."""
    spark = links.sparkSession
    path = new_folder(spark, "edges")
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", path)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, path = path, new_folder(spark, "edges")
        edges = written(small, "edges", path)
        drop_folder(spark, before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = (now["n"], now["h"])


def _labels(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """id and component of the classes of equal sets that are linked with others."""
    buckets = banded(classes)
    shared = buckets.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last").select("key", "lead")
    ties = written(buckets.join(shared, "key").where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "ties")
    tied = ties.select(F.col("a").alias("id")).unionByName(ties.select(F.col("b").alias("id"))).distinct()
    sets = written(full_sets(docs, tied), "sets")
    judged = written(compared(ties, sets), "judged")
    links = judged.where("linked").select("a", "b")
    labels = components(links)
    more = written(across(judged, labels, sets), "links")
    return labels if more.isEmpty() else components(links.unionByName(more))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    spark = docs.sparkSession
    rows = written(described(docs), "described")
    known = rows.where("n > 0 and doc_id is not null")
    classes = written(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("packed").alias("packed")), "classes")
    path = new_folder(spark, "labels")
    with scratch(spark):
        labels = written(_labels(docs, classes), "labels", path)
    classed = classes.select("d1", "d2", "id").join(labels, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    plain = rows.select("doc_id", F.col("n").alias("n_shingles"), *[F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col(d)).alias(d) for d in ("d1", "d2")])
    found = plain.join(classed, ["d1", "d2"], "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def across(judged: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members of one lead that are of different components (see the module's text)."""
    named = judged.join(labels, judged["b"] == labels["id"], "left").select("a", "b", "linked", (8 * F.col("n")).alias("bytes"), F.coalesce("component", "b").alias("component"))
    leads = judged.select("a").distinct().join(labels, F.col("a") == F.col("id"), "left").select("a", F.coalesce("component", "a").alias("of_lead"))
    sizes = named.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.when(F.col("linked"), 0).otherwise(1)).alias("asking"), F.count("*").alias("members"), F.sum(F.when(F.col("linked"), 0).otherwise(F.col("bytes"))).alias("asking_bytes"), F.sum("bytes").alias("bytes"))
    mixed = sizes.join(leads, "a").where("members > 1 and low <> high")
    parts = lambda n, k: F.greatest(F.ceil(F.col(n) / BLOCK[k]), F.ceil(F.col("asking_bytes" if n == "asking" else "bytes") / BLOCK_BYTES[k]), F.lit(1)).cast("int")
    blocks = mixed.select("a", parts("asking", 0).alias("rows"), parts("members", 1).alias("columns"))
    facts = written(named.join(blocks, "a"), "facts")
    groups = max(64, (facts.agg(F.sum("bytes").alias("n")).first()["n"] or 0) // GROUP_BYTES)
    full = facts.join(deltas(facts, sets), ["a", "b"])
    # Each member goes to its column of blocks; one that asks goes to its row of blocks, too.
    row, col = F.pmod(F.xxhash64("b"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("b", F.lit(1)), F.col("columns")).cast("int")
    steps = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_member = F.transform(steps("rows"), lambda i: F.struct(i.alias("i"), col.alias("j"), F.lit(False).alias("asks")))
    as_asking = F.when(~F.col("linked"), F.transform(steps("columns"), lambda j: F.struct(row.alias("i"), j.alias("j"), F.lit(True).alias("asks")))).otherwise(F.array().cast("array<struct<i:int,j:int,asks:boolean>>"))
    placed = full.withColumn("at", F.explode(F.concat(as_member, as_asking))).select(F.col("a").alias("lead"), "lead_set", F.col("b").alias("id"), "n", "common", "component", "size", "lacked", "beyond", "at.*")
    placed = placed.withColumn("group", F.pmod(F.xxhash64("lead", "lead_set", "i", "j"), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        of = {c: rows[c].to_numpy() for c in ("lead", "lead_set", "i", "j", "id", "n", "common", "component", "size", "asks")}
        lacked, beyond = (rows[c].chunk(0) if rows.num_rows else pa.array([], pa.binary()) for c in ("lacked", "beyond"))
        order = np.lexsort((of["j"], of["i"], of["lead_set"], of["lead"]))
        ends = np.flatnonzero(np.any([of[c][order][1:] != of[c][order][:-1] for c in ("lead", "lead_set", "i", "j")], axis=0)) + 1 if len(order) else []
        found = []
        for block in np.split(order, ends):
            asks, members = block[of["asks"][block]], block[~of["asks"][block]]
            if len(asks) and len(members):
                found += [(min(x, y), max(x, y)) for x, y in _block_links(asks, members, of, lacked, beyond)]
        trim()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return placed.groupBy("group").applyInArrow(run, "a long, b long")
