"""Removal of byte strings that also start in an earlier document, by suffix arrays over content-routed shards.

Every string of ``length`` bytes holds a minimizer: of its 20-byte grams, the leftmost with the least hash. It depends on
the string alone, so equal strings meet where their minimizer is sent. Runs of strings with one minimizer travel together,
as the piece of text they cover.

1. Rows are packed into blocks (compressed Arrow batches), written once. Each block tells the fingerprints of its
   minimizers; a shard finds those that occur in two documents. What only one document has goes no further.
2. Blocks send the distinct pieces around repeated minimizers, with the places and documents that hold them. A shard
   merges equal pieces, builds the suffix array of the others by induced sorting and their permuted common prefixes;
   neighbours with a common prefix of ``length`` or more are one string, and its least doc_id stands for it. (Pieces that
   are alone with their minimizer are left out of the array: nothing in the shard could equal a part of them.)
3. Each block hears which runs of strings start in an earlier document, and cuts the bytes they cover.

What grows, and how. Blocks and shards hold so many bytes that messages between them are as many as there are KB of text
(``sizes``), and each shard is a partition of its own. A block sends each distinct piece once, so a passage in every block
costs a shard one piece a block, however many copies there are. What the copies don't share is split: a minimizer found in
more than ``hot`` different surroundings (beyond one a block) has its strings sent one by one, by their own hash. A shard
works through its minimizers in ranges, so the arrays hold a bounded part of it at a time.

Defined results: a null or empty text, or one of fewer bytes than ``length``, loses nothing and contributes nothing
(null counts as empty); the first in doc_id order keeps what equal rows lose; rows that share a doc_id don't remove from
each other; a null doc_id comes after all others; an empty table gives no rows; a text of any length is read whole, in one
task; further columns are kept as they are: where one has the name of a result, the result's name gets underscores until
it is free.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .common import column, free_name, lean, slices, text_bytes, trim, written
from .suffix_array import common_prefixes, suffix_array

LENGTH = 50
#: Bytes of a gram; least bytes of texts in a block and for each shard; different surroundings that make a minimizer hot;
#: ranges of minimizers in a shard, and packed bytes of ranges that it works on at once; bytes of text for each message
#: between a block and a shard.
GRAM, BLOCK, SHARD, HOT, RANGES, WORK, MESSAGE = 20, 4 << 20, 6 << 20, 16384, 8, 8 << 20, 1024
_WINDOWS = 1 << 19
_LOW = np.uint64((1 << 22) - 1)
_LAST = np.iinfo(np.int64).max
_SEPARATOR = b"\xff"  # no byte of UTF-8


def _zip(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of known types, compressed: their sizes, then their bytes."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.compress(np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts), 3)


def _unzip(blob: bytes, *kinds: str | None) -> list:
    data = zstandard.decompress(blob)
    sizes = np.frombuffer(data, "<u4", len(kinds))
    cuts = np.cumsum(np.concatenate([[4 * len(kinds)], sizes.astype(np.int64)])).tolist()
    return [data[a:b] if k is None else np.frombuffer(data[a:b], k) for k, a, b in zip(kinds, cuts[:-1], cuts[1:], strict=True)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(data: bytes, n: int) -> np.ndarray:
    """Hashes of the 20-byte grams at the first n places of data."""
    word = lambda at: np.ndarray((n,), "<u8", data, at, (1,))
    h = word(0) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += word(8)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h += word(GRAM - 8)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _grams_at(data: bytes, at: np.ndarray) -> np.ndarray:
    """Hashes of the 20-byte grams at some places."""
    word = lambda k: np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))[at + k]
    return _mix(word(0)) + _mix(word(8) + np.uint64(1)) + _mix(word(GRAM - 8) + np.uint64(2))


def runs_by_minimizer(data: bytes, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, count of strings, minimizer's hash and text number of each run of strings with one minimizer.

    bounds: where the texts in data start, and where the last one ends. Strings never cross a bound.
    """
    span, out = length - GRAM + 1, []
    for low in range(0, len(data) - length + 1, _WINDOWS):
        high = min(low + _WINDOWS, len(data) - length + 1)
        h = _grams(data[low : high + length - 1], high - low + span - 1)
        best = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            best, width = np.minimum(best[:-width], best[width:]), 2 * width
        if width < span:
            best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
        at = (best & _LOW).astype(np.int32)
        # Only the texts that this stretch meets.
        first, last = np.searchsorted(bounds, [low, high - 1], "right") - 1
        number = np.repeat(np.arange(first, last + 1), np.diff(np.clip(bounds[first : last + 2], low, high)))
        inside = np.arange(low, high) + length <= bounds[number + 1]
        at[~inside] = -1
        cut = np.flatnonzero((at[1:] != at[:-1]) | (number[1:] != number[:-1])) + 1
        start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
        real = at[start] >= 0
        start, stop = start[real], stop[real]
        out.append((start + low, stop - start, h[at[start]], number[start]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def sizes(total: int) -> tuple[int, int]:
    """Bytes of a block and of a shard: their product is MESSAGE times the total, so messages grow as the total does."""
    scale = max(1.0, (MESSAGE * total / (BLOCK * SHARD)) ** 0.5)
    return int(BLOCK * scale), int(SHARD * scale)


class Block:
    """The rows of a packed block."""

    def __init__(self, blob: bytes, text: str, doc_id: str) -> None:
        self.batch = pa.ipc.open_stream(blob).read_next_batch()
        texts = [b if b is not None else b"" for b in column(self.batch, text).cast(pa.binary()).to_pylist()]
        self.data = b"".join(texts)
        self.bounds = np.cumsum([0] + [len(t) for t in texts])
        ids = column(self.batch, doc_id).cast(pa.int64())
        self.ids = np.array([_LAST if x is None else x for x in ids.to_pylist()], np.int64)


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _fingerprints(block: Block, shards: int, length: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], tuple]:
    """For each shard its number, sorted fingerprints, whether two documents of the block have them, and their different
    surroundings beyond one (255 at most); the runs."""
    runs = runs_by_minimizer(block.data, block.bounds, length)
    spread = _mix(runs[2])
    shard = ((spread >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
    key = (shard.astype(np.uint64) << np.uint64(32)) | (spread & np.uint64(0xFFFFFFFF))
    order = np.argsort(key, kind="stable")
    ordered, ids = key[order], block.ids[runs[3]][order]
    first = _heads(ordered)
    several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, bool)
    more = np.zeros(len(first), np.uint8)
    many = np.diff(np.append(first, len(ordered)))
    among = np.flatnonzero(np.repeat(many > 1, many))
    if len(among):  # a piece is told by its first and last gram and its length
        begin, last = runs[0][order[among]], (runs[0] + runs[1] + length - 1 - GRAM)[order[among]]
        grams = lambda at: _grams_at(block.data, at)
        piece = _mix(grams(begin) ^ _mix(grams(last) + (last - begin).astype(np.uint64)))
        which = np.repeat(np.arange(len(first)), many)[among]
        by = np.lexsort((piece, which))
        which, piece = which[by], piece[by]
        fresh = np.concatenate([[False], (which[1:] == which[:-1]) & (piece[1:] != piece[:-1])])
        more = np.minimum(np.bincount(which[fresh], minlength=len(first)), 255).astype(np.uint8)
    unique = ordered[first]
    cuts = np.searchsorted(unique, np.arange(shards + 1, dtype=np.uint64) << np.uint64(32))
    parts = [(s, (unique[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4"), several[a:b], more[a:b]) for s, (a, b) in enumerate(itertools.pairwise(cuts.tolist())) if b > a]
    return parts, (*runs, shard, key)


def _repeated(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], hot: int) -> Iterator[tuple[int, np.ndarray]]:
    """(block, 0 / 1 / 2 for each of its fingerprints: alone, repeated, hot)."""
    every = np.concatenate([p[1] for p in parts])
    order = np.argsort(every, kind="stable").astype(np.int32)
    first = _heads(every[order])
    many = np.diff(np.append(first, len(every)))
    several = np.logical_or.reduceat(np.concatenate([p[2] for p in parts])[order], first) if len(first) else np.zeros(0, bool)
    load = np.add.reduceat(np.concatenate([p[3] for p in parts])[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    state = np.empty(len(every), np.uint8)
    state[order] = np.repeat(np.where((many > 1) | several, np.where(load > hot, 2, 1), 0).astype(np.uint8), many)
    at = 0
    for block, prints, *_ in parts:
        yield block, state[at : at + len(prints)]
        at += len(prints)


def _pieces(block: Block, states: dict[int, np.ndarray], shards: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(shard, packed ranges): for each range of minimizers the distinct pieces, and the places and documents of each."""
    parts, (start, count, gram, number, shard, key) = _fingerprints(block, shards, length)
    unique = np.concatenate([(np.uint64(s) << np.uint64(32)) | p.astype(np.uint64) for s, p, *_ in parts]) if parts else np.zeros(0, np.uint64)
    told = np.concatenate([states[s] if s in states else np.zeros(len(p), np.uint8) for s, p, *_ in parts]) if parts else np.zeros(0, np.uint8)
    state = told[np.searchsorted(unique, key)] if len(key) else np.zeros(0, np.uint8)
    hot, keep = np.flatnonzero(state == 2), state == 1
    single = (start[hot], count[hot], number[hot])
    start, count, gram, number, shard = start[keep], count[keep], gram[keep], number[keep], shard[keep]
    if len(hot):  # one string each, by its own content
        many = single[1]
        begin = np.repeat(single[0], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        own = np.frombuffer(b"".join(hashlib.blake2b(block.data[b : b + length], digest_size=8).digest() for b in begin.tolist()), np.uint64)
        start, count = np.concatenate([start, begin]), np.concatenate([count, np.ones(len(begin), np.int64)])
        gram, number = np.concatenate([gram, own]), np.concatenate([number, np.repeat(single[2], many)])
        shard = np.concatenate([shard, (own % np.uint64(shards)).astype(np.int32)])
    bucket = shard.astype(np.int64) * RANGES + (_mix(gram + np.uint64(1)) % np.uint64(RANGES)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(shards * RANGES + 1)).tolist()
    data, extra, nothing = block.data, length - 1, _zip(*[b""] * 6)
    for s in range(shards):
        if cuts[s * RANGES] == cuts[(s + 1) * RANGES]:
            continue
        ranges = []
        for r in range(s * RANGES, (s + 1) * RANGES):
            mine = order[cuts[r] : cuts[r + 1]]
            if not len(mine):
                ranges.append(nothing)
                continue
            index: dict[bytes, int] = {}
            which = np.fromiter((index.setdefault(data[x : x + c + extra], len(index)) for x, c in zip(start[mine].tolist(), count[mine].tolist(), strict=True)), np.int32, len(mine))
            _, head = np.unique(which, return_index=True)
            ranges.append(_zip(b"".join(index), np.fromiter(map(len, index), "<u4", len(index)), gram[mine][head].astype("<u8"), which.astype("<u4"), start[mine].astype("<u4"), block.ids[number[mine]].astype("<i8")))
        yield s, np.array([len(r) for r in ranges], "<u4").tobytes() + b"".join(ranges)


def _ranges(blob: bytes) -> list[tuple[int, int]]:
    """Where each range of a message lies."""
    cuts = np.cumsum(np.concatenate([[4 * RANGES], np.frombuffer(blob, "<u4", RANGES)]).astype(np.int64))
    return list(itertools.pairwise(cuts.tolist()))


def _removed(parts: list[tuple[int, bytes]], length: int) -> Iterator[tuple[int, bytes]]:
    """(block, packed starts and counts of strings that also start in an earlier document), WORK packed bytes at a time."""
    lies = [_ranges(blob) for _, blob in parts]
    held: list[tuple[int, bytes]] = []
    size = 0
    for r in range(RANGES):
        mine = [(block, blob[at[r][0] : at[r][1]]) for (block, blob), at in zip(parts, lies, strict=True)]
        more = sum(len(blob) for _, blob in mine)
        if held and size + more > WORK:
            yield from _removed_in_ranges(held, length)
            held, size = [], 0
        held, size = held + mine, size + more
    yield from _removed_in_ranges(held, length)


def _removed_in_ranges(parts: list[tuple[int, bytes]], length: int) -> Iterator[tuple[int, bytes]]:
    index: dict[bytes, int] = {}
    grams: list[int] = []
    least: list[int] = []
    sent = []
    for block, blob in parts:
        texts, sizes, gram, which, start, ids = _unzip(blob, None, "<u4", "<u8", "<u4", "<u4", "<i8")
        if not len(which):
            continue
        order = np.argsort(which, kind="stable")
        first = np.searchsorted(which[order], np.arange(len(sizes)))
        low = np.minimum.reduceat(ids[order], first).tolist()
        local, at = [], 0
        for size, g, m in zip(sizes.tolist(), gram.tolist(), low, strict=True):
            piece = texts[at : at + size]
            at += size
            k = index.setdefault(piece, len(index))
            if k == len(grams):
                grams.append(g)
                least.append(m)
            elif m < least[k]:
                least[k] = m
            local.append(k)
        sent.append((block, np.array(local, np.int32)[which], start, ids))
    if not sent:
        return
    pieces = list(index)
    del index
    sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
    strings = sizes - (length - 1)
    firsts = np.cumsum(np.concatenate([[0], strings]), dtype=np.int64)  # of each piece's strings
    # Documents by their rank among those that are the least of a piece.
    docs, first_doc = np.unique(np.array(least, np.int64), return_inverse=True)
    first_doc = first_doc.astype(np.int32)
    earliest = np.repeat(first_doc, strings)
    _, group, many = np.unique(np.array(grams, np.uint64), return_inverse=True, return_counts=True)
    several = np.flatnonzero(many[group] > 1)
    if len(several):
        text = np.frombuffer(_SEPARATOR.join([pieces[i] for i in several.tolist()]) + _SEPARATOR, np.uint8)
        del pieces
        begins = np.cumsum(np.concatenate([[0], sizes[several[:-1]] + 1]), dtype=np.int64)
        order = suffix_array(text)
        prefix = common_prefixes(text, order, begins, length)
        # A class of equal strings: a run of neighbours that share the whole length.
        heads = np.flatnonzero(prefix[order] < length)
        # The strings' places in the text, piece by piece, and the ranks of their documents; other places have none.
        n = strings[several]
        place = np.repeat(begins - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        rank = np.full(len(text), len(docs), np.int32)
        rank[place] = np.repeat(first_doc[several], n)
        low = np.minimum.reduceat(rank[order], heads)
        rank[order] = np.repeat(low, np.diff(np.append(heads, len(text))))
        earliest[np.repeat(firsts[several] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] = rank[place]
    for block, which, start, ids in sent:
        count = strings[which]
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        gone = docs[earliest[np.repeat(firsts[which], count) + within]] < np.repeat(ids, count)
        if gone.any():
            places = np.sort((np.repeat(start.astype(np.int64), count) + within)[gone])
            cut = np.flatnonzero(np.diff(places) != 1) + 1
            begin, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(places)]])
            yield block, _zip(places[begin].astype("<u4"), (stop - begin).astype("<u4"))


def _cut(block: Block, replies: list[bytes], length: int) -> list[tuple[list[tuple[int, int]], bytes]]:
    """For each row its removed spans (maximal, start and stop in its own bytes) and what is left."""
    spans: list[list[tuple[int, int]]] = [[] for _ in block.ids]
    if replies:
        found = [_unzip(r, "<u4", "<u4") for r in replies]
        low = np.concatenate([f[0] for f in found]).astype(np.int64)
        high = low + np.concatenate([f[1] for f in found]) + length - 1
        number = np.searchsorted(block.bounds, low, "right") - 1
        order = np.argsort(low, kind="stable")
        low, high, number = low[order], high[order], number[order]
        reach = np.maximum.accumulate(high)  # spans of a text end in it, so those of the one before never reach over
        fresh = np.concatenate([[True], (low[1:] > reach[:-1]) | (number[1:] != number[:-1])])
        heads = np.flatnonzero(fresh)
        for k, a, b in zip(number[heads].tolist(), low[heads].tolist(), reach[np.append(heads[1:], len(low)) - 1].tolist(), strict=True):
            base = int(block.bounds[k])
            spans[k].append((a - base, b - base))
    out = []
    for k, mine in enumerate(spans):
        base, end = int(block.bounds[k]), int(block.bounds[k + 1])
        left, at = [], base
        for a, b in mine:
            left.append(block.data[at : base + a])
            at = base + b
        left.append(block.data[at:end])
        out.append((mine, b"".join(left)))
    return out


RESULT = "array<struct<start:int,stop:int>>"


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", spans: str = "removed", kept: str = "kept_bytes", length: int = LENGTH, hot: int = HOT, block_bytes: int | None = None, shard_bytes: int | None = None, replace: bool = False) -> DataFrame:
    """All columns, and two more: the removed spans (byte places, maximal) and the bytes that are left.

    With replace there are no more columns: the text is what is left of it, without characters of which a part went; a
    null text stays null.
    """
    if length < GRAM + 1:
        raise ValueError(f"strings must be longer than {GRAM} bytes")
    spans, kept = free_name(spans, docs.columns), free_name(kept, [*docs.columns, spans])
    spark = docs.sparkSession
    ship(spark)
    typed = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    schema = typed.schema
    total = text_bytes(typed, f"`{text}`")
    block_bytes, shard_bytes = block_bytes or sizes(total)[0], shard_bytes or sizes(total)[1]
    shards = max(12, -(-total // shard_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        for k, batch in enumerate(slices(batches, text, block_bytes)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId() << 32 | k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "packed"])

    def table(kinds: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=[n for n, _ in kinds])

    sent = [("shard", pa.int32()), ("block", pa.int64()), ("found", pa.binary())]
    told = [("block", pa.int64()), ("shard", pa.int32()), ("found", pa.binary())]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(column(batch, "block").to_pylist(), column(batch, "packed"), strict=True):
                parts, _ = _fingerprints(Block(packed.as_buffer(), text, doc_id), shards, length)
                # Sorted numbers pack well as differences.
                yield from table(sent, [(s, block, _zip(np.diff(p, prepend=np.uint32(0)).astype("<u4"), np.packbits(m), x)) for s, p, m, x in parts]).to_batches()

    def find(key: tuple, rows: pa.Table) -> pa.Table:
        parts = []
        for block, blob in zip(rows["block"].to_pylist(), rows["found"].to_pylist(), strict=True):
            gaps, bits, more = _unzip(blob, "<u4", "u1", "u1")
            parts.append((block, np.cumsum(gaps, dtype=np.uint32), np.unpackbits(bits, count=len(gaps)).view(bool), more))
        trim()
        return table(told, [(b, key[0].as_py(), _zip(state)) for b, state in _repeated(parts, hot) if state.any()])

    def send(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        states = {s: _unzip(f, "u1")[0] for s, f in zip(replies["shard"].to_pylist(), replies["found"].to_pylist(), strict=True)}
        for block, packed in zip(blocks["block"].to_pylist(), blocks["packed"].to_pylist(), strict=True) if states else ():
            rows += [(s, block, blob) for s, blob in _pieces(Block(packed, text, doc_id), states, shards, length)]
        trim()
        return table(sent, rows)

    def sort(key: tuple, rows: pa.Table) -> pa.Table:
        done = table(told, [(b, key[0].as_py(), blob) for b, blob in _removed(list(zip(rows["block"].to_pylist(), rows["found"].to_pylist(), strict=True)), length)])
        trim()
        return done

    def finish(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for packed in blocks["packed"].to_pylist():
            block = Block(packed, text, doc_id)
            done = _cut(block, replies["found"].to_pylist(), length)
            if replace:
                at = block.batch.schema.get_field_index(text)
                left = pa.array([b.decode("utf-8", "ignore") if there else None for there, (_, b) in zip(block.batch.column(at).is_valid().to_pylist(), done, strict=True)], pa.string())
                out.append(pa.Table.from_batches([block.batch.set_column(at, text, left)]))
                continue
            marks = pa.array([[{"start": a, "stop": b} for a, b in s] for s, _ in done], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            out.append(pa.Table.from_arrays([*block.batch.columns, marks, pa.array([b for _, b in done], pa.binary())], names=[*block.batch.schema.names, spans, kept]))
        trim()
        return pa.concat_tables(out) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

    result = schema if replace else StructType([*schema.fields, StructField(spans, ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))), StructField(kept, BinaryType())])
    empty = to_arrow_schema(result).empty_table()
    blocks = written(typed.mapInArrow(lean(pack), "block long, packed binary"), "blocks")
    # A shard is a partition: what reaches a task is one shard's.
    prints = blocks.mapInArrow(lean(tell), "shard int, block long, found binary").repartitionById(shards, F.col("shard"))
    repeated = prints.groupBy("shard").applyInArrow(find, "block long, shard int, found binary")
    pieces = blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(send, "shard int, block long, found binary").repartitionById(shards, F.col("shard"))
    gone = pieces.groupBy("shard").applyInArrow(sort, "block long, shard int, found binary")
    return blocks.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(finish, result)


def digest(done: DataFrame) -> DataFrame:
    """Figures and a checksum for each row of remove_repeats(docs)."""
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return done.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
