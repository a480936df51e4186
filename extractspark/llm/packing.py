"""Best-fit packing of tokenised documents, after a dominance reduction.

Lengths are whole numbers up to the capacity, so the instance that is solved is the histogram of lengths: at most
``capacity`` counts, whatever the number of documents. The reduction of Martello and Toth runs on it: a small set of
lengths that provably dominates every other set with its largest member is fixed for good. What is left goes through
best-fit decreasing, in bulk. The plan is a table of slots (length, range of ranks, first sequence, place), joined with
the pieces by length and by their rank among the pieces of that length; ranks come from salted groups and prefix sums.

Defined results: a null or empty text is one piece that holds only the end id; repeated rows are packed each for itself;
a null doc_id stays null; a text of any length is encoded whole, in one task; pieces of one length are ranked by doc_id and
piece, and equal ones in any order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship
from .common import column, lean, segments, slices, written

CAPACITY = 2048
#: Words whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 1_400_000, 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# The normaliser and the splitter that never look across a word's edges.
BY_WORD = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


class Words(dict):
    """Little-endian ids of a word without white space. A tokenizer of another kind encodes each text as a whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        self.by_word = (own.get("normalizer"), own.get("pre_tokenizer")) == BY_WORD and own["model"]["type"] == "BPE" and not any(t["normalized"] or " " in t["content"] for t in own.get("added_tokens", ()))
        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        self.most = REMEMBERED

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encoder.encode(word, add_special_tokens=False).ids)
        if ids.itemsize != 4 or sys.byteorder != "little":
            ids = np.asarray(ids, dtype="<u4")
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids.tobytes()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return np.asarray(self.encoder.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out = []
        for part in segments(text, 1 << 20):
            try:  # Latin-1 is composed already, and lower case maps it letter by letter
                part.encode("latin-1")
                part = part.lower()
            except UnicodeEncodeError:
                pass
            out.append(b"".join(map(self.__getitem__, part.replace("\n", " ").split(" "))))
        return b"".join(out)


@functools.cache
def words_of(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """A row for each run of at most ``capacity`` ids of each document, its end id included.

    remembered: words that a worker keeps; fewer take less memory and more time, and the result is the same.
    """
    ship(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        words.most = remembered
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                ids = words.encode(text or "") + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    rows.append((doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(cut), PIECES)


def reduce_by_dominance(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets in place; counts[w] is what is left of length w. Returns (lengths of a bin, bins).

    For the largest item w with room r: nothing fits, w stands alone; the largest fitting k fills r, or no two others
    fit together, or k is as long as any two that fit: {w, k}; at most two fit and the pair (a, b) is, member by
    member, as long as any two that fit: {w, a, b}.
    """
    fixed = []
    changed = True
    while changed:
        changed = False
        for w in range(capacity, 0, -1):
            while counts[w]:
                counts[w] -= 1
                bin_, least = _dominating(counts, capacity - w), 1
                counts[w] += 1
                if bin_ is None:
                    break
                need = {x: (w, *bin_).count(x) for x in (w, *bin_)}
                least = min(counts[x] // n for x, n in need.items())
                for x, n in need.items():
                    counts[x] -= n * least
                fixed.append(((w, *bin_), least))
                changed = True
    return fixed


def _dominating(counts: list[int], room: int) -> tuple[int, ...] | None:
    """What dominates every other filling of room; None if the criteria don't tell."""
    k = room
    while k and not counts[k]:
        k -= 1
    if not k:
        return ()
    if k == room:
        return (k,)
    small = []
    for x in range(1, room + 1):
        if counts[x]:
            small += [x] * min(3 - len(small), counts[x])
            if len(small) == 3:
                break
    if len(small) < 2 or small[0] + small[1] > room:
        return (k,)
    if len(small) == 3 and sum(small) <= room:
        return None
    best, low = (0, 0), 0
    for x in range(k, 0, -1):
        if counts[x]:
            y = min(x, room - x)
            while y and (not counts[y] or y == x and counts[x] < 2):
                y -= 1
            if y:
                low = max(low, y)
                best = max(best, (x + y, x))
    if k >= best[0]:
        return (k,)
    a = best[1]
    b = best[0] - a
    return (a, b) if a >= k and b >= low else None


def best_fit(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal bins move together."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for w in range(capacity, 0, -1):
        left, room = counts[w], w
        while left:
            while room <= capacity and not open_[room]:
                room += 1
            if room > capacity:
                fit = capacity // w
                for n, bins in ((fit, left // fit), (left % fit, 1)):
                    if n and bins:
                        open_[capacity - n * w].append(((w,) * n, bins))
                break
            held, bins = open_[room].pop()
            fit = room // w
            whole = min(bins, left // fit)
            if whole:
                open_[room - fit * w].append((held + (w,) * fit, whole))
                left, bins = left - whole * fit, bins - whole
            if bins and left and left < fit:
                open_[room - left * w].append((held + (w,) * left, 1))
                left, bins = 0, bins - 1
            if bins:
                open_[room].append((held, bins))
    return [x for group in open_ for x in group]


def plan(counts: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], dict]:
    """Slots (length, first rank, rank after, first sequence, items of that length a sequence, first place) and figures."""
    counts = list(counts)
    total = sum(w * n for w, n in enumerate(counts))
    fixed = reduce_by_dominance(counts, capacity)
    patterns = fixed + best_fit(counts, capacity)
    used, slots, sequence = [0] * (capacity + 1), [], 0
    for held, bins in patterns:
        place = 0
        for w in sorted(set(held), reverse=True):
            n = held.count(w)
            slots.append((w, used[w], used[w] + n * bins, sequence, n, place))
            used[w] += n * bins
            place += n * w
        sequence += bins
    return slots, {"sequences": sequence, "least": -(-total // capacity), "fixed": sum(n for _, n in fixed), "patterns": len(patterns)}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    spark = docs.sparkSession
    table = written(pieces(docs, tokenizer, capacity, end_id, remembered), "pieces")
    rows = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slots, _ = plan([rows.get(w, 0) for w in range(capacity + 1)], capacity)
    salts = max(16, sum(rows.values()) // 200_000)
    keyed = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = keyed.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("length").alias("of"), F.col("salt").alias("part"), (F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("of")) & (F.col("salt") == F.col("part"))).withColumn("rank", F.col("rank") + F.col("before"))
    # At most a few slots for each of the capacity's lengths: the patterns come from a histogram, not from rows.
    places = spark.createDataFrame(slots, "of_length long, low long, high long, first long, each long, place long")
    joined = ranked.join(F.broadcast(places), (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
