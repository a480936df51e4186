import hashlib
import random

import numpy as np
import pytest
from extractspark.llm import suffix_array, suffix_dedup


def test_suffix_arrays_of_small_texts():
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = rng.integers(0, rng.integers(1, 6), rng.integers(0, 60)).astype(np.uint8)
        raw = text.tobytes()
        order = suffix_array.suffix_array(text)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        if len(raw) > 1:
            firsts = np.unique(np.append(rng.integers(0, len(raw), 3), 0))
            shared = suffix_array.common_prefixes(text, order, firsts, 9)
            for a, b in zip(order[:-1], order[1:], strict=True):
                n = next((k for k in range(len(raw)) if b + k >= len(raw) or a + k >= len(raw) or raw[a + k] != raw[b + k]), 0)
                assert shared[b] == min(n, 9)


@pytest.mark.parametrize("raw", [b"a" * 500, b"ab" * 300, b"abracadabra" * 30, bytes(range(256)) * 3, b"\xff" * 3 + b"\0" * 3])
def test_suffix_arrays_of_regular_texts(raw):
    assert suffix_array.suffix_array(np.frombuffer(raw, np.uint8)).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def brute_kept(rows, length):
    """For every row its id, bytes, kept bytes and removed runs, by looking every string up among those of lesser ids."""
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, key(i)), key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < key(i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        yield i, b, kept, sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), gone


def brute(rows, length):
    """Figures of every row."""
    return [(i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()) for i, b, kept, spans, _ in brute_kept(rows, length)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r))


def compare(docs, length=50, **options):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs.select("doc_id", "text"), length=length, **options)).collect()]
    assert order(got) == order(brute(rows, length))


def test_odd_rows(odd_docs, no_docs):
    compare(odd_docs)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_documents(some_docs):
    compare(some_docs)


@pytest.mark.parametrize("hot", [0, 2, suffix_dedup.HOT])
def test_hot_passages_in_many_blocks(spark, hot):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé") for _ in range(6))
    passages = [" ".join(word() for _ in range(30)) for _ in range(3)]
    rows = [(i, " ".join([*(word() for _ in range(rng.randint(0, 20))), rng.choice(passages), *(word() for _ in range(rng.randint(0, 20))), "z" * rng.randint(0, 130)])) for i in range(120)]
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), hot=hot, block_bytes=2000, shard_bytes=4000)


def test_texts_longer_than_a_window_segment(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_WINDOWS", 300)
    data = "".join(random.Random(1).choice("ab") for _ in range(2000)).encode()
    bounds = np.array([0, 700, 700, 2000])
    runs = suffix_dedup.runs_by_minimizer(data, bounds, 50)
    covered = sorted(x for s, c in zip(runs[0], runs[1], strict=True) for x in range(s, s + c))
    assert covered == [*range(0, 651), *range(700, 1951)]


def test_replacing_keeps_columns_and_whole_characters(spark, odd_docs, odd_rows):
    done = suffix_dedup.remove_repeats(odd_docs, replace=True)
    assert done.columns == odd_docs.columns and done.count() == len(odd_rows)
    assert {r["text"] for r in done.where("doc_id = 1").collect()} == {None}
    assert not any("�" in (r["text"] or "") for r in done.collect())


def test_names_that_clash(spark):
    done = suffix_dedup.remove_repeats(spark.createDataFrame([(1, "a", 2, "b")], "doc_id long, text string, Removed int, kept_bytes string"))
    assert done.columns == ["doc_id", "text", "Removed", "kept_bytes", "removed_", "kept_bytes_"] and done.first()["kept_bytes_"] == b"a"


def test_messages_grow_with_the_text():
    for total in (0, 10**8, 10**11, 10**14):
        block, shard = suffix_dedup.sizes(total)
        assert block >= suffix_dedup.BLOCK and shard >= suffix_dedup.SHARD
        assert (total / block) * (total / shard) <= 1.01 * total / suffix_dedup.MESSAGE + 1


@pytest.mark.parametrize("work", [1, 2000, 1 << 20])
def test_ranges_of_a_shard(some_docs, work, monkeypatch):
    """One range at a time, some, or all: the same strings go."""
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in some_docs.collect()][:60]
    data, bounds = b"".join(t for _, t in docs), np.cumsum([0] + [len(t) for _, t in docs])
    block = suffix_dedup.Block.__new__(suffix_dedup.Block)
    block.data, block.bounds, block.ids = data, bounds, np.array([i for i, _ in docs])
    states = {s: np.ones(len(p), np.uint8) for s, p, *_ in suffix_dedup._fingerprints(block, 2, 50)[0]}
    messages = list(suffix_dedup._pieces(block, states, 2, 50))
    found = lambda: sorted((a, b) for _, m in messages for _, blob in suffix_dedup._removed([(0, m)], 50) for a, b in zip(*(x.tolist() for x in suffix_dedup._unzip(blob, "<u4", "<u4")), strict=True))
    want = {x for a, n in found() for x in range(a, a + n)}
    monkeypatch.setattr(suffix_dedup, "WORK", work)
    assert want and {x for a, n in found() for x in range(a, a + n)} == want


def test_one_passage_in_every_block(spark):
    """Whatever surrounds it, and with each way to treat a hot minimizer; shards stay small."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, f"{word()} {word()} {passage} {word()} {word()}" if i % 3 else passage) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (0, 50, suffix_dedup.HOT):
        compare(docs, hot=hot, block_bytes=1500, shard_bytes=4000)
