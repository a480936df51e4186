import base64
import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from extractspark.llm import bpe, packing
from extractspark.llm.common import segments

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 7, 1000):
        keys = [f"k{i}".encode() for i in range(n)]
        table = bpe.PerfectHash(keys)
        assert [table.find(k) for k in keys] == list(range(n))
        assert sorted(table.values) == list(range(n))
        assert table.find(b"other") == -1


def test_bpe_equals_the_library(spark, odd_docs, odd_rows, some_docs, reference):
    for docs in (odd_docs, some_docs):
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(docs, RANKS, P.PATTERN, with_ids=False).collect())
        expected = []
        for r in docs.select("doc_id", "text").collect():
            ids = np.array(reference.encode_ordinary(r["text"] or ""), "<u4")
            expected.append((r["doc_id"] if r["doc_id"] is not None else -1, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        assert got == sorted(expected)


def test_bpe_of_random_text(reference):
    code, rng = bpe.encoder(RANKS, P.PATTERN), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab '\n\t.9é́ \x1c日🎉x") for _ in range(rng.randrange(80)))
        ids = np.frombuffer(code.encode(text), "<u4").tolist()
        assert ids == reference.encode_ordinary(text)
        assert code.decode(code.encode(text)) == text.encode()


def test_decode_gives_the_texts(spark, some_docs):
    encoded = bpe.encode(some_docs, RANKS, P.PATTERN)
    assert bpe.decode(encoded, RANKS, P.PATTERN).exceptAll(some_docs.select("doc_id", "text")).isEmpty()


def test_segments_join_and_start_at_lone_spaces():
    text = "ab  cd e " * 50 + "x" * 40
    parts = list(segments(text, 16))
    assert "".join(parts) == text
    assert all(p[0] == " " and not p[1].isspace() for p in parts[1:])


def test_empty_tables(no_docs):
    assert bpe.encode(no_docs, RANKS, P.PATTERN).count() == 0
    assert packing.pack(no_docs, WORDS).count() == 0


def check_packing(rows, docs, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want.append((r["doc_id"] if r["doc_id"] is not None else -1, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(held))
        assert held[-1][0] + held[-1][1] <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_holds_every_piece_once(spark, odd_docs, some_docs, capacity):
    for docs in (odd_docs, some_docs):
        rows = packing.pack(docs, WORDS, capacity).collect()
        used = check_packing(rows, docs, capacity)
        total = sum(r["length"] for r in rows)
        assert used <= -(-total // capacity) * 1.25 + 2


def test_tokenizers_of_another_kind(tmp_path):
    """Without lower case, or with spaces as part of tokens: whole texts are encoded, not words."""
    import json

    from tokenizers import Tokenizer

    own = json.loads(open(WORDS, encoding="utf-8").read())
    assert packing.Words(WORDS).by_word
    for k, change in enumerate((lambda c: c["normalizer"]["normalizers"].pop(), lambda c: c.update(normalizer=None), lambda c: c["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"))):
        other = json.loads(json.dumps(own))
        change(other)
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(other))
        words, whole = packing.Words(str(path)), Tokenizer.from_file(str(path))
        assert not words.by_word
        for text in ("", "Some Text, don't  it?\n New", "É é 日本 12"):
            assert words.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def best(lengths: tuple[int, ...], capacity: int) -> int:
    """Fewest bins, by trying all."""
    found = [len(lengths)]

    def go(i: int, rooms: list[int]) -> None:
        if len(rooms) >= found[0]:
            return
        if i == len(lengths):
            found[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return found[0]


def test_reduction_fixes_only_what_some_best_packing_has():
    rng = random.Random(11)
    for _ in range(300):
        capacity = rng.randint(5, 14)
        lengths = tuple(sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True))
        counts = [lengths.count(w) for w in range(capacity + 1)]
        fixed = packing.reduce_by_dominance(counts, capacity)
        rest = tuple(w for w in range(capacity, 0, -1) for _ in range(counts[w]))
        assert sum(n for _, n in fixed) + best(rest, capacity) == best(lengths, capacity)
        assert sorted([*rest, *(w for held, n in fixed for w in held * n)], reverse=True) == list(lengths)


def test_plan_covers_each_rank_once():
    rng = random.Random(2)
    counts = [0] + [rng.randint(0, 30) for _ in range(64)]
    slots, figures = packing.plan(counts, 64)
    for w in range(1, 65):
        ranges = sorted((low, high) for length, low, high, *_ in slots if length == w)
        assert [x for r in ranges for x in range(*r)] == list(range(counts[w]))
    assert figures["least"] <= figures["sequences"] <= figures["least"] * 1.1 + 1
