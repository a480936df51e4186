import random
import re

import numpy as np
from extractspark.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """(doc_id, n, component, kept) of every row, by comparing all with all."""
    sets = [(i, shingles(t)) for i, t in rows]
    least = list(range(len(rows)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is not None and j is not None and s and t and (i == j or 100 * len(s & t) >= 75 * len(s | t)):
                least[max(find(a), find(b))] = min(find(a), find(b))
    ids: dict[int, int] = {}
    for a, (i, s) in enumerate(sets):
        if i is not None and s:
            ids[find(a)] = min(ids.get(find(a), i), i)
    out = []
    for a, (i, s) in enumerate(sets):
        component = None if i is None else ids[find(a)] if s else i
        out.append((i, len(s), component, i is None or i == component))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def compare(docs):
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = [tuple(r) for r in minhash.near_duplicates(docs).collect()]
    assert order(got) == order(want)


def test_odd_rows(odd_docs, no_docs):
    compare(odd_docs)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_documents(some_docs):
    compare(some_docs)


def test_group_around_a_lead_and_a_common_passage(spark):
    """Variants at all distances from one text, so that many aren't linked with the lead, and texts that share a passage."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(140)], [word() for _ in range(60)]
    rows = [(1, " ".join(base))]
    for i in range(2, 160):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = word()
        if i % 7 == 0:
            w += passage
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join([*(word() for _ in range(rng.randint(5, 70))), *passage])) for i in range(200, 260)]
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_chain_of_links(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[k * 4 : k * 4 + 60])) for k in range(40)]
    compare(spark.createDataFrame(rows, "doc_id long, text string"))


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    got = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 1400, dtype=np.uint64)
        s = minhash.signatures([np.unique(x[:1100]), np.unique(x[300:])])
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - 800 / 1400) < 0.02


def test_long_documents_are_signed_piece_by_piece():
    x = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 200_000, dtype=np.uint64))
    whole = minhash.signatures([x], 20)[0]
    halves = minhash.signatures([x[:60_000], x[60_000:]], 20)
    assert (whole == halves.min(axis=0)).all()


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    text = " ".join(f"word{i} Ünï" for i in range(500)) + " " + "y" * 700 + " end"
    whole = minhash.shingle_sets([text, "ab c", None])
    monkeypatch.setattr(minhash, "_SEGMENT", 1024)
    assert all((a == b).all() for a, b in zip(whole, minhash.shingle_sets([text, "ab c", None]), strict=True))
    assert len(whole[0]) == len(shingles(text))
