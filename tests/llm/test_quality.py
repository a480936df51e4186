import math
import random
import re
import unicodedata
from collections import Counter

import duckdb
import pytest
from extractspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.fixture(scope="module")
def references(some_docs, labels):
    return quality.fit(some_docs, labels, least=3)


def test_counts_against_brute_force(spark, odd_docs, some_docs, references):
    for docs in (odd_docs, some_docs):
        key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
        want = sorted((key(r), brute(r["text"])) for r in docs.select("doc_id", "text").collect())
        rows = quality.score(docs, references).collect()
        assert sorted((key(r), tuple(r[c] for c in COUNTS)) for r in rows) == want
        assert not any(r["kept"] and r["base_failed"] for r in rows)


@pytest.mark.parametrize("bits", [26, 60])
@pytest.mark.parametrize("text", ["a b c a b c", "x " * 9, "a b a b a b a", "p q r s p q r t p q r", "\na b c\n a b c \n", "a b c d " * 40 + "e f g " * 40])
def test_repeats(spark, text, bits, monkeypatch):
    """Also where the bits of a position leave too few to tell windows apart."""
    monkeypatch.setattr(quality, "PLACE_BITS", bits)
    row = quality.score(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), {}).first()
    assert tuple(row[c] for c in COUNTS) == brute(text)


def plain_distance(counts, shares):
    total = sum(counts)
    both = 0.0
    for n, q in zip(counts, shares, strict=True):
        p = n / total
        both += (p * math.log2(2 * p / (p + q)) if p else 0) + (q * math.log2(2 * q / (p + q)) if q else 0)
    return math.sqrt(max(0.0, both / 2))


def test_references_and_distances_against_brute_force(spark, some_docs, labels, references):
    docs = [r.asDict() for r in some_docs.collect()]
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    norm = lambda w: w.lower().rstrip(".,")

    def classes(t):
        kinds = [sum(map(str.islower, t)), sum(unicodedata.category(c) == "Lu" for c in t), sum(c in "0123456789" for c in t), sum(c in " \t\n\v\f\r" for c in t), sum(c in ".,;:!?'\"()-" for c in t)]
        kinds[0] = sum(unicodedata.category(c) == "Ll" for c in t)
        return [*kinds, len(t) - sum(kinds)]

    for lang, ref in references.items():
        mine = [d["text"] for d in docs if d["doc_id"] in good and lang in ("", d["lang"])]
        total = [sum(c) for c in zip(*map(classes, mine), strict=True)]
        assert ref.classes == pytest.approx([c / sum(total) for c in total])
        if lang:
            words = Counter(norm(w) for t in mine for w in WORD.findall(t))
            n = words.total()
            del words[""]
            top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]
            assert ref.words == tuple(w for w, _ in top) and ref.shares == pytest.approx([k / n for _, k in top])
    by = {d["doc_id"]: d for d in docs}
    for r in quality.score(some_docs, references).collect():
        d = by[r["doc_id"]]
        ref, words = references[d["lang"]], Counter(norm(w) for w in WORD.findall(d["text"]))
        each = [words[w] for w in ref.words]
        assert r["class_distance"] == pytest.approx(plain_distance(classes(d["text"]), ref.classes), abs=2e-6)
        assert r["common_distance"] == pytest.approx(plain_distance([*each, words.total() - sum(each)], [*ref.shares, 1 - sum(ref.shares)]), abs=2e-6)
        assert r["kept"] == (not r["base_failed"] and (len(d["text"]) < quality.MIN_CHARS or r["class_distance"] + r["common_distance"] <= quality.MAX_BOTH + 1e-6))


def test_sql_gives_the_same_rows(spark, some_docs, labels):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    rows = quality.score(some_docs, quality.fit(some_docs, labels))
    sql = f"select {', '.join(rows.columns)} from ({quality.score_sql()})"
    assert sorted(tuple(r) for r in rows.collect()) == sorted(con.sql(sql).fetchall())
    con.execute("drop view labels")
    con.execute("create view labels as select 1 as doc_id, 0 as quality")  # none is good: of all documents
    rows = quality.score(some_docs, quality.fit(some_docs, labels.where("quality = 0")))
    assert sorted(tuple(r) for r in rows.collect()) == sorted(con.sql(sql).fetchall())


def test_distance_is_zero_for_equal_and_one_for_disjoint(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    counts = lambda *x: F.array(*[F.lit(v).cast("bigint") for v in x])
    shares = lambda *x: F.array(*map(F.lit, x))
    got = one.select(quality.distance(counts(10, 30), shares(0.25, 0.75)), quality.distance(counts(5, 0), shares(0.0, 1.0)), quality.distance(counts(0, 0), shares(0.5, 0.5))).first()
    assert got[0] == pytest.approx(0) and got[1] == pytest.approx(1, abs=1e-4) and got[2] == 0


def test_filter_keeps_columns_and_clean_documents(spark, odd_docs, no_docs, some_docs, labels, references):
    assert quality.filter_kept(odd_docs, references).columns == odd_docs.columns
    assert quality.fit(no_docs) == {} and quality.filter_kept(no_docs, {}).count() == 0 and quality.score(no_docs, references).count() == 0
    kept = {r["doc_id"] for r in quality.score(some_docs, references).where("kept").collect()}
    assert {r["doc_id"] for r in quality.filter_kept(some_docs, references).collect()} == kept
    plain = {r["doc_id"] for r in quality.score(some_docs, references).where("not base_failed").collect()}
    good, bad = ({r["doc_id"] for r in labels.where(f"quality = {q}").collect()} for q in (1, 0))
    assert len(good & plain - kept) <= 0.02 * len(good) and len(bad & kept) <= 0.1 * len(bad)


def test_short_junk_and_other_languages(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    references = quality.fit(docs, labels)
    assert set(references) == {"", "de", "en", "es", "fr"}
    counts = {(r["quality"], r["kept"]): r["n"] for r in quality.score(docs, references).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().withColumnRenamed("count", "n").collect()}
    assert counts.get((1, False), 0) <= 0.005 * counts[1, True] and counts.get((0, True), 0) <= 0.05 * counts[0, False]
    text = docs.join(labels.where("quality = 1"), "doc_id").where("lang = 'en' and length(text) > 1000").first()["text"]
    rng = random.Random(1)
    rows = [(1, text, "EN-us"), (2, text, "en_GB"), (3, text, None), (4, text, "x-klingon"), (5, text, "it"), (6, "$ # " * 10 + "| % & * " * 300, "it"), (7, " ".join("".join(rng.choice(["сло", "во", "де", "ло", "ка", "утро", "на"]) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", "", ",", "."]) for _ in range(300)), "ru")]
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), references).collect()}
    assert got[1]["common_distance"] == got[2]["common_distance"] > 0 and all(got[i]["common_distance"] == 0 for i in (3, 4, 5, 6, 7))
    assert all(got[i]["kept"] for i in (1, 2, 3, 4, 5, 7)) and not got[6]["kept"]


def test_plan_has_no_python(some_docs, references):
    plan = quality.score(some_docs, references)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
