"""The pipeline's stages against brute force on the small tables, and against rows of every odd kind."""

import corpus_pipeline as pipeline
from extractspark.llm import pii
from extractspark.llm.common import written
from test_bpe_and_packing import check_packing
from test_minhash import brute as brute_near
from test_quality import brute as brute_quality
from test_suffix import brute_kept


FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "suffix_array", "pii", "packing"]


def test_each_stage_on_its_input(spark, some_docs):
    docs = some_docs.select(*pipeline.COLUMNS)
    kept = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, FOLDER), "test")
        kept[name] = docs
        rows = {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "packing":
            check_packing(docs.collect(), before, 2048)
            continue
        assert docs.columns == pipeline.COLUMNS
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if name != "quality" and name != "near_duplicates")
        if name == "quality":
            assert after.items() <= rows.items() and not any(brute_quality(t)[-1] for t in after.values())
        elif name == "near_duplicates":
            assert after.keys() == {i for i, *_, keep in brute_near(list(rows.items())) if keep}
        elif name == "suffix_array":
            assert after == {i: t for i, t in left(list(rows.items()))}
        else:
            made = pii.surrogates(pipeline.PII_KEY)
            assert after == {i: pii.replace(t, made)[0] for i, t in rows.items()}


def left(rows):
    """What the cutting stage leaves of each text: without the bytes of characters that lost a part."""
    return [(i, None if t is None else kept.decode("utf-8", "ignore")) for (_, t), (i, _, kept, *_) in zip(rows, brute_kept(rows, 50), strict=True)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_each_stage_on_odd_rows(spark, odd_docs):
    """Nulls, empty and long texts, copies, repeated rows and ids, further columns: each stage on all of them."""
    source = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd_docs.collect()]
    pairs = [(i, t) for i, t, *_ in source]
    for name, stage in pipeline.STAGES:
        done = stage(spark, odd_docs, FOLDER)
        if name == "packing":
            check_packing(done.collect(), odd_docs, 2048)
            continue
        assert done.columns == pipeline.COLUMNS
        got = [tuple(r) for r in done.collect()]
        if name == "quality":
            assert got and all(not brute_quality(t)[-1] and (i, t, lang, s) in source for i, t, lang, s, _ in got)
        elif name == "near_duplicates":
            gone = {i for i, *_, keep in brute_near(pairs) if i is not None and not keep}
            assert ordered(r[:4] for r in got) == ordered(r for r in source if r[0] not in gone)
        elif name == "suffix_array":
            assert ordered(r[:2] for r in got) == ordered(left(pairs)) and all(n == (None if t is None else len(t)) for _, t, _, _, n in got)
        else:
            made = pii.surrogates(pipeline.PII_KEY)
            assert ordered(r[:2] for r in got) == ordered((i, None if t is None else pii.replace(t, made)[0]) for i, t in pairs)


def test_no_rows(spark, no_docs):
    docs = no_docs
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), "test")
        assert docs.count() == 0
    assert set(docs.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_run(spark):
    import os

    folder = f"{spark.conf.get('spark.checkpoint.dir')}/extractspark"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = pipeline.run(spark, FOLDER)
    assert rows.count() > 0
    # What the stages wrote on their way is gone, and so are the stages before the last two.
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"stage-packing"}
