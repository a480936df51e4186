import random

import pytest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, id long, key long, block long, rank long, length long, salt long, words string, kept_0 string, packed string, component long, shingle long, row string"


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls in any column, empty, blank, one-word and long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(5)
    long, base = _words(rng, 30_000), _words(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", "   \n\t ", "word", "one two three", base, base, " ".join(near), base.upper(), long, "x" * 50_000, "a\x00b \x1c c d　e 日本語 🎉", "é" * 60, _words(rng, 80) + " " + base, "tail " + long[1000:3000]]
    rows = [(i + 1, t, "en" if i % 3 else None, "s" if i % 2 else None, len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(None, base, "en", "s", 1), (None, None, None, None, None), rows[5], rows[5], (6, "another text of the same id", "de", None, 0)]
    return [(*r, i, i, i, i, i, i, i, "w", "k", "p", i, i, "r") for i, r in enumerate(rows)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, EXTRA).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
