import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of (doc_id, text, lang, source), with columns whose names operators use themselves."""

    def make(rows, extra=False):
        full = [(*(tuple(r) + (None,) * 4)[:4], None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", *(f"'x' AS {c}" for c in ("row", "node", "k", "t", "piece", "digest", "_digest", "dropped", "size", "item", "word")) if extra else ())

    return make


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


ODD = [None, "", "   ", "\n\n", "x", "a b", "A  b\tc\x0bd e f", "é à ü ñ 漢字", "long " * 30000, "  nbsp", "🙂 emoji 🙂", "a\x00b c"]


@pytest.fixture(scope="session")
def odd():
    """(doc_id, text, lang, source): null keys, repeated rows, odd texts."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None) for i, t in enumerate(ODD)]
    return [*rows, rows[4], rows[4], (None, "x y z", None, None), (None, None, None, None), (None, "x y z", None, None)]


@pytest.fixture
def rng():
    return random.Random(7)
