import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names the operators use themselves.
CLASHING = ["id", "h", "key", "node", "root", "words", "score", "count", "label_id", "gone_id", "taken_id", "quality_score", "trusted_id", "is_clean", "unit_id", "body", "line"]


class Prose:
    """Invented words, the same for the same seed."""

    def __init__(self, seed, size=400):
        self.rng = random.Random(seed)
        self.words = ["".join(self.rng.choices("abcdefghijklmnoprstuvwz", k=self.rng.randint(2, 9))) for _ in range(size)]

    def text(self, n):
        return " ".join(self.rng.choices(self.words, k=n))

    def edited(self, text, share):
        return " ".join(self.rng.choice(self.words) if self.rng.random() < share else w for w in text.split())


@pytest.fixture
def prose():
    return Prose(11)


@pytest.fixture
def documents(spark):
    def make(rows, schema="doc_id bigint, text string", clashing=False):
        df = spark.createDataFrame(rows, schema)
        if clashing:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(c) for c in CLASHING})
        return df

    return make


@pytest.fixture
def full(documents):
    """Documents with all columns, from (doc_id, text) or (doc_id, text, source)."""

    def make(rows, clashing=False):
        return documents([(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows], SCHEMA, clashing)

    return make


@pytest.fixture
def odd(prose):
    """Nulls, empty and blank texts, a very long one, repeated rows."""
    long = prose.text(30_000)
    return [(None, None), (None, "some words"), (1, None), (2, ""), (3, " \n\t "), (4, "..."), (5, long), (5, long), (6, "a"), (6, "a"), (7, "a")]
