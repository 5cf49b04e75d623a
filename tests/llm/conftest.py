import datetime
import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice(["ba", "ko", "ri", "mu", "te", "la", "sho", "ñe"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    """prose(seed, n): n words of invented text with lines."""
    def make(seed, n):
        rng = random.Random(seed)
        return "".join(rng.choice(words) + ("\n" if rng.random() < 0.08 else " ") for _ in range(n)).strip()
    return make


@pytest.fixture(scope="session")
def docs(spark, prose):
    """Nulls, empty and blank texts, copies, near copies, repeated rows, a null id, a
    very long text, and extra columns whose names clash with operators' own."""
    base = [prose(k, 60 + 7 * k) for k in range(20)]
    near = base[3].split(" ")
    near[5] = "changed"
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100, base[2]), (101, base[2]), (102, " ".join(near)), (103, None), (104, ""), (105, " \t\n "), (106, "one two"),
             (107, "ONE two"), (108, "12 34 !! ##"), (109, prose(999, 30_000)), (7, base[7]), (7, base[8]), (None, base[9]),
             (110, "A b\tc\vd\fe\rf"), (111, "tail space "), (112, "x  y   z <|endoftext|> 'tis don't   ω≈ \U0001f600")]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "fr", f"s{(i or 0) % 2}", 0, "clash", 1.5, datetime.date(2020, 1, 1)) for i, t in rows],
                                 DOCS + ", text_hash string, score double, node date")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
