import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, m string, hits string, kept string, ids string, key string, data string, spans string"


def rows(texts, first=0):
    return [(i, t, "en", f"s{i % 3}", len(t or ""), "m", "h", "k", "i", "key", "d", "s") for i, t in enumerate(texts, first)]


def prose(n, seed, words=None):
    rng = random.Random(seed)
    pool = words or [f"{a}{b}" for a in ("ba", "ti", "ron", "el", "us") for b in ("ka", "mo", "li", "then", "der", "s")]
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and
    extra columns whose names the operators use inside."""
    shared = prose(80, 1)
    texts = [None, "", " ", "one", prose(300, 2), prose(300, 2), prose(30_000, 3), shared + " " + prose(50, 4), prose(40, 5) + "\n" + shared, "é漢字 " * 50, "x" * 5000, "a\n" * 200, "\0\t\r\n", prose(120, 6) + "."]
    data = rows(texts)
    data += [data[4], data[4]]  # repeated rows
    data.append((None,) * 12)
    data.append((None, prose(300, 2), None, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
