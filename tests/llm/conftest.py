import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, held_out boolean, score string, id long, node long"


def words(rng, n, stems=("ba", "ke", "lo", "mi", "tu", "sha")):
    return ["".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    base = " ".join(words(rng, 120))
    texts = [None, "", " ", "\n\t ", "x", "Ärger überall 日本語 テキスト", base, base, base.upper(), base + " tail", base.replace("ba", "bo", 1), "a  b\n\nc <|endoftext|> d", " ".join(words(rng, 30_000))]
    rows = [(k, t, rng.choice(["en", "de", None]), "s", len(t or ""), True, "z", 1, 2) for k, t in enumerate(texts)]
    return [*rows, rows[6], (None, base, None, None, None, None, None, None, None), (6, "another text of document six here", "en", "s", 1, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
