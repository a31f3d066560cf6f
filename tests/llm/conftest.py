import random

import pytest

WORDS = ["the", "of", "and", "in", "was", "river", "stone", "bridge", "water", "old", "Tree", "light", "paper", "winter", "green", "house"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, start int, shard string, node long, u int"


def row(i, text, lang="en", source="s0"):
    """A document with columns beside those of the table, some named like columns of results."""
    return (i, text, lang, source, len(text) if text is not None else None, "x", 1, "y", 2, 3)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ids and texts."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(40)]
    rows = [row(i, t, source=f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [row(100, None), row(101, ""), row(102, "   \n\t "), row(103, prose(rng, 30_000)), row(None, texts[0], None, None), row(None, None, None, None), row(104, "x" * 50_000)]
    rows += [rows[3], rows[3], row(5, "another text with the id five"), row(200, texts[7]), row(201, texts[7]), row(202, "日本語 🙂 ▁ <|endoftext|> </s> \x00 é́"), row(203, "123 456 ²½")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
