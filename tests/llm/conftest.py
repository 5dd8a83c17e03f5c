import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, node long, n int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    prose = "the quick brown fox jumps over the lazy dog near a quiet river bank"
    texts = [
        (1, prose), (1, prose), (2, prose), (3, None), (4, ""), (5, " \n\t\n"), (None, prose),
        (6, prose + "\n" + prose), (7, prose.replace("quiet", "small") + "\nanother line with enough words in it"),
        (8, "w " * 60_000), (9, "one"), (10, "a b c"), (-11, "é " * 50), (12, "x" * 200_000),
        (13, " ".join(f"v{i}" for i in range(30_000))),
    ]
    rows = [(i, t, None, "s" if k % 3 else None, None, 7, 0.5, 3, 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame(
        [(i, i % 2, (i + 1) % 2, "x") for i in [*range(14), 1]] + [(None, 1, 1, "x"), (5, None, None, "x")],
        "doc_id long, quality int, toxic int, text string",
    )
