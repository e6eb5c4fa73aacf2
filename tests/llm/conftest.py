import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (2, "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "two words"),
    (7, "two words"),
    (7, "two words"),
    (None, "two words"),
    (None, None),
    (8, LONG),
    (9, LONG + " end"),
    (10, "é😀 naïve café – «quoted» text\u00a0with odd\u2003spaces and many more words in it"),
    (11, "x"),
    (11, "another text under the same id as the one before it"),
    (None, "text without any id but with enough words to have shingles of its own"),
]
EXTRA = ("lang", "source", "n_chars", "sig", "label", "row", "bucket", "chunk", "h", "_base", "component_id", "score")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, and extra columns under names that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(1) if c == "n_chars" else F.lit("x") for c in EXTRA})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def sort(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
