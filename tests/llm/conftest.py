import pytest

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(12_000))
# clashing names: columns that operators use inside
EXTRA = "id long, row string, n int, size int, line int, node string, root string, lang string, kept string"


def extra(lang="en"):
    return (7, "r", 1, 2, 3, "node", "root", lang, "kept")


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    base = "The quick brown fox jumps over the lazy dog and runs away. " * 3
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, base), (5, base), (6, base.replace(" ", "  ")),
        (7, base.upper()), (8, "one"), (8, "one"), (9, LONG), (10, LONG + " x"), (None, base),
        (None, None), (11, "12 34 !!"), (12, "a\x0bb\x0cc d"), (13, "Ünïcode 日本 🙂 text"), (14, "one"),
    ]
    data = [(i, t, *extra()) for i, t in rows] + [(15, base, *([None] * 9)), (4, base, *extra())]
    return spark.createDataFrame(data, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def small(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")

