import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, keep string, bucket string, cell string, found string, tokens string, hub string, slot string, h string, w string, `__gone` string"
FOX = "the quick brown fox jumps over the lazy dog and then the dog jumps over the quick brown fox again"
LONG = " ".join(f"word{i * 7919 % 10007} of{i}" for i in range(25_000))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns whose names clash."""
    more = tuple("x" for _ in range(11))
    rows = [
        (1, FOX, "en", "web", 90), (2, FOX, "en", "web", 90), (2, FOX, "en", "web", 90), (3, None, "en", "web", 0), (4, "", "de", "web", 0), (5, "", None, None, None),
        (None, FOX, "en", "web", 90), (6, LONG, "en", "books", len(LONG)), (7, LONG.replace("of777 ", "off "), None, "books", None), (8, "Ein kurzer Satz über nichts", None, None, None), (9, "   ", "en", "web", 3),
        (10, "é ü 漢字 🎉 zwölf Boxkämpfer jagen", "de", None, 30), (None, None, None, None, None),
    ]
    nothing = tuple(None for _ in range(11))
    return spark.createDataFrame([r + (nothing if i % 3 == 0 else more) for i, r in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
