import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, copies, and extra columns named like results."""
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w7 ", "other ")
    long = " ".join(f"x{i % 997}y{i // 997}" for i in range(20000))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "fr", None), (4, None, "en", "b"), (5, "", None, "b"),
        (6, "password: abcdef12 and MIT License here", "en", "b"), (7, long, "fr", "a"), (8, "one two", "en", "c"),
        (9, "head " + " ".join(base.split()[20:90]) + " tail", "fr", "c"), (8, "one two", "en", "c"), (None, "no id at all", None, None),
    ]
    return spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, lang string, source string, score double, size int")
