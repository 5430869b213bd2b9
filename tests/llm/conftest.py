import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, clashing column names."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [
        (1, base, "en"),
        (1, base, "en"),
        (2, base, None),
        (3, None, "en"),
        (4, "", "de"),
        (5, " \t\n ", "de"),
        (None, base, "en"),
        (None, None, None),
        (6, LONG, "en"),
        (7, "é 12345 ü", "de"),
        (8, "x", "de"),
    ]
    df = spark.createDataFrame([(i, t, g, 0, "k", 1.0) for i, t, g in rows], "doc_id long, text string, lang string, mark int, found string, base double")
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts():
    """doc_id and text of the smallest table."""
    import duckdb

    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
