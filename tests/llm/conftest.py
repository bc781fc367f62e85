import pytest

#: Rows that every operator has to bear: nulls, empty, blank, repeated, long.
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, None, None, None, 0), (2, "", "en", "a", 0), (3, " \t\n\x0b\f\r ", None, "b", 7),
    (4, "The cat sat on the mat.", "en", "a", 1), (4, "The cat sat on the mat.", "en", "a", 1),
    (5, "Die Katze saß auf der Matte.", "de", None, 2), (None, "A text without an id.", "en", "a", 3),
    (None, None, None, None, None), (6, LONG, "en", "b", 4), (7, LONG, "en", "b", 5), (8, "12345 !!! ---", None, "c", 6),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns whose names the operators use for their own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, size long")
    clash = {c: "size" for c in ("n", "key", "bucket", "block", "rank", "row", "score", "kept", "copy", "part", "trusted",
                                 "window", "crc", "sid", "component", "of", "found", "words", "start", "length")}
    return df.withColumns({name: df[of] for name, of in clash.items()})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
