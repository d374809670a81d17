import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, fp string, size string, kept string, score string, batch string, shard string"
LONG = "the quick brown fox jumps over the lazy dog near the river bank today again " * 400


def rows():
    base = [
        (1, "Alpha beta  gamma\tdelta epsilon zeta eta theta", "en", "a"),
        (2, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, LONG, "en", "b"),
        (5, LONG, "en", "b"),  # a repeated row
        (6, LONG + "tail", "fr", "b"),
        (7, " \n\t ", "fr", ""),
        (None, "Alpha beta gamma delta epsilon zeta eta theta", "de", "c"),
        (8, "12 34 !!", "de", None),
        (9, 'x token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" and 4785380592391139 è ü', "de", "src/test.py"),
    ]
    return [(i, t, g, s, 0, "k", "f", "z", "q", "s", "b", "h") for i, t, g, s in base]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
