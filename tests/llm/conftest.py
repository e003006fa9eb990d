import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, marked string, row string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table, with extra columns that clash with names used inside, from (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "m", "r") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def sample():
    """The smallest driver table, if it is there."""
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no driver tables here")
    return path
