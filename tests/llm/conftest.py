import pytest


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    """A place for small tables."""
    return tmp_path_factory.mktemp("llm")


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table of (doc_id, text[, source])."""
    def make(rows, extra=""):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + extra
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *r[3:]) for r in rows]
        return spark.createDataFrame(full, schema)
    return make
