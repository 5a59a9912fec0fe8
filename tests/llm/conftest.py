import pytest


@pytest.fixture
def documents(spark):
    """A documents frame from (doc_id, text) or (doc_id, text, source) rows, with an extra column."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or ""), {"k": "v"}) for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, extra map<string,string>"
        )

    return make


@pytest.fixture(autouse=True)
def _nothing_stays_cached(spark):
    yield
    spark.catalog.clearCache()
