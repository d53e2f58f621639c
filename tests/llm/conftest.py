import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from texts, with columns whose names clash with the operators' own."""

    def make(texts, sources=None, ids=None):
        rows = [(i if ids is None else ids[k], t, "en", "s" if sources is None else sources[k], -1, "x", 7) for k, (i, t) in enumerate(zip(range(len(texts)), texts, strict=True))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, size int")

    return make
