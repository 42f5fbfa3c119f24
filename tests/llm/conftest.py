import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Fingerprint string, __found string"
#: Extra columns whose names are those of internal or result columns.
EXTRA = ("mine", "mine")


@pytest.fixture(scope="session")
def documents(spark):
    """documents from texts: ids 0, 1, .. with extra columns; {id: text} or a list of (id, text) for other ids."""

    def make(texts, langs=None):
        pairs = list(texts.items()) if isinstance(texts, dict) else texts if texts and isinstance(texts[0], tuple) else list(enumerate(texts))
        rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t) if t is not None else None, *EXTRA) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make
