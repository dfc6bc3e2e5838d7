import pytest

from plumbline.llm.common import prepare

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Table of documents from (doc_id, text[, lang]) rows, with columns that clash with results."""
    prepare(spark)

    def make(rows, schema=DOCS):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        names = "kept string, score string, n_words string, spans string, items string, _x string"
        table = spark.createDataFrame([(*r, *(["?"] * 6)) for r in full], f"{schema}, {names}")
        return table

    return make
