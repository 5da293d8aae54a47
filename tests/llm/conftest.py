import pytest

SF = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang, source]) rows."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1",
                 None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC)
    return make


@pytest.fixture
def real(spark):
    """The documents and labels of the small supplied tables."""
    return (spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
