import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with a column that clashes with internal names."""

    def make(rows):
        from pyspark.sql import functions as F

        full = [(*r, *(None,) * (4 - len(r)), None)[:5] for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.withColumns({c: F.lit("x") for c in ("rank", "size", "bucket", "before", "text_sha256", "row_key", "fp")})

    return make
