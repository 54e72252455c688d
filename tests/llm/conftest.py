import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples, with an extra column that the operators use inside."""

    def make(rows, extra=True):
        full = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOC)
        clash = ("copies", "size", "label", "digest", "key", "node", "n", "spans", "l", "k", "md5", "items", "score", "source_size")
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit("x") for c in clash}) if extra else df

    return make
