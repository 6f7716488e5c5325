import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Rows to a documents table with columns that clash with the operators' own names."""

    def make(rows, **extra):
        full = [(i, t, *r, *["en", "src0", None][len(r) :]) for i, t, *r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df

    return make


def rows_by(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out
