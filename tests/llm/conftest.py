import hashlib

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text[, lang, source]) rows; more columns by keyword, alike in all rows."""
    from pyspark.sql import functions as F

    from tunewright.llm.common import ship

    ship(spark)

    def build(rows, **more):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name, value in more.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return build


@pytest.fixture(scope="session")
def sha():
    return lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()
