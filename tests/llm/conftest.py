import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture()
def docs(spark):
    """Rows (doc_id, text[, lang, source]) as a table of documents, in two partitions."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(2)
        if extra:  # names that operators use inside
            for c in ("node", "label", "key", "n", "part", "ids", "_w", "bucket", "first", "start"):
                df = df.withColumn(c, df.text)
        return df

    return make


@pytest.fixture(scope="session")
def words():
    import random

    rng = random.Random(7)
    return lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
