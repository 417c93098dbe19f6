import pytest


@pytest.fixture(autouse=True)
def prepared(spark):
    from quarry.llm.common import prepare

    prepare(spark)


@pytest.fixture
def frame(spark):
    """A frame of documents (doc_id, text) with columns whose names clash with results."""

    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(7) for c in ("fp", "kept", "score", "shard", "component_id", "text_hash", "prediction", "held", "word")})

    return make
