import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture
def docs_of(spark):
    """A documents table from texts (numbered from 0) or from (id, text) pairs, over several partitions."""
    from mapframe.llm.common import ship

    ship(spark)

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, DOCS).repartition(3)
    return make


@pytest.fixture
def as_dicts():
    def read(df):
        return {r["doc_id"]: r.asDict(recursive=True) for r in df.collect()}
    return read
