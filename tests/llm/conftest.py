import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """DataFrame of (id, text) pairs with the columns of ``documents``, or with
    extra columns whose names operators might use inside."""
    def _docs(pairs, extra: bool = False):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA)
        if extra:
            for name in ("_id", "_row", "_text", "_score", "_report", "_mask", "_n_words", "key",
                         "group", "node", "digest", "fp", "spans", "item_id", "start", "shard"):
                df = df.withColumn(name, df.doc_id)
        return df
    return _docs
