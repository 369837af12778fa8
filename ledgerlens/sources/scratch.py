"""Tables in the shared checkpoint folder: intermediate results that are read
more than once, or whose lineage is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back: computed once,
    and whole though executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
