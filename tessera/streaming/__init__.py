"""Streams over relations.

The engine's query surface is batch only; a relation that arrives as files can be read as a stream and appended to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.schema import Schema


def read_stream(spark: SparkSession, schema: Schema, path: str) -> DataFrame:
    """The Parquet files of a folder, as they arrive."""
    return spark.readStream.schema(schema.struct()).parquet(path)


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that has arrived to a folder of Parquet files, each row once, and ends."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
