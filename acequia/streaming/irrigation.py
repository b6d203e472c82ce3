"""The daily irrigation projection on a stream of climate files.

The formulas are stateless columns, so the batch projection is used as it is;
each arriving file is converted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from acequia.functions.agronomy import DEFAULT, with_irrigation
from acequia.operators.calendar import nan_to_null
from acequia.schema import CLIMATE_SCHEMA, CropParams


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Climate rows from Parquet files as they arrive in a folder."""
    return nan_to_null(spark.readStream.schema(CLIMATE_SCHEMA).parquet(folder))


def write_irrigation(
    rows: DataFrame, folder: str, checkpoint: str, crop: CropParams = DEFAULT
) -> StreamingQuery:
    """Append irrigation rows to Parquet, once for everything that has arrived."""
    return (
        with_irrigation(rows, crop)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(folder)
    )
