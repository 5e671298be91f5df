"""As many tasks as a counted number of rows needs, so that the memory of one does not grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Short rows that one task hashes or sorts: some hundred MB.
ROWS = 1_500_000


def parts(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, dealt by the keys to the tasks that so many rows need. Their number is given, so that Spark does not merge them to fewer."""
    return df.repartition(parts(df.sparkSession, rows), *keys)


def distinct(df: DataFrame, rows: int) -> DataFrame:
    """Distinct rows of df, which has about so many. They are dealt first: a map-side step would hash a whole part of the scan, mostly for nothing."""
    return dealt(df, rows, *df.columns).distinct()
