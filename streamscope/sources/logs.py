"""Operational logs: ``HH:MM:SS.mmm [tag] message``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value.
LINE = r"^([0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}) \[([^\]]+)\] (.*)$"


def oplog_from(df: DataFrame, line: str) -> DataFrame:
    """Add ``time``, ``tag`` and ``message``; a line of another shape keeps nulls and its text."""
    fits = F.col(line).rlike(LINE)
    return df.withColumns(
        {
            "time": F.when(fits, F.regexp_extract(line, LINE, 1)),
            "tag": F.when(fits, F.regexp_extract(line, LINE, 2)),
            "message": F.when(fits, F.regexp_extract(line, LINE, 3)).otherwise(F.col(line)),
        }
    )


def read_oplog(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    lines = reader.text(path).select("value", F.col("_metadata.file_name").alias("node"))
    return oplog_from(lines, "value").drop("value")
