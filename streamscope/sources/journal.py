"""Tracker journals: one announce per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Counters are unsigned 64-bit numbers, and the largest `left` means unknown.
ANNOUNCE_SCHEMA = (
    "ts_unix bigint, src_ip string, announced_port int, infohash_hex string, peer_id_hex string, "
    "event string, downloaded decimal(20,0), left decimal(20,0), uploaded decimal(20,0)"
)
UNKNOWN_LEFT = "18446744073709551615"


def _known(df: DataFrame) -> DataFrame:
    known = F.col("left") != F.lit(UNKNOWN_LEFT).cast("decimal(20,0)")
    return df.withColumn("left_known", known)


def announces_from(df: DataFrame, raw: str) -> DataFrame:
    """Announces in a JSON text column."""
    keep = [c for c in df.columns if c != raw]
    parsed = df.select(*keep, F.from_json(raw, ANNOUNCE_SCHEMA).alias("a")).select(*keep, "a.*")
    return _known(parsed)


def read_announces(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Journal files, each a JSON array of announces, on a batch and on a stream."""
    reader = spark.readStream if stream else spark.read
    return _known(reader.schema(ANNOUNCE_SCHEMA).option("multiLine", True).json(path))
