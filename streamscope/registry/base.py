"""Registration, and the roles the driver's tables play."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_SCHEMAS: dict[str, StructType] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def schema(self, name: str) -> StructType:
        """A table's schema, read from its footer once."""
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return _SCHEMAS[path]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """stream/peer = user_id, order = event_id, bytes or clock = cents, small counter = k."""
        return self.read("events").select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "user_id",
            "event_type",
            F.round(F.col("value") * 100).cast("bigint").alias("cents"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )

    @cached_property
    def lineitem(self) -> DataFrame:
        """Deliveries: piece, chunk, peer, nbytes, header, arrival time."""
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("piece"),
            F.col("l_linenumber").cast("bigint").alias("chunk"),
            F.col("l_suppkey").alias("peer"),
            F.col("l_quantity").cast("bigint").alias("nbytes"),
            F.round(F.col("l_tax") * 100).cast("bigint").alias("header"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.col("l_partkey").alias("part"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders")

    @cached_property
    def part(self) -> DataFrame:
        return self.read("part")

    @cached_property
    def windows(self) -> DataFrame:
        """Peer windows: peer, stream, min_piece, max_piece, position, unchoked."""
        return self.part.select(
            F.col("p_partkey").alias("peer"),
            F.col("p_partkey").alias("min_piece"),
            (F.col("p_partkey") + F.col("p_size")).alias("max_piece"),
            (F.col("p_partkey") + F.expr("p_size div 2")).alias("position"),
            (F.col("p_brand") != "Brand#1").alias("unchoked"),
            F.lit("live").alias("stream"),
        )


# The same roles for the checking SQL.
EV = """ev AS (SELECT event_id, ts, user_id, event_type,
  CAST(round(value * 100) AS BIGINT) AS cents,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
LI = """li AS (SELECT l_orderkey AS piece, CAST(l_linenumber AS BIGINT) AS chunk, l_suppkey AS peer,
  CAST(l_quantity AS BIGINT) AS nbytes, CAST(round(l_tax * 100) AS BIGINT) AS header,
  l_shipdate AS ts, l_partkey AS part, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem)"""
WN = """wn AS (SELECT p_partkey AS peer, p_partkey AS min_piece, p_partkey + p_size AS max_piece,
  p_partkey + p_size // 2 AS position, p_brand <> 'Brand#1' AS unchoked, 'live' AS stream
  FROM part)"""


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return build

    return register


def plain_time(*names: str):
    """Columns back to zone-less timestamps, as the tables hold them."""
    return {n: F.col(n).cast("timestamp_ntz") for n in names}
