"""Positions in a global order, without gathering the rows anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

_LOCAL = (1 << 33) - 1


def blocks_for(df: DataFrame, factor: int = 8) -> int:
    """Bits of a hash that give at least `factor` blocks for each shuffle partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, (parts * factor - 1).bit_length())


def numbered(df: DataFrame, *order: Column, name: str, label: str) -> DataFrame:
    """The rows with a number from 0 in column `name`, along `order`.

    Range partitions are sorted and written; a row's number is its place in its partition plus the
    rows of the partitions before. That table has one row per partition, whatever the data.
    """
    at = F.monotonically_increasing_id()
    rows = written(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"__part": F.shiftright(at, 33), "__at": at.bitwiseAND(F.lit(_LOCAL))}),
        label,
    )
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")
    )
    return rows.join(F.broadcast(base), "__part").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("__base") + F.col("__at")).alias(name)
    )
