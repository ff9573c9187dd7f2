"""Ranges of whole numbers as rows, without an array that holds a whole range."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Numbers in a block of the first, the second and the last step.
STEPS = (1 << 20, 1 << 10, 1)


def expand(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """One row per number from ``low`` to ``high``, both included; none if ``low`` is above.

    A range becomes blocks, and those smaller blocks, which are dealt out over the tasks before
    their numbers are written out: an array has at most range / 2 ** 20 or 1,024 entries.
    """
    rows = df.filter(F.col(low) <= F.col(high)).withColumns({"__a": F.col(low), "__b": F.col(high)})
    for step in STEPS:
        if step == 1:
            rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        start = F.explode(F.sequence("__a", "__b", F.lit(step).cast("bigint")))
        rows = rows.withColumn("__start", start).withColumns(
            {"__a": F.col("__start"), "__b": F.least(F.col("__start") + step - 1, F.col("__b"))}
        )
    return rows.withColumn(name, F.col("__a")).drop("__a", "__b", "__start")
