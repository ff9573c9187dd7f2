"""Range joins as equi-joins on buckets whose number per interval is bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# An interval is filed under the finest level at which it spans fewer than this many buckets.
SPAN = 8
LEVELS = 9


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    point: str,
    low: str,
    high: str,
    bucket: int = 512,
) -> DataFrame:
    """Pairs with ``low <= point <= high`` and equal ``keys``.

    Level L has buckets of ``bucket * 8**L``.  However wide an interval claims to be it becomes at
    most nine rows, and a point becomes one row per level in use (mostly one).  The join key holds
    the bucket, so a stream with most of the points spreads over its buckets, and adaptive skew
    handling splits a bucket that many intervals share.
    """
    usable = intervals.filter(F.col(low) <= F.col(high))
    level = F.lit(LEVELS - 1)
    for n in reversed(range(LEVELS - 1)):
        level = F.when(F.col(high) - F.col(low) < bucket * SPAN ** (n + 1), n).otherwise(level)
    usable = usable.withColumn("__level", level)
    used = sorted(r[0] for r in usable.select("__level").distinct().collect())
    if not used:
        used = [0]
    width = F.expr(f"shiftleft({bucket}L, 3 * __level)")  # bucket * 8**level
    filed = usable.withColumn("__width", width).withColumn(
        "__bucket",
        F.explode(
            F.sequence(F.expr(f"{low} div __width"), F.expr(f"{high} div __width"))
        ),
    )
    placed = (
        points.withColumn("__level", F.explode(F.array(*[F.lit(n) for n in used])))
        .withColumn("__width", width)
        .withColumn("__bucket", F.expr(f"{point} div __width"))
    )
    inside = F.col(point).between(F.col(low), F.col(high))
    return (
        placed.drop("__width")
        .join(filed.drop("__width"), [*keys, "__level", "__bucket"])
        .filter(inside)
        .drop("__level", "__bucket")
    )
