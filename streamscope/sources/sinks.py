"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_verdicts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Verdict rows as JSON lines, one object per row, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_lines(
    lines: DataFrame, stream: str, number: str, line: str, path: str, mode: str = "errorifexists"
) -> None:
    """Rendered playlists: a folder per stream holding its lines in order.

    Lines are range-partitioned by (stream, number), so a long playlist spans several files whose
    names sort in line order.
    """
    (
        lines.repartitionByRange(stream, number)
        .sortWithinPartitions(stream, number)
        .select(F.col(stream), F.col(line).alias("value"))
        .write.mode(mode)
        .partitionBy(stream)
        .text(path)
    )
