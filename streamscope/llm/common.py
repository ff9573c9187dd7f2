"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.durable import fresh_path

# Words are maximal runs of anything but these six ASCII separators (Java and RE2 syntax).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


_scopes: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the paths of the tables that `written` makes inside."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that no frame still in use reads."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once below the folder that all executors share, and read from there.

    Cuts lineage, makes generated ids final, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """The rows with all their columns in one struct `doc`, so that no name of theirs can meet one
    that an operator adds; `select("doc.*")` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def met(rows: DataFrame, groups: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows joined with a summary that has one row for each key.

    The summary is written first: a join of two plain tables is one that Spark splits when a key
    holds very many rows, which it can't do if the other side is still being aggregated.
    """
    return rows.join(written(groups, label), keys)


def words_of(text: Column) -> Column:
    """All words of a text in order; of a null text none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
