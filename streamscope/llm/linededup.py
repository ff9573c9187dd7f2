"""Repeated line runs across documents, by prefix doubling over sequences of line ids.

The suffixes of all documents' line sequences are ordered by classes: two positions have the same
class of level k if their next 2 ** k lines, within their documents, are equal. A level follows
from the one before by pairing the classes of a position and of the one 2 ** k lines on; positions
that share their class with no other drop out. A class is named by its first position, which is
also what decides which copy stays. Equal windows of any length m, the suffixes whose common
prefix has at least m lines, follow from two overlapping classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import met, packed, union_all, written
from .order import numbered

#: A run is removed if it has at least this many words.
MIN_WORDS = 50
#: Positions leave room for 2**27 lines of a document and 2**36 documents; beyond, the job fails.
_LINE_BITS = 27
_FLUSH = 200_000

_LINES = "__row long, line int, id1 long, id2 long, ahead int, behind int"


def _windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the number of lines from it on, and up to it, that reach `least` words."""
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(len(words))
    ends = np.searchsorted(total, total[:-1] + least)
    ahead = np.where(ends <= len(words), ends - at, 0)
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    behind = np.where(total[1:] >= least, at - starts + 1, 0)
    return ahead, behind


def line_table(wide: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """One row per line: 128 bits of its content, and its shortest windows of enough words."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        names = ["__row", "line", "id1", "id2", "ahead", "behind"]
        held, size = [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                ids = np.frombuffer(b"".join(map(xxh3_128_digest, parts)), "<i8").reshape(-1, 2)
                words = np.fromiter((len(p.split()) for p in parts), np.int64, len(parts))
                ahead, behind = _windows(words, min_words)
                held.append((np.full(len(parts), row), np.arange(len(parts)), *ids.T, ahead, behind))
                size += len(parts)
                if size >= _FLUSH:
                    yield _batch(held, names)
                    held, size = [], 0
        if held:
            yield _batch(held, names)

    return wide.select("__row", F.col(text_col)).mapInArrow(lines, _LINES)


def _batch(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    columns = [pa.array(np.concatenate(c)).cast(t) for c, t in zip(zip(*held), types)]
    return pa.RecordBatch.from_arrays(columns, names)


def _first_of(rows: DataFrame, *key: str) -> DataFrame:
    """(at, name): each position whose key another shares, with the first position of that key."""
    shared = (
        rows.groupBy(*key)
        .agg(F.min("at").alias("name"), F.max("at").alias("__last"))
        .filter(F.col("name") < F.col("__last"))
        .drop("__last")
    )
    return met(rows, shared, list(key), "classes").select("at", "name")


def _shifted(level: DataFrame, by: Column | int, name: str) -> DataFrame:
    return level.select((F.col("at") - by).alias("at"), F.col("name").alias(name))


def repeated_runs(wide: DataFrame, text_col: str, id_col: str, min_words: int) -> DataFrame:
    """(__row, first, until): disjoint line ranges that repeat what stands earlier.

    Earlier means a smaller document id (null last), then an earlier row, then an earlier line. A
    line goes if it lies in a run of consecutive lines of one document with at least `min_words`
    words that also starts at an earlier position. Each line of such a run lies in the shortest
    long-enough window that starts at the run's first line, or in the one that ends at the line,
    and these windows repeat whenever the run does; so windows that repeat cover exactly the
    maximal repeated runs, and only their classes are needed.
    """
    lines = written(line_table(wide, text_col, min_words), "lines")
    known = (
        lines.groupBy("id1", "id2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    order = numbered(
        wide.select("__row", F.col(id_col).alias("__id")),
        F.col("__id").asc_nulls_last(), F.col("__row"), name="__number", label="documents",
    )
    fits = (F.col("line") < 1 << _LINE_BITS) & (F.col("__number") < 1 << (63 - _LINE_BITS))
    twice = written(
        met(lines, known, ["id1", "id2"], "known")
        .join(order.select("__row", "__number"), "__row")
        .withColumn("at", F.when(fits, F.shiftleft("__number", _LINE_BITS) + F.col("line"))
                    .otherwise(F.raise_error(F.lit("too many lines or documents for a position")))),
        "repeated_lines",
    )
    windows = written(
        twice.filter("ahead > 0").select(F.col("at").alias("at"), F.col("ahead").alias("m"))
        .unionByName(
            twice.filter("behind > 0").select(
                (F.col("at") - F.col("behind") + 1).alias("at"), F.col("behind").alias("m")
            )
        ),
        "windows",
    )
    longest = windows.agg(F.max("m")).first()[0] or 0
    level = written(_first_of(twice.select("at", "id1", "id2"), "id1", "id2"), "level")
    found = []
    for k in range(longest.bit_length()):
        reach = windows.filter((F.col("m") >= 1 << k) & (F.col("m") < 2 << k))
        ends = level.select(
            F.col("at").alias("__end"), F.col("name").alias("b")
        )
        both = (
            reach.join(level.withColumnRenamed("name", "a"), "at")
            .withColumn("__end", F.col("at") + F.col("m") - F.lit(1 << k))
            .join(ends, "__end")
        )
        again = _named(both)
        found.append(again)
        if k + 1 < longest.bit_length():
            pairs = level.withColumnRenamed("name", "a").join(_shifted(level, 1 << k, "b"), "at")
            level = written(_first_of(pairs, "a", "b"), "level")
    if not found:
        return twice.select("__row", F.col("line").alias("first"), F.col("line").alias("until"))
    spans = union_all(found).withColumn("__number", F.shiftright("at", _LINE_BITS))
    spans = spans.withColumn("first", (F.col("at") - F.shiftleft("__number", _LINE_BITS)).cast("int"))
    spans = spans.withColumn("until", (F.col("first") + F.col("m")).cast("int"))
    # Overlapping ranges of a document become one.
    past = Window.partitionBy("__number").orderBy("first").rowsBetween(
        Window.unboundedPreceding, -1
    )
    so_far = Window.partitionBy("__number").orderBy("first").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    opened = F.when(F.col("first") <= F.max("until").over(past), 0).otherwise(1)
    merged = (
        spans.groupBy("__number", "first").agg(F.max("until").alias("until"))
        .withColumn("__run", opened)
        .withColumn("__run", F.sum("__run").over(so_far))
        .groupBy("__number", "__run")
        .agg(F.min("first").alias("first"), F.max("until").alias("until"))
    )
    return merged.join(order.select("__row", "__number"), "__number").select(
        "__row", "first", "until"
    )


def _named(both: DataFrame) -> DataFrame:
    """(at, m) of the windows whose content starts earlier as well."""
    firsts = (
        both.groupBy("m", "a", "b")
        .agg(F.min("at").alias("__first"), F.max("at").alias("__last"))
        .filter(F.col("__first") < F.col("__last"))
        .drop("__last")
    )
    repeats = met(both, firsts, ["m", "a", "b"], "firsts")
    return repeats.filter(F.col("at") > F.col("__first")).select("at", "m")


def _marked(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Each document as a struct `doc`, with its sorted repeated ranges in `cut` (null if none)."""
    wide = written(packed(docs).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    runs = repeated_runs(wide, f"doc.`{text_col}`", f"doc.`{id_col}`", min_words)
    cuts = runs.groupBy("__row").agg(
        F.array_sort(F.collect_list(F.struct("first", "until"))).alias("cut")
    )
    return wide.join(cuts.hint("shuffle_hash"), "__row", "left").drop("__row")


def _rest(text: Column) -> Column:
    """The lines between the ranges, joined again."""
    lines, cut = F.split(text, "\n"), F.col("cut")

    def between(j: Column) -> Column:
        start = F.coalesce(F.get(cut, j - 1).getField("until"), F.lit(0))
        end = F.coalesce(F.get(cut, j).getField("first"), F.size(lines))
        return F.slice(lines, start + 1, end - start)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), between))
    return F.when(cut.isNull(), text).otherwise(F.array_join(kept, "\n"))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """All documents without the later copies of repeated line runs; other columns as they were.

    Rows of equal id are documents of their own. A document all of whose lines repeat keeps an
    empty text; null texts stay null. A column n_chars follows the text.
    """
    doc = F.col("doc")
    rows = _marked(docs, id_col, text_col, min_words).withColumn("rest", _rest(doc[text_col]))
    after = doc.withField(text_col, F.col("rest"))
    if "n_chars" in docs.columns:
        length = F.length("rest").cast(docs.schema["n_chars"].dataType)
        after = after.withField("n_chars", length)
    return rows.select(F.when(F.col("cut").isNull(), doc).otherwise(after).alias("doc")).select("doc.*")


def line_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """One row per document: doc_id, n_lines, deleted_lines, text (what is left)."""
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = F.aggregate(
        F.coalesce("cut", F.array().cast("array<struct<first:int,until:int>>")),
        F.lit(0).cast("long"),
        lambda a, x: a + x.getField("until") - x.getField("first"),
    )
    return _marked(thin, "doc_id", "text", min_words).select(
        "doc.doc_id",
        F.size(F.split(F.coalesce("doc.text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        gone.alias("deleted_lines"),
        _rest(F.col("doc.text")).alias("text"),
    )
