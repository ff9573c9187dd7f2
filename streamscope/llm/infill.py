"""Fill-in-the-middle: texts cut at two ranks of an indexable skip list of their units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Fixed values.
SEED = 7
SENTINELS = ("<P>", "<S>", "<M>")
RATE, SUFFIX_FIRST = 100, 50

#: Output texts are handed on when they hold this many characters.
_FLUSH = 1 << 23


def line_lengths(text: str) -> np.ndarray:
    """Code points of each line with its line feed, as the pattern `[^\\n]*\\n|[^\\n]+` cuts."""
    parts = text.split("\n")
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    sizes[:-1] += 1
    return sizes if sizes[-1] else sizes[:-1]


def _heights(n: int) -> np.ndarray:
    """Lanes above the first that the node before each unit stands in: a further one with
    chance 1/4, by a hash of its rank, so that every run builds the same list."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    heights = np.zeros(n, np.int64)
    for lane in range(1, 32):
        up = x & np.uint64((1 << 2 * lane) - 1) == 0
        if not up.any():
            break
        heights[up] = lane
    return heights


class SkipList:
    """Units of known code-point widths, found by rank.

    A node stands before each unit; the head, before the first, is in every lane. A lane links each
    of its nodes to its next one, or to the end, and the link carries how many units and how many
    code points it passes. A lane has about a quarter of the nodes of the lane below.
    """

    def __init__(self, widths: np.ndarray):
        n = len(widths)
        self.n = n
        passed = np.concatenate([[0], np.cumsum(widths)])
        self.total = int(passed[-1])
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        heights, below = _heights(n), np.arange(n)
        if n:
            heights[0] = heights.max()
        for lane in range(int(heights.max(initial=-1)) + 1):
            nodes = np.flatnonzero(heights >= lane)
            ends = np.append(nodes[1:], n)
            down = np.append(np.searchsorted(below, nodes), len(below))
            self.lanes.append((ends - nodes, passed[ends] - passed[nodes], down))
            below = nodes

    def before(self, rank: int) -> int:
        """Code points before the unit of a rank from 0 to n, down from the topmost lane."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        node, units, points = 0, 0, 0
        for spans, widths, down in reversed(self.lanes):
            while node < len(spans) and units + spans[node] <= rank:
                units += int(spans[node])
                points += int(widths[node])
                node += 1
            node = int(down[node])
        return points


def _draws(id_text: Column, seed: int) -> list[Column]:
    """Four whole numbers of a document, from the hash of its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    sentinels: tuple[str, str, str] = SENTINELS,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars, middle_chars, output.

    `rate` per cent of the texts are transformed, of those `suffix_first` per cent with the suffix
    in front. Empty and null texts, and texts that hold a sentinel, stay plain, with null
    prefix_chars and middle_chars; the output of a null text is empty. A null id draws as an empty
    one; rows of equal id draw alike and keep a row each; other columns are not read. Each text is
    cut where it lies: nothing is shuffled.
    """
    draws = [d.alias(f"h{k}") for k, d in enumerate(_draws(F.col(id_col).cast("string"), seed))]
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *draws)
    schema = StructType([
        StructField("doc_id", thin.schema["doc_id"].dataType), StructField("n", LongType()),
        StructField("form", StringType()), StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()), StructField("output", StringType()),
    ])
    p, s, m = sentinels

    def one(text: str, h: tuple[int, int, int, int]) -> tuple:
        units = SkipList(line_lengths(text))
        n = units.n
        if not n or any(x in text for x in sentinels) or h[2] % 100 >= rate:
            return n, "plain", None, None, text
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = units.before(low), units.before(high)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h[3] % 100 < suffix_first:
            return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows, size, first = [], 0, 0

            def part(until: int) -> pa.RecordBatch:
                made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, until - first), *made], schema.names
                )

            columns = (batch.column(c) for c in ("text", "h0", "h1", "h2", "h3"))
            for at, (text, *h) in enumerate(zip(*columns)):
                rows.append(one(text.as_py() or "", tuple(x.as_py() for x in h)))
                size += len(rows[-1][-1])
                if size >= _FLUSH:
                    yield part(at + 1)
                    rows, size, first = [], 0, at + 1
            if rows:
                yield part(batch.num_rows)

    return thin.mapInArrow(transform, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that a transformed output was made from.

    The pieces hold no sentinel, so each sentinel stands in the output once.
    """
    p, s, m = (F.lit(x) for x in sentinels)

    def between(first: Column, second: Column) -> Column:
        start = F.instr(output, first) + F.length(first)
        return F.substring(output, start, F.instr(output, second) - start)

    rest = F.substring(output, F.instr(output, m) + F.length(m), F.length(output))
    return (
        F.when(form == "psm", F.concat(between(p, s), rest, between(s, m)))
        .when(form == "spm", F.concat(between(p, m), rest, between(s, p)))
        .otherwise(output)
    )


def infill_digest(docs: DataFrame, **options) -> DataFrame:
    """The transformed documents with digests: doc_id, n, form, prefix_chars, middle_chars,
    output_sha256, and restored_sha256 of the text rebuilt from the output. Nulls, empty texts and
    repeated rows as in `fill_in_middle`; no documents, no rows."""
    sentinels = options.get("sentinels", SENTINELS)
    back = restored(F.col("output"), F.col("form"), sentinels)
    return fill_in_middle(docs, **options).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )
