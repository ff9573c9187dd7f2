"""SimHash near-duplicates through covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from .common import met, union_all, written
from .components import components

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
#: Buckets up to this many fingerprints are compared pair by pair, larger ones through hubs.
#: Both ways find exactly the same links.
PAIRWISE = 32


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """Bit masks such that any two words within the radius agree under one of them.

    Bit i gets a non-zero vector over GF(2) of length radius + 1; mask v keeps the bits whose
    vector has odd inner product with v. The at most `radius` differing bits of a pair give as
    many linear equations in radius + 1 unknowns, so some v drops all of them.
    """
    count = (1 << (radius + 1)) - 1
    vector = [i % count + 1 for i in range(bits)]
    return [
        sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2)
        for v in range(1, count + 1)
    ]


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of one text, as a signed 64-bit number; memory is bounded by the text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    # bytes.lower() changes A-Z alone, and bytes.split() separates at exactly the six separators.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return _signed(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


@F.pandas_udf(LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield pd.Series([fingerprint_of(t) for t in series], dtype="int64")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints in `fp` that together connect all near pairs.

    A bucket holds the fingerprints that agree under one mask. Those of a small bucket are
    compared pair by pair. In a large one, two fingerprints within two bits share a point within
    one bit of both, so each names its neighbouring points inside the bucket, and those who name
    the same point (at most 65) are linked to the smallest: linear in the bucket, no pair lost.
    """
    masks = [_signed(m) for m in covering_masks()]
    tables = F.explode(
        F.array(*[
            F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
            for m in masks
        ])
    )
    buckets = prints.select("fp", tables.alias("t")).select("fp", "t.mask", "t.key")
    sizes = buckets.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(met(buckets, sizes, ["mask", "key"], "sizes"), "buckets")

    small = shared.filter(F.col("n") <= PAIRWISE).select("mask", "key", "fp")
    pairs = (
        small.withColumnRenamed("fp", "a")
        .join(small.withColumnRenamed("fp", "b"), ["mask", "key"])
        .filter((F.col("a") < F.col("b")) & (_distance(F.col("a"), F.col("b")) <= RADIUS))
        .select("a", "b")
    )
    points = F.array(
        "fp", *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)]
    )
    hubs = (
        shared.filter(F.col("n") > PAIRWISE)
        .select("mask", "key", "fp", F.explode(points).alias("point"))
        .filter(F.col("point").bitwiseAND(F.col("mask")) == F.col("key"))
        .groupBy("point")
        .agg(F.collect_set("fp").alias("near"))
        .filter(F.size("near") > 1)
        .select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
        .filter("a <> b")
    )
    return union_all([pairs, hubs]).distinct()


def near_classes(prints: DataFrame) -> DataFrame:
    """(fp, root) for each fingerprint that has a link."""
    found = components(links(prints.select("fp").distinct()), "a", "b")
    return found.select(F.col("node").alias("fp"), "root")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per document.

    Null and wordless texts have fingerprint zero and link like any other. Rows of equal id keep a
    row each. A component's id is the smallest non-null id in it (null if there is none). Other
    columns are not read. Only (id, fingerprint) is shuffled, and copies meet in map-side minima.
    """
    prints = written(
        docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")),
        "prints",
    )
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = written(first.join(near_classes(prints), "fp"), "linked")
    low = linked.groupBy("root").agg(F.min("first").alias("low"))
    lows = met(linked, low, ["root"], "lows").select("fp", "low")
    labels = first.join(lows, "fp", "left").select(
        "fp", F.coalesce("low", "first").alias("component_id")
    )
    return met(prints, labels, ["fp"], "labels").select(
        "doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )
