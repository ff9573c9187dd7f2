"""Best-fit packing of token sequences by exact-complement hashing."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import (
    BinaryType, IntegerType, LongType, StructField, StructType,
)

from .common import written
from .order import blocks_for
from .tokens import encoded

CAPACITY = 1024
END_ID = 2
#: Shares of the capacity up to which lengths are kept out of exact groups, for best fit to close
#: gaps with; the plan with the fewest sequences is taken.
RESERVES = (0.0, 1 / 8, 1 / 4, 1 / 3)
_FLUSH = 16 << 20

Patterns = list[tuple[tuple[int, ...], int]]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids): each text's ids and the end id, cut into pieces.

    Only a document of more than `capacity` ids is cut; then every piece but the first is full.
    `ids` are little-endian unsigned 32-bit numbers. A null text counts as empty (the end id
    alone). Rows of equal id keep their own pieces; other columns are not read.
    """
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType(
        [
            thin.schema["doc_id"],
            StructField("piece", IntegerType()),
            StructField("start", LongType()),
            StructField("length", LongType()),
            StructField("ids", BinaryType()),
        ]
    )
    tail = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, kind = [], 0, None
        names = schema.names

        def batch() -> pa.RecordBatch:
            types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names
            )

        for doc, ids in encoded(batches, vocabulary):
            kind = doc.type
            ids += tail
            total = len(ids) // 4
            end = total % capacity or capacity if total > capacity else total
            at = piece = 0
            while at < total:
                rows.append((doc.as_py(), piece, at, end - at, ids[4 * at : 4 * end]))
                at, end, piece = end, end + capacity, piece + 1
            held += len(ids)
            if held >= _FLUSH:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    return thin.mapInArrow(cut, schema)


class _Stock:
    """Lengths on hand, with an index of the sums that one, two or three of them make."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.sums = None

    def take(self, lengths: tuple[int, ...]) -> int:
        """Use up as many equal groups of these lengths as there are."""
        need = Counter(lengths)
        times = min(int(self.left[x]) // n for x, n in need.items())
        for x, n in need.items():
            self.left[x] -= n * times
            if not self.left[x]:
                self.sums = None
        return times

    def pair(self, total: int, *beside: int) -> tuple[int, ...] | None:
        """Two lengths on hand with this sum, as equal as possible."""
        high = np.arange((total + 1) // 2, total)
        for b in high[(self.left[high] > 0) & (self.left[total - high] > 0)].tolist():
            if self._has((*beside, b, total - b)):
                return b, total - b
        return None

    def single(self, total: int, *beside: int) -> tuple[int, ...] | None:
        return (total,) if self._has((*beside, total)) else None

    def triple(self, total: int, *beside: int) -> tuple[int, ...] | None:
        """Three lengths on hand with this sum; the pairs' sums are looked up in their index."""
        if self.sums is None:
            there = (self.left > 0).astype(np.float64)
            self.sums = np.convolve(there, there) > 0
        third = np.arange(1, total // 3 + 1)
        for d in third[(self.left[third] > 0) & self.sums[total - third]].tolist():
            if pair := self.pair(total - d, *beside, d):
                return (*pair, d)
        return None

    def _has(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= n for x, n in Counter(lengths).items())


def _exact(stock: _Stock, capacity: int) -> Patterns:
    """Groups that fill a sequence exactly, as often as the counts allow.

    From the longest length down: those with one complement, then with two, then with three. Each
    step uses up a length.
    """
    patterns: Patterns = [((capacity,), n)] if (n := stock.take((capacity,))) else []
    for complement in (stock.single, stock.pair, stock.triple):
        for anchor in range(capacity - 1, 0, -1):
            while stock.left[anchor] and (fill := complement(capacity - anchor, anchor)):
                patterns.append(((anchor, *fill), stock.take((anchor, *fill))))
    return patterns


def _best_fit(counts: dict[int, int], capacity: int) -> Patterns:
    """Best fit, longest first, many equal sequences at a time."""
    open_bins: dict[int, Patterns] = defaultdict(list)
    for length, n in sorted(counts.items(), reverse=True):
        while n:
            gap = min((g for g, bins in open_bins.items() if g >= length and bins), default=None)
            if gap is None:
                each = min(capacity // length, n)
                open_bins[capacity - each * length].append(((length,) * each, n // each))
                n -= each * (n // each)
                continue
            lengths, times = open_bins[gap].pop()
            if times > n:
                open_bins[gap].append((lengths, times - n))
                times = n
            open_bins[gap - length].append(((*lengths, length), times))
            n -= times
    return [p for bins in open_bins.values() for p in bins]


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> Patterns:
    """Patterns (lengths in a sequence, number of such sequences) that use every piece once.

    Works on how many pieces there are of each length, so its size depends on the capacity alone.
    Exact groups first; what they leave is packed best-fit. Exact groups may use up the short
    pieces that best fit would close gaps with, so some of the shortest can be reserved for it.
    """
    plans = []
    for share in RESERVES:
        stock = _Stock({x: n for x, n in counts.items() if x > share * capacity}, capacity)
        exact = _exact(stock, capacity)
        rest = {x: n for x, n in counts.items() if x <= share * capacity}
        rest |= {x: int(stock.left[x]) for x in np.flatnonzero(stock.left).tolist()}
        plans.append(exact + _best_fit(rest, capacity))
    return min(plans, key=lambda p: sum(n for _, n in p))


def _slots(patterns: Patterns) -> list[tuple[int, int, int, int, int]]:
    """(length, rank of the first piece, pieces, first sequence, offset) of each place."""
    used, out, sequence = Counter(), [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            out.append((length, used[length], times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return out


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to `written_pieces`, or to some of their columns.

    All that leaves Spark is the number of pieces of each length. A piece's rank among those of
    its length, however many share it, is its place in a hash block plus the blocks before.
    """
    spark = pieces.sparkSession
    bits = blocks_for(pieces)
    keys = ["length", "__block"]
    block = F.shiftrightunsigned(F.xxhash64("__row"), 64 - bits)
    rows = pieces.withColumn("__block", block)
    counts = written(rows.groupBy(*keys).agg(F.count("*").alias("__n")), "lengths")
    histogram = {
        r["length"]: r["n"]
        for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()
    }
    slots = spark.createDataFrame(
        _slots(pack_lengths(histogram, capacity)),
        "length long, __rank long, __times long, __sequence long, offset long",
    )
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*keys).orderBy("__row")
    ranked = rows.join(bases, keys).withColumn(
        "__at", F.col("__base") + F.row_number().over(within) - 1
    )
    nth = F.col("__at") - F.col("__rank")
    return (
        ranked.join(F.broadcast(slots), "length")
        .filter((nth >= 0) & (nth < F.col("__times")))
        .select(
            *[F.col(f"`{c}`") for c in pieces.columns if c != "__row"],
            (F.col("__sequence") + nth).alias("sequence_id"),
            "offset",
        )
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids as one row (sequence_id, doc_ids, ids) per sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("p"))
        .select(
            "sequence_id",
            F.col("p.doc_id").alias("doc_ids"),
            F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
        )
    )


def written_pieces(docs: DataFrame, vocabulary: str | None = None, **options) -> DataFrame:
    """`token_pieces` of the documents, written once, with a number `__row` for each."""
    pieces = token_pieces(docs, vocabulary or default_vocabulary(), **options)
    return written(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")


def packed(docs: DataFrame, vocabulary: str | None = None, **options) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    return placed(written_pieces(docs, vocabulary, **options), options.get("capacity", CAPACITY))


def packed_digest(docs: DataFrame, vocabulary: str | None = None, **options) -> DataFrame:
    """As `packed`, with a checksum of the written ids in their stead."""
    pieces = written_pieces(docs, vocabulary, **options)
    thin = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return placed(thin, options.get("capacity", CAPACITY)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
