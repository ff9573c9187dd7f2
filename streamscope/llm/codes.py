"""Token-id files in directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level 0 holds the first chunk of every id,
level 1 the second chunk of those that have one, and so on. A bitmap beside each level says which
ids continue, and a directory counts the ones before every block of 512 bits, so the place of an
id's next chunk is a rank, and any id is read without decoding others.

A segment is one blob, all numbers little-endian:

    b"DAC1", levels (u32), then per level: entries (u64), chunks (u8 each),
    bitmap (bit i in byte i // 8 from the lowest bit, padded to 64 bytes),
    directory (u64 per 64 bytes of bitmap: ones before it)

Spark writes segments as rows of a Parquet table beside the ids and bounds of their documents; a
document never spans segments. Both sides go through Spark, so any file system it reaches serves.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StructField, StructType,
)

from .common import written
from .tokens import encoded

END_ID = 1
#: A segment is closed when it holds this many ids.
SEGMENT_IDS = 1 << 19
_MAGIC = b"DAC1"
_BLOCK_BYTES = 64


def encode(ids: np.ndarray) -> bytes:
    """The blob of an array of unsigned 32-bit ids."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    out, levels = [], 0
    while levels == 0 or len(rest):
        chunk, high = (rest & 255).astype(np.uint8), rest >> 8
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % _BLOCK_BYTES))
        ones = np.bitwise_count(bits.reshape(-1, _BLOCK_BYTES)).sum(axis=1, dtype=np.uint64)
        before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8")[: len(ones)]
        out += [struct.pack("<Q", len(rest)), chunk.tobytes(), bits.tobytes(), before.tobytes()]
        rest, levels = high[more], levels + 1
    return _MAGIC + struct.pack("<I", levels) + b"".join(out)


class Codes:
    """A blob opened for random access."""

    def __init__(self, blob: bytes):
        if blob[:4] != _MAGIC:
            raise ValueError("not a segment of token codes")
        (count,) = struct.unpack_from("<I", blob, 4)
        at, self.levels = 8, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            chunks = np.frombuffer(blob, np.uint8, n, at)
            at += n
            blocks = -(-n // (8 * _BLOCK_BYTES))
            bits = np.frombuffer(blob, np.uint8, blocks * _BLOCK_BYTES, at)
            at += blocks * _BLOCK_BYTES
            before = np.frombuffer(blob, "<u8", blocks, at).astype(np.int64)
            at += 8 * blocks
            self.levels.append((chunks, bits.view("<u8"), before))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before each position: the directory, the words before it in its block, its word."""
        block, word = at >> 9, at >> 6
        ranks = before[block]
        for k in range(_BLOCK_BYTES // 8 - 1):
            w = (block << 3) + k
            ranks = ranks + np.where(w < word, np.bitwise_count(words[w]), 0)
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return ranks + np.bitwise_count(words[word] & mask)

    def range(self, first: int, until: int) -> np.ndarray:
        """The ids at consecutive positions. Their chunks lie together at each level, in order, so
        one rank for each level finds them."""
        out = np.zeros(until - first, dtype=np.uint32)
        where = np.arange(until - first)
        for level, (chunks, words, before) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= chunks[first:until].astype(np.uint32) << np.uint32(8 * level)
            head = first >> 3
            bits = np.unpackbits(words.view(np.uint8)[head : (until + 7) >> 3], bitorder="little")
            where = where[bits[first - 8 * head : until - 8 * head] > 0]
            if len(where):
                first = int(self._rank(words, before, np.array([first]))[0])
                until = first + len(where)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at any positions, in any order."""
        at = np.asarray(at, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.uint32)
        where = np.arange(len(at))
        for level, (chunks, words, before) in enumerate(self.levels):
            out[where] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            more = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            where, at = where[more], at[more]
            if not len(at):
                break
            at = self._rank(words, before, at)
        return out


def write_codes(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "codes",
) -> DataFrame:
    """Encode all texts in ascending id order into segments, written to the shared folder.

    Rows: part, segment (order within part), before (ids of the part before the segment), doc_ids,
    ends (bounds of the documents within the segment), codes. A null text counts as empty, each
    document ends with `end_id`; null ids come first, and equal ids are ordered by text hash.
    """
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = thin.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = StructType(
        [
            StructField("part", IntegerType()),
            StructField("segment", LongType()),
            StructField("before", LongType()),
            StructField("doc_ids", ArrayType(thin.schema["doc_id"].dataType)),
            StructField("ends", ArrayType(LongType())),
            StructField("codes", BinaryType()),
        ]
    )
    tail = int(end_id).to_bytes(4, "little")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        docs, ends, held, size, before, n, kind = [], [], [], 0, 0, 0, None

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            columns = ([part], [n], [before], [docs], [ends], [encode(ids)])
            types = (
                pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()),
                pa.binary(),
            )
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for doc, ids in encoded(batches, vocabulary):
            kind = doc.type
            ids += tail
            size += len(ids) // 4
            docs.append(doc.as_py())
            ends.append(size)
            held.append(ids)
            if size >= SEGMENT_IDS:
                yield close()
                docs, ends, held, size, before, n = [], [], [], 0, before + size, n + 1
        if docs:
            yield close()

    return written(ranged.mapInArrow(segments, schema), label)


def read_codes(segments: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, read from written segments.
    No segments give no rows; null and repeated doc_ids are those that were written.

    A part's first id is the sum of the parts before it, a table of one row per written part.
    """
    sums = segments.groupBy("part").agg(F.sum(F.element_at("ends", -1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    kind = segments.schema["doc_ids"].dataType.elementType
    schema = StructType(
        [
            StructField("doc_id", kind),
            StructField("start", LongType()),
            StructField("n_tokens", LongType()),
            StructField("ids_crc32", LongType()),
        ]
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("doc_ids", "ends", "codes", "start")))
            for doc_ids, ends, blob, start in rows:
                codes, start = Codes(blob.as_py()), start.as_py()
                stops = np.array(ends.as_py())
                starts = np.concatenate([[0], stops[:-1]])
                sums = [
                    zlib.crc32(codes.range(a, b).astype("<u4").tobytes())
                    for a, b in zip(starts.tolist(), stops.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(start + starts), pa.array(stops - starts),
                     pa.array(sums, pa.int64())],
                    schema.names,
                )

    return (
        segments.join(F.broadcast(base), "part")
        .select("doc_ids", "ends", "codes", (F.col("base") + F.col("before")).alias("start"))
        .mapInArrow(documents, schema)
    )


def token_files(docs: DataFrame, vocabulary: str | None = None, **options) -> DataFrame:
    """The documents' tokens, written as directly addressable codes and read back: doc_id, start,
    n_tokens, ids_crc32. A null text is an empty one, null ids come first, rows of equal id keep a
    row each, other columns are not read; no documents, no rows."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return read_codes(write_codes(docs, vocabulary, **options))
