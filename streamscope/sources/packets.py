"""MPEG-TS captures: fixed 188-byte records, so a file splits across tasks at record bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values.
PACKET_BYTES = 188
SYNC_BYTE = 0x47


def _byte(packet: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(packet, at + 1, 1)), 16, 10).cast("int")


def packet_fields(packet: Column | str) -> dict[str, Column]:
    """Header columns of one packet: pid, pusi, random_access, discontinuity, pcr, bytes, aligned."""
    packet = F.col(packet) if isinstance(packet, str) else packet
    b1, b2, b3, length, flags = (_byte(packet, i) for i in (1, 2, 3, 4, 5))
    adapted = (b3.bitwiseAND(0x20) != 0) & (length > 0)
    high = F.conv(F.hex(F.substring(packet, 7, 4)), 16, 10).cast("bigint")
    pcr = high * 2 + F.shiftright(_byte(packet, 10), 7)
    return {
        "pid": F.shiftleft(b1.bitwiseAND(0x1F), 8) + b2,
        "pusi": b1.bitwiseAND(0x40) != 0,
        "random_access": adapted & (flags.bitwiseAND(0x40) != 0),
        "discontinuity": adapted & (flags.bitwiseAND(0x80) != 0),
        "counter": b3.bitwiseAND(0x0F),
        "pcr": F.when(adapted & (length >= 7) & (flags.bitwiseAND(0x10) != 0), pcr),
        "bytes": F.octet_length(packet),
        "aligned": (F.octet_length(packet) == PACKET_BYTES) & (_byte(packet, 0) == SYNC_BYTE),
    }


def read_ts_packets(spark: SparkSession, path: str, stream_id: str) -> DataFrame:
    """Packets of one stream's capture file, in file order.

    ``pkt`` comes from the partition a record is in and its place there, and both follow the byte
    ranges of a single file; a file whose length is not a whole number of packets is refused by
    the record reader.
    """
    records = spark.sparkContext.binaryRecords(path, PACKET_BYTES)
    indexed = records.zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
    raw = spark.createDataFrame(indexed, "pkt bigint, packet binary")
    return raw.select(
        F.lit(stream_id).alias("stream_id"),
        "pkt",
        *[c.alias(n) for n, c in packet_fields("packet").items()],
    )
