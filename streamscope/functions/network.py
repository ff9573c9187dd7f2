"""Addresses and tracker URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# IPv4 blocks by class, as (class, first address, prefix bits).
BLOCKS = [
    ("unspecified", "0.0.0.0", 32),
    ("private", "10.0.0.0", 8),
    ("cgnat", "100.64.0.0", 10),
    ("loopback", "127.0.0.0", 8),
    ("link_local", "169.254.0.0", 16),
    ("private", "172.16.0.0", 12),
    ("documentation", "192.0.2.0", 24),
    ("private", "192.168.0.0", 16),
    ("documentation", "198.51.100.0", 24),
    ("documentation", "203.0.113.0", 24),
    ("multicast", "224.0.0.0", 4),
    ("broadcast", "255.255.255.255", 32),
]
# IPv6 blocks by class, as (class, first group, prefix bits within it).
GROUP_BLOCKS = [("private", 0xFC00, 7), ("link_local", 0xFE80, 10), ("multicast", 0xFF00, 8)]
# Classes each policy refuses.
TRACKER_REFUSES = [
    "private", "loopback", "link_local", "multicast", "broadcast", "unspecified", "documentation",
]
TRANSPORT_REFUSES = [*TRACKER_REFUSES, "cgnat"]
OPT_IN_ALLOWS = ["private", "loopback", "cgnat"]
MAX_TRACKER_URL_BYTES = 256
MAX_TRACKERS = 64


def _number(ip: str) -> int:
    a, b, c, d = (int(part) for part in ip.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def ipv4_number(ip: Column | str) -> Column:
    """A dotted IPv4 address as a bigint; null when it is not one."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    parts = F.split(ip, r"\.")
    number = sum(
        (parts[i].try_cast("bigint") * (1 << (24 - 8 * i)) for i in range(1, 4)),
        parts[0].try_cast("bigint") * (1 << 24),
    )
    return F.when(ip.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"), number)


def ipv6_groups(ip: Column | str) -> Column:
    """An IPv6 address as its eight 16-bit groups; null when it is not one.

    ``::`` stands for one or more zero groups, once; the last two groups may be dotted IPv4.
    """
    ip = F.lower(F.col(ip) if isinstance(ip, str) else ip)
    tail = F.regexp_extract(ip, r"^[0-9a-f:]*:([0-9.]+)$", 1)
    number = F.when(F.instr(tail, ".") > 0, ipv4_number(tail))
    dotted = F.concat(
        F.substring(ip, F.lit(1), F.length(ip) - F.length(tail)),
        F.hex(F.shiftright(number, 16)), F.lit(":"), F.hex(number.bitwiseAND(F.lit(0xFFFF))),
    )
    text = F.when(F.instr(ip, ".") > 0, F.lower(dotted)).otherwise(ip)
    short = F.instr(text, "::") > 0

    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    head, rest = groups(F.regexp_extract(text, "^(.*?)(::|$)", 1)), groups(F.regexp_extract(text, "::(.*)$", 1))
    missing = F.lit(8) - F.size(head) - F.size(rest)
    zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
    every = F.when(short, F.concat(head, zeros, rest)).otherwise(F.split(text, ":"))
    fits = F.when(short, missing >= 1).otherwise(F.size(every) == 8)
    legal = F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(fits & legal, F.transform(every, lambda g: F.conv(g, 16, 10).cast("int")))


def _ipv4_class(number: Column) -> Column:
    kind = F.when(number.isNull(), F.lit(None).cast("string"))
    for name, first, bits in BLOCKS:
        low = _number(first)
        kind = kind.when(number.between(low, low + (1 << (32 - bits)) - 1), name)
    return kind.otherwise("global")


def address_class(df: DataFrame, ip: str, policy: str = "tracker", opt_in: bool = False) -> DataFrame:
    """Add ``address_class`` and ``allowed`` under the tracker or the transport policy.

    IPv4 and IPv6; an IPv4 address written as an IPv6 one has the class of the IPv4 address, and
    unique local addresses are private.  The blocks are a handful of constant ranges, so they are
    compared in place: no join, no shuffle, and the result can be pushed into later filters.
    """
    groups = F.col("__groups")
    mapped = (F.slice(groups, 1, 5) == F.array(*[F.lit(0)] * 5)) & (groups[5] == 0xFFFF)
    number = F.coalesce(
        ipv4_number(ip), F.when(mapped, groups[6].cast("bigint") * 65536 + groups[7])
    )
    total = F.aggregate(groups, F.lit(0), lambda a, g: a + g)
    six = F.when(groups.isNull(), F.lit("invalid")).when(total == 0, "unspecified")
    six = six.when((total == 1) & (groups[7] == 1), "loopback")
    for name, first, bits in GROUP_BLOCKS:
        six = six.when(groups[0].between(first, first + (1 << (16 - bits)) - 1), name)
    kind = F.coalesce(_ipv4_class(F.col("__number")), six.otherwise("global"))
    refused = TRACKER_REFUSES if policy == "tracker" else TRANSPORT_REFUSES
    if opt_in and policy == "tracker":
        refused = []
    elif opt_in:
        refused = [c for c in refused if c not in OPT_IN_ALLOWS]
    text = F.col(ip)
    df = (
        df.withColumn("__groups", F.when(F.instr(text, ":") > 0, ipv6_groups(text)))
        .withColumn("__number", number)
        .withColumn("address_class", kind)
        .drop("__groups", "__number")
    )
    return df.withColumn("allowed", ~F.col("address_class").isin("invalid", *refused))


def tracker_class(url: Column | str) -> Column:
    """``udp``, ``other_scheme``, ``too_long`` or ``malformed``; schemes are case-sensitive."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    return (
        F.when(F.octet_length(url) > MAX_TRACKER_URL_BYTES, "too_long")
        .when((at <= 1) | (F.length(url) < at + 3), "malformed")
        .when(F.substring_index(url, "://", 1) == "udp", "udp")
        .otherwise("other_scheme")
    )
