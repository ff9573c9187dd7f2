"""Catalog lookups, payload checks, leases and idle streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.scan import OrderedScan, last_value

# Fixed values.
CATALOG_TTL_SECONDS = 300
LEASE_CAPACITY = 4_096
STARTUP_SEGMENTS = 6
STARTUP_TIMEOUT_SECONDS = 45
ENTRY_TTL_SECONDS = 300


def resolve_catalog(
    requests: DataFrame,
    catalog: DataFrame,
    key: str,
    ts: str,
    value: str,
    ttl_seconds: int = CATALOG_TTL_SECONDS,
) -> DataFrame:
    """Each request with the latest entry of its key, while that is younger than the limit.

    Requests and entries are put in one order and the latest entry is carried along: linear in
    both inputs, where a join on the key would pair every request with every entry before it.
    """
    entries = catalog.select(key, ts, F.struct(F.col(value).alias("v"), F.col(ts).alias("t")).alias("__entry"))
    both = requests.withColumn("__kind", F.lit(1)).unionByName(
        entries.withColumn("__kind", F.lit(0)), allowMissingColumns=True
    )
    scan = OrderedScan(both, key, [ts, "__kind"]).add(__found=last_value(F.col("__entry")))
    age = F.unix_micros(ts) - F.unix_micros("__found.t")
    fresh = F.coalesce(age < ttl_seconds * 1_000_000, F.lit(False))
    return scan.df.filter("__kind = 1").select(
        *requests.columns,
        F.when(fresh, F.col("__found.v")).alias(value),
        fresh.alias("resolved"),
    )


def expand_manifest(manifest: DataFrame, key: str, hashes: str) -> DataFrame:
    """One row per (key, piece) from a list of piece hashes."""
    return manifest.select(key, F.posexplode(hashes).alias("piece", "expected"))


def verify_pieces(
    payload: DataFrame, manifest: DataFrame, keys: list[str], data: str, expected: str
) -> DataFrame:
    """Whether each payload's SHA-1 is the listed one; a piece without a listed hash is not ok.

    Only the 40-digit hash crosses the shuffle, never the payload.
    """
    hashed = payload.select(*keys, F.sha1(F.col(data)).alias("actual"))
    joined = hashed.join(manifest.select(*keys, expected), keys, "left")
    return joined.withColumn("ok", F.coalesce(F.col("actual") == F.lower(expected), F.lit(False)))


def authorize(
    requests: DataFrame, leases: DataFrame, keys: list[str], expires_at: str, now: str
) -> DataFrame:
    """Requests whose (token, playback) holds a lease that has not expired at ``now``."""
    latest = leases.groupBy(*keys).agg(F.max(expires_at).alias("__expires"))
    return requests.join(latest, keys).filter(F.col("__expires") > F.col(now)).drop("__expires")


def lease_capacity(
    df: DataFrame, token: str, expires_at: str, now: Column, cap: int = LEASE_CAPACITY
) -> DataFrame:
    """Leases left after dropping expired ones and, above the capacity, those that expire first."""
    live = df.filter(F.col(expires_at) > now)
    return live.orderBy(F.col(expires_at).desc(), F.col(token).desc()).limit(cap)


def idle_streams(
    sessions: DataFrame,
    hls: DataFrame,
    pending: DataFrame,
    stream: str,
    subscribers: str,
    accessed: str,
    now: Column,
    grace: str,
) -> DataFrame:
    """Streams without subscribers, recent playlist access or a pending open."""
    recent = hls.filter(F.col(accessed) > now - F.expr(f"interval {grace}"))
    in_use = recent.select(stream).unionByName(pending.select(stream)).distinct()
    return sessions.filter(F.col(subscribers) <= 0).join(in_use, stream, "left_anti")


def idle_entries(
    df: DataFrame,
    key: str,
    ts: str,
    kind: str,
    producers: str,
    now: Column,
    ttl_seconds: int = ENTRY_TTL_SECONDS,
) -> DataFrame:
    """Registry entries to reap: not broadcast, nobody producing, idle for the whole limit."""
    latest = df.groupBy(key).agg(
        F.max_by(F.struct(F.col(kind).alias("kind"), F.col(producers).alias("producers")), ts).alias("s"),
        F.max(ts).alias("last_active"),
    )
    idle = F.unix_micros(now) - F.unix_micros("last_active") >= ttl_seconds * 1_000_000
    return latest.filter((F.col("s.kind") != "broadcast") & (F.col("s.producers") <= 0) & idle).select(
        key, "last_active"
    )


def startup_readiness(
    segments: DataFrame,
    requests: DataFrame,
    stream: str,
    done_at: str,
    asked_at: str,
    n: int = STARTUP_SEGMENTS,
    timeout_seconds: int = STARTUP_TIMEOUT_SECONDS,
) -> DataFrame:
    """When each request can be answered: at the n-th segment, or never within the timeout."""
    n = max(n, 1)
    nth = (
        segments.select(stream, done_at)
        .withColumn("__rank", F.row_number().over(W.partitionBy(stream).orderBy(done_at)))
        .filter(F.col("__rank") <= n)
        .groupBy(stream)
        .agg(F.max(done_at).alias("__ready"), F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") == n)
        .select(stream, "__ready")
    )
    limit = F.col(asked_at) + F.expr(f"interval {timeout_seconds} seconds")
    ok = F.coalesce(F.col("__ready") <= limit, F.lit(False))
    return requests.join(nth, stream, "left").select(
        *requests.columns,
        ok.alias("ready"),
        F.when(ok, F.greatest(F.col("__ready"), F.col(asked_at))).otherwise(limit).alias("answered_at"),
    )
