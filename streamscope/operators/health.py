"""Verdicts over status samples and playback: health, stability, contiguity, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scan import OrderedScan, last_value, previous, running_count, running_sum

# Fixed values.
MIN_DL_PERCENT = 90
MIN_THROUGHPUT_PERCENT = 80
STALL_BYTES_PER_SECOND = 188
MAX_STALL_SECONDS = 5
EXPECTED_BYTES_PER_SECOND = 175_000
PACKET_BYTES = 188
MIN_PACKETS = 4


def longest_run(
    df: DataFrame, stream: str, order: list[str], pred: Column
) -> DataFrame:
    """The longest unbroken run of rows satisfying ``pred``.

    Rows of one run share the number of failing rows before them, so a run is a group that
    combines before the shuffle however long it is.
    """
    holds = F.coalesce(pred, F.lit(False))
    runs = OrderedScan(df.withColumn("__holds", holds), stream, order).add(
        __breaks=running_sum((~F.col("__holds")).cast("bigint"))
    )
    return (
        runs.df.groupBy(stream, "__breaks")
        .agg(F.count_if("__holds").alias("__n"))
        .groupBy(stream)
        .agg(F.max("__n").alias("longest_run"))
    )


def is_rising(
    df: DataFrame, key: str, order: list[str], value: str
) -> DataFrame:
    """Never falling, at least two values, and the last above the first."""
    scan = OrderedScan(df, key, order).add(__before=previous(F.col(value)))
    steady = F.bool_and(F.coalesce(F.col(value) >= F.col("__before"), F.lit(True)))
    # For a series that never falls, last > first is max > min.
    return scan.df.groupBy(key).agg(
        (steady & (F.count(value) >= 2) & (F.max(value) > F.min(value))).alias("rising")
    )


def swarm_health(
    df: DataFrame,
    peer: str,
    order: list[str],
    status: str,
    peers: str,
    down: str,
    up: str,
    warmup: int,
    everyone: DataFrame | None = None,
) -> DataFrame:
    """Health per peer after its first ``warmup`` samples; upload is reported but not required.

    One scan and one aggregation; peers whose samples are all warm-up stay in the result and fail,
    and so do those of ``everyone`` without any sample.
    """
    scan = OrderedScan(df, peer, order).add(
        __n=running_count(), __before=previous(F.col(down))
    )
    post = F.col("__n") > warmup
    compared = F.col("__n") > warmup + 1
    verdict = scan.df.groupBy(peer).agg(
        F.count_if(post).alias("samples"),
        F.count_if(post & (F.col(status) == "dl")).alias("__dl"),
        F.coalesce(F.min(F.when(post, F.col(peers))) >= 1, F.lit(False)).alias("peers_ok"),
        (
            F.coalesce(F.bool_and(F.when(compared, F.col(down) >= F.col("__before"))), F.lit(False))
            & (F.max(F.when(post, F.col(down))) > F.min(F.when(post, F.col(down))))
        ).alias("downloaded_rising"),
        F.coalesce(F.max(F.when(post, F.col(up))) > 0, F.lit(False)).alias("upload_positive"),
    )
    if everyone is not None:
        flags = {c: False for c in ("peers_ok", "downloaded_rising", "upload_positive")}
        verdict = everyone.select(peer).distinct().join(verdict, peer, "left")
        verdict = verdict.fillna({"samples": 0, "__dl": 0, **flags})
    status_ok = (F.col("samples") > 0) & (F.col("__dl") * 100 >= F.col("samples") * MIN_DL_PERCENT)
    ratio = F.when(F.col("samples") > 0, F.col("__dl") / F.col("samples")).otherwise(F.lit(0.0))
    rising = F.coalesce(F.col("downloaded_rising"), F.lit(False))
    return verdict.select(
        peer,
        "samples",
        F.round(ratio, 6).alias("dl_ratio"),
        status_ok.alias("status_ok"),
        "peers_ok",
        rising.alias("downloaded_rising"),
        "upload_positive",
        (status_ok & F.col("peers_ok") & rising).alias("passed"),
    )


def swarm_reciprocates(health: DataFrame, swarm: str) -> DataFrame:
    """Whether any peer of a swarm uploaded."""
    return health.groupBy(swarm).agg(F.bool_or("upload_positive").alias("reciprocates"))


def stream_stability(
    df: DataFrame,
    playback: DataFrame,
    stream: str,
    second: str,
    nbytes: str,
    expected_bps: int = EXPECTED_BYTES_PER_SECOND,
    stall_bytes: int = STALL_BYTES_PER_SECOND,
    max_stall: int = MAX_STALL_SECONDS,
) -> DataFrame:
    """Throughput and longest stall over the whole playback window, from bytes per second.

    ``playback`` has one row per stream with ``first`` and ``until``, its first and last second.
    Seconds without a row count as empty, at the ends of the window too: a stream that starts late
    or stops early has stalled, and one without any second has stalled throughout. Sparse sums give
    the verdict of the zero-filled table (``bucket_seconds``) without building it, since a stall is
    the distance between two seconds with data. A window without a second fails.
    """
    rows = df.join(playback, stream).filter(F.col(second).between(F.col("first"), F.col("until")))
    if stall_bytes > 0:
        # Empty seconds neither flow nor add bytes: of those only a window's first is scanned.
        rows = rows.filter((F.col(nbytes) != 0) | (F.col(second) == F.col("first")))
    flowing = F.when(F.col(nbytes) >= stall_bytes, F.col(second))
    scan = OrderedScan(rows, stream, second).add(__before=last_value(flowing, exclusive=True))
    found = scan.df.groupBy(stream).agg(
        F.sum(nbytes).alias("__bytes"),
        F.max(flowing - F.col("__before") - 1).alias("__between"),
        F.min(flowing).alias("__low"),
        F.max(flowing).alias("__high"),
    )
    length = F.greatest(F.col("until") - F.col("first") + 1, F.lit(0))
    ends = [F.col("__low") - F.col("first"), F.col("until") - F.col("__high")]
    totals = playback.join(found, stream, "left").select(
        stream,
        F.coalesce("__bytes", F.lit(0)).alias("total_bytes"),
        length.alias("seconds"),
        F.coalesce(F.greatest("__between", *ends), length).alias("max_stall"),
    )
    some = F.col("seconds") > 0
    enough = some & (
        F.col("total_bytes") * 100 >= F.lit(expected_bps) * F.col("seconds") * MIN_THROUGHPUT_PERCENT
    )
    smooth = some & (F.col("max_stall") <= max_stall)
    return totals.withColumns(
        {"throughput_ok": enough, "stall_ok": smooth, "passed": enough & smooth}
    )


def packet_contiguity(df: DataFrame, head: str) -> DataFrame:
    """Add ``contiguous``: four sync bytes one packet apart somewhere in the captured head.

    One byte is one character in Latin-1, so a single pattern looks at every phase.
    """
    packets = ("G.{%d}" % (PACKET_BYTES - 1)) * (MIN_PACKETS - 1)
    text = F.decode(F.col(head).cast("binary"), "ISO-8859-1")
    long_enough = F.octet_length(head) >= PACKET_BYTES * MIN_PACKETS
    return df.withColumn("contiguous", long_enough & text.rlike(f"(?s){packets}G"))


def scenario_rollup(verdicts: DataFrame, scenario: str, peer: str) -> DataFrame:
    """Per scenario and, with a null scenario, over all: does everything pass?

    ``verdicts`` has one row per (scenario, peer) with ``health_ok``, ``stability_ok``,
    ``contiguous`` and ``upload_positive``; a null counts as failed. The row over all is there even
    for an empty batch, which fails.
    """
    oks = [F.coalesce(c, F.lit(False)) for c in ("health_ok", "stability_ok", "contiguous")]
    passed = oks[0] & oks[1] & oks[2]
    per_scenario = verdicts.groupBy(scenario).agg(
        F.count(peer).alias("peers"),
        F.count_if(passed).alias("peers_passed"),
        F.coalesce(F.bool_or("upload_positive"), F.lit(False)).alias("reciprocates"),
    )
    per_scenario = per_scenario.withColumn(
        "passed",
        (F.col("peers") > 0) & (F.col("peers") == F.col("peers_passed")) & F.col("reciprocates"),
    )
    overall = per_scenario.agg(
        F.coalesce(F.sum("peers"), F.lit(0)).alias("peers"),
        F.coalesce(F.sum("peers_passed"), F.lit(0)).alias("peers_passed"),
        F.coalesce(F.bool_and("reciprocates"), F.lit(False)).alias("reciprocates"),
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"),
        F.lit(True).alias("overall"),
    )
    return per_scenario.withColumn("overall", F.lit(False)).unionByName(
        overall, allowMissingColumns=True
    )
