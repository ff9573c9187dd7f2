"""Status and soak samples: lenient readers that never fail on a bad cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values.
STATUS_FIELDS = ["status", "peers", "downloaded", "uploaded"]
NATIVE_FIELDS = ["peers", "uploaded"]
PROCESS_COLUMNS = [
    "ts_unix", "elapsed_s", "rss_kb", "hwm_kb", "pss_kb", "threads", "fds",
    "mem_allocated", "mem_resident", "mem_retained",
]
SOAK_COLUMNS = [
    "ts_unix", "elapsed_s", "id", "http_code", "clients", "peers", "bitrate", "buffer_ms",
    "uploaded", "frames",
]
SOAK_TEXT = ["id", "http_code"]


def absent(body: Column, expected: Sequence[str]) -> Column:
    """Expected names without a key in the JSON object; a key holding null is present."""
    wanted = F.array(*[F.lit(n) for n in expected])
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    return F.filter(wanted, lambda n: ~F.array_contains(keys, n))


def status_from(df: DataFrame, raw: str, expected: Sequence[str] = STATUS_FIELDS) -> DataFrame:
    """Parse a JSON status column: status, peers, downloaded, uploaded, missing_fields."""
    body = F.coalesce(F.get_json_object(raw, "$.response"), F.col(raw))
    parsed = F.from_json(body, "status string, peers bigint, downloaded bigint, uploaded bigint")
    df = df.withColumns({"__body": body}).withColumn("__p", parsed)

    def count(name: str) -> Column:
        return F.greatest(F.coalesce(F.col(f"__p.{name}"), F.lit(0)), F.lit(0)).cast("bigint")

    return df.withColumns(
        {
            "status": F.coalesce(F.col("__p.status"), F.lit("unknown")),
            "peers": count("peers"),
            "downloaded": count("downloaded"),
            "uploaded": count("uploaded"),
            "missing_fields": absent(F.col("__body"), expected),
        }
    ).drop("__body", "__p")


def read_status_samples(
    spark: SparkSession, path: str, expected: Sequence[str] = STATUS_FIELDS, stream: bool = False
) -> DataFrame:
    """Files with one JSON status body per line."""
    reader = spark.readStream if stream else spark.read
    return status_from(reader.text(path).withColumnRenamed("value", "raw"), "raw", expected)


def native_status(df: DataFrame, peers: str, bitrate: str, nbytes: str) -> DataFrame:
    """Samples without a status field: ``dl`` while a peer is seen or bytes move, else ``idle``."""
    moving = (F.col(peers) >= 1) | (F.col(bitrate) > 0) | (F.col(nbytes) > 0)
    return df.withColumns(
        {
            "status": F.when(moving, "dl").otherwise("idle"),
            "downloaded": F.coalesce(F.col(nbytes), F.lit(0)).cast("bigint"),
        }
    )


def _numbers(df: DataFrame, columns: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *[
            F.col(c) if c in text else F.trim(F.col(c)).try_cast("double").alias(c)
            for c in columns
        ]
    )


def process_samples_from(df: DataFrame) -> DataFrame:
    """String cells to doubles; a cell that is no number becomes null."""
    extra = [c for c in df.columns if c not in PROCESS_COLUMNS]
    return _numbers(df, [*extra, *PROCESS_COLUMNS], extra)


def soak_streams_from(df: DataFrame) -> DataFrame:
    extra = [c for c in df.columns if c not in SOAK_COLUMNS]
    return _numbers(df, [*extra, *SOAK_COLUMNS], [*extra, *SOAK_TEXT])


def _csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_process_samples(spark: SparkSession, path: str) -> DataFrame:
    return process_samples_from(_csv(spark, path, PROCESS_COLUMNS))


def read_soak_streams(spark: SparkSession, path: str) -> DataFrame:
    return soak_streams_from(_csv(spark, path, SOAK_COLUMNS))
