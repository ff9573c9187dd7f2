"""How a request names the stream it wants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
HEX_ID = r"^[0-9a-fA-F]{40}$"
NAME = r"^[A-Za-z0-9._-]{1,64}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stream_key(
    content_id: Column | str,
    infohash: Column | str,
    id: Column | str,
    url: Column | str,
    magnet: Column | str,
) -> Column:
    """Struct of ``kind``, ``key`` and ``error``: the first non-empty selector decides alone.

    ``magnet`` is the info hash already taken out of the magnet link; ``url`` is used as it is.
    """

    def hashed(value: Column, kind: str, label: str, prefix: str = "") -> Column:
        good = value.rlike(HEX_ID)
        return F.struct(
            F.lit(kind).alias("kind"),
            F.when(good, F.concat(F.lit(prefix), F.lower(value))).alias("key"),
            F.when(~good, F.lit(f"invalid {label}")).alias("error"),
        )

    def given(value: Column) -> Column:
        return value.isNotNull() & (value != "")

    content_id, infohash, id = _col(content_id), _col(infohash), _col(id)
    url, magnet = _col(url), _col(magnet)
    none = F.lit(None).cast("string")
    return (
        F.when(given(content_id), hashed(content_id, "content_id", "content_id", "cid:"))
        .when(given(infohash), hashed(infohash, "infohash", "infohash"))
        .when(given(id), hashed(id, "content_id", "id", "cid:"))
        .when(
            given(url),
            F.struct(F.lit("url").alias("kind"), url.alias("key"), none.alias("error")),
        )
        .when(given(magnet), hashed(magnet, "magnet", "magnet"))
        .otherwise(
            F.struct(none.alias("kind"), none.alias("key"), F.lit("missing selector").alias("error"))
        )
    )


def name_ok(name: Column | str) -> Column:
    """Names that are safe as one path component."""
    name = _col(name)
    return F.coalesce(name.rlike(NAME) & ~name.isin(".", ".."), F.lit(False))
