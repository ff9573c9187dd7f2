"""Sources parsed from table-derived text, and row-wise predicates."""

from pyspark.sql import functions as F

from .. import functions as fn
from .. import sources as src
from .base import EV, LI, WN, Tables, query


@query(
    "s1_ts_packets",
    f"""WITH {EV}
    SELECT event_id, 256 + k AS pid, event_type = 'signup' AS pusi,
      event_type = 'view' AS random_access, event_type = 'error' AS discontinuity,
      event_id % 16 AS counter, CASE WHEN k % 3 <> 0 THEN cents * 100000 END AS pcr,
      188::BIGINT AS bytes, k <> 7 AS aligned FROM ev""",
)
def _(t: Tables):
    """Packets assembled from events as 188-byte records, then read back."""
    def byte(c):
        return F.lpad(F.hex(c), 2, "0")

    pid = 256 + F.col("k")
    pcr = F.col("cents") * 100000
    b1 = F.when(F.col("event_type") == "signup", 0x40).otherwise(0) + F.expr("(256 + k) div 256")
    flags = (
        F.when(F.col("event_type") == "error", 0x80).otherwise(0)
        + F.when(F.col("event_type") == "view", 0x40).otherwise(0)
        + F.when(F.col("k") % 3 != 0, 0x10).otherwise(0)
    )
    text = F.concat(
        F.when(F.col("k") == 7, "48").otherwise("47"),
        byte(b1), byte(pid % 256), byte(0x30 + F.col("event_id") % 16), F.lit("07"), byte(flags),
        F.lpad(F.hex(F.shiftright(pcr, 1)), 8, "0"), byte(F.shiftleft(pcr.bitwiseAND(1), 7)),
        F.lit("00"),
    )
    packets = t.events.select("event_id", F.unhex(F.rpad(text, 376, "F")).alias("packet"))
    fields = src.packet_fields("packet")
    wide = ["pid", "counter", "bytes"]
    return packets.select(
        "event_id", *[(c.cast("bigint") if n in wide else c).alias(n) for n, c in fields.items()]
    )


@query(
    "s2_status_samples",
    f"""WITH {EV}
    SELECT event_id, CASE WHEN k % 5 = 0 THEN 'unknown' ELSE event_type END AS status,
      CASE WHEN k % 7 = 0 THEN 0 ELSE k END AS peers,
      CASE WHEN k % 11 = 0 THEN 0 ELSE cents END AS downloaded, user_id AS uploaded,
      concat_ws(',', CASE WHEN k % 5 = 0 THEN 'status' END,
        CASE WHEN k % 11 = 0 THEN 'downloaded' END) AS missing_fields FROM ev""",
)
def _(t: Tables):
    body = F.concat(
        F.lit('{"uploaded": '), F.col("user_id").cast("string"),
        F.when(F.col("k") % 5 == 0, "").otherwise(
            F.concat(F.lit(', "status": "'), F.col("event_type"), F.lit('"'))
        ),
        F.lit(', "peers": '), F.when(F.col("k") % 7 == 0, "null").otherwise(F.col("k").cast("string")),
        F.when(F.col("k") % 11 == 0, "").otherwise(
            F.concat(F.lit(', "downloaded": '), F.col("cents").cast("string"))
        ),
        F.lit("}"),
    )
    raw = F.when(F.col("k") % 2 == 0, body).otherwise(
        F.concat(F.lit('{"response": '), body, F.lit(', "error": null}'))
    )
    parsed = src.status_from(t.events.select("event_id", raw.alias("raw")), "raw")
    return parsed.drop("raw").withColumn("missing_fields", F.array_join("missing_fields", ","))


@query(
    "s3_native_status",
    f"""WITH {EV}
    SELECT event_id, CASE WHEN k % 4 >= 1 OR (event_type = 'view') OR cents > 25000
      THEN 'dl' ELSE 'idle' END AS status,
      CASE WHEN cents > 25000 THEN cents ELSE 0 END AS downloaded FROM ev""",
)
def _(t: Tables):
    df = t.events.select(
        "event_id",
        (F.col("k") % 4).alias("peers"),
        F.when(F.col("event_type") == "view", F.lit(800)).alias("bitrate"),
        F.when(F.col("cents") > 25000, F.col("cents")).otherwise(0).alias("nbytes"),
    )
    return src.native_status(df, "peers", "bitrate", "nbytes").select("event_id", "status", "downloaded")


def journal(t: Tables):
    """Events as announce records in JSON text."""
    kind = F.expr(
        "case event_type when 'signup' then 'started' when 'purchase' then 'completed' "
        "when 'error' then 'stopped' else 'none' end"
    )
    return t.events.select(
        "event_id",
        F.to_json(
            F.struct(
                F.unix_seconds("ts").alias("ts_unix"),
                F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")).alias("src_ip"),
                (F.lit(8000) + F.col("k")).cast("int").alias("announced_port"),
                F.lpad(F.hex(F.col("k") % 16), 40, "0").alias("infohash_hex"),
                F.lpad(F.hex("user_id"), 40, "0").alias("peer_id_hex"),
                kind.alias("event"),
                F.col("cents").alias("downloaded"),
                F.when(F.col("k") == 3, F.lit("18446744073709551615").cast("decimal(20,0)"))
                .otherwise(F.col("k").cast("decimal(20,0)")).alias("left"),
                F.lit(0).alias("uploaded"),
            )
        ).alias("raw"),
    )


@query(
    "s4_announces",
    f"""WITH {EV}
    SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts_unix,
      '10.0.0.' || (user_id % 256) AS src_ip, 8000 + k AS announced_port,
      lpad(upper(to_hex(k % 16)), 40, '0') AS infohash_hex,
      CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed'
        WHEN 'error' THEN 'stopped' ELSE 'none' END AS event,
      cents AS downloaded, CASE WHEN k <> 3 THEN k END AS remaining FROM ev""",
)
def _(t: Tables):
    return src.announces_from(journal(t), "raw").select(
        "event_id", "ts_unix", "src_ip", F.col("announced_port").cast("bigint"), "infohash_hex",
        "event", F.col("downloaded").cast("bigint").alias("downloaded"),
        F.when(F.col("left_known"), F.col("left").cast("bigint")).alias("remaining"),
    )


@query(
    "s5_process_samples",
    f"""WITH {EV}
    SELECT user_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS elapsed_s,
      CASE WHEN k % 10 <> 0 THEN CAST(cents AS DOUBLE) END AS rss_kb,
      CASE WHEN event_type <> 'error' THEN CAST(k AS DOUBLE) END AS threads FROM ev""",
)
def _(t: Tables):
    blank = [c for c in src.samples.PROCESS_COLUMNS if c not in ("elapsed_s", "rss_kb", "threads")]
    cells = t.events.select(
        "user_id",
        F.unix_seconds("ts").cast("string").alias("elapsed_s"),
        F.when(F.col("k") % 10 == 0, "").otherwise(F.concat(F.lit(" "), F.col("cents").cast("string"))).alias("rss_kb"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("k").cast("string")).alias("threads"),
        *[F.lit("").alias(c) for c in blank],
    )
    return src.process_samples_from(cells).select("user_id", "elapsed_s", "rss_kb", "threads")


@query(
    "s6_oplog",
    f"""WITH {EV}
    SELECT event_id, CASE WHEN k % 9 <> 0 THEN strftime(ts, '%H:%M:%S') || '.000' END AS time,
      CASE WHEN k % 9 <> 0 THEN event_type END AS tag,
      CASE WHEN k % 9 = 0 THEN 'plain ' || k ELSE 'user ' || user_id || ' [k] ' || k END AS message
    FROM ev""",
)
def _(t: Tables):
    line = F.when(F.col("k") % 9 == 0, F.concat(F.lit("plain "), F.col("k").cast("string"))).otherwise(
        F.concat(
            F.date_format("ts", "HH:mm:ss"), F.lit(".000 ["), F.col("event_type"), F.lit("] user "),
            F.col("user_id").cast("string"), F.lit(" [k] "), F.col("k").cast("string"),
        )
    )
    return src.oplog_from(t.events.select("event_id", line.alias("line")), "line").drop("line")


@query(
    "p1_chunk_address",
    f"""WITH {LI}, o AS (SELECT *, COALESCE(CAST(SUM(nbytes) OVER (PARTITION BY peer
      ORDER BY ts, piece, chunk, cents, part, nbytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      AS BIGINT), 0) AS off FROM li)
    SELECT peer, nbytes, off AS "offset", 1000 + off // 160 AS piece, (off % 160) // 16 AS chunk,
      off % 160 AS begin FROM o""",
)
def _(t: Tables):
    writes = t.lineitem.select("peer", "nbytes", "ts", *[F.col(c).alias(f"o_{c}") for c in ("piece", "chunk", "cents", "part")])
    out = fn.chunk_address(
        writes, "peer", ["ts", "o_piece", "o_chunk", "o_cents", "o_part", "nbytes"], "nbytes", 160, 16, 1000
    )
    return out.select("peer", "nbytes", "offset", "piece", "chunk", "begin")


@query(
    "p2_geometry_ok",
    """WITH g AS (SELECT p_partkey, CAST(p_size AS BIGINT) * p_size * 8192 AS pl,
        CASE WHEN p_size % 7 = 0 THEN 8192 ELSE 16384 END AS cl FROM part)
    SELECT p_partkey, cl = 16384 AND pl <= 8388608 AND pl % 16384 = 0 AND pl // 16384 <= 65535 AS ok FROM g""",
)
def _(t: Tables):
    size = F.col("p_size").cast("bigint")
    return t.part.select(
        "p_partkey",
        fn.geometry_ok(size * size * 8192, F.when(F.col("p_size") % 7 == 0, 8192).otherwise(16384)).alias("ok"),
    )


@query(
    "p3_window_normalize",
    """WITH w AS (SELECT p_partkey AS peer, CASE WHEN p_size % 5 <> 0 THEN p_partkey - 100 END AS mn,
        CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN -1 ELSE p_partkey + p_size - 20 END AS mx,
        CASE WHEN p_size % 3 <> 0 THEN p_partkey + (p_size % 13) * 10 - 50 END AS pos FROM part),
      n AS (SELECT peer, mx, pos, least(greatest(COALESCE(mn, 0), 0), mx) AS mn FROM w WHERE mx >= 0)
    SELECT peer, mn AS min_piece, mx AS max_piece,
      greatest(least(COALESCE(pos, mx), mx), mn) AS position FROM n""",
)
def _(t: Tables):
    w = t.part.select(
        F.col("p_partkey").alias("peer"),
        F.expr("case when p_size % 5 <> 0 then p_partkey - 100 end").alias("min_piece"),
        F.expr("case when p_size % 7 = 0 then null when p_size % 11 = 0 then -1 else p_partkey + p_size - 20 end").alias("max_piece"),
        F.expr("case when p_size % 3 <> 0 then p_partkey + (p_size % 13) * 10 - 50 end").alias("position"),
    )
    return fn.window_normalize(w, "min_piece", "max_piece", "position")


@query(
    "p4_window_or_null",
    """WITH w AS (SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 4294967295 WHEN p_size % 7 = 0 THEN 0
        ELSE p_partkey END AS mn, p_partkey + p_size - 10 AS mx FROM part),
      v AS (SELECT *, mn NOT IN (0, 4294967295) AND mx NOT IN (0, 4294967295) AND mn <= mx AS ok FROM w)
    SELECT p_partkey, CASE WHEN ok THEN mn END AS min_piece, CASE WHEN ok THEN mx END AS max_piece FROM v""",
)
def _(t: Tables):
    low = F.expr("case when p_size % 6 = 0 then 4294967295 when p_size % 7 = 0 then 0 else p_partkey end")
    w = t.part.select("p_partkey", fn.window_or_null(low, F.expr("p_partkey + p_size - 10")).alias("w"))
    return w.select("p_partkey", F.col("w.min").alias("min_piece"), F.col("w.max").alias("max_piece"))


@query(
    "p5_live_start_piece",
    f"WITH {WN} SELECT peer, greatest(greatest(position - 40, 0), min_piece - 30) AS start_piece FROM wn",
)
def _(t: Tables):
    return t.windows.select(
        "peer", fn.live_start_piece(F.col("min_piece") - 30, "position", F.lit(40)).alias("start_piece")
    )


@query(
    "p6_prefetch_pieces",
    """WITH r AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size * 1000 END AS tm,
        CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey * 100 END AS br, p_size * 1000 - 2000 AS pl FROM part)
    SELECT p_partkey, CASE WHEN br IS NULL THEN CASE WHEN tm = 0 THEN 32 ELSE 8 END
      ELSE (tm * br + 8000 * greatest(pl - 96, 1) - 1) // (8000 * greatest(pl - 96, 1)) + 2 END AS pieces FROM r""",
)
def _(t: Tables):
    return t.part.select(
        "p_partkey",
        fn.prefetch_pieces(
            F.expr("case when p_size % 4 = 0 then 0 else p_size * 1000 end"),
            F.expr("case when p_size % 5 = 0 then null else p_partkey * 100 end"),
            F.expr("cast(p_size as bigint) * 1000 - 2000"), 96,
        ).alias("pieces"),
    )


_PREFIXES = [
    "10.1.2.", "100.64.0.", "100.128.0.", "127.0.0.", "169.254.7.", "172.16.3.", "172.32.3.",
    "192.0.2.", "192.168.9.", "198.51.100.", "203.0.113.", "224.0.0.", "255.255.255.", "0.0.0.", "8.8.8.",
]
_SQL_PREFIXES = "[" + ", ".join(f"'{p}'" for p in _PREFIXES) + "]"


@query(
    "p7_address_class",
    f"""WITH {EV}, a AS (SELECT event_id, ({_SQL_PREFIXES})[CAST(k % 15 AS INTEGER) + 1] || (event_id % 300) AS ip FROM ev),
      o AS (SELECT *, CAST(split_part(ip, '.', 1) AS INT) AS a, CAST(split_part(ip, '.', 2) AS INT) AS b,
        CAST(split_part(ip, '.', 3) AS INT) AS c, CAST(split_part(ip, '.', 4) AS INT) AS d FROM a),
      c AS (SELECT event_id, ip, CASE WHEN d > 255 THEN 'invalid' WHEN ip = '0.0.0.0' THEN 'unspecified'
        WHEN ip = '255.255.255.255' THEN 'broadcast' WHEN a = 10 THEN 'private'
        WHEN a = 172 AND b BETWEEN 16 AND 31 THEN 'private' WHEN a = 192 AND b = 168 THEN 'private'
        WHEN a = 100 AND b BETWEEN 64 AND 127 THEN 'cgnat' WHEN a = 127 THEN 'loopback'
        WHEN a = 169 AND b = 254 THEN 'link_local' WHEN a BETWEEN 224 AND 239 THEN 'multicast'
        WHEN (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)
          THEN 'documentation' ELSE 'global' END AS address_class FROM o)
    SELECT event_id, ip, address_class, address_class IN ('global', 'cgnat') AS tracker_allowed,
      address_class IN ('global', 'private', 'loopback', 'cgnat') AS transport_opt_in FROM c""",
)
def _(t: Tables):
    prefix = F.element_at(F.array(*[F.lit(p) for p in _PREFIXES]), (F.col("k") % 15 + 1).cast("int"))
    df = t.events.select("event_id", F.concat(prefix, (F.col("event_id") % 300).cast("string")).alias("ip"))
    df = fn.address_class(df, "ip").withColumnRenamed("allowed", "tracker_allowed")
    return fn.address_class(df, "ip", "transport", opt_in=True).withColumnRenamed("allowed", "transport_opt_in")


# Both families, by the event's counter: beginning, and class of whatever follows it.
_SIX = [
    ("2001:4860:4860::", "global"), ("fc00::", "private"), ("fdff:1:2:3:4:5:6:", "private"), ("fe80::1:", "link_local"),
    ("febf:ffff::", "link_local"), ("fec0::", "global"), ("ff02::", "multicast"), ("FF0E:0:0:0:0:0:0:", "multicast"),
    ("2001:db8::1:2:3:4:5:6:", "invalid"), ("1:2:3:4:5:6:", "invalid"), ("::1:", "global"), ("::ffff:10.1.2.", "private"),
    ("::ffff:8.8.8.", "global"), ("0:0:0:0:0:ffff:7f00:", "loopback"), ("::ffff:0:8.8.8.", "global"), ("10.9.8.", "private"), ("8.8.4.", "global"),
    ("1::2::", "invalid"), ("12345::", "invalid"),
]
_SIX_SQL = ", ".join(f"('{text}', '{kind}')" for text, kind in _SIX)


@query(
    "p7_address_class_both",
    f"""WITH {EV}, p AS (SELECT text, kind, row_number() OVER () - 1 AS n FROM (VALUES {_SIX_SQL}) v(text, kind)),
      a AS (SELECT event_id, text || (event_id % 100) AS ip, kind FROM ev JOIN p ON n = (k + event_id) % {len(_SIX)}),
      c AS (SELECT event_id, ip, kind AS address_class FROM a)
    SELECT event_id, ip, address_class, address_class IN ('global', 'cgnat') AS tracker_allowed FROM c""",
)
def _(t: Tables):
    prefix = F.element_at(F.array(*[F.lit(p) for p, _ in _SIX]), ((F.col("k") + F.col("event_id")) % len(_SIX) + 1).cast("int"))
    df = t.events.select("event_id", F.concat(prefix, (F.col("event_id") % 100).cast("string")).alias("ip"))
    return fn.address_class(df, "ip").withColumnRenamed("allowed", "tracker_allowed")


@query(
    "p8_tracker_class",
    """WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN replace(replace(url, 'https://', 'udp://'), 'http://', 'udp://')
        WHEN 1 THEN url || repeat('x', 250) WHEN 2 THEN replace(url, '://', ':') WHEN 3 THEN '://' || url
        WHEN 4 THEN split_part(url, '://', 1) || '://' ELSE url END AS url FROM pages)
    SELECT page_id, url, CASE WHEN strlen(url) > 256 THEN 'too_long' WHEN strpos(url, '://') <= 1 THEN 'malformed'
      WHEN length(url) < strpos(url, '://') + 3 THEN 'malformed' WHEN starts_with(url, 'udp://') THEN 'udp'
      ELSE 'other_scheme' END AS class FROM u""",
)
def _(t: Tables):
    url = F.expr(
        "case page_id % 6 when 0 then replace(replace(url, 'https://', 'udp://'), 'http://', 'udp://') "
        "when 1 then url || repeat('x', 250) when 2 then replace(url, '://', ':') when 3 then '://' || url "
        "when 4 then split_part(url, '://', 1) || '://' else url end"
    )
    return t.read("pages").select("page_id", url.alias("url")).withColumn("class", fn.tracker_class("url"))


@query(
    "p9_stream_key",
    f"""WITH {EV}, s AS (SELECT event_id,
        CASE WHEN k % 5 = 0 THEN CASE WHEN k % 10 = 0 THEN 'bad' ELSE upper(sha1('c' || user_id)) END WHEN k % 5 = 1 THEN '' END AS cid,
        CASE WHEN k % 7 = 0 THEN CASE WHEN k % 14 = 0 THEN 'zz' ELSE sha1('h' || user_id) END END AS ih,
        CASE WHEN k % 11 = 0 THEN sha1('i' || user_id) END AS id,
        CASE WHEN k % 3 = 0 THEN 'http://x/' || k END AS url,
        CASE WHEN k % 2 = 0 THEN sha1('m' || user_id) END AS mg FROM ev)
    SELECT event_id,
      CASE WHEN cid <> '' THEN 'content_id' WHEN ih <> '' THEN 'infohash' WHEN id <> '' THEN 'content_id'
        WHEN url <> '' THEN 'url' WHEN mg <> '' THEN 'magnet' END AS kind,
      CASE WHEN cid <> '' THEN CASE WHEN length(cid) = 40 THEN 'cid:' || lower(cid) END
        WHEN ih <> '' THEN CASE WHEN length(ih) = 40 THEN ih END WHEN id <> '' THEN 'cid:' || id
        WHEN url <> '' THEN url WHEN mg <> '' THEN mg END AS key,
      CASE WHEN cid <> '' THEN CASE WHEN length(cid) <> 40 THEN 'invalid content_id' END
        WHEN ih <> '' THEN CASE WHEN length(ih) <> 40 THEN 'invalid infohash' END
        WHEN id <> '' OR url <> '' OR mg <> '' THEN NULL ELSE 'missing selector' END AS error FROM s""",
)
def _(t: Tables):
    def digest(letter):
        return f"sha1(concat('{letter}', cast(user_id as string)))"

    sel = t.events.select(
        "event_id",
        F.expr(f"case when k % 5 = 0 then case when k % 10 = 0 then 'bad' else upper({digest('c')}) end when k % 5 = 1 then '' end").alias("cid"),
        F.expr(f"case when k % 7 = 0 then case when k % 14 = 0 then 'zz' else {digest('h')} end end").alias("ih"),
        F.expr(f"case when k % 11 = 0 then {digest('i')} end").alias("id"),
        F.expr("case when k % 3 = 0 then concat('http://x/', cast(k as string)) end").alias("url"),
        F.expr(f"case when k % 2 = 0 then {digest('m')} end").alias("mg"),
    )
    return sel.select("event_id", fn.stream_key("cid", "ih", "id", "url", "mg").alias("s")).select("event_id", "s.*")


_WS = r"' \t\n\r' || chr(11) || chr(12) || chr(133) || chr(160)".replace(r"\t", "' || chr(9) || '").replace(r"\n", "' || chr(10) || '").replace(r"\r", "' || chr(13) || '")


@query(
    "p10_bounded_text",
    f"""WITH d AS (SELECT doc_id, trim(text, {_WS}) AS s FROM documents),
      c AS (SELECT doc_id, CASE WHEN s <> '' THEN substring(s, 1, CAST(list_max(list_filter(range(0, 257),
        lambda n: strlen(substring(s, 1, CAST(n AS BIGINT))) <= 256)) AS BIGINT)) END AS title FROM d)
    SELECT doc_id, title, strlen(title) AS title_bytes FROM c""",
)
def _(t: Tables):
    return t.read("documents").select("doc_id", fn.bounded_text("text", 256).alias("title")).withColumn(
        "title_bytes", F.octet_length("title").cast("bigint")
    )


@query(
    "p11_byte_range",
    f"""WITH {EV}, s AS (SELECT event_id, CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN 'bytes=' || k || '-' || (k + 100)
        WHEN 2 THEN 'bytes=' || cents || '-' WHEN 3 THEN 'bytes=-' || k WHEN 4 THEN 'bytes=-0'
        WHEN 5 THEN 'bytes=9-2' WHEN 6 THEN 'bytes=0-1,3-4' WHEN 7 THEN 'bytes=-' WHEN 8 THEN 'items=0-5'
        ELSE 'bytes= ' || user_id || ' - ' || cents || ' ' END AS spec, k, cents, user_id FROM ev)
    SELECT event_id, spec,
      CASE k % 10 WHEN 1 THEN 'satisfiable' WHEN 2 THEN CASE WHEN cents < 20000 THEN 'satisfiable' ELSE 'unsatisfiable' END
        WHEN 3 THEN 'satisfiable' WHEN 4 THEN 'unsatisfiable' WHEN 5 THEN 'unsatisfiable'
        WHEN 9 THEN CASE WHEN user_id <= cents AND user_id < 20000 THEN 'satisfiable' ELSE 'unsatisfiable' END ELSE 'full' END AS outcome,
      CASE k % 10 WHEN 1 THEN k WHEN 2 THEN CASE WHEN cents < 20000 THEN cents END WHEN 3 THEN 20000 - k
        WHEN 9 THEN CASE WHEN user_id <= cents AND user_id < 20000 THEN user_id END END AS first_byte,
      CASE k % 10 WHEN 1 THEN k + 100 WHEN 2 THEN CASE WHEN cents < 20000 THEN 19999 END WHEN 3 THEN 19999
        WHEN 9 THEN CASE WHEN user_id <= cents AND user_id < 20000 THEN least(cents, 19999) END END AS last_byte FROM s""",
)
def _(t: Tables):
    spec = F.expr(
        "case k % 10 when 0 then null when 1 then 'bytes=' || k || '-' || (k + 100) when 2 then 'bytes=' || cents || '-' "
        "when 3 then 'bytes=-' || k when 4 then 'bytes=-0' when 5 then 'bytes=9-2' when 6 then 'bytes=0-1,3-4' "
        "when 7 then 'bytes=-' when 8 then 'items=0-5' else 'bytes= ' || user_id || ' - ' || cents || ' ' end"
    )
    df = t.events.select("event_id", spec.alias("spec")).withColumn("r", fn.byte_range("spec", F.lit(20000)))
    return df.select(
        "event_id", "spec", "r.outcome", F.col("r.start").alias("first_byte"), F.col("r.end").alias("last_byte")
    )


@query(
    "p12_name_ok",
    """WITH n AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_')
        WHEN 2 THEN '..' ELSE repeat('a', p_size + 20) END AS name FROM part)
    SELECT p_partkey, name, length(name) BETWEEN 1 AND 64 AND name NOT IN ('.', '..')
      AND regexp_full_match(name, '[A-Za-z0-9._-]+') AS ok FROM n""",
)
def _(t: Tables):
    name = F.expr(
        "case p_size % 4 when 0 then p_name when 1 then replace(p_name, ' ', '_') when 2 then '..' "
        "else repeat('a', p_size + 20) end"
    )
    return t.part.select("p_partkey", name.alias("name")).withColumn("ok", fn.name_ok("name"))


@query(
    "p13_vod_eligible",
    """SELECT p_partkey, p_size % 4 > 0 AND p_size - 10 > 0 AND p_brand <> 'Brand#3' AS ok FROM part""",
)
def _(t: Tables):
    hashes = F.expr("slice(array(sha1('a'), sha1('b'), sha1('c')), 1, p_size % 4)")
    return t.part.select(
        "p_partkey", fn.vod_eligible(hashes, F.col("p_size") - 10, F.col("p_brand") == "Brand#3").alias("ok")
    )
