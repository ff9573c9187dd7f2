import json

import pytest
from compare import rows
from pyspark.sql import functions as F

from streamscope import sources as src
from streamscope.operators import delivery, health, media, swarm, trend


def packet(pid, counter=0, pcr=None, flag=False, access=False, pusi=False, sync=0x47):
    control = 0x10 | counter
    field = b""
    if pcr is not None or flag or access:
        control |= 0x20
        flags = (0x80 if flag else 0) | (0x40 if access else 0) | (0x10 if pcr is not None else 0)
        body = bytes([flags])
        if pcr is not None:
            body += (pcr >> 1).to_bytes(4, "big") + bytes([(pcr & 1) << 7 | 0x7E, 0])
        field = bytes([len(body)]) + body
    head = bytes([sync, (0x40 if pusi else 0) | pid >> 8, pid & 0xFF, control]) + field
    return head + b"\xff" * (188 - len(head))


def test_packets(spark, tmp_path):
    top = (1 << 33) - 1
    data = [packet(256 + i % 2, i % 16, top if i == 3 else i * 1000, i == 5, i == 7, i == 9) for i in range(200)]
    data.append(packet(0x1FFF, 3))
    data.append(packet(256, sync=0x48))
    path = tmp_path / "a.ts"
    path.write_bytes(b"".join(data))
    got = src.read_ts_packets(spark, str(path), "a").orderBy("pkt").collect()
    assert len(got) == 202 and [r.pkt for r in got] == list(range(202))
    assert got[3].pcr == top and got[5].discontinuity and got[7].random_access and got[9].pusi
    assert [r.pid for r in got[:2]] == [256, 257] and got[200].pid == 0x1FFF and got[200].pcr is None
    assert got[10].counter == 10 and all(r.aligned for r in got[:201]) and not got[201].aligned
    clock = media.pcr_segments(spark.createDataFrame(got[:200]), "stream_id", ["pkt"], "pid", "pcr", "discontinuity")
    assert {r.segment for r in clock.filter("elapsed is not null").collect()} >= {0, 1}
    inventory = trend.packet_inventory(spark.createDataFrame(got), ["stream_id", "pid"], ["pkt"], "counter")
    assert sum(r.packets for r in inventory.collect()) == 202


def test_contiguity(spark):
    good = b"xyz" + b"".join(packet(1) for _ in range(4))
    broken = b"".join(packet(1) + b"?" for _ in range(9))
    df = spark.createDataFrame([(0, good), (1, broken), (2, packet(1) * 3), (3, b"")], "i int, head binary")
    got = health.packet_contiguity(df, "head").orderBy("i").collect()
    assert [r.contiguous for r in got] == [True, False, False, False]


def test_status(spark, tmp_path):
    bodies = [
        {"response": {"status": "dl", "peers": 3, "downloaded": 10, "uploaded": 0}, "error": None},
        {"status": "idle", "peers": None, "downloaded": 5},
        {"response": None, "peers": -1, "uploaded": 2},
        {"response": {}},
    ]
    (tmp_path / "s.json").write_text("\n".join(json.dumps(b) for b in bodies))
    got = src.read_status_samples(spark, str(tmp_path / "s.json")).collect()
    assert [tuple(r[1:5]) for r in got] == [("dl", 3, 10, 0), ("idle", 0, 5, 0), ("unknown", 0, 0, 2), ("unknown", 0, 0, 0)]
    assert [r.missing_fields for r in got] == [
        [], ["uploaded"], ["status", "downloaded"], ["status", "peers", "downloaded", "uploaded"],
    ]


def announce(**kw):
    base = dict(ts_unix=1, src_ip="10.0.0.1", announced_port=1, infohash_hex="aa", peer_id_hex="01",
                event="started", downloaded=0, left=0, uploaded=0)
    return {**base, **kw}


def test_announces(spark, tmp_path):
    data = [
        announce(left=2**64 - 1), announce(ts_unix=2, peer_id_hex="02", event="completed", left=7),
        announce(ts_unix=3, event="stopped"), announce(ts_unix=4, peer_id_hex="03", left=9),
    ]
    (tmp_path / "j.json").write_text(json.dumps(data, indent=1))
    got = src.read_announces(spark, str(tmp_path / "j.json"))
    assert got.count() == 4 and [r.left_known for r in got.orderBy("ts_unix").collect()] == [False, True, True, True]
    members = swarm.swarm_members(got, "infohash_hex", "peer_id_hex", "event", ["ts_unix"])
    assert rows(members) == [("aa", "02"), ("aa", "03")]
    roles = swarm.swarm_seed_leech(got, "infohash_hex", "peer_id_hex", "event", "left", ["ts_unix"])
    assert rows(roles) == [("aa", 1, 1)]


def test_samples(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",".join(src.samples.PROCESS_COLUMNS) + "\n1,0,100,,,4,9,,,\n2,60, 160 ,x,,5,,,,\n3,120,n/a,,,4,9,,,\n")
    got = src.read_process_samples(spark, str(tmp_path / "p.csv"))
    assert [r.rss_kb for r in got.collect()] == [100.0, 160.0, None]
    fit = trend.memory_trend(got.withColumn("run", F.lit("r")), "run", "elapsed_s", "rss_kb").first()
    assert (fit.first, fit.last, fit.delta, fit.slope) == (100.0, 160.0, 60.0, 1.0) and fit.tail_slope is None
    (tmp_path / "s.csv").write_text(",".join(src.samples.SOAK_COLUMNS) + "\n1,0,s1,200,1,3,,,,10\n2,2,s1,000,1,,,,,\n3,4,s1,200,1,5,,,,12\n")
    soak = src.read_soak_streams(spark, str(tmp_path / "s.csv"))
    live = trend.decode_liveness(soak, "id", "elapsed_s", "frames", "http_code", "peers").first()
    assert (live.frames_first, live.frames_last, live.codes, live.peers_max, live.state) == (10.0, 12.0, "000,200", 5.0, "DECODING")


def test_oplog(spark, tmp_path):
    (tmp_path / "n1.log").write_text("01:02:03.004 [net] 4 parcels asked for again [north]\nplain\n")
    got = src.read_oplog(spark, str(tmp_path / "n1.log")).collect()
    assert [tuple(r) for r in got] == [
        ("n1.log", "01:02:03.004", "net", "4 parcels asked for again [north]"), ("n1.log", None, None, "plain"),
    ]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", True), (None, False)], "scenario string, passed boolean")
    src.write_verdicts(df, str(tmp_path / "v"))
    assert rows(spark.read.schema(df.schema).json(str(tmp_path / "v"))) == rows(df)
    with pytest.raises(Exception):
        src.write_verdicts(df, str(tmp_path / "v"))
    segments = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 3.5), ("b", 5, 1.0)], "s string, seq bigint, d double")
    lines = src.render_media_playlist(segments, "s", "seq", "d", live=False)
    src.write_lines(lines, "s", "line_no", "line", str(tmp_path / "m"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "m" / "s=a").glob("part-*")))
    assert text == (
        "#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:4\n#EXT-X-MEDIA-SEQUENCE:0\n"
        "#EXTINF:2.000,\nseg0.ts\n#EXTINF:3.500,\nseg1.ts\n#EXT-X-ENDLIST\n"
    )


def test_aggregates_run_on_streams(spark, tmp_path):
    """Single-level aggregates take a stream as they take a table."""
    from conftest import SF

    table = spark.read.parquet(f"{SF}/lineitem.parquet")
    live = (
        spark.readStream.schema(table.schema).option("pathGlobFilter", "lineitem.parquet").parquet(SF)
    )
    cases = {
        "completeness": lambda d: delivery.piece_completeness(d, "l_suppkey", "l_orderkey", "l_linenumber", 8),
        "window": lambda d: delivery.piece_window(d, "l_suppkey", "l_orderkey"),
        "header": lambda d: delivery.piece_header(d, ["l_orderkey"], "l_tax", ["l_shipdate", "l_linenumber", "l_tax"]),
        "stats": lambda d: delivery.source_stats(d, "l_suppkey", "l_partkey", "l_quantity", "l_quantity", approximate=True),
        "funnel": lambda d: swarm.connect_funnel(d, "l_suppkey", "l_returnflag", ["A", "N", "R"]),
        "reachable": lambda d: swarm.reachable(d.withColumn("i", F.col("l_tax") > 0), "l_suppkey", "i"),
        "oplog": lambda d: trend.oplog_counts(d, ["l_suppkey"], "l_returnflag", {"a": "A"}),
    }
    for name, build in cases.items():
        run = build(live).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        run.awaitTermination()
        assert spark.table(name).exceptAll(build(table)).count() == 0
        assert spark.table(name).count() == build(table).count()
