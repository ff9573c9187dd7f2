import random

from compare import rows
from pyspark.sql import functions as F

from streamscope import functions as fn
from streamscope.operators import access, delivery, health, media, peers, swarm


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_byte_range(spark):
    cases = {
        None: ("full", None, None),
        "bytes=0-9": ("satisfiable", 0, 9),
        "bytes=5-": ("satisfiable", 5, 99),
        "bytes=-5": ("satisfiable", 95, 99),
        "bytes=-500": ("satisfiable", 0, 99),
        "bytes=-0": ("unsatisfiable", None, None),
        "bytes=9-2": ("unsatisfiable", None, None),
        "bytes=100-": ("unsatisfiable", None, None),
        "bytes=90-500": ("satisfiable", 90, 99),
        "bytes=0-1,3-4": ("full", None, None),
        "bytes=-": ("full", None, None),
        "bytes=+-5": ("full", None, None),
        "bytes=+3-+7": ("satisfiable", 3, 7),
        "bytes=0007-": ("satisfiable", 7, 99),
        "bytes=99999999999999999999-": ("full", None, None),
        "bytes=18446744073709551615-": ("unsatisfiable", None, None),
        "items=0-5": ("full", None, None),
        "bytes= 1 - 2 ": ("satisfiable", 1, 2),
        "bytes=a-b": ("full", None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "spec string")
    for r in df.select("spec", fn.byte_range("spec", F.lit(100)).alias("r")).collect():
        assert tuple(r.r) == cases[r.spec], r.spec


def test_bounded_text(spark):
    rng = random.Random(1)
    texts = ["", "  ", "　a ", *["".join(rng.choice("aé漢🎬 ") for _ in range(rng.randrange(1, 30))) for _ in range(200)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in (1, 4, 9):
        for r in df.select("t", fn.bounded_text("t", limit).alias("c")).collect():
            want = r.t.strip().encode()[:limit].decode("utf-8", "ignore") if r.t.strip() else None
            assert r.c == want, (r.t, limit)
    many = spark.createDataFrame([(["x", " ", "y" * 200, *["z"] * 40],)], "c array<string>")
    cut = many.select(fn.bounded_categories("c").alias("c")).first().c
    assert cut[:2] == ["x", "y" * 128] and len(cut) == 32


def test_windows_and_geometry(spark):
    assert one(spark, fn.prefetch_pieces("t", "b", "p", 0), t=1000, b=8_000_000, p=1_000_000) == 3
    assert one(spark, fn.prefetch_pieces("t", F.lit(None).cast("bigint"), "p", 0), t=0, p=1) == 32
    assert one(spark, fn.prefetch_pieces("t", F.lit(None).cast("bigint"), "p", 0), t=5, p=1) == 8
    assert one(spark, fn.live_start_piece("m", "p", F.lit(10)), m=3, p=5) == 3
    assert one(spark, fn.window_or_null("a", "b"), a=0, b=9) is None
    assert one(spark, fn.geometry_ok("p", "c"), p=1 << 20, c=16384)
    assert not one(spark, fn.geometry_ok("p", "c"), p=(8 << 20) + 16384, c=16384)
    assert one(spark, fn.vod_eligible(F.array(F.lit("h")), "n", "m"), n=5, m=False)


def test_tracker_class(spark):
    cases = {
        "udp://a:1": "udp", "UDP://a": "other_scheme", "http://a": "other_scheme", "://a": "malformed",
        "udp://": "malformed", "udp:a": "malformed", "udp://" + "x" * 300: "too_long",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in df.select("u", fn.tracker_class("u").alias("c")).collect()} == cases


def test_covered_bytes(spark):
    rng = random.Random(2)
    blocks = [(p, rng.randrange(0, 60), rng.randrange(0, 25)) for p in range(20) for _ in range(rng.randrange(1, 12))]
    got = {r.p: r for r in delivery.covered_bytes(spark.createDataFrame(blocks, "p int, b int, n int"), ["p"], "b", "n", 64).collect()}
    for p in range(20):
        mine = [(b, n) for q, b, n in blocks if q == p]
        good = [(b, n) for b, n in mine if n > 0 and b + n <= 64]
        covered = {x for b, n in good for x in range(b, b + n)}
        assert (got[p].covered, got[p].rejected) == (len(covered), len(mine) - len(good))


def test_frontier_and_ranges(spark):
    rng = random.Random(4)
    for start in (0, 3):
        data = {(s, p) for s in range(8) for p in range(30) if rng.random() < 0.8}
        df = spark.createDataFrame(sorted(data) * 2, "s int, p bigint")
        got = dict(rows(delivery.contiguous_frontier(df, "s", "p", start)))
        for s in got:
            nxt = start
            while (s, nxt) in data:
                nxt += 1
            assert got[s] == nxt
        covered = {(r.s, r.first_piece + i) for r in delivery.have_ranges(df, "s", "p").collect() for i in range(r.n_pieces)}
        assert covered == data


def test_range_join_levels(spark):
    rng = random.Random(6)
    windows = [(i, a, a + rng.choice([0, 3, 200, 5000, 10**6, 2**32])) for i, a in enumerate(rng.randrange(3000) for _ in range(60))]
    pieces = [(rng.randrange(-5, 4000),) for _ in range(200)]
    w = spark.createDataFrame(windows, "peer int, a bigint, b bigint").withColumn("s", F.lit(1))
    p = spark.createDataFrame(sorted(set(pieces)), "piece bigint").withColumn("s", F.lit(1))
    got = rows(peers.window_coverage(p, w, "s", "piece", "a", "b", bucket=16).select("piece", "peer"))
    assert got == sorted(((x, i) for (x,) in set(pieces) for i, a, b in windows if a <= x <= b), key=repr)


def test_correlation_consumes_each_query_once(spark):
    q = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("b", 3, 10)], "k string, i int, at bigint")
    r = spark.createDataFrame([("a", 4, 12), ("a", 5, 13), ("b", 6, 14), ("c", 7, 1)], "k string, i int, at bigint")
    t = F.timestamp_seconds("at").alias("ts")
    got = swarm.correlate_replies(q.select("k", "i", t), r.select("k", "i", t), ["k"], "ts", "i", 3)
    assert rows(got.select("i", "query")) == [(4, 2), (5, None), (6, None), (7, None)]


def test_health_edge_cases(spark):
    data = [("a", i, "dl", 3, i * 10, 0) for i in range(10)] + [("b", i, "dl", 3, 5, 1) for i in range(10)] + [("c", 0, "dl", 1, 1, 1)]
    df = spark.createDataFrame(data, "p string, o int, s string, n int, d int, u int")
    got = {r.p: r for r in health.swarm_health(df, "p", ["o"], "s", "n", "d", "u", 2).collect()}
    assert got["a"].passed and not got["a"].upload_positive
    assert not got["b"].passed and not got["b"].downloaded_rising
    assert got["c"].samples == 0 and not got["c"].passed and got["c"].dl_ratio == 0.0
    everyone = spark.createDataFrame([("a",), ("z",), ("z",)], "p string")
    got = {r.p: r for r in health.swarm_health(df, "p", ["o"], "s", "n", "d", "u", 2, everyone).collect()}
    assert set(got) == {"a", "z"} and got["a"].passed
    assert got["z"].samples == 0 and not got["z"].passed and not got["z"].peers_ok


def test_stability(spark):
    def verdict(seconds, first=0, until=None):
        df = spark.createDataFrame([("a", i, n) for i, n in enumerate(seconds) if n], "s string, sec bigint, n bigint")
        until = len(seconds) - 1 if until is None else until
        window = spark.createDataFrame([("a", first, until)], "s string, first bigint, until bigint")
        return health.stream_stability(df, window, "s", "sec", "n", 1000).first()

    full = 1000
    assert verdict([full] * 10).passed
    assert verdict([full] * 50 + [0] * 5 + [full] * 5).passed
    bad = verdict([full] * 50 + [0] * 6 + [full] * 5)
    assert bad.max_stall == 6 and bad.throughput_ok and not bad.stall_ok
    assert verdict([full] * 5 + [0] * 7).max_stall == 7 and verdict([0] * 4).max_stall == 4
    assert not verdict([700] * 10).throughput_ok
    # Ten good seconds of a minute: the dead tail counts, and so does a dead head.
    tail = verdict([full] * 10, until=59)
    assert (tail.seconds, tail.max_stall, tail.passed) == (60, 50, False)
    assert verdict([0] * 6 + [full] * 54).max_stall == 6
    assert verdict([9 * full] * 10, first=5, until=7).total_bytes == 27 * full
    assert not verdict([full] * 3, first=2, until=1).passed


def test_rollup(spark):
    schema = "scenario int, peer int, health_ok boolean, stability_ok boolean, contiguous boolean, upload_positive boolean"
    good = [(1, 1, True, True, True, True), (1, 2, True, True, True, False)]

    def rolled(rows):
        df = spark.createDataFrame(rows, schema)
        return {r.scenario: (r.peers, r.peers_passed, r.passed) for r in health.scenario_rollup(df, "scenario", "peer").collect()}

    assert rolled(good) == {1: (2, 2, True), None: (2, 2, True)}
    lost = [(2, 3, True, None, None, True)]
    assert rolled(good + lost) == {1: (2, 2, True), 2: (1, 0, False), None: (3, 2, False)}
    assert rolled([]) == {None: (0, 0, False)}


def test_lease_capacity_and_catalog(spark):
    df = spark.range(10).select("id", F.timestamp_seconds("id").alias("e"))
    kept = access.lease_capacity(df, "id", "e", F.timestamp_seconds(F.lit(3)), 4)
    assert sorted(r.id for r in kept.collect()) == [6, 7, 8, 9]
    c = spark.createDataFrame([("k", 0, "old"), ("k", 100, "new")], "k string, at bigint, v string")
    q = spark.createDataFrame([("k", 99, 1), ("k", 100, 2), ("k", 399, 3), ("k", 400, 4)], "k string, at bigint, i int")
    t = F.timestamp_seconds("at").alias("ts")
    got = access.resolve_catalog(q.select("k", t, "i"), c.select("k", t, "v"), "k", "ts", "v")
    assert rows(got.select("i", "v")) == [(1, "old"), (2, "new"), (3, "new"), (4, None)]


def test_unchoked_rotation(spark):
    df = spark.range(7).selectExpr("'s' as s", "id as p", "id as o")
    for tick in range(9):
        got = {r.p for r in peers.choose_unchoked(df, ["s"], "p", "o", 3, tick).collect()}
        assert got == {0, 1, 2, 3 + tick % 4}
    assert peers.choose_unchoked(df, ["s"], "p", "o", 9, 1).count() == 7


def test_open_stall(spark):
    df = spark.createDataFrame(
        [("a", 1, 0, True), ("a", 2, 5, True), ("a", 3, 40, True), ("b", 1, 0, True), ("c", 1, 50, True)],
        "s string, o int, at bigint, out boolean",
    ).withColumn("ts", F.timestamp_seconds("at"))
    got = media.stall_intervals(df, "s", ["o"], "ts", "out", "out", F.timestamp_seconds(F.lit(60)), 12)
    at = [F.unix_seconds(c).alias(c) for c in ("stalled_from", "stale_at", "resumed_at")]
    assert rows(got.select("s", *at)) == sorted(
        [("a", 5, 17, 40), ("a", 40, 52, None), ("b", 0, 12, None)], key=repr
    )


def test_backward_clock_empties_the_buffer(spark):
    data = [("a", 1, 0, 60, 0, 0), ("a", 2, 1, 60, 90, 0), ("a", 3, 2, 60, 0, 1), ("a", 4, 3, 60, 90_000, 1)]
    df = spark.createDataFrame(data, "s string, o int, at bigint, n bigint, e bigint, g bigint")
    df = df.withColumn("ts", F.timestamp_seconds("at"))
    got = media.startup_release(df, "s", ["o"], "ts", "n", "e", "g", 1000, 150, 60_000).first()
    assert (got.reason, got.queued) == ("TargetDuration", 120)
    one = media.startup_release(df.withColumn("g", F.lit(0).cast("bigint")), "s", ["o"], "ts", "n", "e", "g", 1000, 150, 60_000)
    assert one.first().reason == "ByteLimit"


def test_walk_counters(spark):
    """An error answers nothing; a silent round is a timeout; told nodes must be asked too."""
    def frame(rows_, schema):
        return spark.createDataFrame(rows_, schema)

    seeds = frame([(1, 10), (1, 11), (2, 20)], "walk int, node int")
    asked = frame([(1, 10, 1, 0), (1, 11, 1, 1), (1, 12, 2, 9), (2, 20, 1, 0)], "walk int, node int, round int, at bigint")
    came = frame(
        [(1, 10, 1, 1, "e", 5, 5), (1, 10, 1, 2, "r", 2, 3), (1, 11, 1, 2, None, 7, 7), (1, 99, 1, 3, "r", 1, 1)],
        "walk int, node int, round int, at bigint, kind string, p int, n int",
    )
    asked, came = (d.withColumn("ts", F.timestamp_seconds("at")) for d in (asked, came))
    answers = swarm.correlate_replies(asked, came.filter("kind = 'r'"), ["node"], "ts", "at", 3)
    found = frame([(1, 12), (2, 21)], "walk int, node int")
    got = swarm.dht_walk_metrics(seeds, asked, came, answers, found, "walk", "node", "round", "kind", "p", "n")
    one, two = got.orderBy("walk").collect()
    assert one.asDict() == dict(
        walk=1, seeded=2, queried=3, valid=1, peers=2, nodes=3, malformed=1, errors=1, uncorrelated=1,
        timeouts=1, exhausted=True,
    )
    assert (two.seeded, two.queried, two.timeouts, two.exhausted) == (1, 1, 1, False)


def test_expand(spark):
    from streamscope.plans.expand import expand

    df = spark.createDataFrame([(1, 5, 4), (2, 0, 0), (3, 7, 2_500), (4, None, 3)], "k int, a bigint, b bigint")
    got = expand(df, "a", "b", "x")
    assert got.columns == ["k", "a", "b", "x"]
    assert rows(got.filter("k = 2").select("k", "x")) == [(2, 0)]
    assert sorted(r.x for r in got.filter("k = 3").collect()) == list(range(7, 2501))
    wide = spark.createDataFrame([(1 << 40, (1 << 40) + 3_000_000)], "a bigint, b bigint")
    assert expand(wide, "a", "b", "x").agg(F.count_distinct("x")).first()[0] == 3_000_001


def test_coverage_counts(spark):
    pieces = spark.createDataFrame([("a", n) for n in range(-1, 12)] + [("b", 5)], "s string, p bigint")
    windows = spark.createDataFrame(
        [("a", 0, 3, True), ("a", 2, 1 << 40, True), ("a", 4, 3, True), ("a", 5, 5, False), ("c", 0, 9, True)],
        "s string, lo bigint, hi bigint, open boolean",
    )
    got = {(r.s, r.p): r.peers for r in peers.coverage_counts(pieces, windows, "s", "p", "lo", "hi", "open").collect()}
    want = {("a", n): (0 <= n <= 3) + (n >= 2) for n in range(-1, 12)} | {("b", 5): 0}
    assert got == want


def test_ipv6_against_the_standard_library(spark):
    import ipaddress
    import random

    from streamscope.functions import network

    rng, texts = random.Random(3), []
    for _ in range(400):
        groups = [rng.choice((0, 0, 1, 0xFFFF, rng.randrange(1 << 16))) for _ in range(8)]
        address = ipaddress.IPv6Address(int.from_bytes(b"".join(g.to_bytes(2) for g in groups)))
        texts += [str(address), address.exploded, address.exploded.upper()]
    texts += [
        "", ":", "::", ":::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1:2:3:4:5:6:7:8:9", "::1.2.3.4",
        "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::ffff:1.2.3.256", "::1.2.3", "1.2.3.4::", "g::", "1::2::3", "::ffff:1.2.3.4:5", "fe80::1%eth0", "a b::",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", network.ipv6_groups("ip").alias("g")).collect()
    for r in rows:
        try:
            want = ipaddress.IPv6Address(r.ip)
            want = None if "%" in r.ip else [want.packed[i] << 8 | want.packed[i + 1] for i in range(0, 16, 2)]
        except ValueError:
            want = None
        assert r.g == want, r.ip
