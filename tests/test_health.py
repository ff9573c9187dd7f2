"""Verdicts over zero-filled tables."""

from compare import rows

from streamscope.operators import health


def test_empty_seconds_are_not_scanned(spark, monkeypatch):
    """A zero-filled table gives the sparse one's verdict from its seconds with data."""
    scanned = []

    class Counted(health.OrderedScan):
        def __init__(self, df, *args, **options):
            scanned.append(df.count())
            super().__init__(df, *args, **options)

    monkeypatch.setattr(health, "OrderedScan", Counted)
    data = {"a": {3: 900, 4: 10, 60: 500}, "b": {}, "c": {1: 400, 100: 400}}
    playback = spark.createDataFrame([(s, 1, 100) for s in data], "s string, first long, until long")
    schema = "s string, t long, n long"
    filled = [(s, t, found.get(t, 0)) for s, found in data.items() for t in range(1, 101)]
    sparse = [r for r in filled if r[2]]
    verdicts = [
        rows(health.stream_stability(spark.createDataFrame(x, schema), playback, "s", "t", "n"))
        for x in (filled, sparse)
    ]
    assert verdicts[0] == verdicts[1] and scanned == [7, 5]
    free = health.stream_stability(spark.createDataFrame(filled, schema), playback, "s", "t", "n", stall_bytes=0)
    assert [r.max_stall for r in free.collect()] == [0, 0, 0] and scanned[-1] == 300
