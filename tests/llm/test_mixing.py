import re
from fractions import Fraction

import pytest
from conftest import SF
from made import documents
from pyspark.sql import functions as F

from streamscope.llm import mixing
from streamscope.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def targets(docs):
    """Targets by giving out the excess round by round."""
    totals = {}
    for d in docs:
        totals[d.source] = totals.get(d.source, 0) + size(d.text)
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = Fraction(3, 2) * sum(totals.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * totals[s]}
        if not over:
            return totals, out | {s: float(v) for s, v in share.items()}
        for s in over:
            out[s] = float(2 * totals[s])
            left -= 2 * totals[s]
        open_ -= over
    return totals, out


def check(rows, docs):
    totals, want = targets(docs)
    source = {d.doc_id: d.source for d in docs}
    taken = dict.fromkeys(totals, 0)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == totals[s]
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1


def test_whole_table_and_rerun(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    first = QUERIES["op9_source_mix"](spark, SF).collect()
    check(first, docs)
    assert all(r["size"] == size(d.text) for r in first for d in docs if d.doc_id == r.doc_id)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = QUERIES["op9_source_mix"](spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_edges(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, "x y z", "en", None),
            (4, " ".join("ab" for _ in range(90_000)), "en", "big"),
            (5, "p\tq  r\n", "en", "a"), (6, "s", "en", "")]
    frame = documents(spark, rows).withColumn("size", F.lit(1)).withColumn("target", F.lit("t"))
    check(mixing.mixture(frame).collect(), frame.collect())
    again = frame.unionByName(frame)
    assert len(mixing.mixture(again).collect()) == 12
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    for r in out.collect():
        assert r.n_chars == len(r.text) and size(r.text) > 0
    assert mixing.mixture(frame.limit(0)).collect() == []
    assert mixing.mixed(frame.limit(0)).collect() == []
    assert len(mixing.mixture(frame.filter("text is null or text = ''")).collect()) == 2
    nulls = frame.select(*[F.lit(None).cast(t).alias(c) for c, t in frame.dtypes])
    assert len(mixing.mixture(nulls).collect()) == 6


def test_stream_of_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.mixture(docs).collect()}
    out = mixing.mixed(docs).collect()
    words = {}
    for r in out:
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
    assert words == {k: v for k, v in taken.items() if v}
    texts = {d.doc_id: d.text for d in docs.collect()}
    assert all(texts[r.doc_id].startswith(r.text) for r in out)


def test_positions_follow_the_schedule(spark):
    """Each source's words up to a time are its schedule's integral."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keyed = mixing._keyed(docs, F.col("doc_id"), F.col("text"), F.col("source"))
    rows = mixing.assigned(keyed).select("source", "mix").collect()
    names = sorted({r.source for r in rows})
    for n, s in enumerate(names):
        ramp = mixing.RAMPS[n % 3]
        takes = [t for r in rows if r.source == s for t in r["mix"].takes]
        target = next(r["mix"].target for r in rows if r.source == s)
        longest = max(t.words for t in takes)
        for at in (0.25, 0.5, 0.75):
            got = sum(t.words for t in takes if t.position < at)
            assert abs(got - target * (at + ramp * (at * at - at))) <= longest
        assert all(0 <= t.position <= 1 for t in takes)


def test_ties_are_ordered_by_text(spark):
    """Rows of equal id and size are cut alike however they are dealt."""
    rows = [(1, f"w{k} " * 5, "en", "s") for k in range(40)] + [(None, f"v{k} " * 5, "en", "t") for k in range(40)]
    docs = documents(spark, rows)
    first = sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()), key=repr)
    again = sorted(map(tuple, mixing.mixed(docs.orderBy(F.col("text").desc()).coalesce(1)).collect()), key=repr)
    assert first == again


def test_places_are_those_of_the_training_order(spark):
    """A document's place and words are those of its copies in the mix that `mixed` writes."""
    data = [(n, " ".join(f"w{n}" for _ in range(1 + n * 7 % 23)), "abc"[n % 3] if n % 4 else "a") for n in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    trained = [(r.doc_id, len(r.text.split())) for r in mixing.mixed(docs).collect()]
    for r in mixing.mixture(docs).collect():
        own = [(n, words) for n, (doc, words) in enumerate(trained) if doc == r.doc_id]
        assert r.place == (own[0][0] if own else None)
        assert r.taken == sum(words for _, words in own)
