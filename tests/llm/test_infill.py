"""Fill-in-the-middle against plain cuts, and the skip list against sums."""

import hashlib
import re

import numpy as np
import pytest
from compare import same
from conftest import SF
from hypothesis import given, settings, strategies as st
from made import documents
from pyspark.sql import functions as F

from streamscope.llm import infill
from streamscope.llm.queries import QUERIES, SQL


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc, n, form, len(p), len(m), sha(out), sha(text)


def test_whole_table(spark, duck):
    name = "op12_fill_in_middle"
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf())


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(infill, "_FLUSH", 5_000)
    rows = [
        (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "no line feed"), (None, "a\nb\nc"), (6, "x<M>\ny"),
        (7, "tail < P>\n<<\nS>\n"), (8, "é𝄞\n" * 5_000 + "end"), (9, "\r\nword\r\n x\x0b\n"), (9, "a\nb\n"),
        *[(100 + k, "".join(f"line {i}\n" for i in range(k))) for k in range(60)],
        *[(200 + k, "<P\n<S\n<\nP>") for k in range(20)],
    ]
    frame = documents(spark, rows).withColumn("h0", F.lit("x")).withColumn("n", F.lit(1)).withColumn("form", F.lit(0))
    got = sorted(map(tuple, infill.infill_digest(frame).collect()), key=repr)
    assert got == sorted((plain(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.infill_digest(frame.limit(0)).collect() == []


def test_rate_and_sentinels(spark):
    frame = documents(spark, [(k, f"a {k}\nb\nc <P>\n") for k in range(300)])
    marks = ("[pre]", "[suf]", "[mid]")
    out = infill.fill_in_middle(frame, seed=3, sentinels=marks, rate=40, suffix_first=0)
    rows = out.withColumn("back", infill.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == f"a {r.doc_id}\nb\nc <P>\n" for r in rows)
    assert 80 < sum(r.form == "psm" for r in rows) < 160 and not any(r.form == "spm" for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=400), st.data())
def test_skip_list(widths, data):
    listed = infill.SkipList(np.array(widths, np.int64))
    for rank in data.draw(st.lists(st.integers(0, len(widths)), max_size=10)):
        assert listed.before(rank) == sum(widths[:rank])
    for rank in (-1, len(widths) + 1):
        with pytest.raises(IndexError):
            listed.before(rank)


def test_lanes_thin_out():
    listed = infill.SkipList(np.ones(100_000, np.int64))
    sizes = [len(spans) for spans, _, _ in listed.lanes]
    assert len(sizes) > 6 and all(3 * b < a < 5.5 * b for a, b in zip(sizes[:4], sizes[1:5]))
    assert all(spans.sum() == widths.sum() == 100_000 for spans, widths, _ in listed.lanes)
    assert [listed.before(r) for r in (0, 1, 77_777, 100_000)] == [0, 1, 77_777, 100_000]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a\n\ré𝄞", max_size=60))
def test_lines(text):
    assert infill.line_lengths(text).tolist() == [len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", text)]
