import random

from compare import same
import pytest
from conftest import SF
from made import documents
from pyspark.sql import functions as F

from streamscope.llm import linededup
from streamscope.llm.queries import QUERIES, SQL


def plain(docs, least=50):
    """Remaining text by comparing every position with every earlier one."""
    lines = [(d, (t or "").split("\n")) for d, t in docs]
    places, gone = {}, set()
    for n, (_, parts) in enumerate(lines):
        for s, x in enumerate(parts):
            for m, t in places.get(x, []):
                run = 0
                while (
                    s + run < len(parts) and t + run < len(lines[m][1])
                    and parts[s + run] == lines[m][1][t + run]
                ):
                    run += 1
                if sum(len(p.encode().split()) for p in parts[s : s + run]) >= least:
                    gone |= {(n, i) for i in range(s, s + run)}
            places.setdefault(x, []).append((n, s))
    return {
        n: None if t is None else "\n".join(
            x for i, x in enumerate(lines[n][1]) if (n, i) not in gone
        ) for n, (_, t) in enumerate(docs)
    }


def test_whole_table(spark, duck):
    docs = sorted(
        (r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()
    )
    got = {r.doc_id: r for r in QUERIES["op5_line_dedup"](spark, SF).collect()}
    want = plain(docs)
    assert len(got) == len(docs)
    for n, (i, t) in enumerate(docs):
        assert got[i].text == want[n], i
        assert got[i].n_lines == len(t.split("\n"))
    assert sum(r.deleted_lines for r in got.values()) > 0
    same(spark.createDataFrame(list(got.values())).toPandas(), duck.execute(SQL["op5_line_dedup"]).fetchdf())


def test_random_lines(spark):
    rng = random.Random(11)
    vocabulary = ["", " ", "a", "b b", "c c c c c", "d " * 9, "e", "f f f"]
    docs = [
        (n, "\n".join(rng.choice(vocabulary) for _ in range(rng.randrange(30)))) for n in range(25)
    ]
    docs += [(25 + n, docs[n][1] + "\nx") for n in range(4)]
    want = plain(docs, 12)
    out = linededup.without_repeats(documents(spark, docs), min_words=12).collect()
    assert {r.doc_id: r.text for r in out} == want
    assert all(r.n_chars == len(r.text) for r in out)


def test_edges(spark):
    run = "\n".join(["one two three four five"] * 12)
    long = "\n".join(f"line {i} of it" for i in range(40_000))
    rows = [(3, run), (1, f"x\n{run}\ny"), (None, long), (7, long), (8, None), (9, ""), (9, None),
            (4, "\n\n\n"), (5, "\n\n\n"), (6, "w " * 200), (2, "z\n" + "w " * 200)]
    frame = documents(spark, rows).withColumn("first", F.lit(1)).withColumn("n_lines", F.lit(2))
    out = linededup.without_repeats(frame)
    assert out.columns == frame.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = plain([r for r in ordered if r[1] != long])
    assert got == {(i, want[n]) for n, (i, _) in enumerate(r for r in ordered if r[1] != long)} | {
        (7, long), (None, "")
    }
    same = frame.filter("doc_id = 6")
    twice = sorted(r.text for r in linededup.without_repeats(same.unionByName(same)).collect())
    assert twice == ["", "w " * 200]
    assert linededup.without_repeats(frame.limit(0)).collect() == []
    assert linededup.line_report(frame.limit(0)).collect() == []


def test_more_lines_than_positions_have_room_for_fail(spark, monkeypatch):
    """No line is taken for one of the next document."""
    monkeypatch.setattr(linededup, "_LINE_BITS", 3)
    text = "\n".join(f"one two three four five six seven {i}" for i in range(20))
    with pytest.raises(Exception, match="too many lines"):
        linededup.without_repeats(documents(spark, [(1, text), (2, text)])).collect()
