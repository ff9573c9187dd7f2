import zlib

import numpy as np
import pytest
from made import documents
from pyspark.sql import functions as F

from streamscope.llm import recurrent as net, toxicity as tox
from streamscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture
def quick(monkeypatch):
    monkeypatch.setattr(tox, "ROUNDS", 2)
    monkeypatch.setattr(tox, "STEPS", 40)


def test_gradients_agree_with_differences():
    words = np.array([[0, 1, 2, -1], [3, 1, -1, -1], [-1, -1, -1, -1]])
    sizes = np.where(words.ravel() >= 0, 2, 0)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    w = net.Windows(words, np.arange(bounds[-1]) % 5, bounds)
    p = {k: v.astype(float) for k, v in net.initial(4, 5, 2, 3).items()}
    y = np.array([1.0, 0.0, 1.0])
    _, g = net.gradients(p, w, y)
    for name, x in p.items():
        for i in range(x.size):
            old = x.flat[i]
            x.flat[i] = old + 1e-5
            up = net.gradients(p, w, y)[0]
            x.flat[i] = old - 1e-5
            down = net.gradients(p, w, y)[0]
            x.flat[i] = old
            assert g[name].flat[i] == pytest.approx((up - down) / 2e-5, abs=1e-6), (name, i)


def test_windows_cover_every_word_and_overlap():
    texts = ["", "one", "a b c " * 100, "x " * tox.LENGTH, "y " * (tox.LENGTH + 1)]
    words = tox.Words.of(texts)
    assert np.diff(words.texts).tolist() == [0, 1, 300, tox.LENGTH, tox.LENGTH + 1]
    windows, text = tox.windows_of(words, np.unique(words.hashes))
    assert np.bincount(text).tolist() == [1, 1, 9, 1, 2]
    real = (windows.words >= 0).sum(axis=1)
    for t, n in enumerate(np.diff(words.texts)):
        assert real[text == t].sum() >= n
    one = windows.take(np.array([1]))
    assert one.words[0, 0] > 0 and one.bounds[-1] == 3


def test_same_word_same_hash_everywhere():
    words = tox.Words.of(["Été idiot, x", "an IDIOT été"])
    assert words.hashes[0] == words.hashes[5] and words.hashes[1] == words.hashes[4]
    assert len(set(words.hashes.tolist())) == 4


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op7_toxicity"](spark, SF).collect()
    assert len(got) == 10_000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    toxic = [r for r in held if labels[r.doc_id]]
    clean = [r for r in held if not labels[r.doc_id]]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.8
    assert sum(r.predicted for r in clean) / len(clean) < 0.02


def test_edges(spark, quick):
    rows = [(n, f"good day number{n} to all of you friend" + " idiot" * (n % 3 == 0)) for n in range(90)]
    rows += [(100, None), (101, ""), (None, "fine"), (102, "nice " * 60_000 + "idiot")]
    frame = documents(spark, rows).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame(
        [(n, 1, int(n % 3 == 0)) for n in range(90)] + [(None, 1, 1), (5, None, None), (4, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    got = {r.doc_id: r for r in tox.toxicity(frame, labels).collect()}
    assert len(got) == len(rows)
    wrong = sum(got[n].predicted != int(n % 3 == 0) for n in range(90))
    assert wrong <= 4
    assert got[102].predicted == 1 and got[101].predicted == got[100].predicted == 0
    none = tox.toxicity(frame, labels.limit(0)).collect()
    assert len(none) == len(rows) and {r.predicted for r in none} == {0}
    assert tox.toxicity(frame.limit(0), labels).collect() == []
