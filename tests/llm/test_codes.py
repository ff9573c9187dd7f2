import zlib

import numpy as np
import public_tokenizers as P
from conftest import SF
from hypothesis import given, settings, strategies as st
from made import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streamscope.llm import codes
from streamscope.llm.queries import QUERIES


def encoder():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def want(rows):
    ids_of, at, out = encoder(), 0, []
    for doc, text in rows:
        ids = ids_of(text)
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_random_access(ids, data):
    opened = codes.Codes(codes.encode(np.array(ids, np.uint32)))
    assert len(opened) == len(ids)
    if ids:
        at = data.draw(st.lists(st.integers(0, len(ids) - 1), max_size=20))
        assert opened.get(np.array(at, int)).tolist() == [ids[i] for i in at]
        assert opened.get(np.arange(len(ids))).tolist() == ids
        a, b = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
        assert opened.range(a, b).tolist() == ids[a:b]


def test_large_segment():
    ids = np.random.default_rng(1).integers(0, 1 << 17, 200_000).astype(np.uint32)
    blob = codes.encode(ids)
    assert (codes.Codes(blob).get(np.arange(len(ids))) == ids).all()
    assert len(blob) < 4 * len(ids)


def test_whole_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(map(tuple, QUERIES["op10_token_codes"](spark, SF).collect()))
    assert got == want(rows)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(codes, "SEGMENT_IDS", 50)
    rows = [(None, "first of all"), (1, None), (2, ""), (3, "word " * 30_000), (-4, "a b"), (9, "z")]
    frame = documents(spark, rows).withColumn("part", F.lit("p")).withColumn("start", F.lit(0))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(map(tuple, codes.token_files(frame).collect()), key=lambda r: r[1])
    assert got == want(ordered)
    twice = codes.token_files(frame.unionByName(frame)).collect()
    assert len(twice) == 12
    assert sum(r.n_tokens for r in twice) == 2 * sum(r[2] for r in got)
    assert len({r.start for r in twice}) == 12
    assert codes.token_files(frame.limit(0)).collect() == []
