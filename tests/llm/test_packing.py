import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from conftest import SF
from hypothesis import given, settings, strategies as st
from made import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streamscope.llm import packing, tokens
from streamscope.llm.queries import QUERIES

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def direct(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_word_by_word_equals_whole(name):
    want, enc = direct(name), tokens.encoder(P.path(name))
    assert enc.direct

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(
        st.sampled_from(" \n\t\r'.,!?#|-_09azAZéßñİΣςǺ   \x1c\x85\x0b中😀"),
        st.characters(exclude_categories=["Cs"]),
    ), max_size=60))
    def same(text):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want(text)

    same()
    for text in ("<|endoftext|> it's I'LL we're", "a" * 5000, "x\n\n y", "  a", "a  ", "", "Été\tça"):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want(text)


def test_forgetting_words(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    enc, want = tokens.Encoder(P.path(FILES[0])), direct(FILES[0])
    text = " ".join(f"w{i % 13}o" for i in range(200))
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == want(text)


def check(rows, docs, capacity=1024):
    ids_of, by_doc, by_sequence = direct(FILES[0]), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in docs.items():
        ids = ids_of(text) + [2]
        parts = sorted(by_doc.pop(doc), key=lambda r: r.piece)
        at = 0
        for n, r in enumerate(parts):
            assert (r.piece, r.start) == (n, at)
            assert len(parts) == 1 or n == 0 or r.length == capacity
            piece = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(piece)
            at += r.length
        assert at == len(ids)
    assert not by_doc
    total = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += at
    return len(by_sequence), -(-total // capacity)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    used, least = check(QUERIES["op4_best_fit_packing"](spark, SF).collect(), docs)
    assert used <= 1.03 * least


def test_pack_lengths():
    rng = random.Random(3)
    for counts in (
        {}, {1: 5}, {1024: 3}, {513: 4}, {512: 7}, {341: 8, 342: 4}, {1: 10_000_000, 1023: 1},
        {rng.randrange(1, 1025): rng.randrange(1, 90) for _ in range(300)},
        {rng.randrange(300, 1025): 10 ** rng.randrange(10) for _ in range(700)},
        {n: 1 for n in range(1, 1025)},
    ):
        got = {}
        for lengths, times in packing.pack_lengths(counts):
            assert sum(lengths) <= 1024 and times > 0
            for x in lengths:
                got[x] = got.get(x, 0) + times
        assert got == counts
    bins = sum(t for _, t in packing.pack_lengths({n: 1 for n in range(1, 1025)}))
    assert bins <= -(-sum(range(1, 1025)) // 1024) + 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "hello there"), (4, "long " * 20_000), (5, "a"), (5, "b"),
            (6, "word " * 1022 + "word"), (7, "word " * 1023 + "word")]
    frame = documents(spark, rows).withColumn("piece", F.lit("x")).withColumn("length", F.lit(2))
    out = packing.packed_digest(frame.filter("doc_id <> 5 or doc_id is null")).collect()
    used, least = check(out, {i: t for i, t in rows if i != 5})
    assert used <= least + 1
    both = packing.packed_digest(frame).collect()
    assert len([r for r in both if r.doc_id == 5]) == 2
    assert packing.packed_digest(frame.limit(0)).collect() == []
    whole = packing.packed(frame)
    size = {r.sequence_id: 0 for r in whole.collect()}
    for r in packing.sequences(whole).collect():
        size[r.sequence_id] = len(r.ids) // 4
    assert sum(size.values()) == sum(r.length for r in whole.collect())
    assert max(size.values()) <= 1024
