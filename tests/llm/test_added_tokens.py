"""Texts with strings of added tokens, against the library with the files as they are."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from made import documents
from tokenizers import Tokenizer

from streamscope.llm import codes, packing, tokens

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TEXTS = ("one <|endoftext|> two", "<|startoftext|>a\n\n<|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "plain words")


def untouched(name):
    t = Tokenizer.from_file(P.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_equal_to_the_library(name):
    want, enc = untouched(name), tokens.encoder(P.path(name))

    def same(text):
        assert np.frombuffer(enc.with_added(text), "<u4").tolist() == want(text)

    pieces = ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "\n", "two", "Été's")
    settings(max_examples=300, deadline=None)(
        given(st.lists(st.sampled_from(pieces), max_size=12).map("".join))(same)
    )()
    for text in TEXTS:
        same(text)


def test_operators(spark):
    frame = documents(spark, list(enumerate(TEXTS)))
    ids_of = untouched(FILES[0])
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.packed_digest(frame).collect()}
    for n, text in enumerate(TEXTS):
        ids = np.array([*ids_of(text), 2], "<u4")
        assert got[n] == (len(ids), zlib.crc32(ids.tobytes()))
    ids_of, at = untouched(FILES[1]), 0
    for n, row in enumerate(sorted(map(tuple, codes.token_files(frame).collect()))):
        ids = np.array([*ids_of(TEXTS[n]), 1], "<u4")
        assert row == (n, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
