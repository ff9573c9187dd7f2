"""Token ids of whole texts by the tokenizers library, with the ids of words remembered.

Byte-pair merges never cross the places where the two supported pre-tokenizers cut, and both cut
before every run of white space that follows anything else. So a text's ids are those of its words
one after the other, and a word met before need not be encoded again. Texts with unusual white
space are encoded whole, and so are those in which a string of an added token stands.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

#: Words remembered in each of two generations.
REMEMBERED = 300_000

_CHUNK = re.compile(r"([ \n\t\r]*)([^ \n\t\r]+)|[ \n\t\r]+\Z")
_TAILED = re.compile(r"(.*?)([!-&(-/:-@\[-`{-~]+)")
_PLAIN_LIMIT = "ɏ"


class _Odd(Exception):
    """Not a word: white space that only the whole text's encoding treats rightly."""


class _Remembered(dict):
    """Ids by word, computed when missing; forgets the older generation when the newer is full."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.compute(word)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in
    Latin-1, else the next free code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.normalizer = self.tokenizer.normalizer if any(t.normalized for t in added) else None
        # What `encode` splits has no added tokens, or is to be read as ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.letters = _byte_letters()
        self.lower = self.whole("A") == self.whole("a")
        spaced = self.whole(" a") != self.whole("a")
        self.lead = {"": "", " ": self.letters[32] if spaced else ""}
        self.newline = self.whole("\n")
        self.direct = all(
            self._letters(w, s) == self.whole(s + w) for w in ("the", "Straße") for s in ("", " ")
        )
        self.first = _Remembered(lambda w: self._word(w, ""))
        self.after = _Remembered(lambda w: self._word(w, " "))
        self.other = _Remembered(self.whole)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, word: str, space: str) -> bytes:
        """A word of letters is one pre-token: only the merges are needed."""
        text = word.lower() if self.lower else word
        if not text.isascii():
            text = "".join([self.letters[b] for b in text.encode()])
        found = [t.id for t in self.tokenizer.model.tokenize(self.lead[space] + text)]
        return struct.pack(f"<{len(found)}I", *found)

    def _word(self, word: str, space: str) -> bytes:
        if word.split() != [word]:
            raise _Odd
        if self.direct:
            if word.isalpha() and max(word) <= _PLAIN_LIMIT and word.count("İ") == 0:
                return self._letters(word, space)
            tail = _TAILED.fullmatch(word)
            if tail and tail[1].isalpha():
                return (self.after if space else self.first)[tail[1]] + self.first[tail[2]]
        return self.whole(space + word)

    def _adds(self, text: str) -> bool:
        return any(content in text for content in self.added)

    def with_added(self, text: str) -> bytes:
        """The ids that the file alone gives: strings of added tokens become those tokens."""
        if not self._adds(text) and not (
            self.normalizer and self._adds(self.normalizer.normalize_str(text))
        ):
            return self.encode(text)
        self.tokenizer.encode_special_tokens = False
        try:
            return self.whole(text)
        finally:
            self.tokenizer.encode_special_tokens = True

    def encode(self, text: str) -> bytes:
        """The ids of ordinary text as little-endian unsigned 32-bit numbers."""
        try:
            out, after = [], self.after.__getitem__
            for n, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if n:
                    out.append(self.newline)
                out.append(self.first[words[0]])
                out.extend(map(after, words[1:]))
            return b"".join(out)
        except _Odd:
            return self._spaced(text)

    def _spaced(self, text: str) -> bytes:
        """For runs of several separators: each goes with the word after it."""
        try:
            out = []
            for m in _CHUNK.finditer(text):
                space, word = m.groups()
                if space == " ":
                    out.append(self.after[word])
                elif space == "":
                    out.append(self.first[word])
                elif word is None or word.split() == [word]:
                    out.append(self.other[m[0]])
                else:
                    raise _Odd
            return b"".join(out)
        except _Odd:
            return self.whole(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterator, path: str) -> Iterator[tuple]:
    """(id, bytes of token ids) for the rows of Arrow batches whose columns are id and text."""
    encode = encoder(path).with_added
    for batch in batches:
        yield from zip(batch.column(0), (encode(t or "") for t in batch.column(1).to_pylist()))
