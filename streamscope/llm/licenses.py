"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, and a
shunting-yard parser evaluates the licence expressions that follow the tags."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType,
)

# The phrases of the contract, as words, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notices in use, as words.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "free and unencumbered software released into the public domain": "unlicense",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "gnu free documentation license": "gfdl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "boost software license": "bsl-1",
    "open database license": "odbl",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "reserved",
}
#: Identifiers of licence expressions, in lower case.
IDENTIFIERS = {
    "0bsd": "0bsd", "afl-3.0": "afl-3", "agpl-3.0": "agpl-3", "agpl-3.0-only": "agpl-3",
    "agpl-3.0-or-later": "agpl-3", "apache-2.0": "apache-2", "artistic-2.0": "artistic-2",
    "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "bsl-1.0": "bsl-1", "cc-by-3.0": "cc-by",
    "cc-by-4.0": "cc-by", "cc-by-nc-3.0": "cc-by-nc", "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-nc-sa-4.0": "cc-by-nc", "cc-by-nd-4.0": "cc-by-nd", "cc-by-sa-3.0": "cc-by-sa",
    "cc-by-sa-4.0": "cc-by-sa", "cc0-1.0": "cc0", "epl-1.0": "epl", "epl-2.0": "epl",
    "gfdl-1.3": "gfdl", "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2",
    "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "isc": "isc",
    "lgpl-2.1": "lgpl", "lgpl-2.1-only": "lgpl", "lgpl-2.1-or-later": "lgpl", "lgpl-3.0": "lgpl",
    "lgpl-3.0-only": "lgpl", "lgpl-3.0-or-later": "lgpl", "mit": "mit", "mit-0": "mit",
    "mpl-2.0": "mpl-2", "odbl-1.0": "odbl", "unlicense": "unlicense", "wtfpl": "wtfpl",
    "zlib": "zlib",
}
#: Exceptions after "with"; they let a work be linked or distributed under other terms.
EXCEPTIONS = {
    "autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0",
    "font-exception-2.0", "gcc-exception-3.1", "linux-syscall-note", "llvm-exception",
    "openjdk-assembly-exception-1.0", "qt-gpl-exception-1.0",
}
#: How freely a work under a label may be reused: 1 with a notice, 2/3 if changes to its files are
#: shared, 1/3 if the whole must be, 0 if not for every purpose. Labels not named here have 1.
FREEDOM = {
    "mpl-2": 2 / 3, "epl": 2 / 3, "lgpl": 2 / 3, "cc-by-sa": 1 / 3, "odbl": 1 / 3, "gfdl": 1 / 3,
    "gpl-2": 1 / 3, "gpl-3": 1 / 3, "agpl-3": 1 / 3, "cc-by-nd": 0.0, "cc-by-nc": 0.0,
    "reserved": 0.0, "other": 0.0,
}
LINKABLE = 2 / 3
#: Tags before an expression, in lower case: those that always begin one, whose unknown names are
#: label "other", and those that do so only if every name after them is known.
TAGS = {
    "spdx-license-identifier:": True, "license-expression:": True, "license:": False,
    "licence:": False, 'license":': False, "license =": False,
}
#: Chance that a finding of a kind is right; a label is stated unless all its findings are wrong.
TRUST = {"phrase": 0.9, "tag": 0.98, "other": 0.5}

OPERATORS = {"or": 1, "and": 2, "with": 3}
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_TOKEN = re.compile(r"[ \t\"']*([()]|[a-z0-9][a-z0-9.+:-]*)")


@dataclass(frozen=True)
class Expression:
    postfix: tuple[str, ...]
    labels: frozenset[str]
    freedom: float
    known: bool


def postfix(tokens: list[str]) -> list[str]:
    """The longest part from the start that is an expression, operators after their operands.

    Precedence: with, and, or; equal operators from the left. What does not fit where it stands
    ends the expression; an operator left without a right side is dropped, and parentheses still
    open are closed at the end.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand = True
    for token in tokens:
        if token == "(" and operand:
            waiting.append(token)
        elif operand and token not in OPERATORS and token != ")":
            out.append(token)
            operand = False
        elif not operand and token == ")" and "(" in waiting:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif not operand and token in OPERATORS:
            while waiting and OPERATORS.get(waiting[-1], 0) >= OPERATORS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        else:
            break
    if operand:
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    return out + [w for w in reversed(waiting) if w != "("]


def _label(name: str) -> str | None:
    return IDENTIFIERS.get(name) or IDENTIFIERS.get(name.removesuffix("+"))


def evaluated(text: str, at: int = 0) -> Expression | None:
    """The expression that begins at a place of a lower-cased text, on its line.

    "or" leaves a choice, so the freer side counts; "and" binds by both; a known exception after
    "with" makes a licence linkable.
    """
    tokens = []
    while (m := _TOKEN.match(text, at)) is not None:
        tokens.append(m[1].rstrip(".") or m[1])
        at = m.end()
    order = postfix(tokens)
    if not order:
        return None
    stack: list[float] = []
    labels, known, exception = set(), True, False
    for n, token in enumerate(order):
        if token in OPERATORS:
            right, left = stack.pop(), stack.pop()
            stack.append(
                max(left, right) if token in ("or", "with") else min(left, right)
            )
            continue
        exception = order[n + 1 : n + 2] == ["with"]
        if exception:
            stack.append(LINKABLE if token in EXCEPTIONS else 0.0)
            continue
        label = _label(token)
        known = known and label is not None
        labels.add(label or "other")
        stack.append(FREEDOM.get(label or "other", 1.0))
    return Expression(tuple(order), frozenset(labels), stack[-1], known)


def _automaton(words: list[tuple[str, object]]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for key, value in words:
        made.add_word(key, value)
    made.make_automaton()
    return made


_AUTOMATA: list = []


def automata() -> list:
    """One automaton of phrases and one of tags for each worker process."""
    if not _AUTOMATA:
        phrases = [(f" {p} ", (len(p) + 2, label, p in BASE)) for p, label in (NOTICES | BASE).items()]
        _AUTOMATA.extend([_automaton(phrases), _automaton(list(TAGS.items()))])
    return _AUTOMATA


def scanned(text: bytes | None) -> tuple[int, list[dict], list[dict]]:
    """(words, places of phrases, expressions) of a whole UTF-8 text; of a null one none.

    A place: word (its first word, from 0), label, base. An expression: postfix, labels, freedom,
    known.
    """
    phrases, tags = automata()
    raw = text or b""
    spaced = np.frombuffer(b" " + raw.translate(_WORDS) + b" ", np.uint8)
    gap = spaced == 32
    kept = ~gap
    kept[0] = True
    kept[1:] |= ~gap[:-1]
    words = spaced[kept]
    # Words are between single spaces; each byte is one character of the decoded text.
    found = [
        (end + 1 - length, label, base)
        for end, (length, label, base) in phrases.iter(words.tobytes().decode("latin-1"))
    ]
    n_words = int(np.count_nonzero(words == 32)) - 1
    places = []
    if found:
        gaps = np.flatnonzero(words == 32)
        at = np.searchsorted(gaps, [start for start, *_ in found])
        places = [
            {"word": int(w), "label": label, "base": base}
            for w, (_, label, base) in zip(at, found)
        ]
    expressions = []
    lower = raw.translate(_LOWER)
    if b"licen" in lower:
        plain = lower.decode("latin-1")
        for end, always in tags.iter(plain):
            e = evaluated(plain, end + 1)
            if e is not None and (always or e.known):
                expressions.append(
                    {"postfix": " ".join(e.postfix), "labels": sorted(e.labels),
                     "freedom": e.freedom, "known": e.known}
                )
    return n_words, places, expressions


_PLACES = ArrayType(StructType([
    StructField("word", LongType()), StructField("label", StringType()),
    StructField("base", BooleanType()),
]))
_EXPRESSIONS = ArrayType(StructType([
    StructField("postfix", StringType()), StructField("labels", ArrayType(StringType())),
    StructField("freedom", DoubleType()), StructField("known", BooleanType()),
]))
_ARROW_PLACES = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))
_ARROW_EXPRESSIONS = pa.list_(pa.struct([
    ("postfix", pa.string()), ("labels", pa.list_(pa.string())), ("freedom", pa.float64()),
    ("known", pa.bool_()),
]))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, places, expressions, as `scanned` gives them.

    Whole texts are read where they lie; nothing is shuffled and texts do not leave the task. A
    null or empty text has no words and no findings, rows of equal or null id keep a row each,
    other columns are not read.
    """
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = StructType([
        StructField("doc_id", thin.schema["doc_id"].dataType), StructField("n_words", LongType()),
        StructField("places", _PLACES), StructField("expressions", _EXPRESSIONS),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time: a batch's texts are not copied together.
            rows = [scanned(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], _ARROW_PLACES),
                    pa.array([r[2] for r in rows], _ARROW_EXPRESSIONS),
                ],
                schema.names,
            )

    return thin.mapInArrow(scan, schema)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, freedom, expressions.

    score is the chance that the text states a licence at all, 0 without findings. freedom is the
    least of its findings, null without any; expressions are in postfix order, joined by "; ". A
    text without a base phrase has null first_word and last_word and empty base_labels.
    """
    rows = findings(docs, id_col, text_col)
    base = F.filter("places", lambda p: p.getField("base"))
    starts = F.transform(base, lambda p: p.getField("word"))
    labels = F.transform("places", lambda p: p.getField("label"))
    stated = F.flatten(F.transform("expressions", lambda e: e.getField("labels")))
    # Each label counts once for each way in which it was found.
    doubts = F.concat(
        F.transform(F.array_distinct(labels), lambda x: F.lit(1 - TRUST["phrase"])),
        F.transform(
            F.array_distinct(stated),
            lambda x: F.when(x == "other", 1 - TRUST["other"]).otherwise(1 - TRUST["tag"]),
        ),
    )
    free = F.create_map(*[F.lit(v) for pair in FREEDOM.items() for v in pair])
    freedom = F.array_min(
        F.concat(
            F.transform(F.array_distinct(labels), lambda x: F.coalesce(free[x], F.lit(1.0))),
            F.transform("expressions", lambda e: e.getField("freedom")),
        )
    )
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _joined(F.transform(base, lambda p: p.getField("label"))).alias("base_labels"),
        _joined(F.concat(labels, stated)).alias("labels"),
        (1 - F.aggregate(doubts, F.lit(1.0), lambda a, x: a * x)).alias("score"),
        freedom.alias("freedom"),
        F.array_join(F.transform("expressions", lambda e: e.getField("postfix")), "; ").alias("expressions"),
    )
