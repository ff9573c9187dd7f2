"""License scans against word-by-word search and a recursive evaluation of expressions."""

import re

import pytest
from conftest import SF
from hypothesis import given, settings, strategies as st
from made import documents
from pyspark.sql import functions as F

from streamscope.llm import licenses
from streamscope.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TAG = re.compile("|".join(sorted(map(re.escape, licenses.TAGS), key=len, reverse=True)))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def places(words, phrases):
    found = []
    for phrase, label in phrases.items():
        want = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return found


def names(text):
    """Labels of the expressions of a text: the names between operators on a tag's line."""
    found = set()
    for m in TAG.finditer(text):
        e = licenses.evaluated(text, m.end())
        if e and (licenses.TAGS[m[0]] or e.known):
            found |= e.labels
    return found


def plain(doc, text):
    text = lower(text)
    words = WORD.findall(text)
    base = places(words, licenses.BASE)
    at = [i for i, _ in base]
    noticed = {label for _, label in base + places(words, licenses.NOTICES)}
    stated = names(text)
    score = 1.0
    for _ in noticed:
        score *= 1 - 0.9
    for x in stated:
        score *= 1 - (0.5 if x == "other" else 0.98)
    return (
        doc, len(words), len(base), min(at, default=None), max(at, default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted(noticed | stated)), round(1 - score, 9),
    )


def got(frame):
    return sorted(
        ((*tuple(r)[:7], round(r.score, 9)) for r in frame.collect()), key=repr
    )


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = got(QUERIES["op11_license_scan"](spark, SF))
    assert out == sorted((plain(*r) for r in rows), key=repr)
    assert any(r[2] for r in out) and any(not r[2] for r in out)


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (None, "Under the MIT License"), (4, "under the mit  license,under_the\nMIT license"),
        (4, "cc by nc cc by nc cc by nc"), (5, "xunder the mit license under the mit licenses"),
        (6, "é under the mit license é"), (7, "word " * 40_000 + "Apache License, Version 2.0"),
        (8, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */ or isc"),
        (9, "License: see the file"), (10, '"license": "BSD-3-Clause"'),
        (11, "SPDX-License-Identifier: LicenseRef-own"), (12, "SPDX-License-Identifier:\nMIT"),
        (13, "\x00\x7f@[`{"), (14, "GPL’s under the mit license"),
    ]
    frame = documents(spark, rows).withColumn("n_words", F.lit("x")).withColumn("places", F.lit(1))
    assert got(licenses.license_report(frame)) == sorted((plain(*r) for r in rows), key=repr)
    full = {r.doc_id: r for r in licenses.license_report(frame).collect()}
    assert full[8].labels == "apache-2,gpl-2,mit" and full[8].freedom == 1.0
    assert full[8].expressions == "mit gpl-2.0-only or apache-2.0 and"
    assert full[9].labels == "" and full[9].score == 0.0 and full[9].freedom is None
    assert full[10].labels == "bsd" and full[11].labels == "other" and full[12].labels == ""
    assert licenses.license_report(frame.limit(0)).collect() == []


@pytest.mark.parametrize("text, order, freedom", [
    ("mit", "mit", 1.0),
    ("mit or gpl-3.0", "mit gpl-3.0 or", 1.0),
    ("mit and gpl-3.0", "mit gpl-3.0 and", 1 / 3),
    ("mit or isc and gpl-3.0", "mit isc gpl-3.0 and or", 1.0),
    ("(mit or isc) and gpl-3.0", "mit isc or gpl-3.0 and", 1 / 3),
    ("gpl-2.0 with classpath-exception-2.0", "gpl-2.0 classpath-exception-2.0 with", 2 / 3),
    ("gpl-2.0 with made-up and mit", "gpl-2.0 made-up with mit and", 1 / 3),
    ("mit or gpl-2.0 with gcc-exception-3.1 and cc-by-nc-4.0",
     "mit gpl-2.0 gcc-exception-3.1 with cc-by-nc-4.0 and or", 1.0),
    ("mit or", "mit", 1.0), ("(mit and (gpl-3.0", "mit gpl-3.0 and", 1 / 3), ("mit) or isc", "mit", 1.0),
    ("mit isc", "mit", 1.0), ("gpl-2.0+ .", "gpl-2.0+", 1 / 3), ("(mit or (", "mit", 1.0),
])
def test_expressions(text, order, freedom):
    e = licenses.evaluated(text)
    assert " ".join(e.postfix) == order and e.freedom == pytest.approx(freedom)


def test_nothing_to_parse():
    assert [licenses.evaluated(t) for t in ("", "and mit", ") mit", "\nmit", "((")] == [None] * 5


LEAF = st.sampled_from(["mit", "gpl-3.0", "mpl-2.0", "cc-by-nc-4.0", "isc"])
TREE = st.recursive(LEAF, lambda x: st.tuples(st.sampled_from(["and", "or"]), x, x), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(TREE)
def test_random_expressions(tree):
    """Any tree, written with parentheses, has the value of its recursive evaluation."""
    def shown(t):
        return t if isinstance(t, str) else f"({shown(t[1])} {t[0]} {shown(t[2])})"

    def value(t):
        if isinstance(t, str):
            return licenses.FREEDOM.get(licenses.IDENTIFIERS[t], 1.0)
        return (min if t[0] == "and" else max)(value(t[1]), value(t[2]))

    e = licenses.evaluated(shown(tree))
    assert e.freedom == value(tree) and e.known


def test_deep_and_long_expressions():
    assert licenses.evaluated("(" * 50_000 + "mit" + ")" * 50_000).postfix == ("mit",)
    assert len(licenses.evaluated(" or ".join(["mit"] * 20_000)).postfix) == 39_999
