import random

import xxhash
from conftest import SF
from made import documents
from pyspark.sql import functions as F

from streamscope.llm import simhash
from streamscope.llm.queries import QUERIES


def plain(text):
    """The fingerprint rule, bit by bit."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Components by comparing every pair."""
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_masks_cover_the_radius():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for a in range(64):
        for b in range(64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op1_simhash"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: plain(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == classes(prints)


def test_links_of_large_and_small_buckets(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {}
    for i in range(240):
        p = base[i % 6]
        for _ in range(rng.randrange(4)):
            p ^= 1 << rng.randrange(64)
        prints[i] = p
    want = classes(prints)
    frame = spark.createDataFrame(
        [(i, simhash._signed(p)) for i, p in prints.items()], "i long, fp long"
    )
    for most in (1, 8, 1000):
        monkeypatch.setattr(simhash, "PAIRWISE", most)
        found = {r.fp: r.root for r in simhash.near_classes(frame).collect()}
        groups = {}
        for i, p in prints.items():
            s = simhash._signed(p)
            groups.setdefault(found.get(s, s), set()).add(want[i])
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len(set(want.values()))


def test_edges_of_the_rule(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "one two"), (5, "One TWO"), (5, "one two"),
            (7, "É é x"), (8, "é É x"), (9, "w " * 70_000)]
    frame = documents(spark, rows).withColumn("fingerprint", F.lit(1)).withColumn("component_id", F.lit(2))
    got = [tuple(r) for r in simhash.near_duplicates(frame).collect()]
    assert sorted(r[0] for r in got if r[1] == "0" * 16) == [1, 2, 3]
    assert all(r[2] == 1 for r in got if r[0] in (1, 2, 3))
    assert sorted(str(r[0]) for r in got if r[1] == f"{plain('one two'):016x}") == ["5", "5", "None"]
    assert {r[2] for r in got if r[0] in (None, 5)} == {5}
    assert len({r[1] for r in got if r[0] in (7, 8)}) == 2
    assert simhash.near_duplicates(frame.limit(0)).collect() == []
