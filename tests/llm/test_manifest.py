"""The manifest against trees folded in a list."""

import hashlib
import zlib

from compare import same
from conftest import SF
from made import documents
from pyspark.sql import functions as F

from streamscope.llm import manifest
from streamscope.llm.queries import QUERIES, SQL


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    values = [None if v is None else str(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def beside(tree, at):
    out = []
    for nodes in tree[:-1]:
        low = at // 8 * 8
        out.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + 8])))
        at //= 8
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = {}, []
    for g in order:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[g] = levels([leaf(r, r.text) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for n, r in enumerate(groups[g]):
            path = beside(trees[g], n) + beside(top, k)
            touched = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            text = r.text
            if touched and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((
                r.doc_id, leaf(r, r.text), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)),
                folded, folded == top[-1][0],
            ))
    return sorted(out, key=repr)


def test_whole_table(spark, duck):
    name = "op13_merkle_manifest"
    got = QUERIES[name](spark, SF).toPandas()
    same(got, duck.execute(SQL[name]).fetchdf())
    assert 0 < got.verified.sum() < len(got)


def test_every_shape_of_tree(spark):
    rows, at = [], 0
    for lang, n in (("a", 1), ("b", 8), ("c", 9), ("d", 65), ("e", 513), (None, 2), ("é", 64), ("B", 1), ("", 3), ("f", 7)):
        for _ in range(n):
            at += 1
            rows.append((at * 7919 % 10_007, f"Text {at}", lang))
    frame = documents(spark, rows)
    assert sorted(map(tuple, manifest.manifest_report(frame).collect()), key=repr) == plain(frame.collect())


def test_edges(spark):
    rows = [(None, "One"), (None, None), (5, "Same"), (5, "Same"), (5, "other"), (6, ""), (7, None), (8, "X" * 300_000),
            (9, "ÀÉ Z"), *[(11, "Repeated") for _ in range(30)]]
    frame = documents(spark, rows).withColumn("n_chars", F.when(F.col("doc_id") != 6, F.col("n_chars")))
    frame = frame.withColumn("tree", F.lit("x")).withColumn("at", F.lit(1)).withColumn("leaf", F.lit(None).cast("int"))
    assert sorted(map(tuple, manifest.manifest_report(frame).collect()), key=repr) == plain(frame.collect())
    one = frame.filter("doc_id = 8")
    assert sorted(map(tuple, manifest.manifest_report(one).collect()), key=repr) == plain(one.collect())
    assert manifest.manifest_report(frame.limit(0)).collect() == []


def test_requests_descend_alone(spark):
    """Some requests give the rows that all do, and a path opens with the records it names."""
    frame = documents(spark, [(k, f"t{k}", "de" if k % 3 else "fr") for k in range(700)])
    rows = frame.select(
        manifest.tree_name(F.col("lang")).alias("tree"), "doc_id", manifest.digest(F.col("text")).alias("leaf")
    )
    made = manifest.build(rows)
    every = {r.doc_id: r for r in manifest.proofs(made).collect()}
    some = manifest.proofs(made, made.leaves.filter("doc_id in (3, 4, 400, 699)")).collect()
    assert sorted(r.doc_id for r in some) == [3, 4, 400, 699]
    assert all(r == every[r.doc_id] for r in some)
    records = {r.digest: r.children for r in made.records().collect()}
    for r in some:
        node = r.leaf
        for left, right in r.path:
            children = [(left + node + right)[i : i + 64] for i in range(0, len(left + node + right), 64)]
            node = sha("".join(children))
            assert records[node] == children
        assert node == made.root
