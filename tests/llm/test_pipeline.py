"""The pipeline against plain versions of its stages, each on the rows the stage before kept."""

from collections import Counter
from types import SimpleNamespace

from conftest import SF
from made import documents
from pyspark.sql import functions as F

import corpus_pipeline
import test_linededup
import test_mixing
import test_nearcopies
import test_packing
import test_rules
from streamscope.llm import rules
from streamscope.llm.common import written


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in s.collect()} for s in seen[:4]]

    odds = {r.doc_id: r.good_probability for r in rules.verdicts(docs).collect()}
    good = {i for i, r in rows[0].items() if not test_rules.plain(r.text)[-1] and odds[i] >= 0.5}
    assert set(rows[1]) == good and rows[1] == {i: rows[0][i] for i in good}

    ordered = sorted(rows[1])
    rest = test_linededup.plain([(i, rows[1][i].text) for i in ordered])
    assert {i: r.text for i, r in rows[2].items()} == {i: rest[n] for n, i in enumerate(ordered)}

    assert set(rows[3]) == test_nearcopies.kept([(i, r.text) for i, r in rows[2].items()])

    mixed = seen[4].collect()
    words = Counter()
    for r in mixed:
        words[r.doc_id] += test_mixing.size(r.text)
        assert rows[3][r.doc_id].text.startswith(r.text)
    kept = list(rows[3].values())
    test_mixing.check(
        [
            SimpleNamespace(
                doc_id=r.doc_id, source_size=test_mixing.targets(kept)[0][r.source],
                target=test_mixing.targets(kept)[1][r.source],
                size=test_mixing.size(r.text), taken=words[r.doc_id],
            )
            for r in kept
        ],
        kept,
    )

    packed = seen[5].collect()
    tokens = test_packing.direct(test_packing.FILES[0])
    assert sum(r.length for r in packed) == sum(len(tokens(r.text)) + 1 for r in mixed)
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_empty_and_null_rows(spark, tmp_path):
    rows = [(1, None), (None, "one two three"), (2, ""), (3, "a b c d e f g h i j k l " * 3)]
    for name, frame in (
        ("few", documents(spark, rows)),
        ("none", documents(spark, rows).limit(0)),
    ):
        folder = str(tmp_path / name)
        frame.write.parquet(f"{folder}/documents.parquet")
        assert corpus_pipeline.run(spark, folder).collect() is not None


def test_clashing_names_keep_their_values(spark):
    """Columns named like anything a stage adds come out as they went in."""
    names = (
        "doc row sketch cut rest mix tie id size take same first n keys a b kept m __m __w __l __h __g __s __p "
        "__row __rest __cut __size __src __none __block __spot __base __start __take __text __mix __x"
    ).split()
    rows = [(k, f"This is document number {k}, and " + " ".join(f"word{k}x{i}" for i in range(60)) + ".") for k in range(30)]
    frame = documents(spark, rows)
    for n, name in enumerate(names):
        frame = frame.withColumn(name, F.col("doc_id") * 100 + n)
    want = {r.doc_id: r.asDict() for r in frame.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        got = out.collect()
        assert len(got) >= 20, name
        for r in got:
            mine = {k: v for k, v in r.asDict().items() if k not in ("text", "n_chars")}
            assert mine == {k: want[r.doc_id][k] for k in mine}, name
