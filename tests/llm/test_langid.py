import zlib

from made import documents
from pyspark.sql import functions as F

from streamscope.llm import langid
from streamscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op3_language_id"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    sure = [r for r in held if not r.rejected]
    assert len(sure) > 0.9 * len(held)


def test_sizes_are_sums_over_the_blocks_of_the_whole_text():
    model = langid.Model({"a": b"la le li lo lu " * 50, "b": b"xy yx xx yy " * 50})
    text = "la lo LE 12 yx! " * 300 + "\nxy" * 5
    clean = langid.letters(text)
    assert clean.startswith("la lo le yx la") and clean.endswith("yx xy xy xy xy xy")
    for got, data in zip(langid.Classifier(model).sizes(text), model.dictionaries.values()):
        compress = langid.compressor(data)
        blocks = [clean[i : i + langid.BLOCK] for i in range(0, len(clean), langid.BLOCK)]
        assert "".join(blocks) == clean
        assert got == sum(len(compress(b.encode())) for b in blocks)


def test_narrow_margins_are_rejected():
    same = langid.Model({"a": b"la le li lo lu " * 50, "b": b"la le li lo lu " * 50})
    assert langid.Classifier(same).predict("la le li") == ("a", 0.0, True)


def test_edges(spark):
    rows = [(n, "der die das und nicht " * 9, "de") for n in range(40)]
    rows += [(50 + n, "the and of with from " * 9, "en") for n in range(40)]
    rows += [(90, None, "en"), (91, "", "en"), (92, "12 34 !!", "de"), (None, "das und die", None),
             (93, "the and with " * 40_000, None), (93, "THE AND!! OF!!", "de")]
    frame = documents(spark, rows).withColumn("lang_pred", F.lit("x")).withColumn("p", F.lit(1))
    got = langid.identified(frame).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.lang_pred)
    assert [by[i] for i in (90, 91, 92, None, 93)] == [["und"]] * 3 + [["de"], ["en", "en"]]
    assert langid.identified(frame.limit(0)).collect() == []
    untaught = langid.identified(frame.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in untaught} == {"und"}


def test_a_dirty_language_column_stays_small(spark):
    """Ten thousand values: the most frequent are learned, each from a share of the whole room."""
    rows = [(n, f"text {n} of value {n} " * 40, f"v{n}") for n in range(10_000)]
    rows += [(20_000 + n, "der die das und nicht " * 20, "de") for n in range(50)]
    model = langid.fit(documents(spark, rows))
    assert len(model.dictionaries) == langid.LANGUAGES and "de" in model.dictionaries
    assert sum(map(len, model.dictionaries.values())) <= langid.ALL_BYTES
