import random
import re
from collections import Counter

import numpy as np
from conftest import SF
from made import documents
from pyspark.sql import functions as F

from streamscope.llm import rules
from streamscope.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    counts = (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )
    return (*counts, len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, SF).collect()}
    source = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(source)
    for d in source:
        assert tuple(got[d.doc_id])[1:7] == plain(d.text), d.doc_id
        assert not (got[d.doc_id].kept and got[d.doc_id].base_failed)


def test_verdict_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op8_quality_rules"](spark, sf).join(labels, "doc_id")
    long = rows.filter("not base_failed")
    assert long.filter("quality = 1 and not kept").count() <= 0.005 * long.filter("quality = 1").count()
    assert long.filter("quality = 0 and kept").count() <= 0.1 * rows.filter("quality = 0").count()


def dense(votes, counts, rounds=rules.ROUNDS):
    """The model of `estimate`, as arrays over documents' votes: log odds of good for each row."""
    votes, counts = np.array(votes), np.array(counts, float)
    against, cast = votes < 0, votes != 0
    *belief, most = np.array(list(rules.RULES.values())).T
    belief = np.array(belief)
    rates, good, total = belief.copy(), rules.GOOD, counts.sum()
    for _ in range(rounds + 1):
        bad = np.minimum(0, np.log(rates[0] / rates[1]))
        fine = np.maximum(0, np.log((1 - rates[0]) / (1 - rates[1])))
        odds = np.log(good / (1 - good)) + np.where(against, bad, 0).sum(axis=1)
        odds += np.where(cast & ~against, fine, 0).sum(axis=1) / np.maximum(1, (cast & ~against).sum(axis=1))
        p = 1 / (1 + np.exp(-odds))
        good = ((counts * p).sum() + rules.ASSUMED * total * rules.GOOD) / (total * (1 + rules.ASSUMED))
        for side, q, prior in ((0, p, rules.GOOD), (1, 1 - p, 1 - rules.GOOD)):
            extra = rules.ASSUMED * (counts @ cast) * prior
            rates[side] = ((counts * q) @ against + extra * belief[side]) / ((counts * q) @ cast + extra)
        rates[0] = np.minimum(rates[0], most)
    return odds


def test_plain_model_gives_the_same_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    votes = [v.alias(r) for r, v in rules._votes().items()]
    rows = rules.measured(docs).select("doc.doc_id", rules.base_failed().alias("failed"), *votes).collect()
    odds = dense([r[2:] for r in rows], [1] * len(rows))
    kept = {r.doc_id: r.kept for r in rules.verdicts(docs).collect()}
    assert kept == {r.doc_id: bool(not r.failed and o >= 0) for r, o in zip(rows, odds)}


def text(n, line="Word{0} number {1} of the ordinary sentence.", lines=12):
    return "\n".join(line.format(n * 31 + i, i) for i in range(lines))


def test_verdicts_are_not_all_must_pass(spark):
    """One doubtful fault is outvoted, one clear fault is not, and several doubts together decide."""
    rows = [(k, text(k)) for k in range(300)]
    lone = "\n".join(" ".join(w + chr(97 + k) for w in ("ordinary", "line", "without", "any", "mark")) for k in range(12))
    doubts = "\n".join(f"{k}{k + 1}{k + 2} x{k}" for k in range(30))
    clear = text(5_000) + " " + " ".join(f"#{chr(97 + k % 26)}{chr(97 + k // 26)}$ %" for k in range(60))
    rows += [(1000, lone), (1001, doubts), (1002, clear)]
    frame = documents(spark, rows)
    got = {r.doc_id: r for r in rules.verdicts(frame).collect()}
    votes = [v.alias(r) for r, v in rules._votes().items()]
    bad = {
        r.doc_id: [n for n in rules.RULES if r[n] < 0]
        for r in rules.measured(frame).select("doc.doc_id", *votes).collect()
    }
    assert bad[1000] == ["endings"] and got[1000].kept
    assert bad[1001] == ["digits", "short_lines", "endings"] and not got[1001].kept
    assert bad[1002] == ["symbols"] and not got[1002].kept
    assert all(got[k].kept for k in range(300))


def test_clean_texts_without_spaces_and_very_long_ones_stay(spark):
    rows = [(k, text(k)) for k in range(300)]
    chinese = "".join(f"第{chr(0x4E00 + k)}{chr(0x5200 + 7 * k)}句话说的是另一件普通的事情。\n" for k in range(40))
    rng = random.Random(1)
    common = [f"w{k}" for k in range(3000)]
    long = " ".join(rng.choice(common) + ("." if k % 12 == 0 else "") for k in range(150_000))
    got = {r.doc_id: r for r in rules.verdicts(documents(spark, [*rows, (1000, chinese), (1001, long)])).collect()}
    assert got[1000].kept and got[1001].kept


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e " * 40), (4, "x" * 200_000),
            (5, "w" + " " + "v \t\x0b\x0c\r " * 3), (5, "\n\n a\n a\n a \n\n"),
            (6, " ".join(str(i) for i in range(30_000))), (7, "a b c d e f a b c d e")]
    rows += [(100 + n, " ".join(f"word{n}x{k}" for k in range(30))) for n in range(20)]
    frame = documents(spark, rows).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(0))
    got = sorted((tuple(r)[:7] for r in rules.verdicts(frame).collect()), key=repr)
    want = sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert got == want
    kept = rules.filter_documents(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [6, *range(100, 120)]
    assert rules.verdicts(frame.limit(0)).collect() == []
    assert rules.filter_documents(frame.limit(0)).collect() == []


def test_estimated_accuracies_order_rules(spark):
    model = rules.fit(rules.measured(spark.read.parquet(f"{SF}/documents.parquet")))
    assert set(model.weights) == set(rules.RULES)
    assert all(w[1] >= 0 >= w[-1] for w in model.weights.values())
    assert all(model.weights[r][-1] < -3 for r in ("symbols", "capitals", "marks"))
    assert model.weights["endings"][-1] > -3
