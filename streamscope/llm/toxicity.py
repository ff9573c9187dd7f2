"""Toxicity of whole texts by a recurrent network over overlapping windows of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from . import recurrent as net
from .langid import crc_fold

#: Words of a window, and from one window's start to the next.
LENGTH = 48
STRIDE = 32
#: Labelled texts to learn from, per label, and characters taken from each.
SAMPLE_TEXTS = 1500
SAMPLE_CHARS = 16_000
#: Words with a vector of their own, trigram buckets, sizes of inputs and states.
VOCABULARY = 4096
GRAMS = 8192
INPUTS = 8
HIDDEN = 8
ROUNDS = 5
STEPS = 160
#: Windows scored at once.
BATCH = 1024
_TEXT_BYTES = 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


@dataclass
class Words:
    """Words of several texts: a hash each, their trigrams, and where texts begin."""

    hashes: np.ndarray
    grams: np.ndarray
    bounds: np.ndarray
    texts: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        """Words are runs of lower-case letters; a trigram is a letter's byte and its neighbours."""
        parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" " + b" ".join(parts) + b"  ", np.uint8)
        letter = _LETTER[data]
        held = np.where(letter, data, 0).astype(np.uint32)
        at = np.flatnonzero(letter)
        mixed = (held[at - 1] << 16 | held[at] << 8 | held[at + 1]).astype(np.uint64)
        mixed = (mixed + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        grams = (mixed >> np.uint64(64 - 13)).astype(np.int32) % GRAMS
        first = np.flatnonzero(letter & ~np.roll(letter, 1))
        bounds = np.searchsorted(at, first)
        hashes = np.add.reduceat(mixed, bounds) if len(first) else np.zeros(0, np.uint64)
        ends = np.cumsum([1 + len(p) for p in parts])
        begins = np.searchsorted(first, np.concatenate([[0], ends]))
        return cls(hashes, grams, np.concatenate([bounds, [len(at)]]), begins)


def windows_of(words: Words, vocabulary: np.ndarray) -> tuple[net.Windows, np.ndarray]:
    """All overlapping windows of the texts, and which text each is from; at least one a text."""
    counts = np.diff(words.texts)
    each = 1 + np.maximum(0, -(-(counts - LENGTH) // STRIDE))
    text = np.repeat(np.arange(len(counts)), each)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    places = nth[:, None] * STRIDE + np.arange(LENGTH)
    real = places < counts[text][:, None]
    at = np.where(real, words.texts[:-1][text][:, None] + places, 0).ravel()
    numbers = np.zeros(len(words.hashes) + 1, np.int32)
    if len(vocabulary) and len(words.hashes):
        found = np.searchsorted(vocabulary, words.hashes).clip(max=len(vocabulary) - 1)
        numbers[:-1] = np.where(vocabulary[found] == words.hashes, found + 1, 0)
    size = np.where(real.ravel(), np.append(np.diff(words.bounds), 0)[at], 0)
    bounds = np.concatenate([[0], np.cumsum(size)])
    inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    grams = words.grams[np.repeat(words.bounds[at], size) + inside]
    ids = np.where(real, numbers[at].reshape(real.shape), -1)
    return net.Windows(ids, grams, bounds), text


@dataclass
class Model:
    vocabulary: np.ndarray
    params: net.Params

    def window_odds(self, windows: net.Windows) -> np.ndarray:
        index = np.arange(len(windows))
        return np.concatenate([
            net.log_odds(self.params, windows.take(index[i : i + BATCH]))
            for i in range(0, len(index), BATCH)
        ]) if len(index) else np.zeros(0)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of each text's most toxic window."""
        if not texts:
            return np.zeros(0)
        windows, text = windows_of(Words.of(texts), self.vocabulary)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, self.window_odds(windows))
        return 1 / (1 + np.exp(-best.clip(-30, 30)))


def _evidence(words: Words, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, by hash, and a smoothed log ratio of their texts with and without the label."""
    text = np.repeat(np.arange(len(labels)), np.diff(words.texts))
    pairs = np.unique(np.stack([words.hashes, text.astype(np.uint64)]), axis=1)
    known, number = np.unique(pairs[0], return_inverse=True)
    hit = labels[pairs[1].astype(int)] > 0
    there = np.bincount(number[hit], minlength=len(known))
    other = np.bincount(number[~hit], minlength=len(known))
    share = max(1, labels.sum()) / max(1, (1 - labels).sum())
    return known, np.log((there + 3) / (other * share + 3))


def fit(texts: list[str], labels: np.ndarray, rates: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Train on labelled texts; `rates` are the shares of each label's rows that they stand for.

    The label belongs to a whole text, so a toxic text teaches through its most toxic window as
    the network sees it, and a clean text through its most toxic and another window. Word vectors
    start from how many texts of one half have each word; the network learns on the other half.
    The bias is set where the weighted texts of that half are told apart best.
    """
    labels = np.asarray(labels)
    if not len(texts) or labels.min() == labels.max():
        params = net.initial(1, GRAMS, INPUTS, HIDDEN)
        params["o"][:] = 0
        params["bias"][0] = 3.0 if len(labels) and labels.min() else -3.0
        return Model(np.zeros(0, np.uint64), params)
    rng = np.random.default_rng(11)
    half = np.zeros(len(texts), bool)
    for y in (0, 1):
        half[rng.permutation(np.flatnonzero(labels == y))[::2]] = True
    known, weight = _evidence(Words.of([t for t, h in zip(texts, half) if h]), labels[half])
    strong = np.sort(np.argsort(-np.abs(weight), kind="stable")[:VOCABULARY])
    params = net.initial(len(strong) + 1, GRAMS, INPUTS, HIDDEN)
    params["word"][1:, 0] = weight[strong]
    model = Model(known[strong], params)
    learn = np.flatnonzero(~half) if min(labels[~half].sum(), (1 - labels[~half]).sum()) else np.arange(len(texts))
    windows, text = windows_of(Words.of([texts[i] for i in learn]), model.vocabulary)
    y = labels[learn]
    by_text = [np.flatnonzero(text == i) for i in range(len(learn))] if len(learn) < 64 else np.split(
        np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1
    )
    first = np.where(windows.words > 0, params["word"][np.maximum(windows.words, 0), 0], 0)
    odds = np.sort(first, axis=1)[:, -3:].sum(axis=1)
    adam = net.Adam(params, 0.01)
    for turn in range(ROUNDS):
        best = np.array([w[odds[w].argmax()] for w in by_text])
        other = np.array([rng.choice(w) for w in by_text])
        toxic, clean = best[y > 0], np.concatenate([best[y == 0], other[y == 0]])
        adam.rate = 0.01 * 0.6**turn
        for _ in range(STEPS):
            pick = np.concatenate([rng.choice(toxic, 32), rng.choice(clean, 32)])
            target = np.repeat([1.0, 0.0], 32).astype(np.float32)
            adam.step(net.gradients(params, windows.take(pick), target)[1])
        odds = model.window_odds(windows)
    worst = np.array([odds[w].max() for w in by_text])
    cost = np.where(y > 0, 1 / rates[1], 1 / rates[0])
    order = np.argsort(worst)
    # Errors if everything above each gap between neighbouring texts counts as toxic.
    below = np.concatenate([[0], np.cumsum(np.where(y > 0, cost, -cost)[order])])
    cut = int(np.argmin(below + (cost * (y == 0)).sum()))
    ends = np.concatenate([[worst.min() - 2], worst[order], [worst.max() + 2]])
    params["bias"][0] -= (ends[cut] + ends[cut + 1]) / 2
    return model


def sampled(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", texts: int = SAMPLE_TEXTS
) -> tuple[list[str], np.ndarray, tuple[float, float]]:
    """At most `texts` labelled texts of either label, those of smallest id hash, and their shares.

    Ids are sampled first, so only as many rows meet the documents. An id with several labels
    counts as toxic if one of them is; null ids and labels are left out. Of the rows of an id the
    least text is taken.
    """
    marks = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("y"))
        .withColumn("spot", F.xxhash64("doc_id"))
    )
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    rates = [min(1.0, texts / max(1, counts.get(y, 0))) for y in (0, 1)]
    part = F.shiftrightunsigned("spot", 1) / F.lit(float(1 << 63))
    rate = F.when(F.col("y") == 1, 4 * rates[1]).otherwise(4 * rates[0])
    order = Window.partitionBy("y").orderBy("spot", "doc_id")
    ids = (
        marks.filter(part < rate)
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= texts)
        .select("doc_id", "y")
    )
    # One text for each id, however often the id is repeated.
    rows = (
        docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
    )
    found = sorted((r.doc_id, r.text or "", r.y) for r in rows.toLocalIterator())
    return [t for _, t, _ in found], np.array([y for *_, y in found]), tuple(rates)


def scored(model: Model, text: Column) -> Column:
    """The toxicity of each whole text, null ones as empty; a few texts at a time."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out, held, size = [], [], 0
            for t in series:
                held.append(t or "")
                size += len(held[-1])
                if size >= _TEXT_BYTES:
                    out.append(model.scores(held))
                    held, size = [], 0
            yield pd.Series(np.concatenate([*out, model.scores(held)]), dtype="float64")

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) per document.

    Learns from folds 1 to 4 of five. Rows of equal id keep a row each; other columns are not
    read. Without labels of both kinds every text gets the same score.
    """
    held = crc_fold("doc_id", 5) == 0
    model = fit(*sampled(docs, labels.filter(~held)))
    score = F.when(F.isnan("score"), F.lit(0.0)).otherwise(F.col("score"))
    return docs.select(
        "doc_id", held.alias("held_out"), scored(model, F.col("text")).alias("score")
    ).select(
        "doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )
