"""Language identification by compression with per-language dictionaries.

Text in a language compresses best beside text of the same language. Each language gets a raw
content dictionary from sampled labelled texts; a whole text is cut into blocks, every block is
compressed with every dictionary, and the language with the smallest total is chosen. If no
dictionary is clearly better than the others, the choice is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType, StructField, StringType, DoubleType, BooleanType

#: Sampled labelled texts per language, and characters taken from each: at most 800 * 2,048.
SAMPLE_TEXTS = 800
SAMPLE_CHARS = 2048
#: Languages learned at most, the most frequent ones.
LANGUAGES = 4096
#: Bytes of all dictionaries together, and of one at most, and letters of a passage at least.
ALL_BYTES = 8 << 20
DICTIONARY_BYTES = 48 << 10
PASSAGE = 64
#: A block's characters: short, so that a block leans on the dictionary and not on itself.
BLOCK = 2048
#: Matches of four bytes, searched lazily through the whole dictionary: the usual settings for
#: short inputs look for longer ones, and syllables are what tells languages apart.
MATCHING = {"min_match": 4, "window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 3}
#: A choice is rejected if the next language needs less than this fraction more bytes.
MARGIN = 0.01
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def letters(text: str) -> str:
    """Lower-case words of letters alone, so that case, numbers and marks have no say."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


@dataclass(frozen=True)
class Model:
    """Dictionary bytes by language."""

    dictionaries: dict[str, bytes]


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    sample_texts: int = SAMPLE_TEXTS,
) -> Model:
    """Dictionaries from a bounded sample: the labelled texts of smallest id hash per language.

    Null languages and null texts teach nothing. All labelled rows can be sampled, whatever their
    place. Passages are cut to their dictionary's share before they reach the driver: about four
    times ALL_BYTES at most, for up to LANGUAGES languages.
    """
    spot = F.xxhash64(F.col(id_col))
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.substring(text_col, 1, SAMPLE_CHARS).alias("text"),
        spot.alias("spot"),
    )
    # A common language sends on about four times its sample, from a narrow scan of counts.
    counts = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()
    rates = [x for r in counts for x in (F.lit(r["lang"]), F.lit(4.0 * sample_texts / r["count"]))]
    if not rates:
        return Model({})
    room = min(DICTIONARY_BYTES, ALL_BYTES // len(counts))
    most = min(sample_texts, max(1, room // PASSAGE))
    part = F.shiftrightunsigned("spot", 1) / F.lit(float(1 << 63))
    rows = rows.filter(part < F.element_at(F.create_map(*rates), F.col("lang")))
    order = Window.partitionBy("lang").orderBy("spot", "text")
    # Something of every passage, until the dictionary is full.
    each = F.greatest(F.lit(PASSAGE), F.floor(F.lit(room) / F.count("*").over(Window.partitionBy("lang"))))
    sample = (
        rows.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= most)
        .withColumn("each", each.cast("int"))
        .select("lang", "n", "each", F.substring("text", F.lit(1), 4 * F.col("each")).alias("text"))
    )
    texts: dict[str, list[str]] = {}
    for r in sample.orderBy("lang", "n").toLocalIterator():
        passage = letters(r.text)[: r.each]
        texts.setdefault(r.lang, []).extend([passage] if passage else [])
    out = {}
    for lang, parts in texts.items():
        out[lang] = " ".join(parts).encode("utf-8", "ignore")[:room] or lang.encode()
    return Model(dict(sorted(out.items())))


def compressor(data: bytes) -> Callable[[bytes], bytes]:
    """Compression beside a raw content dictionary."""
    import zstandard as z

    params = z.ZstdCompressionParameters(
        strategy=z.STRATEGY_LAZY, write_content_size=False, write_dict_id=False, **MATCHING
    )
    kept = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
    kept.precompute_compress(compression_params=params)
    return z.ZstdCompressor(dict_data=kept, compression_params=params).compress


class Classifier:
    def __init__(self, model: Model):
        self.langs = list(model.dictionaries)
        self.compress = [compressor(data) for data in model.dictionaries.values()]

    def sizes(self, text: str) -> list[int]:
        clean = letters(text)
        blocks = [
            clean[i : i + BLOCK].encode("utf-8", "surrogatepass")
            for i in range(0, len(clean), BLOCK)
        ]
        return [sum(len(c(b)) for b in blocks) for c in self.compress]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); the score is how much smaller the choice is than the next,
        from 0 to 1 at a fifth of its size. Equal sizes go to the language first in order."""
        if text is None or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        ranked = sorted(zip(self.sizes(text), range(len(self.langs))))
        best, k = ranked[0]
        gap = (ranked[1][0] - best) / max(1, best) if len(ranked) > 1 else 1.0
        return self.langs[k], min(1.0, 5 * gap), gap < MARGIN


RESULT = StructType(
    [
        StructField("lang_pred", StringType()),
        StructField("score", DoubleType()),
        StructField("rejected", BooleanType()),
    ]
)


def predicted(model: Model, text: Column) -> Column:
    """A struct (lang_pred, score, rejected) for each whole text."""

    @F.pandas_udf(RESULT)
    def classify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(model)
        for series in texts:
            rows = [classifier.predict(t) for t in series]
            yield pd.DataFrame(rows, columns=RESULT.names)

    return classify(text)


def crc_fold(id_col: str, folds: int) -> Column:
    """Fold of a document by the checksum of its id as text; null ids are in fold 0."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds))


def identified(docs: DataFrame) -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score, rejected) per document.

    Learns from folds 0, 1 and 3 of four. A null text, or one without a letter, is `und`, rejected
    with score 0, and so is every text if there is nothing to learn from. Rows of equal id keep a
    row each; other columns are not read.
    """
    held = crc_fold("doc_id", 4) == 2
    model = fit(docs.select("doc_id", "text", "lang").filter(~held))
    return docs.select(
        "doc_id", held.alias("held_out"), predicted(model, F.col("text")).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
