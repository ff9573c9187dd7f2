"""Quality rules as weak supervision: rules vote or abstain, their accuracies are estimated by
expectation-maximisation without labels, and documents are kept by posterior probability.

Each rule votes on its own measure: for a document in its ordinary range, against it beyond a limit,
not at all in between. Some rules are known to be seldom wrong about a good document, others often;
that knowledge enters the estimate as a prior, so that one clear fault can decide and one doubtful
fault does not.

Everything about documents is DataFrame functions. The driver sees only the number of documents
for each combination of votes, at most 3 ** len(RULES) rows at any corpus size (59,049).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import common
from .common import words_of, written

WINDOW = 5
#: Words over which different words are counted.
STRETCH = 500
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
SYMBOLS = "#*$%&|<>"
ROUNDS = 40


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Two structs for each document: `doc`, its columns, and `__m`, counts over its whole text.

    Per row: n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word),
    n_dup_lines (lines with a word, equal to an earlier line), n_repeat_words (words covered by
    windows of five that occur twice or more), n_fresh (different words in each stretch of STRETCH
    words, summed), n_upper (A-Z), n_marks ('!'), n_digits (0-9), n_ended (lines that end a
    sentence), n_bytes and n_chars of the text. A null text counts as empty: zeros.

    Repeated windows are found within the row by sorting their hashes, so that no window of any
    document is shuffled; texts without a repeated window skip that.
    """
    packed = common.packed(docs).withColumn("text", F.col("doc").getField(text_col))
    text = F.coalesce(F.col("text"), F.lit(""))

    def count_of(kept: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = packed.select("*", words_of(F.col("text")).alias("__w"), lines.alias("__l"))
    step = step.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))

    def window_hash(i: Column) -> Column:
        return F.xxhash64(*[F.get("__h", i + F.lit(k)) for k in range(WINDOW)])

    step = step.withColumn(
        "__g",
        F.when(
            F.size("__h") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("__h") - F.lit(WINDOW)), window_hash),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    step = step.withColumn(
        "__s",
        F.when(
            F.size(F.array_distinct("__g")) < F.size("__g"),
            F.array_sort(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )

    def repeated(x: Column, j: Column) -> Column:
        near = [F.get("__s", j + F.lit(d)).getField("h") == x.getField("h") for d in (-1, 1)]
        return F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False))

    step = step.withColumn(
        "__p",
        F.array_sort(F.transform(F.filter("__s", repeated), lambda x: x.getField("i"))),
    )
    # Each window covers five words, or as many as come before the next repeated window.
    cover = F.transform(
        "__p",
        lambda p, j: F.least(
            F.lit(WINDOW), F.coalesce(F.get("__p", j + F.lit(1)) - p, F.lit(WINDOW))
        ),
    )
    covered = F.aggregate(cover, F.lit(0), lambda a, x: a + x)
    # A text's share of different words falls with its length; that of a stretch does not.
    stretches = F.sequence(F.lit(1), F.greatest(F.size("__h"), F.lit(1)), F.lit(STRETCH))
    fresh = F.aggregate(
        stretches, F.lit(0),
        lambda a, i: a + F.size(F.array_distinct(F.slice("__h", i, F.lit(STRETCH)))),
    )
    ended = F.filter("__l", lambda x: x.rlike(r"[.!?:;…。！？»”\"')]\s*$"))
    counts = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        count_of(SYMBOLS).alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        fresh.cast("long").alias("n_fresh"),
        count_of("A-Z").alias("n_upper"),
        count_of("!").alias("n_marks"),
        count_of("0-9").alias("n_digits"),
        F.size(ended).cast("long").alias("n_ended"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.length(text).cast("long").alias("n_chars"),
    )
    return step.select("doc", counts.alias("__m"))


#: Each rule with the assumed share of its votes that are against, among those on good documents and
#: among those on poor ones, and the most it may be among good ones: a rule of the first kind is
#: trusted to accuse at most one good document in 200, so that its vote alone can decide.
_CLEAR, _DOUBTFUL = (0.001, 0.3, 0.005), (0.1, 0.3, 0.9)
RULES = {
    "symbols": _CLEAR, "repeated_words": _CLEAR, "repeated_lines": _CLEAR, "capitals": _CLEAR,
    "marks": _CLEAR, "word_length": _CLEAR, "variety": _CLEAR, "digits": _DOUBTFUL,
    "short_lines": _DOUBTFUL, "endings": _DOUBTFUL,
}
#: Weight of what is assumed against what is counted, and the assumed share of good documents.
ASSUMED, GOOD = 1.0, 0.9


def _field(name: str) -> Column:
    return F.col("__m").getField(name)


def _ratio(part: str, whole: str) -> Column:
    return _field(part) / F.greatest(_field(whole), F.lit(1))


def _votes() -> dict[str, Column]:
    """Rule: 1 for good, -1 for bad, 0 to abstain."""
    words, lines = _field("n_words"), _field("n_lines")
    mean = _ratio("word_chars", "n_words")
    # Scripts of three bytes a character mostly have no spaces between words.
    spaced = _field("n_bytes") < 2.2 * _field("n_chars")
    # A value that is bad above the second limit and ordinary up to the first, and where it tells.
    rules = {
        "symbols": (_ratio("n_symbols", "n_words"), 0.08, 0.2, words > 0),
        "repeated_words": (_ratio("n_repeat_words", "n_words"), 0.05, 0.2, words > 0),
        "repeated_lines": (_ratio("n_dup_lines", "n_lines"), 0.2, 0.5, lines > 1),
        "capitals": (_ratio("n_upper", "word_chars"), 0.2, 0.35, words > 0),
        "marks": (_ratio("n_marks", "n_words"), 0.1, 0.3, words > 0),
        "word_length": (F.abs(mean - 7), 5.0, 6.0, spaced),
        "variety": (-_ratio("n_fresh", "n_words"), -0.1, -0.06, words >= 20),
        "digits": (_ratio("n_digits", "word_chars"), 0.1, 0.25, words > 0),
        "short_lines": (-_ratio("n_words", "n_lines"), -6.0, -3.0, lines >= 5),
        "endings": (-_ratio("n_ended", "n_lines"), -0.5, -0.1, lines >= 5),
    }
    return {
        rule: F.when(~tells, 0).when(value > bad, -1).when(value <= ordinary, 1).otherwise(0)
        for rule, (value, ordinary, bad, tells) in rules.items()
    }


@dataclass(frozen=True)
class Model:
    """log prior odds of good, and for each rule the log likelihood ratio of each vote.

    Votes against add up. Votes for depend on each other, as a text that is ordinary in one way
    mostly is in others, and count by their mean.
    """

    prior: float
    weights: dict[str, dict[int, float]]

    def log_odds(self) -> Column:
        against, for_, n = F.lit(0.0), F.lit(0.0), F.lit(0)
        for rule, vote in _votes().items():
            w = self.weights[rule]
            against = against + F.when(vote == -1, w[-1]).otherwise(0.0)
            for_ = for_ + F.when(vote == 1, w[1]).otherwise(0.0)
            n = n + F.when(vote == 1, 1).otherwise(0)
        return F.lit(self.prior) + against + for_ / F.greatest(n, F.lit(1))

    def of(self, votes: tuple) -> float:
        """The log odds of one combination of votes."""
        cast = [self.weights[r][v] for r, v in zip(RULES, votes) if v > 0]
        against = sum(self.weights[r][v] for r, v in zip(RULES, votes) if v < 0)
        return self.prior + against + sum(cast) / max(1, len(cast))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


def estimate(table: list[tuple], rounds: int = ROUNDS) -> Model:
    """Rule accuracies from (votes..., documents) rows, by expectation-maximisation.

    Two classes; votes against are independent within a class, and abstaining tells nothing. What RULES assumes counts like ASSUMED times the votes cast, at any size, and is the
    start. A vote against can never count for a document, nor one for it against it. Without
    documents the assumptions stand.
    """
    total = sum(t[-1] for t in table)
    share, rates = GOOD, {r: [a, b] for r, (a, b, _) in RULES.items()}
    for _ in range(rounds + 1):
        prior = math.log(share / (1 - share))
        weights = {
            r: {-1: min(0.0, math.log(a / b)), 0: 0.0, 1: max(0.0, math.log((1 - a) / (1 - b)))}
            for r, (a, b) in rates.items()
        }
        if not total:
            break
        odds = [Model(prior, weights).of(t[:-1]) for t in table]
        good = [1 / (1 + math.exp(-max(-500.0, min(500.0, o)))) for o in odds]
        mass = sum(t[-1] * g for t, g in zip(table, good))
        share = (mass + ASSUMED * total * GOOD) / (total * (1 + ASSUMED))
        for k, (rule, (*pair, most)) in enumerate(RULES.items()):
            cast = sum(t[-1] for t in table if t[k])
            for side, belief in enumerate((good, [1 - g for g in good])):
                extra = ASSUMED * cast * (GOOD if side == 0 else 1 - GOOD)
                held = sum(t[-1] * p for t, p in zip(table, belief) if t[k])
                against = sum(t[-1] * p for t, p in zip(table, belief) if t[k] < 0)
                if cast:
                    rates[rule][side] = (against + extra * pair[side]) / (held + extra)
            rates[rule][0] = min(rates[rule][0], most)
    return Model(prior, weights)


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Model:
    """`estimate` over all rows of `measured`: the driver sees one row for each combination of votes."""
    votes = [v.cast("int").alias(r) for r, v in _votes().items()]
    return estimate([tuple(r) for r in rows.select(*votes).groupBy(*RULES).count().collect()], rounds)


def base_failed() -> Column:
    return (_field("n_words") < MIN_WORDS) | (
        100 * _field("n_repeat_words") > MAX_REPEATED_PERCENT * _field("n_words")
    )


def judged(rows: DataFrame, model: Model) -> DataFrame:
    """Adds base_failed, good_probability and kept to rows of `measured`."""
    return rows.withColumns(
        {
            "base_failed": base_failed(),
            "good_probability": model.probability(),
            "kept": ~base_failed() & (model.log_odds() >= 0),
        }
    )


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts, base_failed, kept, good_probability.

    Null and empty texts have zero counts and fail the base rule. Rows of equal id keep a row
    each; other columns are not read. Texts are read once: only the counts are written.
    """
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(measured(thin).select("doc.doc_id", "__m"), "measures")
    wanted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(rows, fit(rows)).select(
        "doc_id", *[_field(n).alias(n) for n in wanted], "base_failed", "kept", "good_probability"
    )


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with every column as it was. Nothing is shuffled."""
    rows = written(measured(docs, text_col), "measured")
    kept = ~base_failed() & (fit(rows).log_odds() >= 0)
    return rows.filter(kept).select("doc.*")
