"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import packed, word_count, written
from .order import blocks_for, numbered

#: Weights of the sources in code-point order, repeating; the share of all words to take.
WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST_REPEATS = 2
#: Slope of each source's weight over training, repeating likewise: a source with ramp a has the
#: weight target * (1 + a * (2 t - 1)) at time t in 0..1, whose integral is its target.
RAMPS = (-0.5, 0.0, 0.5)

#: Copies are trained on by time; digests order those of one time.
TRAINING_ORDER = ("take.position", "id", "tie")

_KEYS = ("__src", "__none", "__block")


def water_level(sources: DataFrame) -> Fraction:
    """The words per unit of weight at which capped sources and the others use up the share.

    Sources at their cap stay there while the level rises, so each round moves to the level that
    the sources still below can take; it ends when no further source reaches its cap. Each round
    is one aggregation to three whole numbers, exact at any size.
    """
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return Fraction(0)
    level = SHARE * total / weight
    while True:
        cap = MOST_REPEATS * F.col("source_size").cast("decimal(38,0)")
        full = F.col("weight") * F.lit(str(level.numerator)).cast("decimal(30,0)") >= (
            cap * F.lit(str(level.denominator)).cast("decimal(12,0)")
        )
        held, rest = sources.agg(
            F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if not rest:
            return level
        following = (SHARE * total - int(held or 0)) / int(rest)
        if following == level:
            return level
        level = following


def source_targets(sizes: DataFrame) -> DataFrame:
    """(__src, __none, source_size, target, ramp) from rows with __src, __none, size."""
    totals = sizes.groupBy("__src", "__none").agg(F.sum("size").alias("source_size"))
    ranked = numbered(
        totals, F.col("__none"), F.col("__src"), name="rank", label="sources"
    )
    turn = F.pmod(F.col("rank"), F.lit(len(WEIGHTS))).cast("int") + 1
    ranked = ranked.withColumns(
        {
            "weight": F.element_at(F.array(*map(F.lit, WEIGHTS)), turn),
            "ramp": F.element_at(F.array(*map(F.lit, RAMPS)), turn),
        }
    )
    level = water_level(ranked)
    open_target = F.element_at(
        F.array(*[F.lit(float(level * w)) for w in WEIGHTS]), turn
    )
    cap = (MOST_REPEATS * F.col("source_size")).cast("double")
    return ranked.select(
        "__src", "__none", "source_size", F.least(open_target, cap).alias("target"), "ramp"
    )


def _position(demand: Column, ramp: Column) -> Column:
    """The time at which a source has been asked for this share of its target.

    The integral of its weight up to t is t + ramp * (t * t - t).
    """
    root = F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * demand)
    return F.when(ramp == 0, demand).otherwise((root - (1 - ramp)) / (2 * ramp))


def _keyed(rows: DataFrame, id_col: Column, text: Column, source: Column) -> DataFrame:
    """What places a document: id, source, size, and a digest of the text between equal ids."""
    return rows.withColumns({
        "id": id_col,
        "__src": F.coalesce(source.cast("string"), F.lit("")),
        "__none": source.isNull(),
        "__size": word_count(text),
        "tie": F.xxhash64(text),
    })


def assigned(keyed: DataFrame) -> DataFrame:
    """The rows of `_keyed` with a struct `mix`: size, source_size, target, takes.

    `takes` lists (words, position) of the document's copies in the mix, none to two. A source's
    documents are laid end to end in the order of a hash, twice; the mix takes what lies before
    the target, so that only one document of a source can be cut (its first words are taken) and
    each source's words differ from its target by less than one. A null text has no words and
    takes no part; null is a source, the last one. Rows that agree in id, size and text digest are
    the same to the mix.

    A source may hold any share of the rows, and an id too: running sums are those of blocks of the
    hash, within blocks, and over the blocks' sums.
    """
    bits = blocks_for(keyed)
    keyed = keyed.withColumn("__spot", F.xxhash64("id", "__size", "tie"))
    keyed = keyed.withColumn("__block", F.shiftrightunsigned("__spot", 64 - bits))
    thin = keyed.select(*_KEYS, F.col("__size").alias("size"))
    sums = written(thin.groupBy(*_KEYS).agg(F.sum("size").alias("size")), "block_sums")
    before = Window.partitionBy("__src", "__none").orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = sums.select(
        *_KEYS, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__base")
    ).join(source_targets(sums), ["__src", "__none"])
    names = {c: f"__{c}" for c in ("source_size", "target", "ramp")}
    bases = bases.withColumnsRenamed(names)
    within = (
        Window.partitionBy(*_KEYS)
        .orderBy(F.shiftrightunsigned("__spot", 1), "__spot", "id", "__size", "tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    laid = keyed.join(bases, list(_KEYS)).withColumn(
        "__start", F.col("__base") + F.sum("__size").over(within) - F.col("__size")
    )
    whole = F.floor("__target")

    def take(passed: int) -> Column:
        start = F.col("__start") + passed * F.col("__source_size")
        words = F.greatest(F.lit(0), F.least(F.col("__size"), whole - start)).cast("long")
        middle = (start + words / 2) / F.nullif(F.col("__target"), F.lit(0.0))
        return F.struct(words.alias("words"), _position(middle, F.col("__ramp")).alias("position"))

    takes = F.filter(
        F.array(*[take(k) for k in range(MOST_REPEATS)]), lambda x: x.getField("words") > 0
    )
    mix = F.struct(
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        takes.alias("takes"),
    )
    return laid.withColumn("mix", mix)


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position and place.

    The copies are put in training order, as in `mixed`, and a document's figures are read from its
    copies there: the words they hold, and of the first one the time in 0..1 and the number in that
    order, from 0. Rows of equal id keep a row each; other columns are not read. No documents: no
    rows.
    """
    roles = [F.col(id_col), F.col(text_col), F.col(source_col)]
    thin = _keyed(docs.select(*[c.alias(f"c{k}") for k, c in enumerate(roles)]), *map(F.col, ("c0", "c1", "c2")))
    rows = written(
        assigned(thin.drop("c0", "c1", "c2")).select(
            F.monotonically_increasing_id().alias("row"), "id", "tie", "mix"
        ),
        "assigned",
    )
    copies = rows.select("row", "id", "tie", F.explode("mix.takes").alias("take"))
    trained = numbered(copies, *map(F.col, TRAINING_ORDER), name="place", label="training_order")
    read = trained.groupBy("row").agg(
        F.sum("take.words").alias("taken"),
        F.min("take.position").alias("position"),
        F.min("place").alias("place"),
    )
    return rows.join(read, "row", "left").select(
        F.col("id").alias("doc_id"),
        *[F.col(f"mix.{n}").alias(n) for n in ("size", "source_size", "target")],
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "position",
        "place",
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The documents of the mix in training order, with the columns of `docs`.

    A document taken twice is two rows; of a cut one the text holds the first words taken. A
    column n_chars follows the text. Documents that the mix does not take are left out.
    """
    doc = F.col("doc")
    rows = assigned(_keyed(packed(docs), doc[id_col], doc[text_col], doc[source_col]))
    copies = rows.select(
        "doc", "id", "tie", F.col("mix.size").alias("size"), F.explode("mix.takes").alias("take")
    )
    words, text = F.col("take.words"), doc[text_col]
    # Split where a word begins, so that separators stay with the word before them.
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = text.rlike(r"^[\x20\x09-\x0D]").cast("int")
    cut = F.array_join(F.slice(parts, F.lit(1), words.cast("int") + lead), "")
    after = doc.withField(text_col, cut)
    if "n_chars" in docs.columns:
        after = after.withField("n_chars", F.length(cut).cast(docs.schema["n_chars"].dataType))
    return (
        copies.repartitionByRange(*map(F.col, TRAINING_ORDER))
        .sortWithinPartitions(*map(F.col, TRAINING_ORDER))
        .select(F.when(words < F.col("size"), after).otherwise(doc).alias("doc"))
        .select("doc.*")
    )
