"""Chat formatting in budgeted windows of whole turns, with a loss mask.

Everything is DataFrame functions: running sums of turn tokens give each turn its window, and
arrays of a window's turns give the text. A window holds at most the budget (unless a single turn
is longer), so arrays are bounded; only running sums and checksums see a whole conversation.

The template writes a turn of the model as `<s>text</s>` and any other turn as
`<s>[INST]role[/ROLE]text[/INST]`. Inside roles and texts a backslash is doubled, and one is put
after the first character of every control string, so that none stands there as itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import word_count, written

#: Tokens of a window, and how many of them repeated history may take.
BUDGET = 2048
HISTORY = 256
#: A turn counts its words and this much for its marks.
MARKS = 4
MODEL = "assistant"
SYSTEM = "system"

_CONTROL = r"([<\[])(?=/?s>|/?INST\]|/ROLE\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _sorted_turns(rows: DataFrame) -> Window:
    return Window.partitionBy("conv_id").orderBy("turn", "role", "text")


def spans(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window (from 1), repeated turns, fresh turns.

    Turns in order of their number; ties by role and text; nulls first. The window of a turn
    follows from the tokens before it: a stride of seven eighths of what the system turn and the
    history leave, and a turn that would break the budget is a window of its own. Every window but
    the first repeats a leading system turn, and then all turns just before it that fit the history,
    however many windows they come from.
    """
    turns = rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = _sorted_turns(turns)
    all_rows = Window.partitionBy("conv_id")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leads = (F.col("n") == 1) & (F.col("role") == SYSTEM)
    step = (
        turns.withColumn("n", F.row_number().over(order))
        .withColumn("leads", leads)
        .withColumn("tokens", word_count(F.col("text")) + MARKS)
        .withColumn("own", F.when(F.col("leads"), 0).otherwise(F.col("tokens")))
        .withColumn("end", F.sum("own").over(running))
        .withColumn("start", F.col("end") - F.col("own"))
        .withColumn("system", F.sum(F.when(F.col("leads"), F.col("tokens")).otherwise(0)).over(running))
        .withColumn("fresh", F.greatest(F.lit(2), budget - history - F.col("system")))
        .withColumn("stride", F.floor(F.col("start") / F.ceil(F.col("fresh") * 7 / 8)))
    )
    by_stride = Window.partitionBy("conv_id", "stride")
    step = step.withColumn("base", F.min("start").over(by_stride)).withColumn(
        "alone", (F.col("end") - F.col("base") > F.col("fresh")) & (F.col("start") > F.col("base"))
    )
    step = step.withColumn(
        "window",
        F.dense_rank().over(Window.partitionBy("conv_id").orderBy("stride", "alone")),
    )
    # A turn is history to the windows that begin within that many tokens after its start.
    ahead = Window.partitionBy("conv_id").orderBy("start").rangeBetween(0, history)
    last = F.when(F.col("leads"), F.col("window")).otherwise(F.max("window").over(ahead))
    turn = F.struct("n", "role", "text", "leads", (F.col("into") > F.col("window")).alias("again"))
    windows = (
        step.withColumn("last", last)
        .withColumn("into", F.explode(F.sequence("window", "last")))
        .groupBy("conv_id", "into")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    by_window = Window.partitionBy("conv_id").orderBy("into")
    lead = F.when(
        F.col("into") > 1, F.filter(F.first("turns").over(by_window), lambda t: t.leads)
    ).otherwise(F.slice("turns", 1, 0))
    windows = windows.withColumn("lead", lead)
    return windows.select(
        "conv_id",
        F.col("into").alias("window"),
        F.concat("lead", F.filter("turns", lambda t: t.again)).alias("repeated"),
        F.filter("turns", lambda t: ~t.again).alias("turns"),
    )


def _rendered(turn: Column) -> Column:
    text, model = escaped(turn.getField("text")), turn.getField("role") == MODEL
    return F.struct(
        F.when(model, F.lit("<s>"))
        .otherwise(F.concat(F.lit("<s>[INST]"), escaped(turn.getField("role")), F.lit("[/ROLE]")))
        .alias("head"),
        text.alias("body"),
        F.when(model, F.lit("</s>")).otherwise(F.lit("[/INST]")).alias("tail"),
        model.alias("model"),
    )


def formatted(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, repeated (turns), loss_spans.

    `loss_spans` lists (start, length) in code points of the texts to learn: those of the model's
    turns that the window does not repeat. `rows` has conv_id, turn, role, text; null roles and
    texts count as empty, null conversations as one; other columns are not read.
    """
    parts = spans(rows, budget, history).select(
        "conv_id",
        "window",
        F.size("repeated").alias("repeated"),
        F.transform(F.concat("repeated", "turns"), _rendered).alias("parts"),
    )

    def length(part: Column, *names: str) -> Column:
        return sum((F.length(part.getField(n)) for n in names), F.lit(0))

    sizes = F.transform("parts", lambda p: length(p, "head", "body", "tail"))
    parts = parts.withColumn("sizes", sizes)
    # Running lengths of at most budget / MARKS turns.
    offsets = F.aggregate(
        "sizes", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    )
    parts = parts.withColumn("offsets", offsets)

    def span(part: Column, i: Column) -> Column:
        return F.when(
            part.getField("model") & (i >= F.col("repeated")),
            F.struct(
                (F.get("offsets", i) + F.length(part.getField("head"))).alias("start"),
                F.length(part.getField("body")).alias("length"),
            ),
        )

    whole = F.transform(
        "parts", lambda p: F.concat(p.getField("head"), p.getField("body"), p.getField("tail"))
    )
    return parts.select(
        "conv_id",
        "window",
        F.array_join(whole, "").alias("formatted"),
        "repeated",
        F.filter(F.transform("parts", span), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parsed_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted window."""
    marks = F.filter(F.split(text, "<s>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        other = p.startswith("[INST]")
        inner = F.split(F.substr(p, F.lit(7), F.length(p) - 13), r"\[/ROLE\]")
        return F.struct(
            F.when(other, unescaped(F.get(inner, F.lit(0)))).otherwise(F.lit(MODEL)).alias("role"),
            unescaped(
                F.when(other, F.get(inner, F.lit(1))).otherwise(
                    F.substr(p, F.lit(1), F.length(p) - 4)
                )
            ).alias("text"),
        )

    return F.transform(marks, turn)


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, checksums of its turns and learned text."""
    fresh = F.slice("all", F.col("repeated") + 1, F.size("all"))
    lines = F.transform(
        fresh,
        lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n")),
    )
    learned = F.transform(
        "loss_spans",
        lambda s: unescaped(
            F.substr("formatted", s.getField("start") + 1, s.getField("length"))
        ),
    )
    parts = windows.withColumn("all", parsed_turns(F.col("formatted"))).select(
        "conv_id",
        F.struct(
            "window",
            F.size(fresh).alias("n"),
            F.array_join(lines, "").alias("turns"),
            F.array_join(learned, "").alias("loss"),
            F.length("formatted").alias("chars"),
        ).alias("p"),
    )
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))

    def total(field: str) -> Column:
        return F.aggregate(f"p.{field}", F.lit(0).cast("long"), lambda a, x: a + x)

    loss = F.array_join("p.loss", "")
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(F.array_join("p.turns", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


def conversation_digest(rows: DataFrame, **options: int) -> DataFrame:
    """`formatted` windows, written and read back."""
    return read_back(written(formatted(rows, **options), "formatted"))
