import hashlib
import re

from conftest import SF
from pyspark.sql import functions as F

from streamscope.llm import chat
from streamscope.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[[INST]", "<<s>>", "[/ROLE]x", "$1\\n",
         "", None, "a\nb", "é😀 <s", "[/INST", "</s>" * 3, "\\<s>\\"]


def digest(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    want = {}
    for conv, turns in out.items():
        turns = [t[2:] for t in sorted(turns, key=lambda t: (t[0], t[1] or 0, t[2], t[3]))]
        loss = "".join(t for r, t in turns if r == "assistant")
        text = "".join(f"{r}\n{t}\n" for r, t in turns)
        want[conv] = (
            len(turns), hashlib.sha256(text.encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest(),
        )
    return want


def test_whole_table(spark):
    rows = [
        tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
        .select("conv_id", "turn", "role", "text").collect()
    ]
    rows += [(-1, 0, "user", NASTY[0]), (-1, 1, "assistant", NASTY[0])]
    got = {r[0]: tuple(r)[1:5] for r in QUERIES["op6_chat_format"](spark, SF).collect()}
    assert got == digest(rows)


def test_windows(spark):
    rows = [(1, 0, "system", "be good")]
    rows += [(1, n + 1, ("user", "assistant")[n % 2], f"w{n} " * (1 + n * 7 % 23)) for n in range(90)]
    rows += [(1, 91, "user", "long " * 300), (1, 92, "assistant", "end")]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = chat.formatted(frame, budget=120, history=30).orderBy("window").collect()
    assert len(out) > 10
    words = [len(t[3].split()) + 4 for t in rows]
    at = 0
    for w in out:
        turns = w.formatted.split("<s>")[1:]
        fresh = len(turns) - w.repeated
        inside = words[at : at + fresh]
        history = words[max(1, at - w.repeated + (w.window > 1)) : at]
        system = words[0] if w.window > 1 else 0
        assert sum(inside) + sum(history) + system <= 120 or fresh == 1
        assert sum(history) <= 30
        assert (w.window == 1) == (not w.repeated)
        if w.window > 1:
            assert turns[0] == "[INST]system[/ROLE]be good[/INST]"
        learned = [w.formatted[s.start : s.start + s.length] for s in w.loss_spans]
        assert learned == [t[3] for t in rows[at : at + fresh] if t[2] == "assistant"]
        at += fresh
    assert at == len(rows)
    assert any(w.repeated > 1 for w in out)
    assert {r[0]: tuple(r)[1:5] for r in chat.read_back(
        chat.formatted(frame, budget=120, history=30)).collect()} == digest(rows)


def test_history_is_whole_and_windows_are_full(spark):
    """With a long system turn, history comes from as many windows as it needs; otherwise windows
    hold most of the budget."""
    rows = [(1, 0, "system", "s " * 1700)]
    rows += [(1, n + 1, ("user", "assistant")[n % 2], f"w{n} " * 6) for n in range(200)]
    rows += [(2, n, ("user", "assistant")[n % 2], f"w{n} " * 30) for n in range(400)]
    out = chat.spans(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "window").collect()
    long = [w for w in out if w.conv_id == 1]
    assert all(sum(len(t.text.split()) + 4 for t in w.repeated[1:]) > 240 for w in long[4:])
    for w in long[1:]:
        again = [t.n for t in w.repeated[1:]]
        assert again == list(range(w.turns[0].n - len(again), w.turns[0].n))
    full = [sum(len(t.text.split()) + 4 for t in [*w.repeated, *w.turns]) for w in out if w.conv_id == 2]
    assert max(full) <= chat.BUDGET and min(full[:-1]) > 0.7 * chat.BUDGET


def test_formatted_chars_on_the_table(spark):
    """The sum of what the windows hold, written out plainly."""
    got = {r[0]: r.formatted_chars for r in QUERIES["op6_chat_format"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    want = {}
    for w in chat.spans(rows).collect():
        for t in [*w.repeated, *w.turns]:
            role, text = (escaped(x) for x in (t.role, t.text))
            size = len(f"<s>{text}</s>") if t.role == "assistant" else len(f"<s>[INST]{role}[/ROLE]{text}[/INST]")
            want[w.conv_id] = want.get(w.conv_id, 0) + size
    assert {k: v for k, v in got.items() if k != -1} == want


def escaped(text):
    return re.sub(r"([<\[])(?=/?s>|/?INST\]|/ROLE\])", r"\1\\", text.replace("\\", "\\\\"))


def test_edges(spark):
    rows = [(5, n, r, t) for n, t in enumerate(NASTY) for r in ("assistant", "user")]
    rows += [(6, n, t, "x") for n, t in enumerate(NASTY)]
    rows += [(None, None, None, None), (None, 1, "assistant", "a"), (7, 0, "system", None)]
    rows += [(8, 1, "user", "same"), (8, 1, "user", "same"), (9, 0, "assistant", "y " * 60_000)]
    rows += [(10, 0, "system", "s " * 5000), (10, 1, "user", "u"), (10, 2, "assistant", "v")]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame = frame.withColumns({c: F.lit(1) for c in ("window", "n", "start", "formatted", "p")})
    got = {r[0]: tuple(r)[1:5] for r in chat.conversation_digest(frame).collect()}
    assert got == digest(rows)
    assert chat.conversation_digest(frame.limit(0)).collect() == []
