"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only its text is trainable.  Turns after the last assistant turn
(or all turns, where there is none) make one example without a trainable part,
so no turn is lost.

Template, with a blank inside the marks::

    user       [INST] text [/INST]
    assistant   text </s>
    system     <<SYS>>\\n text \\n<</SYS>>\\n
    others     [ROLE] role \\n text [/ROLE]

Inside texts and roles a backslash is doubled and then one is put after the
first character of every control string, so no text can close or open a turn.
``unescape`` undoes it exactly.

Defined cases: null text counts as empty and a null role as the empty role;
turns of one number are ordered by role and text, so repeated rows are repeated
turns; rows without a conversation id make one conversation without id; an empty
table gives no example; very long texts are kept whole; only id, turn, role and
text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

# The template's control strings.
CONTROLS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
USER, ASSISTANT, SYSTEM, OTHER = ("[INST] ", " [/INST]"), (" ", " </s>"), ("<<SYS>>\n", "\n<</SYS>>\n"), ("[ROLE] ", " [/ROLE]")

_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|\[ROLE\] (?P<role>(?:\\.|[^\\\n])*)\n(?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>", re.DOTALL
)


def escape(text: Column) -> Column:
    safe = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        safe = F.replace(safe, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return safe


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _line_safe(role: Column) -> Column:
    """A role that ends at its line's end."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def _before(role: Column) -> Column:
    known = F.when(role == "user", F.lit(USER[0])).when(role == "assistant", F.lit(ASSISTANT[0])).when(role == "system", F.lit(SYSTEM[0]))
    return known.otherwise(F.concat(F.lit(OTHER[0]), _line_safe(role), F.lit("\n")))


def _after(role: Column) -> Column:
    known = F.when(role == "user", F.lit(USER[1])).when(role == "assistant", F.lit(ASSISTANT[1])).when(role == "system", F.lit(SYSTEM[1]))
    return known.otherwise(F.lit(OTHER[1]))


def examples(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, example, n_turns, formatted, loss_start, loss_end)``; the loss span counts characters, empty without a target.

    An example holds its whole context, so a conversation's turns meet in one
    row; examples are then built one at a time.
    """
    who, what = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    turns = conversations.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), who.alias("role"), what.alias("text"))
    marked = turns.select("conv_id", F.struct("turn", "role", "text", _before(F.col("role")).alias("before"), escape(F.col("text")).alias("safe"), _after(F.col("role")).alias("after")).alias("t"))
    whole = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    places = F.expr("filter(sequence(1, size(turns)), i -> element_at(turns, i).role = 'assistant' or i = size(turns))")
    one = whole.select("conv_id", "turns", F.posexplode(places).alias("example", "n_turns"))
    context = F.expr("array_join(transform(slice(turns, 1, n_turns - 1), t -> concat(t.before, t.safe, t.after)), '')")
    last = F.expr("element_at(turns, n_turns)")
    made = one.select("conv_id", "example", "n_turns", context.alias("context"), last.alias("last"))
    start = F.length("context") + F.length("last.before")
    trained = F.col("last.role") == "assistant"
    return made.select(
        "conv_id", F.col("example").cast("long").alias("example"), F.col("n_turns").cast("long").alias("n_turns"),
        F.concat("context", "last.before", "last.safe", "last.after").alias("formatted"),
        F.when(trained, start).otherwise(0).cast("long").alias("loss_start"), F.when(trained, start + F.length("last.safe")).otherwise(0).cast("long").alias("loss_end"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted example."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
        kind = m.lastgroup
        role = unescape(m["role"]) if kind == "other" else kind
        turns.append((role, unescape(m[kind])))
        at = m.end()
    return turns


def read_back(made: DataFrame) -> DataFrame:
    """``(conv_id, example, turns, loss)`` of examples: the parsed turns and the unescaped text under the loss mask."""
    schema = "turns array<struct<role string, text string>>, loss string"

    @F.pandas_udf(schema)
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for formatted, starts, ends in batches:
            turns = [[{"role": r, "text": t} for r, t in parse(f)] for f in formatted]
            loss = [unescape(f[s:e]) for f, s, e in zip(formatted, starts, ends)]
            yield pd.DataFrame({"turns": turns, "loss": loss})

    rows = made.withColumn("parsed", parsed("formatted", "loss_start", "loss_end"))
    return rows.select("conv_id", "example", "n_turns", F.length("formatted").alias("formatted_chars"), "parsed.turns", "parsed.loss")
