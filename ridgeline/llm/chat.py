"""Chat formatting with DataFrame functions alone: prefix-target expansion.

A conversation becomes one transcript of marked turns. Each assistant turn becomes an example of its own: all turns
before it are context, its reply is the only trainable part. An example holds the length of its context in the
transcript and the reply, so the examples of a conversation grow with its turns, not with their square; ``materialised``
spells an example out.

Texts and roles can't hold a marker: ``&``, ``<``, ``[`` and in roles line ends are escaped as ``&amp;``, ``&lt;``,
``&#91;`` and ``&#10;``, and ``restored`` undoes that.

Defined cases: turns are ordered by turn, then role and text (nulls first), so ties and repeated rows have one result;
a null text or role is empty; only the role ``assistant`` is trainable; a conversation without one has no example; rows
with a null conv_id are one conversation; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, REPLY, END = "<|turn|>", "<|reply|>", "<|end|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escaped(text: Column, more: tuple = ()) -> Column:
    for a, b in (*ESCAPES, *more):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def restored(text: Column, more: tuple = ()) -> Column:
    for a, b in reversed((*ESCAPES, *more)):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


LINE = (("\n", "&#10;"),)


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id and transcript; ``<|reply|>`` and ``<|end|>`` are the edges of the loss mask."""
    rows = conversations.select("conv_id", F.struct("turn", "role", "text").alias("t"))
    turns = F.sort_array(F.collect_list("t"))

    def said(x: Column) -> Column:
        role, text = (F.coalesce(x[c], F.lit("")) for c in ("role", "text"))
        mark = F.when(role == "assistant", F.lit(REPLY)).otherwise("")
        return F.concat(F.lit(TURN), escaped(role, LINE), F.lit("\n"), mark, escaped(text), F.lit(END))

    return rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.array_join(F.transform("turns", said), "").alias("transcript"))


def examples(formatted: DataFrame) -> DataFrame:
    """One row for each assistant turn: example (from 0), context_chars (before the reply in the transcript), target."""
    parts = formatted.select("conv_id", F.split("transcript", r"<\|reply\|>", -1).alias("parts"))
    # Part 0 is what precedes the first reply; every later part starts with a reply.
    ends = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("all")),
        lambda a, x: F.struct((a["n"] + F.length(x) + len(REPLY)).alias("n"), F.concat(a["all"], F.array((a["n"] + F.length(x) + len(REPLY)).cast("int"))).alias("all")),
        lambda a: a["all"],
    )
    each = parts.select("conv_id", ends.alias("ends"), "parts").select("conv_id", "ends", F.posexplode(F.expr("slice(parts, 2, size(parts))")).alias("example", "rest"))
    return each.select("conv_id", "example", F.element_at("ends", F.col("example") + 1).cast("long").alias("context_chars"), F.split_part("rest", F.lit(END), F.lit(1)).alias("target"))


def materialised(formatted: DataFrame) -> DataFrame:
    """Examples spelled out: conv_id, example, text, loss_from and loss_to (code points, end exclusive)."""
    e = examples(formatted)
    both = e.join(formatted.select(F.col("conv_id").alias("_conv"), "transcript"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    text = F.concat(F.expr("left(transcript, int(context_chars))"), F.col("target"), F.lit(END))
    return both.select("conv_id", "example", text.alias("text"), F.col("context_chars").alias("loss_from"), (F.col("context_chars") + F.length("target")).alias("loss_to"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns (role, text) read back from the transcripts."""
    pieces = F.expr(r"slice(split(transcript, '<\\|turn\\|>', -1), 2, size(split(transcript, '<\\|turn\\|>', -1)))")

    def turn(x: Column) -> Column:
        role = F.split_part(x, F.lit("\n"), F.lit(1))
        rest = F.substr(x, F.length(role) + 2)
        text = F.split_part(F.replace(rest, F.lit(REPLY), F.lit("")), F.lit(END), F.lit(1))
        return F.struct(restored(role, LINE).alias("role"), restored(text).alias("text"))

    return formatted.withColumn("turns", F.transform(pieces, turn))


def read_loss(formatted: DataFrame) -> DataFrame:
    """conv_id and the texts under the loss mask in order, read back from transcripts."""
    found = F.regexp_extract_all("transcript", F.lit(r"<\|reply\|>([^<]*)<\|end\|>"), F.lit(1))
    return formatted.select("conv_id", F.transform(found, lambda x: restored(x)).alias("replies"))
