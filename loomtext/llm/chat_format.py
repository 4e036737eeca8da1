"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context and only that reply is trainable. Turns after the last assistant turn
come in one more example without any trainable text, so that nothing of the
conversation is lost.

Template of a turn: ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``.
Control strings inside roles and texts (those of this template and of other
common chat templates) are escaped: each backslash is doubled and a backslash
goes in after the first character of each control string. No control string is
left, and :func:`unescape` gives the text back exactly.

Everything is a projection over one row per conversation: one shuffle on the
conversation id, no Python on the executors. A conversation is a unit: its
longest example holds all of it, so memory follows the longest conversation,
never the number of conversations that share a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Control strings that are escaped, with the first character apart.
CONTROL = r"(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def expand_prefix_targets(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One example for each assistant turn, and one for turns after the last of them.

    Returns ``conv_id, example (from 0), n_turns (in this example), formatted,
    loss_start, loss_end (code points, end exclusive; null if nothing is
    trainable), is_last (the example with every turn of its conversation)``.

    Null role or text: empty. Turns go by ``turn`` (null first), equal turn
    numbers by role, then text; repeated rows are turns of their own. Rows of a
    null conversation id make one conversation. Role ``assistant`` is matched
    exactly. Further columns are not read. Empty input gives no rows.
    """
    rows = turns.select(
        turns[conv].alias("conv_id"),
        F.struct(
            turns[turn].alias("turn"),
            F.coalesce(turns[role], F.lit("")).alias("role"),
            F.coalesce(turns[text], F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    drawn = whole.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == ASSISTANT).alias("replies"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("sizes"),
        F.transform(
            "turns",
            lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(END)),
        ).alias("drawn"),
    )
    last = F.size("drawn") - 1
    at = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("replies", i) | (i == last))
    ex = drawn.select("conv_id", "drawn", "replies", "sizes", F.posexplode(at).alias("example", "i"))
    ex = ex.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        (F.col("i") + 1).cast("long").alias("n_turns"),
        F.array_join(F.slice("drawn", F.lit(1), F.col("i") + 1), "").alias("formatted"),
        F.when(F.get("replies", F.col("i")), F.get("sizes", F.col("i"))).alias("size"),
        (F.col("i") == last).alias("is_last"),
    )
    end = F.length("formatted") - len(END)
    return ex.select(
        "conv_id", "example", "n_turns", "formatted",
        F.when(F.col("size").isNotNull(), end - F.col("size")).cast("long").alias("loss_start"),
        F.when(F.col("size").isNotNull(), end).cast("long").alias("loss_end"),
        "is_last",
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example, unescaped: array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.locate(SEP, p)
        body = F.substring(p, at + len(SEP), F.length(p))
        return F.struct(
            unescape(F.substring(p, F.lit(len(START) + 1), at - len(START) - 1)).alias("role"),
            unescape(body).alias("text"),
        )

    return F.transform(parts, turn)


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """What the loss mask of an example covers, unescaped; null without a mask."""
    return unescape(F.substring(formatted, start.cast("int") + 1, (end - start).cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Read the examples back into one row per conversation (see the query ``op1_chat_format``).

    The examples of a conversation still lie together, so this adds no shuffle;
    only digests and the replies are gathered, never the formatted texts.
    """
    said = F.array_join(
        F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    small = examples.select(
        "conv_id", "example", "n_turns",
        F.when(F.col("is_last"), F.sha2(said, 256)).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("chars"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("reply"),
    )
    got = small.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return got.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
