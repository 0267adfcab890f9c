"""Chat formatting by prefix-target expansion (operator 9), in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns as context, then that reply,
whose text alone is under the loss mask. Turns after the last assistant turn, and conversations without
one, make an example without a target, so that no turn is lost.

Template of a turn: BEGIN role LF text END LF. Inside roles and texts a backslash is doubled and
"<|" becomes "<\\|", so that control strings in data never read as control; a line feed in a role becomes
"\\n". unescape() is the exact inverse.

Defined cases: a null text or role is an empty one; a null turn comes first, equal turns are ordered by
role, then text; repeated rows are turns of their own; a null conv_id is a conversation like any other;
an empty table gives no examples. Only conv_id, turn, role and text are read, other columns do not matter.
A conversation is one sequence and is held in one row; nothing larger is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """An "\\n" after an even number of backslashes is a line feed; then as in unescape()."""
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 1), n_turns, formatted, loss_begin, loss_length (code points of formatted), last."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit(BEGIN), escape_role(t.role), F.lit("\n"), escape(t.text), F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: F.when(t.role == TARGET_ROLE, F.length(escape(t.text)))).alias("target"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.get("target", i - 1).isNotNull() | (i == F.size("parts")))
    cut = parts.select("conv_id", "parts", "target", F.posexplode(ends).alias("example", "n_turns"))
    formatted = cut.select(
        "conv_id",
        (F.col("example") + 1).alias("example"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.array_join(F.slice("parts", F.lit(1), F.col("n_turns")), "").alias("formatted"),
        F.get("target", F.col("n_turns") - 1).alias("target"),
        (F.col("n_turns") == F.size("parts")).alias("last"),
    )
    return formatted.select(
        "conv_id", "example", "n_turns", "formatted",
        F.when(F.col("target").isNotNull(), F.length("formatted") - F.length(F.lit(END)) - F.col("target")).alias("loss_begin"),
        F.coalesce("target", F.lit(0)).alias("loss_length"),
        "last",
    )


def turns_of(formatted: Column) -> Column:
    """The turns of an example, read back: array of struct(role, text)."""
    found = F.split(formatted, BEGIN.replace("|", r"\|"))

    def turn(chunk: Column) -> Column:
        role = F.substring_index(chunk, "\n", 1)
        begin = F.length(role) + 2
        text = F.substring(chunk, begin, F.length(chunk) - begin + 1 - F.length(F.lit(END)))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(found, F.lit(2), F.size(found) - 1), turn)


def loss_text(formatted: Column, begin: Column, length: Column) -> Column:
    """The text under the loss mask, unescaped; null without a target."""
    return F.when(begin.isNotNull(), unescape(F.substring(formatted, begin + 1, length)))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns of the last, and every text under the mask."""
    turns = F.when(F.col("last"), turns_of(F.col("formatted")))
    each = formatted.select(
        "conv_id", "example",
        F.length("formatted").cast("long").alias("chars"),
        loss_text(F.col("formatted"), F.col("loss_begin"), F.col("loss_length")).alias("loss"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
    )
    held = each.groupBy("conv_id").agg(
        F.max(F.when(F.col("turns_sha256").isNotNull(), F.col("n_turns"))).alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.sum(F.coalesce(F.length("loss"), F.lit(0))).alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("losses", lambda x: F.coalesce(x.loss, F.lit(""))), "")
    return held.select("conv_id", "n_turns", "turns_sha256", "loss_chars", F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
