"""Chat formatting with relational expressions.

The turns of a conversation are collected as structs and sorted; runs of turns
with the same role become one message, whose texts are merged by an array
aggregation; the message parts are concatenated.  Everything is a Spark
expression: one shuffle by conversation, no Python code.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``; between the texts of a
merged message stands ``<|im_sep|>``, so the turns can be read back.  No text
can hold a control string: in every ``<|``, ``<\\|``, ``<\\\\|`` ... of a text one
backslash is added before the bar, and taken away again when it is read.  In a
role, backslashes, line feeds and ``<`` are written as ``\\b``, ``\\n`` and ``\\l``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: (as it is, as it is written), in the order of writing
ROLE_CODES = (("\\", "\\b"), ("\n", "\\n"), ("<", "\\l"))


def escape(text: Column) -> Column:
    """``text`` without any ``<|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _message_starts(turns: Column) -> Column:
    """Positions (from 0) of the turns whose role differs from the one before."""
    return _let(F.transform(turns, lambda t: t["role"]), lambda roles: F.filter(
        F.sequence(F.lit(0), F.size(roles) - 1),
        lambda i: (i == 0) | (F.get(roles, i) != F.get(roles, i - 1))))


def _messages(turns: Column) -> Column:
    """array<struct<role, texts>>: adjacent turns of one role together."""
    def cut(starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(turns)))
        return F.transform(F.arrays_zip(starts.alias("at"), ends.alias("end")), lambda m: F.struct(
            F.get(turns, m["at"])["role"].alias("role"),
            F.transform(F.slice(turns, m["at"] + 1, m["end"] - m["at"]), lambda t: t["text"]).alias("texts")))
    return _let(_message_starts(turns), cut)


def _part(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _parts(message: Column, loss_roles: tuple[str, ...]) -> Column:
    """The pieces of one message: heading, texts and what stands behind each."""
    plain = F.lit(False)
    last = F.size(message["texts"]) - 1
    head = F.concat(F.lit(START), escape_role(message["role"]), F.lit("\n"))
    body = F.flatten(F.transform(message["texts"], lambda t, i: F.array(
        _part(escape(t), message["role"].isin(*loss_roles)),
        _part(F.when(i == last, F.lit(END + "\n")).otherwise(F.lit(SEP)), plain))))
    return F.concat(F.array(_part(head, plain)), body)


def format_chat(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_messages, formatted, parts.

    ``parts`` is an array of (text, loss) whose texts, joined, are ``formatted``;
    loss marks the texts of ``loss_roles`` and nothing else.  Turns go by
    ``turn_col``, null turns last, ties by role and text; repeated rows are
    turns of their own.  Null texts and roles are empty, rows without a
    conversation id are one conversation, other columns are ignored, an empty
    table gives no rows.  A conversation is one value, so it has to be within
    Spark's 2 GB for a string; every step is linear in its length.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).isNull().alias("unnumbered"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turns = F.sort_array(F.collect_list(F.struct("unnumbered", "turn", "role", "text")))
    held = rows.groupBy("conv_id").agg(turns.alias("turns"))
    messages = held.select("conv_id", _let(F.col("turns"), _messages).alias("messages"))
    parts = F.flatten(F.transform("messages", lambda m: _parts(m, loss_roles)))
    return (messages.select("conv_id", F.size("messages").cast("long").alias("n_messages"), parts.alias("parts"))
            .select("conv_id", "n_messages", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"), "parts"))


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted conversation holds."""
    def turns(block: Column) -> Column:
        at = F.instr(block, "\n")
        role = unescape_role(F.substr(block, F.lit(1), at - 1))
        body = F.substr(block, at + 1, F.length(block) - at - F.lit(len(END) + 1))
        return _let(role, lambda r: F.transform(
            F.split(body, SEP.replace("|", r"\|")), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    blocks = F.split(formatted, START.replace("|", r"\|"))
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), turns))


def loss_text(parts: Column) -> Column:
    """All text under the loss mask, as it was before the format."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of the turns and the loss, read from :func:`format_chat`."""
    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (formatted.select("conv_id", "n_messages", F.length("formatted").cast("long").alias("formatted_chars"),
                             turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("parts")).alias("loss"))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(told).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"),
                    "formatted_chars", "n_messages"))
